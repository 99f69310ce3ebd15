"""Reviews: pairs and models against each other, coverage through aliases, windows with a tail, segments around hits, and items of the high band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals, labelmodel, reviews
from ..operators.shared import written
from .atoms import atoms_sql, with_atoms
from .label_queries import BAND, FAMILIES, FAMILY, WIDE, gates, votes
from .registry import Tables, query


@query("WITH d AS (SELECT doc_id, n_chars / 100.0::DOUBLE AS total FROM documents WHERE n_chars IS NOT NULL), s AS (SELECT doc_id, total, list_transform(range(0, CAST(ceil((total - 6.0) / 3.0) AS BIGINT)), lambda i: i * 3.0::DOUBLE) AS v FROM d WHERE total > 6.0), a AS (SELECT doc_id, total, unnest(CASE WHEN abs(v[-1] - (total - 6.0)) > 0.25 THEN list_append(v, total - 6.0) ELSE v END) AS start FROM s) SELECT doc_id, round(start, 6) AS start, round(least(total, start + 6.0), 6) AS \"end\" FROM a UNION ALL SELECT doc_id, 0.0, round(total, 6) FROM d WHERE total <= 6.0")
def tail_windows(t: Tables) -> DataFrame:
    """Windows of six seconds every three over media as long as the document, the last of which ends with it."""
    w = t.documents.where("n_chars IS NOT NULL").select("doc_id", F.explode(intervals.with_tail(F.col("n_chars") / 100.0, 6.0, 3.0)).alias("w"))
    return w.select("doc_id", F.round("w.start", 6).alias("start"), F.round("w.end", 6).alias("end"))


_GRID = {"first": "q", "second": "g", "third": "m", "first_and_second": "q AND g", "first_and_third": "q AND m", "second_and_third": "g AND m", "majority_2_of_3": "q::INT + g::INT + m::INT >= 2", "all_3": "q AND g AND m", "first_or_third": "q OR m", "any_3": "q OR g OR m"}


@query(f"WITH b AS (SELECT l.quality = 1 AS y, length(text) % 3 = 0 AS q, n_chars % 5 < 2 AS g, lang = 'en' AS m FROM labels l JOIN documents d ON d.doc_id = l.doc_id), r AS ({' UNION ALL '.join(f'SELECT {n!r} AS rule, y, {c} AS hit FROM b' for n, c in _GRID.items())}) SELECT rule, count(*) FILTER (hit AND y) AS tp, count(*) FILTER (hit AND NOT y) AS fp, count(*) FILTER (NOT hit AND y) AS fn, count(*) FILTER (NOT hit AND NOT y) AS tn FROM r GROUP BY rule")
def three_model_grid(t: Tables) -> DataFrame:
    """Ten rules over three models' answers, against the labels."""
    d = t.labels.join(t.documents, "doc_id")
    return reviews.rule_grid(d, F.length("text") % 3 == 0, F.col("n_chars") % 5 < 2, F.col("lang") == "en", F.col("quality") == 1)


@query("WITH s AS (SELECT conv_id, turn, text, turn * 17.0 AS a, turn * 17.0 + 9 AS b FROM conversations), h AS (SELECT conv_id, turn, a, b FROM s WHERE turn % 3 = 0) SELECT h.conv_id, h.turn, count(*) AS segments, string_agg(trim(s.text), ' ' ORDER BY s.turn) FILTER (trim(s.text) <> '') AS heard FROM h JOIN s ON s.conv_id = h.conv_id AND s.b >= h.a - 30 AND s.a <= h.b + 30 GROUP BY h.conv_id, h.turn")
def segments_near(t: Tables) -> DataFrame:
    """What was said within thirty seconds of a hit."""
    s = t.conversations.select("conv_id", "turn", "text", (F.col("turn") * 17.0).alias("a"), (F.col("turn") * 17.0 + 9).alias("b"))
    h = s.where("turn % 3 = 0").select("conv_id", F.col("turn").alias("hit"), (F.col("a") - 30).alias("lo"), (F.col("b") + 30).alias("hi"))
    j = intervals.overlap_join(h, s, ["conv_id"], ("lo", "hi"), ("a", "b"), 120.0)
    said = F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("x"))))  # of a window of some seventy seconds
    g = j.groupBy("conv_id", "hit").agg(F.count(F.lit(1)).alias("segments"), said.alias("s"))
    heard = F.array_join(F.transform(F.filter("s", lambda e: e["x"] != ""), lambda e: e["x"]), " ")
    return g.select("conv_id", F.col("hit").alias("turn"), "segments", F.nullif(heard, F.lit("")).alias("heard"))


JUDGED = {"choice": (["A", "B", "A", "cant_tell"], 101), "confidence": (["sure", "unsure", None], 103), "flag": (["blurred", None, "cut", None], 107)}
PAIR = {"positive_side": (["A", "B"], 109), "vlm_correct": ([True, None, False], 113)}


@query(f"""WITH p AS ({atoms_sql('documents', 'doc_id', PAIR)}), j AS (SELECT a.*, positive_side, vlm_correct FROM ({atoms_sql('documents', 'doc_id', JUDGED)}) a JOIN p ON p.doc_id = a.doc_id WHERE a.doc_id % 5 > 0), d AS (SELECT *, choice IN ('A', 'B') AS decided FROM j)
SELECT (SELECT count(*) FROM p) AS pairs, (SELECT count(vlm_correct) FROM p) AS both_saw, (SELECT count(*) FILTER (vlm_correct) FROM p) AS vlm_correct, count(*) FILTER (decided) AS decided, count(*) FILTER (choice = 'cant_tell') AS cant_tell, count(*) FILTER (decided AND choice = positive_side) AS correct, count(*) FILTER (decided AND confidence = 'sure') AS sure,
 count(*) FILTER (decided AND confidence = 'sure' AND choice = positive_side) AS sure_correct, count(*) FILTER (decided AND vlm_correct IS NOT NULL) AS decided_on_both, count(*) FILTER (decided AND vlm_correct IS NOT NULL AND choice = positive_side) AS human_correct, (SELECT string_agg(flag || '=' || n, ' ' ORDER BY flag) FROM (SELECT flag, count(*) AS n FROM j WHERE flag IS NOT NULL GROUP BY flag)) AS flags FROM d""")
def pair_head_to_head(t: Tables) -> DataFrame:
    """What judges and a model reach on the same pairs, the sure ones apart, and how often each flag was raised."""
    pairs = with_atoms(t.documents, "doc_id", PAIR).withColumnRenamed("doc_id", "pair_id")
    j = with_atoms(t.documents.where("doc_id % 5 > 0"), "doc_id", JUDGED).select(F.col("doc_id").alias("pair_id"), "choice", "confidence", F.array_compact(F.array("flag")).alias("flags"))
    out = reviews.scored_pairs(pairs, j)
    return out.withColumn("flags", F.array_join(F.transform("flags", lambda x: F.concat(x["f"], F.lit("="), x["n"].cast("string"))), " "))


_IDS = """l AS (SELECT 'd' || doc_id AS item_id, CASE WHEN doc_id % 3 = 0 THEN 'clip' || doc_id END AS alias, 'media' || doc_id % 97 AS path FROM documents), v AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'clip' ELSE 'd' END || doc_id AS item_id FROM documents WHERE doc_id % 4 < 3),
m AS (SELECT CASE WHEN doc_id % 6 = 0 THEN 'clip' ELSE 'd' END || doc_id AS item_id, CASE quality WHEN 1 THEN 'keep' ELSE 'drop' END AS decision FROM labels UNION ALL SELECT 'd' || doc_id, 'toxic' FROM labels WHERE toxic = 1), r1 AS (SELECT DISTINCT 'clip' || doc_id AS item_id FROM documents WHERE n_chars > 900 UNION SELECT 'd' || doc_id FROM documents WHERE n_chars < 500), r2 AS (SELECT 'clip' || doc_id AS item_id FROM documents WHERE lang = 'en'),
a AS (SELECT item_id, item_id AS id FROM l UNION SELECT item_id, alias FROM l WHERE alias IS NOT NULL),
e AS (SELECT l.*, EXISTS (SELECT 1 FROM a JOIN v ON v.item_id = a.id WHERE a.item_id = l.item_id) AS visual, coalesce((SELECT list_sort(list(decision)) FROM a JOIN m ON m.item_id = a.id WHERE a.item_id = l.item_id), []) AS decisions,
 list_filter([CASE WHEN l.item_id IN (SELECT item_id FROM r1) THEN 'own' END, CASE WHEN EXISTS (SELECT 1 FROM a JOIN r2 ON r2.item_id = a.id WHERE a.item_id = l.item_id) THEN 'any' END], lambda x: x IS NOT NULL) AS rules FROM l)"""


def _coverage(t: Tables) -> tuple[DataFrame, DataFrame]:
    name = lambda p, c="doc_id": F.concat(F.lit(p), F.col(c).cast("string"))
    d, n = t.documents, F.col("doc_id")
    labels = d.select(name("d").alias("item_id"), F.when(n % 3 == 0, name("clip")).alias("alias"), F.concat(F.lit("media"), (n % 97).cast("string")).alias("path"))
    visual = d.where("doc_id % 4 < 3").select(F.when(n % 2 == 0, name("clip")).otherwise(name("d")).alias("item_id"))
    given = t.labels.select(F.when(n % 6 == 0, name("clip")).otherwise(name("d")).alias("item_id"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("decision"))
    given = given.unionByName(t.labels.where("toxic = 1").select(name("d").alias("item_id"), F.lit("toxic").alias("decision")))
    own = d.where("n_chars > 900").select(name("clip").alias("item_id")).unionByName(d.where("n_chars < 500").select(name("d").alias("item_id")))
    found = written(reviews.enriched_labels(labels, visual, given, [("own", own, False), ("any", d.where("lang = 'en'").select(name("clip").alias("item_id")), True)]), "coverage")
    media = found.select("path", "item_id").unionByName(d.where("doc_id % 50 = 0").select(F.concat(F.lit("media"), (n % 97).cast("string")).alias("path"), name("gone").alias("item_id")))
    return found, media


@query(f"WITH {_IDS} SELECT item_id, alias, path, visual, decisions, rules, len(decisions) > 0 AS complete FROM e")
def label_coverage(t: Tables) -> DataFrame:
    """Labels with what covers them under their id or their alias: features, decisions of reviewers, and rules."""
    return _coverage(t)[0]


@query(f"WITH {_IDS}, x AS (SELECT path, item_id FROM l UNION ALL SELECT 'media' || doc_id % 97, 'gone' || doc_id FROM documents WHERE doc_id % 50 = 0) SELECT x.path, count(*) AS labels, count(e.item_id) AS linked, coalesce(bool_or(visual), false) AS visual, sum(coalesce(len(decisions), 0))::BIGINT AS judgments, coalesce(bool_and(len(decisions) > 0) FILTER (e.item_id IS NOT NULL), false) AS complete, list_sort(list_distinct(flatten(list(coalesce(rules, []))))) AS rules FROM x LEFT JOIN e ON e.item_id = x.item_id GROUP BY x.path")
def media_coverage(t: Tables) -> DataFrame:
    """Media rolled up over the labels they name: complete only if all known ones are."""
    found, media = _coverage(t)
    return reviews.media_of(found, media)


@query(f"WITH {FAMILY} SELECT item_id, {', '.join(f'max(vote) FILTER (family = {f!r}) AS {f}' for f in FAMILIES)} FROM fam GROUP BY item_id")
def family_vote_matrix(t: Tables) -> DataFrame:
    """Items by families; null where a family abstains."""
    c = labelmodel.collapse(votes(t))
    return c.groupBy("item_id").agg(*[F.max(F.when(F.col("family") == f, F.col("vote"))).alias(f) for f in FAMILIES])


@query(f"""WITH RECURSIVE {FAMILY}, {WIDE}, patterns AS MATERIALIZED (SELECT v, count(*) AS n FROM wide GROUP BY v), {labelmodel.fit_sql('patterns', FAMILIES)},
post AS (SELECT item_id, v, round({labelmodel.posterior_sql('v', FAMILIES)}, 6) AS posterior FROM wide, model)
SELECT item_id, posterior FROM (SELECT item_id, posterior, {BAND.format(failed='d.n_chars < 50 OR coalesce(l.toxic, 0) <> 0', unknown='l.toxic IS NULL')} AS band FROM post JOIN documents d ON d.doc_id = item_id LEFT JOIN labels l ON l.doc_id = item_id) WHERE band IN ('high_confidence_candidate', 'disagreement_manual_review')""")
def high_band_items(t: Tables) -> DataFrame:
    """Items of the high band or in dispute, with their posterior under the fitted model."""
    c = written(labelmodel.collapse(votes(t)), "votes")
    model = labelmodel.fit(c, FAMILIES, items=t.documents.select(F.col("doc_id").alias("item_id")))
    return labelmodel.score(c, gates(t), model).where(F.col("band").isin("high_confidence_candidate", "disagreement_manual_review")).select("item_id", "posterior")


ATOMS = {
    "actor_scope": (["interpersonal_actors", "public_group_or_institution", "none", None], 131), "behavior_scope": (["interpersonal_conduct", "shared_public_conduct", "role_or_appearance_convention", "skill"], 137),
    "expectation_scope": (["interpersonal_treatment", "shared_coordination", "role_obligation", "civic_duty", "preference"], 139), "concrete": (["yes", "yes", "no"], 149), "context": (["yes", "uncertain", "yes"], 151),
    "relation": (["exact", "broad", "wrong_but_relabelable", "wrong"], 157), "aligned": ([True, True, False, None], 163),
}
ALLOWED = {"actor_scope": ["interpersonal_actors", "public_group_or_institution"], "behavior_scope": ["interpersonal_conduct", "shared_public_conduct", "role_or_appearance_convention"], "expectation_scope": ["interpersonal_treatment", "shared_coordination", "role_obligation", "civic_duty"], "concrete": ["yes"], "context": ["yes"], "relation": ["exact", "broad", "wrong_but_relabelable"]}


@query(f"SELECT doc_id, coalesce({' AND '.join(f'{c} IN (' + ', '.join(repr(x) for x in v) + ')' for c, v in ALLOWED.items())} AND aligned, false) AS candidate FROM ({atoms_sql('documents', 'doc_id', ATOMS)})")
def social_candidates(t: Tables) -> DataFrame:
    """Whether all atoms of a social norm in a text are there and grounded; what isn't known counts against it."""
    ok = F.col("aligned")
    for c, v in ALLOWED.items():
        ok = ok & F.col(c).isin(v)
    return with_atoms(t.documents, "doc_id", ATOMS).select("doc_id", F.coalesce(ok, F.lit(False)).alias("candidate"))


TRIMS = [(7.0, 60.0), (2.5, 31.0), (-1.0, 20.0), (0.25, 12.0)]
_TRIMMED = " UNION ALL ".join(f"SELECT {i + 1} AS k, {a}::DOUBLE AS lo, {b}::DOUBLE AS hi" for i, (a, b) in enumerate(TRIMS))


@query(f"WITH RECURSIVE t AS ({_TRIMMED}), s AS (SELECT conv_id, turn, 0 AS k, (turn * 5.0)::DOUBLE AS a, (turn * 5.0 + 4)::DOUBLE AS b FROM conversations), c AS (SELECT conv_id, turn, k, a::DOUBLE AS a, b::DOUBLE AS b FROM s UNION ALL SELECT conv_id, turn, t.k, round(a - lo, 3)::DOUBLE, round(b - lo, 3)::DOUBLE FROM c JOIN t ON t.k = c.k + 1 WHERE b >= lo AND a <= hi AND t.k <= conv_id % 5) SELECT conv_id, turn, a AS start, b AS \"end\" FROM c WHERE k = conv_id % 5")
def rebased_chain(t: Tables) -> DataFrame:
    """Segments through as many trims as the conversation has been repaired by, none to four."""
    trims = F.slice(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in TRIMS]), 1, (F.col("conv_id") % 5).cast("int"))
    turn = F.col("turn")
    one = F.array(F.struct((turn * 5.0).alias("start"), (turn * 5.0 + 4).alias("end"), F.lit("").alias("text")))
    d = t.conversations.select("conv_id", "turn", F.explode(intervals.rebased(one, trims)).alias("s"))
    return d.select("conv_id", "turn", "s.start", "s.end")
