"""Labelling functions over the documents, the label model, and its evaluation against the labels table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.contracts import gate
from ..functions.hashing import split
from ..operators import labelmodel
from ..operators.shared import written
from .registry import Tables, query

#: lf_id, family, vote, SQL condition in the dialect of Spark and of the oracle.
LFS = [
    ("long_text", "length", 1, "n_chars >= 3000", "n_chars >= 3000"),
    ("short_text", "length", -1, "n_chars < 400", "n_chars < 400"),
    ("licence_line", "notice", -1, "text RLIKE '[Ll]icen[sc]e'", "regexp_matches(text, '[Ll]icen[sc]e')"),
    ("rights_line", "notice", -1, "text RLIKE 'rights reserved'", "regexp_matches(text, 'rights reserved')"),
    ("symbol_noise", "noise", -1, "text RLIKE '[%$#&*]{3}'", "regexp_matches(text, '[%$#&*]{3}')"),
    ("sentences", "noise", 1, "regexp_count(text, '[.] [A-Z]') >= 10", "len(regexp_extract_all(text, '[.] [A-Z]')) >= 10"),
    ("english", "language", 1, "lang = 'en'", "lang = 'en'"),
    ("function_words", "lexical", 1, "regexp_count(text, ' (the|of|and) ') >= 5", "len(regexp_extract_all(text, ' (the|of|and) ')) >= 5"),
    ("double_word", "lexical", -1, "text RLIKE ' the the '", "regexp_matches(text, ' the the ')"),
]
IDS = sorted(x[0] for x in LFS)
FAMILIES = sorted({x[1] for x in LFS})
VOTES = "votes AS (" + " UNION ALL ".join(f"SELECT doc_id AS item_id, '{i}' AS lf_id, '{f}' AS family, CAST({v} AS INTEGER) AS vote FROM documents WHERE {sql}" for i, f, v, _, sql in LFS) + ")"
FAMILY = VOTES + ", fam AS (SELECT item_id, family, min(vote) AS vote FROM votes GROUP BY item_id, family)"
GOLD = "gold AS (SELECT doc_id AS item_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS label FROM labels)"
#: A score in [0, 1] of each labelled document, for the evaluation operators.
SCORED = "s AS (SELECT l.doc_id, d.source, d.lang, l.quality = 1 AS y, CAST((CAST(d.n_chars AS BIGINT) * 7919) % 1009 AS DOUBLE) / 1009 AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
WILSON = "greatest(0.0, ({k} / {n} + 3.8416 / (2 * {n}) - 1.96 * sqrt(({k} / {n} * (1 - {k} / {n}) + 3.8416 / (4 * {n})) / {n})) / (1 + 3.8416 / {n}))"


def votes(t: Tables) -> DataFrame:
    """One pass over the documents: each row yields the votes of all functions that don't abstain."""
    entries = [F.when(F.expr(cond), F.struct(F.lit(i).alias("lf_id"), F.lit(f).alias("family"), F.lit(v).alias("vote"))) for i, f, v, cond, _ in LFS]
    return t.documents.select(F.col("doc_id").alias("item_id"), F.explode(F.array_compact(F.array(*entries))).alias("e")).select("item_id", "e.*")


def gold(t: Tables) -> DataFrame:
    return t.labels.select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("label"))


def scored(t: Tables) -> DataFrame:
    d = t.labels.join(t.documents.select("doc_id", "source", "lang", "n_chars"), "doc_id")
    return d.select("doc_id", "source", "lang", (F.col("quality") == 1).alias("y"), (((F.col("n_chars").cast("long") * 7919) % 1009).cast("double") / 1009).alias("p"))


@query(f"WITH {VOTES} SELECT item_id, lf_id, family, vote FROM votes")
def lf_votes_long(t: Tables) -> DataFrame:
    return votes(t)


@query(f"WITH {FAMILY} SELECT item_id, family, vote FROM fam")
def family_collapse(t: Tables) -> DataFrame:
    return labelmodel.collapse(votes(t))


@query(f"WITH {FAMILY} SELECT item_id, CAST(sign(sum(vote)) AS BIGINT) AS majority FROM fam GROUP BY item_id")
def majority_vote(t: Tables) -> DataFrame:
    return labelmodel.majority(labelmodel.collapse(votes(t)))


def gates(t: Tables) -> DataFrame:
    """Eligible documents have 50 characters or more; without a label it's unknown whether they are toxic."""
    d = t.documents.join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    g = gate({"long_enough": F.col("n_chars") >= 50, "not_toxic": F.col("toxic") == 0})
    return d.select(F.col("doc_id").alias("item_id"), *[c.alias(n) for n, c in g.items()])


FIXED = labelmodel.Model(FAMILIES, 0.4, {f: 0.6 + 0.05 * i for i, f in enumerate(FAMILIES)})
_LOG = "sum(CASE WHEN vote = 1 THEN {a} WHEN vote = -1 THEN {b} ELSE 0 END)"


def _posterior_sql() -> str:
    acc = "CASE family " + " ".join(f"WHEN '{f}' THEN {a!r}" for f, a in FIXED.accuracy.items()) + " END"
    pos = f"ln({FIXED.prior!r}) + coalesce(sum(CASE WHEN vote = 1 THEN ln({acc}) WHEN vote = -1 THEN ln(1 - {acc}) ELSE 0 END), 0)"
    neg = f"ln(1 - {FIXED.prior!r}) + coalesce(sum(CASE WHEN vote = -1 THEN ln({acc}) WHEN vote = 1 THEN ln(1 - {acc}) ELSE 0 END), 0)"
    return f"""{FAMILY}, post AS (SELECT d.doc_id AS item_id, round(1 / (1 + exp(({neg}) - ({pos}))), 6) AS posterior, bool_or(coalesce(vote = 1, false)) AS plus, bool_or(coalesce(vote = -1, false)) AS minus, count(vote) AS n
    FROM documents d LEFT JOIN fam ON d.doc_id = fam.item_id GROUP BY d.doc_id)"""


@query(f"WITH {_posterior_sql()} SELECT item_id, posterior FROM post")
def posterior_fixed_params(t: Tables) -> DataFrame:
    return labelmodel.score(labelmodel.collapse(votes(t)), gates(t), FIXED).select("item_id", "posterior")


@query(f"""WITH {_posterior_sql()}, b AS (SELECT CASE WHEN d.n_chars < 50 OR coalesce(l.toxic, 0) <> 0 THEN 'gate_failed_review' WHEN post.n = 0 OR l.toxic IS NULL THEN 'insufficient_evidence_abstain'
 WHEN plus AND minus THEN 'disagreement_manual_review' WHEN posterior >= 0.9 AND plus THEN 'high_confidence_candidate' WHEN posterior >= 0.9 THEN 'insufficient_evidence_abstain' WHEN posterior <= 0.1 THEN 'likely_failure_or_reroute' ELSE 'insufficient_evidence_abstain' END AS band
 FROM post JOIN documents d ON d.doc_id = post.item_id LEFT JOIN labels l ON l.doc_id = d.doc_id) SELECT band, count(*) AS n FROM b GROUP BY band""")
def shadow_band_counts(t: Tables) -> DataFrame:
    return labelmodel.score(labelmodel.collapse(votes(t)), gates(t), FIXED).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


#: Votes of the families of every document, and the counts of their patterns, for the fit in SQL.
WIDE = f"wide AS (SELECT d.doc_id AS item_id, [{', '.join(f'coalesce(max(vote) FILTER (family = {f!r}), 0)' for f in FAMILIES)}] AS v FROM documents d LEFT JOIN fam ON fam.item_id = d.doc_id GROUP BY d.doc_id)"
BAND = """CASE WHEN {failed} THEN 'gate_failed_review' WHEN list_count(list_filter(v, lambda x: x <> 0)) = 0 OR {unknown} THEN 'insufficient_evidence_abstain'
 WHEN list_contains(v, 1) AND list_contains(v, -1) THEN 'disagreement_manual_review' WHEN posterior >= 0.9 AND list_contains(v, 1) THEN 'high_confidence_candidate'
 WHEN posterior >= 0.9 THEN 'insufficient_evidence_abstain' WHEN posterior <= 0.1 THEN 'likely_failure_or_reroute' ELSE 'insufficient_evidence_abstain' END"""


@query(f"""WITH RECURSIVE {FAMILY}, {WIDE}, patterns AS MATERIALIZED (SELECT v, count(*) AS n FROM wide GROUP BY v), {labelmodel.fit_sql('patterns', FAMILIES)},
post AS (SELECT item_id, v, round({labelmodel.posterior_sql('v', FAMILIES)}, 6) AS posterior FROM wide, model)
SELECT item_id, posterior, {BAND.format(failed='d.n_chars < 50 OR coalesce(l.toxic, 0) <> 0', unknown='l.toxic IS NULL')} AS band, CAST(list_count(list_filter(v, lambda x: x <> 0)) AS INTEGER) AS families, CAST(NULL AS INTEGER) AS acceptance_label, false AS delete_media
FROM post JOIN documents d ON d.doc_id = item_id LEFT JOIN labels l ON l.doc_id = item_id""")
def flagship_shadow_rank(t: Tables) -> DataFrame:
    """Votes, family collapse, the fitted label model, gates, bands, and a rank by posterior with a total order. The collapsed votes
    are written once; fit and scores read them."""
    collapsed = written(labelmodel.collapse(votes(t)), "votes")
    model = labelmodel.fit(collapsed, FAMILIES, items=t.documents.select(F.col("doc_id").alias("item_id")))
    out = labelmodel.score(collapsed, gates(t), model)
    return out.select("item_id", "posterior", "band", F.size("family_votes").alias("families"), F.lit(None).cast("int").alias("acceptance_label"), F.lit(False).alias("delete_media")).orderBy(F.desc("posterior"), "item_id")


@query(f"""WITH {VOTES}, n AS (SELECT count(*) AS n FROM documents) SELECT lf_id, family, count(*) FILTER (vote = 1) AS positive, count(*) FILTER (vote = -1) AS negative,
 CAST(max(n.n) - count(*) AS BIGINT) AS abstain, round(count(*)::DOUBLE / max(n.n), 6) AS coverage FROM votes, n GROUP BY lf_id, family""")
def lf_coverage_polarity(t: Tables) -> DataFrame:
    return labelmodel.coverage(votes(t), t.documents.count())


@query(f"""WITH {VOTES}, n AS (SELECT count(*)::DOUBLE AS n FROM documents), ids AS (SELECT unnest({IDS!r}) AS lf),
 p AS (SELECT a.lf AS lf_a, b.lf AS lf_b FROM ids a JOIN ids b ON a.lf < b.lf),
 v AS (SELECT p.lf_a, p.lf_b, coalesce(x.vote, 0) AS x, coalesce(y.vote, 0) AS y FROM p CROSS JOIN documents d LEFT JOIN votes x ON x.item_id = d.doc_id AND x.lf_id = p.lf_a LEFT JOIN votes y ON y.item_id = d.doc_id AND y.lf_id = p.lf_b)
 SELECT lf_a, lf_b, round(count(*) FILTER (x <> 0 AND y <> 0) / max(n.n), 6) AS overlap, count(*) FILTER (x <> 0 AND x = y) AS agree, count(*) FILTER (x <> 0 AND y <> 0 AND x <> y) AS conflict,
 round(CASE WHEN count(*) FILTER (x <> 0 AND y <> 0) > 0 THEN count(*) FILTER (x <> 0 AND y <> 0 AND x <> y)::DOUBLE / count(*) FILTER (x <> 0 AND y <> 0) END, 6) AS conflict_rate,
 round(CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END, 6) AS correlation FROM v, n GROUP BY lf_a, lf_b""")
def lf_pairwise(t: Tables) -> DataFrame:
    docs = t.documents
    full = votes(t).unionByName(docs.select(F.col("doc_id").alias("item_id"), F.lit("-").alias("lf_id"), F.lit("-").alias("family"), F.lit(0).alias("vote")))
    return labelmodel.pairwise(full, IDS, docs.count())


@query(f"""WITH {VOTES}, {GOLD}, ids AS (SELECT unnest({IDS!r}) AS lf_id), g AS (SELECT ids.lf_id, gold.label, coalesce(v.vote, 0) AS vote FROM gold CROSS JOIN ids LEFT JOIN votes v ON v.item_id = gold.item_id AND v.lf_id = ids.lf_id),
 c AS (SELECT lf_id, count(*) FILTER (vote = 1 AND label = 1) AS tp, count(*) FILTER (vote = 1 AND label = -1) AS fp, count(*) FILTER (vote <> 1 AND label = 1) AS fn FROM g GROUP BY lf_id)
 SELECT lf_id, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 6) AS recall,
 round(CASE WHEN tp + fp > 0 THEN {WILSON.format(k='tp::DOUBLE', n='(tp + fp)::DOUBLE')} END, 6) AS wilson_lower FROM c""")
def lf_gold_precision_wilson(t: Tables) -> DataFrame:
    lfs = t.spark.createDataFrame([(i,) for i in IDS], "lf_id string")
    return labelmodel.against_gold(votes(t), gold(t), lfs)


@query(f"""WITH {SCORED}, b AS (SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(p) AS mean_p, CAST(sum(CASE WHEN y THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM s GROUP BY 1)
 SELECT bin, n, round(mean_p, 6) AS mean_p, positives, round(positives::DOUBLE / n, 6) AS rate, round({WILSON.format(k='positives::DOUBLE', n='n::DOUBLE')}, 6) AS wilson_lower,
 round(n::DOUBLE / sum(n) OVER () * abs(mean_p - positives::DOUBLE / n), 6) AS ece_part FROM b""")
def calibration_bins_ece(t: Tables) -> DataFrame:
    return stats.calibration(scored(t), "p", "y")


_AUC = """r AS (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER (PARTITION BY {key} p) - 1) / 2.0 AS rk FROM s),
 a AS (SELECT {key} count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, sum(rk) FILTER (y) AS sr FROM r {group})"""


@query(f"WITH {SCORED}, " + _AUC.format(part="", key="", group="") + " SELECT positives, negatives, round((sr - positives * (positives + 1) / 2.0) / (positives * negatives), 6) AS auroc FROM a")
def auroc_overall(t: Tables) -> DataFrame:
    return stats.auroc(scored(t), "p", "y")


@query(f"WITH {SCORED}, " + _AUC.format(part="PARTITION BY source", key="source,", group="GROUP BY source") + " SELECT source, positives, negatives, round(CASE WHEN positives * negatives > 0 THEN (sr - positives * (positives + 1) / 2.0) / (positives * negatives) END, 6) AS auroc FROM a WHERE positives + negatives >= 20")
def auroc_by_slice(t: Tables) -> DataFrame:
    return stats.auroc(scored(t), "p", "y", ["source"], 20)


@query(f"WITH {SCORED} SELECT lang, count(*) AS n, round(count(*) FILTER ((p >= 0.5) = y)::DOUBLE / count(*), 6) AS accuracy FROM s GROUP BY lang")
def accuracy_at_threshold(t: Tables) -> DataFrame:
    return scored(t).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if((F.col("p") >= 0.5) == F.col("y")) / F.count(F.lit(1)), 6).alias("accuracy"))


@query(f"""WITH {SCORED}, c AS (SELECT source, count(*) FILTER (p >= 0.5 AND y) AS tp, count(*) FILTER (p >= 0.5 AND NOT y) AS fp, count(*) FILTER (p < 0.5 AND y) AS fn, count(*) FILTER (p < 0.5 AND NOT y) AS tn FROM s GROUP BY source),
 m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS re, CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END AS sp FROM c)
 SELECT source, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(sp, 6) AS specificity, round((re + sp) / 2, 6) AS balanced_accuracy, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM m""")
def balanced_metrics(t: Tables) -> DataFrame:
    c = scored(t).groupBy("source").agg(*[v.alias(k) for k, v in stats.confusion(F.col("p") >= 0.5, F.col("y")).items()])
    r = stats.rates(c, 0.0)
    return r.select("source", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "specificity", "balanced_accuracy", "f1")])


@query(f"""WITH {SCORED}, g AS (SELECT p, count(*) FILTER (y) AS k, count(*) AS n FROM s GROUP BY p), c AS (SELECT p, CAST(sum(k) OVER (ORDER BY p DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY p DESC) AS BIGINT) AS selected, sum(k) OVER () AS pos FROM g)
 SELECT p AS threshold, tp, selected, round(tp::DOUBLE / selected, 6) AS precision, round(tp::DOUBLE / pos, 6) AS recall FROM c WHERE tp::DOUBLE / selected >= 0.5 ORDER BY tp DESC, p DESC LIMIT 1""")
def best_threshold_precision_floor(t: Tables) -> DataFrame:
    return stats.best_threshold(scored(t), "p", "y", 0.5)


@query(f"""WITH {SCORED}, w AS (SELECT s.*, length(d.text) % 3 AS k, d.n_chars % 5 AS j FROM s JOIN documents d ON s.doc_id = d.doc_id), r AS (SELECT unnest([1, 2, 3, 4]) AS rule),
 x AS (SELECT rule, y, CASE rule WHEN 1 THEN k = 0 WHEN 2 THEN j < 2 WHEN 3 THEN k = 0 AND j < 2 ELSE k = 0 OR j < 2 END AS hit FROM w CROSS JOIN r)
 SELECT rule, count(*) FILTER (hit AND y) AS tp, count(*) FILTER (hit AND NOT y) AS fp, count(*) FILTER (NOT hit AND y) AS fn, count(*) FILTER (NOT hit AND NOT y) AS tn FROM x GROUP BY rule""")
def ensemble_rule_grid(t: Tables) -> DataFrame:
    d = scored(t).join(t.documents.select("doc_id", (F.length("text") % 3 == 0).alias("k"), (F.col("n_chars") % 5 < 2).alias("j")), "doc_id")
    k, j = F.col("k"), F.col("j")
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), h.alias("hit")) for i, h in enumerate((k, j, k & j, k | j), 1)])
    e = d.select("y", F.explode(rules).alias("r")).select("y", "r.*")
    return e.groupBy("rule").agg(*[v.alias(n) for n, v in stats.confusion(F.col("hit"), F.col("y")).items()])


@query(f"""WITH {VOTES}, {GOLD}, sp AS (SELECT doc_id, CASE WHEN f < 0.6 THEN 'train' WHEN f < 0.8 THEN 'calibration' ELSE 'test' END AS part FROM (SELECT doc_id, ('0x' || substr(sha256('label_model_v1_split:' || source), 1, 12))::BIGINT / 281474976710656.0 AS f FROM documents)),
 ids AS (SELECT unnest({IDS!r}) AS lf_id), g AS (SELECT ids.lf_id, gold.label, coalesce(v.vote, 0) AS vote FROM gold JOIN sp ON sp.doc_id = gold.item_id AND sp.part = 'train' CROSS JOIN ids LEFT JOIN votes v ON v.item_id = gold.item_id AND v.lf_id = ids.lf_id),
 c AS (SELECT lf_id, count(*) FILTER (vote = 1 AND label = 1) AS tp, count(*) FILTER (vote = 1 AND label = -1) AS fp, count(*) FILTER (vote <> 1 AND label = 1) AS fn FROM g GROUP BY lf_id)
 SELECT lf_id, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c WHERE tp > 0 ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC, lf_id LIMIT 1""")
def strongest_single_lf(t: Tables) -> DataFrame:
    """The best function by F1 on the training side of the source-disjoint split."""
    train = t.documents.where(split("label_model_v1_split", F.col("source")) == "train").select(F.col("doc_id").alias("item_id"))
    lfs = t.spark.createDataFrame([(i,) for i in IDS], "lf_id string")
    c = labelmodel.against_gold(votes(t), gold(t).join(train, "item_id"), lfs).where("tp > 0")
    return c.withColumn("__f", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).orderBy(F.desc("__f"), "lf_id").limit(1).select("lf_id", F.round("__f", 6).alias("f1"))


@query()
def leakage_probe_auroc(t: Tables) -> DataFrame:
    """Can a bag of words tell the label? Hashed words, logistic regression, AUROC on held-out sources."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Normalizer

    d = t.labels.join(t.documents.select("doc_id", "source", "text"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), split("probe", F.col("source")).alias("part"), F.slice(F.split(F.lower("text"), r"\s+"), 1, 400).alias("words"))
    x = Normalizer(inputCol="tf", outputCol="features").transform(HashingTF(numFeatures=4096, inputCol="words", outputCol="tf").transform(d))
    model = LogisticRegression(maxIter=20, regParam=1e-3).fit(x.where("part <> 'test'"))
    from pyspark.ml.functions import vector_to_array

    out = model.transform(x.where("part = 'test'")).select((F.col("label") == 1).alias("y"), F.round(vector_to_array("probability")[1], 6).alias("p"))
    return stats.auroc(out, "p", "y")
