"""Audits over windows, turns, pairs and ledgers: roll-ups, ensembles, nearest rows, duplicates, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import json_walk, text, vectors
from ..operators import intervals, relational
from .atoms import atoms_sql, pick, pick_sql, with_atoms
from .registry import Tables, query

def n_rows() -> Column:
    return F.count(F.lit(1))

# --- windows of a parent -----------------------------------------------------------------------------

WIN = {"first": ([True, False, False, None], 31), "second": ([True, True, False, None], 37), "third": ([False, False, True], 41), "error": ([None] * 9 + ["timeout"], 43)}
_WIN = f"w AS ({atoms_sql('documents', 'doc_id', WIN, 'doc_id // 5 AS parent')})"


def _windows(t: Tables) -> DataFrame:
    return with_atoms(t.documents, "doc_id", WIN).withColumn("parent", F.expr("doc_id div 5"))


@query(f"WITH {_WIN} SELECT parent, count(*) AS expected, count(*) FILTER (error IS NULL) AS returned, count(*) FILTER (error IS NULL AND first IS NOT NULL) AS valid, coalesce(bool_or(first) FILTER (error IS NULL), false) AS any_positive, coalesce(list_sort(list(doc_id) FILTER (error IS NULL AND first)), []) AS positives FROM w GROUP BY parent")
def window_parent_rollup(t: Tables) -> DataFrame:
    """Windows of each parent that were expected, returned and valid, and those that are positive."""
    ok = F.col("error").isNull()
    hit = ok & F.coalesce("first", F.lit(False))
    return _windows(t).groupBy("parent").agg(n_rows().alias("expected"), F.count_if(ok).alias("returned"), F.count_if(ok & F.col("first").isNotNull()).alias("valid"), F.bool_or(hit).alias("any_positive"), F.array_sort(F.collect_list(F.when(hit, F.col("doc_id")))).alias("positives"))


@query(f"WITH {_WIN}, h AS (SELECT parent, doc_id, coalesce(first, false) AS hit FROM w), g AS (SELECT parent, doc_id - row_number() OVER (PARTITION BY parent ORDER BY doc_id) AS k FROM h WHERE hit), r AS (SELECT parent, max(n) AS run FROM (SELECT parent, k, count(*) AS n FROM g GROUP BY parent, k) GROUP BY parent) SELECT h.parent, count(*) FILTER (hit) >= 2 AS at_least_two, coalesce(max(run), 0) AS longest, coalesce(max(run), 0) >= 2 AS run_of_two FROM h LEFT JOIN r ON h.parent = r.parent GROUP BY h.parent")
def window_run_rules(t: Tables) -> DataFrame:
    """Two positive windows or more, and the longest run of consecutive ones."""
    d = _windows(t).withColumn("hit", F.coalesce("first", F.lit(False)))
    run = intervals.longest_run(d.where("hit").select("parent", "doc_id"), ["parent"], "doc_id")
    out = d.groupBy("parent").agg((F.count_if("hit") >= 2).alias("at_least_two")).join(run, "parent", "left")
    longest = F.coalesce("longest_run", F.lit(0))
    return out.select("parent", "at_least_two", longest.alias("longest"), (longest >= 2).alias("run_of_two"))


@query(f"WITH {_WIN}, l AS (SELECT doc_id, first FROM w WHERE first IS NOT NULL), r AS (SELECT doc_id, second FROM w WHERE second IS NOT NULL) SELECT parent, count(*) AS both, bool_or(first AND second) AS any_and, bool_or(first OR second) AS any_or, count(*) FILTER (first AND second) >= 2 AS two_and FROM w JOIN l USING (doc_id) JOIN r USING (doc_id) GROUP BY parent".replace("bool_or(first AND", "bool_or(l.first AND").replace("AND second)", "AND r.second)").replace("bool_or(first OR second)", "bool_or(l.first OR r.second)").replace("FILTER (first", "FILTER (l.first"))
def window_ensembles(t: Tables) -> DataFrame:
    """Windows that two models and the manifest hold, with AND and OR of the models by parent: three tables on one key."""
    d = _windows(t)
    left, right = d.where("first IS NOT NULL").select("doc_id", "first"), d.where("second IS NOT NULL").select("doc_id", "second")
    j = d.select("doc_id", "parent").join(left, "doc_id").join(right, "doc_id")
    both, either = F.col("first") & F.col("second"), F.col("first") | F.col("second")
    return j.groupBy("parent").agg(n_rows().alias("both"), F.bool_or(both).alias("any_and"), F.bool_or(either).alias("any_or"), (F.count_if(both) >= 2).alias("two_and"))


NORMS = ["queue manners", "road rage", "anger", "police order", "theft", "fire hazard", "assault", None, "cooking"]
_CATEGORY = "CASE WHEN n = '' THEN 'missing' " + " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{c}'" for c, p in text.NORM_CATEGORIES) + " ELSE 'other_unmapped' END"


@query(f"""WITH d AS (SELECT doc_id // 4 AS item, trim(regexp_replace(lower(coalesce({pick_sql('doc_id', NORMS, 47)}, '')), '\\s+', ' ', 'g')) AS n FROM documents), c AS (SELECT item, {_CATEGORY} AS c FROM d)
SELECT item, list_extract([{', '.join(repr(p) for p in text.NORM_PRIORITY)}], min(list_position([{', '.join(repr(p) for p in text.NORM_PRIORITY)}], c))) AS primary_category, count(DISTINCT c) AS categories, bool_and(c IN ('affect_only', 'missing')) AS affect_only FROM c GROUP BY item""")
def norm_category_rollup(t: Tables) -> DataFrame:
    """Each item's most social category among its reactions."""
    c = text.norm_category(pick("doc_id", NORMS, 47))
    order = F.array(*[F.lit(p) for p in text.NORM_PRIORITY])
    d = t.documents.select(F.expr("doc_id div 4").alias("item"), c.alias("c"))
    return d.groupBy("item").agg(F.min(F.array_position(order, F.col("c"))).alias("p"), F.countDistinct("c").alias("categories"), F.bool_and(F.col("c").isin("affect_only", "missing")).alias("affect_only")).select("item", F.element_at(order, F.col("p").cast("int")).alias("primary_category"), "categories", "affect_only")


@query("WITH c AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s, value FROM events), x AS (SELECT event_type, unnest([s - s % 55, s - s % 55 + 55]) AS chunk, s, value FROM c) SELECT event_type, s AS second, max(value) AS peak FROM x WHERE s BETWEEN chunk AND chunk + 60 GROUP BY event_type, s")
def chunk_second_peaks(t: Tables) -> DataFrame:
    """The peak of each second over chunks of 60 s that overlap by 5: what two chunks saw is one second."""
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    d = t.events.select("event_type", s.alias("second"), "value").withColumn("chunk", F.explode(F.array(F.col("second") - F.col("second") % 55, F.col("second") - F.col("second") % 55 + 55)))
    return d.where(F.col("second").between(F.col("chunk"), F.col("chunk") + 60)).groupBy("event_type", "second").agg(F.max("value").alias("peak"))


# --- turns ---------------------------------------------------------------------------------------------

_TURN = "s AS (SELECT user_id, event_id, event_type, value, epoch(ts) / 600 AS a, epoch(ts) / 600 + value / 50 AS b FROM events WHERE user_id IS NOT NULL)"


def _turns(t: Tables) -> DataFrame:
    a = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 600
    return t.events.where("user_id IS NOT NULL").select("user_id", "event_id", "event_type", "value", a.alias("a"), (a + F.col("value") / 50).alias("b"))


@query(f"""WITH {_TURN}, l AS (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY a, event_id) AS before FROM s) SELECT event_id, round(greatest(-2.0, least(10.0, a - coalesce(before, 0))), 6) AS latency, round(greatest(0.0, b - a), 6) AS duration, (SELECT count(*) FROM s p WHERE p.user_id = l.user_id AND (p.a < l.a OR p.a = l.a AND p.event_id < l.event_id) AND p.b >= l.a - 3) AS preceding FROM l""")
def turn_structure(t: Tables) -> DataFrame:
    """Latency after the turn before (kept to -2 .. 10 s), duration, and how many earlier turns end within the last 3 s or later."""
    d = _turns(t)
    w = W.partitionBy("user_id").orderBy("a", "event_id")
    own = d.withColumn("before", F.lag("b").over(w))
    # an earlier turn lasts its value: none ends within 3 s that began before the longest turn and 3 s
    p = d.select("user_id", F.col("event_id").alias("pe"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    near = intervals.overlap_join(d.select("user_id", "event_id", "a", F.col("a").alias("a2")), p.withColumn("pc", F.greatest("pa", "pb") + 3), ["user_id"], ("a", "a2"), ("pa", "pc"), bucket=10.0)
    near = near.where((F.col("pb") >= F.col("a") - 3) & ((F.col("pa") < F.col("a")) | (F.col("pa") == F.col("a")) & (F.col("pe") < F.col("event_id"))))
    k = near.groupBy("event_id").agg(n_rows().alias("preceding"))
    out = own.join(k, "event_id", "left")
    latency = F.greatest(F.lit(-2.0), F.least(F.lit(10.0), F.col("a") - F.coalesce("before", F.lit(0))))
    return out.select("event_id", F.round(latency, 6).alias("latency"), F.round(F.greatest(F.lit(0.0), F.col("b") - F.col("a")), 6).alias("duration"), F.coalesce("preceding", F.lit(0)).alias("preceding"))


@query(f"""WITH {_TURN}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) AS k FROM s) SELECT x.event_id, (SELECT p.event_type FROM r p WHERE p.user_id = x.user_id AND p.k < x.k AND p.event_type <> 'view' ORDER BY p.k DESC LIMIT 1) AS previous,
(SELECT count(DISTINCT p.event_type) FROM r p WHERE p.user_id = x.user_id AND p.k < x.k) AS distinct_before, coalesce((SELECT p.b > x.a FROM r p WHERE p.user_id = x.user_id AND p.k = x.k - 1), false) AS overlaps FROM r x""")
def speaker_context(t: Tables) -> DataFrame:
    """The last labelled speaker before a turn (view is unlabelled), how many distinct ones spoke, and whether it talks over the turn before."""
    w = W.partitionBy("user_id").orderBy("a", "event_id")
    back = w.rowsBetween(W.unboundedPreceding, -1)
    d = _turns(t)
    return d.select("event_id", F.last(F.when(F.col("event_type") != "view", F.col("event_type")), ignorenulls=True).over(back).alias("previous"), F.size(F.collect_set("event_type").over(back)).cast("long").alias("distinct_before"), F.coalesce(F.lag("b").over(w) > F.col("a"), F.lit(False)).alias("overlaps"))


@query(f"""WITH {_TURN}, m AS (SELECT * FROM s WHERE event_type = 'error'), o AS (SELECT * FROM s WHERE event_type <> 'error'), j AS (SELECT m.event_id, o.event_id AS other, o.a < m.a AS prior, abs(o.a - m.a) AS d FROM m JOIN o ON m.user_id = o.user_id AND abs(o.a - m.a) <= 8),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id, prior ORDER BY d, other) AS k FROM j) SELECT event_id, other, prior, k FROM k WHERE k <= 4""")
def nearest_both_sides(t: Tables) -> DataFrame:
    """The four nearest turns on either side within 8 s of each error."""
    d = _turns(t)
    m = d.where("event_type = 'error'").select("user_id", "event_id", "a", F.col("a").alias("z"))
    o = d.where("event_type <> 'error'").select("user_id", F.col("event_id").alias("other"), F.col("a").alias("oa"), F.col("a").alias("oz"))
    j = intervals.overlap_join(m, o, ["user_id"], ("a", "z"), ("oa", "oz"), bucket=16.0, pad=8.0).where(F.abs(F.col("oa") - F.col("a")) <= 8).withColumn("prior", F.col("oa") < F.col("a"))
    k = F.row_number().over(W.partitionBy("event_id", "prior").orderBy(F.abs(F.col("oa") - F.col("a")), "other")).cast("long")
    return j.select("event_id", "other", "prior", k.alias("k")).where("k <= 4")


@query("""WITH f AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, lag(list_transform(embedding, lambda x: x::DOUBLE)) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings), d AS (SELECT label, list_avg(list_transform(range(1, 65), lambda i: abs(e[i] - p[i]))) AS m FROM f WHERE p IS NOT NULL)
SELECT label, count(*) AS pairs, round(avg(m), 6) AS motion, round(avg(CASE WHEN m > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS moving FROM d GROUP BY label""")
def frame_deltas(t: Tables) -> DataFrame:
    """Mean change between consecutive frames, and the share of pairs that change by more than a bound."""
    d = t.embeddings.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("p", F.lag("e").over(W.partitionBy("label").orderBy("vec_id"))).where("p IS NOT NULL")
    m = F.aggregate(F.zip_with("e", "p", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("e")
    return d.select("label", m.alias("m")).groupBy("label").agg(n_rows().alias("pairs"), F.round(F.avg("m"), 6).alias("motion"), F.round(F.avg((F.col("m") > 0.1).cast("double")), 6).alias("moving"))


ROLES = {"violator": (["subject", "camera_person", "third_party", None], 53), "reactor": (["Bystander", "victim", "camera_person", "subject", "", None], 59), "first": (["bystander", "victim", None], 61), "second": (["organic_audience", "bystander", "host", None], 67)}
_THIRD = "('bystander', 'third_party', 'organic_audience', 'authority_or_host')"


@query(f"""WITH a AS (SELECT *, lower(coalesce(reactor, '')) AS r, lower(coalesce(violator, '')) AS v, list_filter([first, second], lambda x: x IS NOT NULL) AS m FROM ({atoms_sql('documents', 'doc_id', ROLES)}))
SELECT doc_id, r <> '' OR v <> '' AS available, r IN {_THIRD} AS third_party, r IN ('victim', 'affected_target') AS affected, r = 'camera_person' AS camera, r <> '' AND v <> '' AND r <> v AS differ, CAST(len(list_filter(m, lambda x: x IN {_THIRD})) AS BIGINT) AS votes, len(m) >= 2 AND len(list_filter(m, lambda x: x IN {_THIRD})) = len(m) AS agreement FROM a""")
def role_separation(t: Tables) -> DataFrame:
    """Whether reactor and violator are different people, by metadata and by what two models said."""
    third = ["bystander", "third_party", "organic_audience", "authority_or_host"]
    r, v = (F.lower(F.coalesce(x, F.lit(""))) for x in ("reactor", "violator"))
    said = F.array_compact(F.array("first", "second"))
    votes = F.size(F.filter(said, lambda x: x.isin(third)))
    return with_atoms(t.documents, "doc_id", ROLES).select("doc_id", ((r != "") | (v != "")).alias("available"), r.isin(third).alias("third_party"), r.isin("victim", "affected_target").alias("affected"), (r == "camera_person").alias("camera"), ((r != "") & (v != "") & (r != v)).alias("differ"), votes.cast("long").alias("votes"), ((F.size(said) >= 2) & (votes == F.size(said))).alias("agreement"))


# --- pairs ----------------------------------------------------------------------------------------------

_BOX = "x AS (SELECT vec_id, label, CAST(vec_id % 50 AS DOUBLE) AS x0, CAST(vec_id % 7 AS DOUBLE) AS y0, CAST(vec_id % 50 + 10 AS DOUBLE) AS x1, CAST(vec_id % 7 + 5 AS DOUBLE) AS y1 FROM embeddings)"


@query(f"""WITH {_BOX}, p AS (SELECT a.vec_id, b.vec_id AS other, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i FROM x a JOIN x b ON b.vec_id = a.vec_id + 3) SELECT vec_id, other, round(i / (100 - i), 6) AS iou FROM p""")
def box_iou(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    d = t.embeddings.select("vec_id", (v % 50).cast("double").alias("x0"), (v % 7).cast("double").alias("y0"), (v % 50 + 10).cast("double").alias("x1"), (v % 7 + 5).cast("double").alias("y1"))
    box = F.struct("x0", "y0", "x1", "y1")
    a, b = d.select("vec_id", box.alias("p")), d.select((v - 3).alias("vec_id"), v.alias("other"), box.alias("q"))
    side = lambda c: {k: F.col(f"{c}.{k}") for k in ("x0", "y0", "x1", "y1")}
    return a.join(b, "vec_id").select("vec_id", "other", F.round(vectors.iou(side("p"), side("q")), 6).alias("iou"))


PAIR = {"delta": ([0.0, 0.001, 0.02, 0.5], 71), "aligned": ([0.0, 4.0, 9.0, 20.0], 73), "best": ([2.0, 8.0, 12.0, 25.0], 79), "jaccard": ([0.1, 0.5, 0.8, 1.0], 83)}


@query(f"SELECT doc_id, CASE WHEN delta > 0.02 THEN NULL WHEN aligned <= 4 THEN 'near_exact_reencode' WHEN best <= 12 AND jaccard >= 0.5 THEN 'likely_same_episode_edit' END AS kind FROM ({atoms_sql('documents', 'doc_id', PAIR)})")
def pair_classes(t: Tables) -> DataFrame:
    """A pair's class by its lengths, aligned and best picture hashes, and titles."""
    d = with_atoms(t.documents, "doc_id", PAIR)
    return d.select("doc_id", F.when(F.col("delta") > 0.02, None).when(F.col("aligned") <= 4, "near_exact_reencode").when((F.col("best") <= 12) & (F.col("jaccard") >= 0.5), "likely_same_episode_edit").alias("kind"))


@query("""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS ts FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS ts FROM documents),
s AS (SELECT doc_id, item_id, round(len(list_intersect(d.ts, b.ts))::DOUBLE / len(list_distinct(list_concat(d.ts, b.ts))), 9) AS score FROM d JOIN b ON list_has_any(d.ts, b.ts)) SELECT doc_id, arg_max(item_id, struct_pack(s := score, i := item_id)) AS nearest, max(score) AS score FROM s GROUP BY doc_id""")
def nearest_by_jaccard(t: Tables) -> DataFrame:
    """For each document the item whose words are most alike; ties go to the later item. Only pairs that share a word meet:
    words are joined and counted, no cross join."""
    toks = lambda df, k: df.select(k, text.tokens(F.col("text"), 4).alias("ts"))
    d, b = toks(t.documents, "doc_id"), toks(t.benchmark, "item_id")
    shared = d.select("doc_id", F.size("ts").alias("n"), F.explode("ts").alias("w")).join(b.select("item_id", F.size("ts").alias("m"), F.explode("ts").alias("w")), "w").groupBy("doc_id", "item_id").agg(n_rows().alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    score = F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 9)
    return shared.withColumn("score", score).groupBy("doc_id").agg(F.max_by("item_id", F.struct("score", "item_id")).alias("nearest"), F.max("score").alias("score"))


@query("""WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ts FROM conversations), q AS (SELECT conv_id, ts AS qs FROM c WHERE turn = 1), x AS (SELECT conv_id, ts AS cs FROM c WHERE turn = 2),
s AS (SELECT c.conv_id, turn, greatest(CASE WHEN len(qs) = 0 OR len(ts) = 0 THEN 0 ELSE 2.0 * len(list_intersect(qs, ts)) / (len(qs) + len(ts)) END, 0.65 * CASE WHEN len(cs) = 0 OR len(ts) = 0 THEN 0 ELSE 2.0 * len(list_intersect(cs, ts)) / (len(cs) + len(ts)) END) AS score FROM c JOIN q USING (conv_id) JOIN x USING (conv_id) WHERE turn > 2),
r AS (SELECT conv_id, turn, round(score, 9) AS score FROM s) SELECT conv_id, arg_max(turn, struct_pack(s := score, t := -turn)) AS segment, max(score) AS score FROM r WHERE score > 0 GROUP BY conv_id""")
def best_segment(t: Tables) -> DataFrame:
    """The segment most like a reaction or, at 0.65 of the weight, like its context; the first of equal ones."""
    c = t.conversations.select("conv_id", "turn", text.tokens(F.col("text")).alias("ts"))
    q, x = c.where("turn = 1").select("conv_id", F.col("ts").alias("qs")), c.where("turn = 2").select("conv_id", F.col("ts").alias("cs"))
    s = c.where("turn > 2").join(q, "conv_id").join(x, "conv_id")
    s = s.withColumn("score", F.round(F.greatest(text.dice(F.col("qs"), F.col("ts")), 0.65 * text.dice(F.col("cs"), F.col("ts"))), 9)).where("score > 0")
    return s.groupBy("conv_id").agg(F.max_by("turn", F.struct(F.col("score"), -F.col("turn"))).alias("segment"), F.max("score").alias("score"))


# --- ledgers ------------------------------------------------------------------------------------------------

_L3 = "a AS (SELECT doc_id FROM documents WHERE doc_id % 7 > 0), b AS (SELECT doc_id FROM documents WHERE doc_id % 5 > 0), c AS (SELECT doc_id FROM labels)"


@query(f"WITH {_L3}, u AS (SELECT coalesce(a.doc_id, b.doc_id, c.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_a, b.doc_id IS NOT NULL AS in_b, c.doc_id IS NOT NULL AS in_c FROM a FULL JOIN b ON a.doc_id = b.doc_id FULL JOIN c ON c.doc_id = coalesce(a.doc_id, b.doc_id)) SELECT in_a, in_b, in_c, count(*) AS n, min(doc_id) AS least FROM u GROUP BY in_a, in_b, in_c")
def three_ledger_reconcile(t: Tables) -> DataFrame:
    """Which of three ledgers hold a key: exact coverage is one row with all three."""
    mark = lambda d, i: d.select("doc_id", *[F.lit(i == j).alias(f"in_{x}") for j, x in enumerate("abc")])
    u = mark(t.documents.where("doc_id % 7 > 0"), 0).unionByName(mark(t.documents.where("doc_id % 5 > 0"), 1)).unionByName(mark(t.labels, 2))
    return u.groupBy("doc_id").agg(*[F.bool_or(f"in_{x}").alias(f"in_{x}") for x in "abc"]).groupBy("in_a", "in_b", "in_c").agg(n_rows().alias("n"), F.min("doc_id").alias("least"))


@query("WITH x AS (SELECT doc_id, 'old_' || doc_id AS old, CASE WHEN doc_id % 6 = 0 THEN 'u' || doc_id // 12 ELSE 'u' || doc_id || 'x' END AS uid FROM documents), u AS (SELECT uid, count(*) AS n FROM x GROUP BY uid) SELECT doc_id, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'mapped' END AS status, CASE WHEN n = 1 THEN 'new_' || x.uid END AS item FROM x JOIN u ON x.uid = u.uid")
def uid_crosswalk(t: Tables) -> DataFrame:
    """Old item ids to new ones by a uid that must be unique; where it isn't, the row is named ambiguous instead of guessed."""
    uid = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("u"), F.expr("doc_id div 12"))).otherwise(F.concat(F.lit("u"), F.col("doc_id"), F.lit("x")))
    x = t.documents.select("doc_id", uid.alias("uid"))
    j = x.join(x.groupBy("uid").agg(n_rows().alias("n")), "uid")
    return j.select("doc_id", F.when(F.col("n") > 1, "ambiguous").otherwise("mapped").alias("status"), F.when(F.col("n") == 1, F.concat(F.lit("new_"), "uid")).alias("item"))


@query("WITH j AS (SELECT doc_id, doc_id % 4 AS answer, doc_id % 3 = 0 AS sure FROM documents WHERE doc_id % 2 = 0) SELECT count(*) AS judged, count(*) FILTER (l.doc_id IS NULL) AS unknown, count(*) FILTER (answer % 2 = quality) AS right_all, count(*) FILTER (sure AND l.doc_id IS NOT NULL) AS sure, count(*) FILTER (sure AND answer % 2 = quality) AS right_sure FROM j LEFT JOIN labels l ON j.doc_id = l.doc_id")
def human_pair_accuracy(t: Tables) -> DataFrame:
    """Judgments against the truth: unknown keys are counted, not dropped; accuracy over all and over the sure ones."""
    j = t.documents.where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 4).alias("answer"), (F.col("doc_id") % 3 == 0).alias("sure"))
    d = j.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    right = F.col("answer") % 2 == F.col("quality")
    return d.agg(n_rows().alias("judged"), F.count_if(F.col("quality").isNull()).alias("unknown"), F.count_if(right).alias("right_all"), F.count_if(F.col("sure") & F.col("quality").isNotNull()).alias("sure"), F.count_if(F.col("sure") & right).alias("right_sure"))


@query("WITH r AS (SELECT doc_id % 50 AS item, doc_id, CASE WHEN doc_id % 11 = 0 THEN 'reject' ELSE 'accept' END AS decision, doc_id % 13 = 5 AS adjudicated, n_chars AS fields FROM documents) SELECT item, count(*) AS reviews, CASE WHEN count(DISTINCT decision) = 1 THEN 'agreed' WHEN bool_or(adjudicated) THEN 'adjudicated' ELSE 'conflict' END AS status, CASE WHEN count(DISTINCT decision) = 1 THEN arg_max(decision, struct_pack(f := fields, d := doc_id)) WHEN bool_or(adjudicated) THEN arg_max(decision, struct_pack(f := fields, d := doc_id)) FILTER (adjudicated) END AS decision FROM r GROUP BY item")
def gold_consolidation(t: Tables) -> DataFrame:
    """Overlapping reviews to one decision; disagreement is a conflict unless one of them adjudicates."""
    r = t.documents.select((F.col("doc_id") % 50).alias("item"), "doc_id", F.when(F.col("doc_id") % 11 == 0, "reject").otherwise("accept").alias("decision"), (F.col("doc_id") % 13 == 5).alias("adjudicated"), F.col("n_chars").alias("fields"))
    rank = F.struct("fields", "doc_id")
    g = r.groupBy("item").agg(n_rows().alias("reviews"), F.countDistinct("decision").alias("k"), F.bool_or("adjudicated").alias("adj"), F.max_by("decision", rank).alias("best"), F.max_by(F.when(F.col("adjudicated"), F.col("decision")), F.when(F.col("adjudicated"), rank)).alias("ruled"))
    one = F.col("k") == 1
    return g.select("item", "reviews", F.when(one, "agreed").when(F.col("adj"), "adjudicated").otherwise("conflict").alias("status"), F.when(one, F.col("best")).when(F.col("adj"), F.col("ruled")).alias("decision"))


@query("WITH m AS (SELECT doc_id % 3 AS shard, doc_id AS item, doc_id AS idx FROM documents UNION ALL SELECT 9, doc_id, doc_id FROM documents WHERE doc_id % 400 = 7) SELECT count(*) AS rows_in, count(DISTINCT item) AS items, count(*) - count(DISTINCT item) AS repeated, min(idx) AS first_index, max(idx) AS last_index, count(DISTINCT idx) = max(idx) + 1 AND min(idx) = 0 AS gapless, count(*) = count(DISTINCT item) AND count(DISTINCT idx) = count(*) AS disjoint FROM m")
def manifest_merge_check(t: Tables) -> DataFrame:
    """Whether merged manifests are disjoint by item and index and their indices run from 0 without gaps. Keys are counted after a
    shuffle by key, not in one task."""
    m = t.documents.select(F.col("doc_id").alias("item"), F.col("doc_id").alias("idx"))
    m = m.unionByName(m.where("item % 400 = 7"))
    per = lambda c: m.groupBy(c).agg(n_rows().alias("n")).agg(F.sum("n").alias("rows_in"), n_rows().alias("k"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    a, b = per("item").select("rows_in", F.col("k").alias("items")), per("idx").select(F.col("k").alias("ks"), F.col("lo").alias("first_index"), F.col("hi").alias("last_index"))
    j = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one")
    return j.select("rows_in", "items", (F.col("rows_in") - F.col("items")).alias("repeated"), "first_index", "last_index", ((F.col("ks") == F.col("last_index") + 1) & (F.col("first_index") == 0)).alias("gapless"), ((F.col("rows_in") == F.col("items")) & (F.col("ks") == F.col("rows_in"))).alias("disjoint"))


_ARTEFACT = """repeat('{{"rows": [', ({n} % 40){int}) || '{{"uid": " d' || {n} || '", "at": 3, "more": [{{"item_id": "witnessed:' || coalesce(source, '') || ':' || {n} || '"}}, {{"candidate_id": "other:x:1", "video_id": ""}}, "uid"]}}' || repeat(']}}', ({n} % 40){int})"""


@query(f"WITH a AS (SELECT CAST({_ARTEFACT.format(n='doc_id', int='::INTEGER')} AS JSON) AS x FROM documents UNION ALL SELECT CAST(props AS JSON) FROM events WHERE json_valid(props)), k AS (SELECT t.key, t.atom ->> '$' AS v FROM a, json_tree(a.x) AS t WHERE t.type = 'VARCHAR') SELECT DISTINCT uid FROM (SELECT CASE WHEN key IN ('uid', 'video_id', 'source_uid') THEN nullif(trim(v), '') ELSE nullif(regexp_extract(trim(v), '^(?:instructional|witnessed|commentary):([^:]+):', 1), '') END AS uid FROM k WHERE key IN ('uid', 'video_id', 'source_uid', 'item_id', 'candidate_id')) WHERE uid IS NOT NULL")
def uid_harvest(t: Tables) -> DataFrame:
    """Ids found in JSON artefacts at any depth, as one set."""
    a = t.documents.select(F.expr(_ARTEFACT.format(n="doc_id", int="") .replace("(doc_id % 40)", "cast(doc_id % 40 as int)")).alias("x")).unionByName(t.events.select(F.col("props").alias("x")))
    return json_walk.harvested(a, "x")



@query("WITH r AS (SELECT doc_id, doc_id % 40 AS item, CASE WHEN doc_id % 3 = 0 THEN 'e' END AS err FROM documents) SELECT item, coalesce(arg_min(doc_id, doc_id) FILTER (err IS NULL), min(doc_id)) AS doc_id, bool_and(err IS NOT NULL) AS failed FROM r GROUP BY item")
def first_unless_later_success(t: Tables) -> DataFrame:
    """The first row of an item, unless it failed and a later one didn't: then the first that didn't."""
    r = t.documents.select("doc_id", (F.col("doc_id") % 40).alias("item"), (F.col("doc_id") % 3 == 0).alias("bad"))
    return r.groupBy("item").agg(F.min_by("doc_id", F.struct("bad", "doc_id")).alias("doc_id"), F.bool_and("bad").alias("failed"))


@query("WITH r AS (SELECT doc_id, doc_id % 30 AS item, CASE WHEN doc_id % 4 = 0 THEN lang END AS a, CASE WHEN doc_id % 5 = 0 THEN source END AS b, CASE WHEN doc_id % 6 = 1 THEN n_chars END AS c FROM documents) SELECT item, arg_max(a, doc_id) FILTER (a IS NOT NULL) AS a, arg_max(b, doc_id) FILTER (b IS NOT NULL) AS b, arg_max(c, doc_id) FILTER (c IS NOT NULL) AS c FROM r GROUP BY item")
def sectionwise_merge(t: Tables) -> DataFrame:
    """Each section's last value that isn't null; sections don't overwrite one another."""
    pick_ = lambda v, m, k: F.when(F.col("doc_id") % m == k, F.col(v))
    r = t.documents.select("doc_id", (F.col("doc_id") % 30).alias("item"), pick_("lang", 4, 0).alias("a"), pick_("source", 5, 0).alias("b"), pick_("n_chars", 6, 1).alias("c"))
    return r.groupBy("item").agg(*[F.max_by(x, F.when(F.col(x).isNotNull(), F.col("doc_id"))).alias(x) for x in "abc"])


@query("WITH s AS (SELECT event_id % 97 AS uid, event_type AS status, event_id FROM events), l AS (SELECT uid, arg_max(status, event_id) AS status FROM s GROUP BY uid) SELECT status, count(*) AS uids, (SELECT count(*) FROM s) AS rows_total FROM l GROUP BY status")
def ledger_summary(t: Tables) -> DataFrame:
    """Latest status of each key, counted, with the ledger's rows."""
    s = t.events.select((F.col("event_id") % 97).alias("uid"), F.col("event_type").alias("status"), "event_id")
    per = s.groupBy("uid").agg(F.max_by("status", "event_id").alias("status"), n_rows().alias("n"))
    by = per.groupBy("status").agg(n_rows().alias("uids"), F.sum("n").alias("n"))
    return by.select("status", "uids", F.sum("n").over(W.partitionBy(F.lit(1))).alias("rows_total"))  # one row for each status


@query("WITH e AS (SELECT doc_id FROM documents WHERE doc_id % 3 > 0), s AS (SELECT doc_id, doc_id % 10 > 0 AS ok FROM documents WHERE doc_id % 4 > 0) SELECT (SELECT count(*) FROM e) AS expected, count(*) FILTER (ok AND e.doc_id IS NOT NULL) AS successful, round(count(*) FILTER (ok AND e.doc_id IS NOT NULL)::DOUBLE / (SELECT count(*) FROM e), 9) AS fraction, count(*) FILTER (e.doc_id IS NULL) AS unexpected FROM s LEFT JOIN e ON s.doc_id = e.doc_id")
def score_coverage(t: Tables) -> DataFrame:
    """How many of the expected keys were scored, and scores of keys that nobody expected."""
    e = t.documents.where("doc_id % 3 > 0").select("doc_id", F.lit(True).alias("wanted"))
    s = t.documents.where("doc_id % 4 > 0").select("doc_id", (F.col("doc_id") % 10 > 0).alias("ok"))
    d = e.join(s, "doc_id", "full").agg(F.count_if("wanted").alias("expected"), F.count_if(F.col("wanted") & F.col("ok")).alias("successful"), F.count_if(F.col("wanted").isNull()).alias("unexpected"))
    return d.select("expected", "successful", F.round(F.col("successful") / F.col("expected"), 9).alias("fraction"), "unexpected")


@query("WITH s AS (SELECT user_id, event_id, event_type, epoch(ts) AS sec FROM events WHERE user_id IS NOT NULL), l AS (SELECT user_id, arg_max(event_type, struct_pack(a := sec, e := event_id)) AS last, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM s GROUP BY user_id) SELECT user_id, CASE last WHEN 'view' THEN 'enumerated' WHEN 'click' THEN 'pending_transcribe' WHEN 'signup' THEN 'pending_detect' WHEN 'error' THEN CASE WHEN errors > 1 THEN 'failed' ELSE 'pending_transcribe' END ELSE 'done' END AS status, list_filter([CASE WHEN errors * 5 > n THEN 'error_rate' END, CASE WHEN n < 10 THEN 'few_events' END], lambda x: x IS NOT NULL) AS alerts FROM l")
def status_machine(t: Tables) -> DataFrame:
    """The state of each key from its log of events: an error sends it back once, then fails it; with alerts by thresholds."""
    d = t.events.where("user_id IS NOT NULL").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count_if(F.col("event_type") == "error").alias("errors"), n_rows().alias("n"))
    c, e = F.col("last"), F.col("errors")
    status = F.when(c == "view", "enumerated").when(c == "click", "pending_transcribe").when(c == "signup", "pending_detect").when(c == "error", F.when(e > 1, "failed").otherwise("pending_transcribe")).otherwise("done")
    return d.select("user_id", status.alias("status"), F.array_compact(F.array(F.when(e * 5 > F.col("n"), "error_rate"), F.when(F.col("n") < 10, "few_events"))).alias("alerts"))


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS n FROM events, m WHERE ts >= now - INTERVAL 48 HOUR GROUP BY event_type")
def lookback_counts(t: Tables) -> DataFrame:
    """Rows of the last 48 hours before the newest one."""
    now = t.events.agg(F.max("ts").alias("now"))  # one row
    return t.events.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("INTERVAL 48 HOURS")).groupBy("event_type").agg(n_rows().alias("n"))


# --- reports ---------------------------------------------------------------------------------------------------

CONCEPTS = {"th": "th", "er": "er", "double": "(.)\\1", "digit": "[0-9]"}
_RX = {"th": "th", "er": "er", "double": "aa|ee|ll|nn|oo|ss|tt", "digit": "[0-9]"}


@query("WITH c AS (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in _RX.items()) + "], lambda x: x IS NOT NULL)) AS concept, n_chars FROM documents) SELECT concept, count(*) AS n, sum(n_chars) AS chars FROM c GROUP BY concept")
def concept_counts(t: Tables) -> DataFrame:
    """Documents by concept, where one belongs to each concept that it matches."""
    c = F.array_compact(F.array(*[F.when(F.lower("text").rlike(p), F.lit(n)) for n, p in _RX.items()]))
    return t.documents.select(F.explode(c).alias("concept"), "n_chars").groupBy("concept").agg(n_rows().alias("n"), F.sum("n_chars").alias("chars"))


OUT = {f"o{i}": ([0, 1, 2, None], 89 + 6 * i) for i in range(4)}


@query(f"SELECT doc_id % 5 AS platform, {', '.join(f'CAST(sum(coalesce({o}, 0)) AS BIGINT) AS {o}' for o in OUT)}, count(*) FILTER (coalesce(o0, 0) = 0) AS zero FROM ({atoms_sql('documents', 'doc_id', OUT)}) GROUP BY 1")
def trajectory_outcome_sums(t: Tables) -> DataFrame:
    d = with_atoms(t.documents, "doc_id", OUT)
    return d.groupBy((F.col("doc_id") % 5).alias("platform")).agg(*[F.sum(F.coalesce(o, F.lit(0))).alias(o) for o in OUT], F.count_if(F.coalesce("o0", F.lit(0)) == 0).alias("zero"))


@query("WITH r AS (SELECT o_custkey AS q, o_orderpriority AS family FROM orders) SELECT family, count(*) AS picks, count(DISTINCT q) AS unique_queries, count(*) - count(DISTINCT q) AS repeats FROM r GROUP BY family")
def replay_counters(t: Tables) -> DataFrame:
    """Picks of a replayed schedule by family: how many queries were unique, how many picks repeats."""
    per = t.orders.groupBy(F.col("o_orderpriority").alias("family"), "o_custkey").agg(n_rows().alias("n"))
    return per.groupBy("family").agg(F.sum("n").alias("picks"), n_rows().alias("unique_queries"), (F.sum("n") - n_rows()).alias("repeats"))


@query("WITH h AS (SELECT * FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 40), w AS (SELECT 'token' AS kind, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS name FROM h UNION ALL SELECT 'channel', source FROM h), c AS (SELECT kind, name, count(*) AS n FROM w WHERE NOT (kind = 'token' AND name IN ('the', 'and')) GROUP BY kind, name), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS k FROM c) SELECT kind, name, n FROM r WHERE k <= CASE kind WHEN 'token' THEN 15 ELSE 8 END")
def latest_hit_report(t: Tables) -> DataFrame:
    """The commonest 15 title tokens and 8 channels of the latest 40 hits: the limits are the report's own."""
    h = t.documents.where("lang = 'en'").orderBy(F.desc("doc_id")).limit(40)
    w = h.select(F.lit("token").alias("kind"), F.explode(text.title_tokens(F.col("text"), ["the", "and"])).alias("name")).unionByName(h.select(F.lit("channel").alias("kind"), F.col("source").alias("name")))
    c = w.groupBy("kind", "name").agg(n_rows().alias("n"))
    r = c.withColumn("k", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "name")))
    return r.where(F.col("k") <= F.when(F.col("kind") == "token", 15).otherwise(8)).select("kind", "name", "n")


@query("""WITH s AS (SELECT coalesce(CASE event_type WHEN 'view' THEN NULL ELSE event_type END, 'miss/none') AS modality, value >= 20 AS done FROM events) SELECT 'modality' AS report, modality AS name, count(*) AS n FROM s GROUP BY modality UNION ALL SELECT 'status', CASE WHEN done THEN 'done' ELSE 'pending' END, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'total', 'rows', count(*) FROM s
UNION ALL SELECT 'user', name, n FROM (SELECT CAST(user_id AS VARCHAR) AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS k FROM events WHERE user_id IS NOT NULL GROUP BY user_id) WHERE k <= 10 UNION ALL SELECT 'day', CAST(CAST(ts AS DATE) AS VARCHAR), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'kind_status', modality || ':' || CASE WHEN done THEN 'done' ELSE 'pending' END, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'language', lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT 'label', CAST(quality AS VARCHAR), count(*) FROM labels GROUP BY quality""")
def admin_status(t: Tables) -> DataFrame:
    """Totals and eight grouped or top-k reports in one table."""
    modality = F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("miss/none"))
    done = F.when(F.col("value") >= 20, "done").otherwise("pending")

    def report(name: str, df: DataFrame, c) -> DataFrame:
        return df.groupBy(c.cast("string").alias("name")).agg(n_rows().alias("n")).select(F.lit(name).alias("report"), "name", "n")

    e, d = t.events, t.documents
    top = e.where("user_id IS NOT NULL").groupBy("user_id").agg(n_rows().alias("n")).orderBy(F.desc("n"), "user_id").limit(10).select(F.lit("user").alias("report"), F.col("user_id").cast("string").alias("name"), "n")
    out = report("modality", e, modality).unionByName(top)
    for r in (report("status", e, done), report("total", e, F.lit("rows")), report("day", e, F.to_date("ts")), report("kind_status", e, F.concat_ws(":", modality, done)), report("source", d, F.col("source")), report("language", d, F.col("lang")), report("label", t.labels, F.col("quality"))):
        out = out.unionByName(r)
    return out


@query("WITH q AS (SELECT o_orderkey, o_orderstatus AS status, coalesce(CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE o_orderpriority END, 'unrouted') AS modality FROM orders), g AS (SELECT status, modality, count(*) AS n FROM q GROUP BY 1, 2), l AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 8) SELECT 'group' AS kind, status || ':' || modality AS name, n FROM g UNION ALL SELECT 'latest', CAST(o_orderkey AS VARCHAR), 1 FROM l")
def promotion_status(t: Tables) -> DataFrame:
    """Promoted queries by status and modality, and the latest eight."""
    m = F.coalesce(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")), F.lit("unrouted"))
    g = t.orders.groupBy(F.concat_ws(":", "o_orderstatus", m).alias("name")).agg(n_rows().alias("n")).select(F.lit("group").alias("kind"), "name", "n")
    latest = t.orders.select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(8)
    return g.unionByName(latest.select(F.lit("latest").alias("kind"), F.col("o_orderkey").cast("string").alias("name"), F.lit(1).cast("long").alias("n")))


@query("SELECT doc_id, CASE WHEN d LIKE 'PT%' THEN coalesce(TRY_CAST(regexp_extract(d, '(\\d+)H', 1) AS BIGINT), 0) * 3600 + coalesce(TRY_CAST(regexp_extract(d, '(\\d+)M', 1) AS BIGINT), 0) * 60 + coalesce(TRY_CAST(regexp_extract(d, '(\\d+)S', 1) AS BIGINT), 0) END AS seconds FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PT' || n_chars % 9 || 'H' || n_chars % 60 || 'M' WHEN 1 THEN 'PT' || n_chars % 60 || 'S' WHEN 2 THEN 'P1D' ELSE 'PT' || n_chars % 50 || 'M' || n_chars % 60 || 'S' END AS d FROM documents)")
def iso_durations(t: Tables) -> DataFrame:
    n = lambda m: (F.col("n_chars") % m).cast("string")
    k = F.col("doc_id") % 4
    d = F.when(k == 0, F.concat(F.lit("PT"), n(9), F.lit("H"), n(60), F.lit("M"))).when(k == 1, F.concat(F.lit("PT"), n(60), F.lit("S"))).when(k == 2, "P1D").otherwise(F.concat(F.lit("PT"), n(50), F.lit("M"), n(60), F.lit("S")))
    return t.documents.select("doc_id", text.iso_duration(d).alias("seconds"))


@query("WITH a AS (SELECT doc_id, 'pillar:' || CASE WHEN doc_id % 3 = 0 THEN 'a:b:' ELSE '' END || 'u' || doc_id || ':7' AS item FROM documents) SELECT doc_id, regexp_extract(item, '^[^:]*:(.*):[^:]*$', 1) AS uid FROM a")
def item_uid(t: Tables) -> DataFrame:
    """The uid in the middle of an item id, which may itself hold colons."""
    item = F.concat(F.lit("pillar:"), F.when(F.col("doc_id") % 3 == 0, "a:b:").otherwise(""), F.lit("u"), F.col("doc_id"), F.lit(":7"))
    parts = F.split(item, ":")
    return t.documents.select("doc_id", F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), ":").alias("uid"))


@query("WITH c AS (SELECT doc_id % 20 AS cluster, 'u' || doc_id AS uid FROM documents WHERE doc_id % 50 <> 3 UNION ALL SELECT 99, 'u' || doc_id FROM documents WHERE doc_id % 100 = 9), e AS (SELECT 'u' || doc_id AS uid FROM documents), k AS (SELECT uid, count(*) AS n FROM c GROUP BY uid) SELECT CASE WHEN k.uid IS NULL THEN 'missing' WHEN n > 1 THEN 'in_two' ELSE 'ok' END AS status, count(*) AS uids FROM e LEFT JOIN k ON e.uid = k.uid GROUP BY 1")
def cluster_partition_check(t: Tables) -> DataFrame:
    """Whether clusters partition the expected ids: none missing, none in two."""
    u = F.concat(F.lit("u"), F.col("doc_id")).alias("uid")
    c = t.documents.where("doc_id % 50 <> 3").select(u).unionByName(t.documents.where("doc_id % 100 = 9").select(u))
    j = t.documents.select(u).join(c.groupBy("uid").agg(n_rows().alias("n")), "uid", "left")
    return j.groupBy(F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "in_two").otherwise("ok").alias("status")).agg(n_rows().alias("uids"))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256('split:' || source), 1, 8) AS BIGINT) / 4294967295.0 < 0.7 THEN 'train' ELSE 'test' END AS side FROM documents")
def train_test_split(t: Tables) -> DataFrame:
    """Sources to one side each, by the first eight hex digits of a digest."""
    f = F.conv(F.substring(F.sha2(F.concat(F.lit("split:"), "source"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return t.documents.select("doc_id", F.when(f < 0.7, "train").otherwise("test").alias("side"))


@query("""SELECT vec_id, 'scene.' || (i - 1) AS feature, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i) UNION ALL SELECT vec_id, 'meta.label', CAST(label AS DOUBLE) FROM embeddings""")
def flattened_features(t: Tables) -> DataFrame:
    """Nested sections as named features: a vector by place, all of it, other fields by name."""
    scene = F.transform("embedding", lambda x, i: F.struct(F.concat(F.lit("scene."), i.cast("string")).alias("feature"), F.round(x.cast("double"), 6).alias("value")))
    label = F.array(F.struct(F.lit("meta.label").alias("feature"), F.col("label").cast("double").alias("value")))
    return t.embeddings.select("vec_id", F.explode(F.concat(scene, label)).alias("x")).select("vec_id", "x.*")


@query("""WITH f AS (SELECT unnest(['scene.a', 'scene.b', 'meta.x', 'text.n']) AS feature) SELECT doc_id, split_part(feature, '.', 1) AS section, count(*) AS n FROM documents, f WHERE NOT (feature = 'text.n' AND doc_id % 2 = 0) GROUP BY doc_id, 2""")
def feature_groups(t: Tables) -> DataFrame:
    """Features of each row by the prefix of their names."""
    m = F.map_from_entries(F.transform(F.array(*[F.lit(x) for x in ("scene.a", "scene.b", "meta.x", "text.n")]), lambda k: F.struct(k, F.lit(1))))
    kept = F.map_filter(m, lambda k, _: ~((k == "text.n") & (F.col("doc_id") % 2 == 0)))
    groups = F.array(*[F.struct(F.lit(p).alias("section"), F.size(F.map_filter(kept, lambda k, _: F.startswith(k, F.lit(p)))).cast("long").alias("n")) for p in ("scene", "meta", "text")])
    return t.documents.select("doc_id", F.explode(F.filter(groups, lambda g: g["n"] > 0)).alias("g")).select("doc_id", "g.*")


@query("WITH s AS (SELECT conv_id, turn, turn * 5.0 AS a, turn * 5.0 + 4 AS b FROM conversations) SELECT conv_id, turn, CAST(greatest(a, 7) - 7 AS DOUBLE) AS start, CAST(least(b, 22) - 7 AS DOUBLE) AS \"end\" FROM s WHERE a < 22 AND b > 7")
def rebased_segments(t: Tables) -> DataFrame:
    """Segments cut to a trim of the medium, in its own time."""
    segs = F.array_sort(F.collect_list(F.struct("turn", (F.col("turn") * 5.0).alias("a"), (F.col("turn") * 5.0 + 4).alias("b"))))
    d = t.conversations.groupBy("conv_id").agg(segs.alias("s"))
    cut = F.transform(F.filter("s", lambda x: (x["a"] < 22) & (x["b"] > 7)), lambda x: F.struct(x["turn"].alias("turn"), (F.greatest(x["a"], F.lit(7.0)) - 7).alias("start"), (F.least(x["b"], F.lit(22.0)) - 7).alias("end")))
    return d.select("conv_id", F.explode(cut).alias("x")).select("conv_id", "x.*")


@query("WITH h AS (SELECT doc_id // 7 AS k, doc_id, source FROM documents WHERE doc_id % 14 = 0), n AS (SELECT doc_id // 7 AS k, doc_id, source FROM documents WHERE doc_id % 14 <> 0 QUALIFY row_number() OVER (PARTITION BY doc_id // 7 ORDER BY source, doc_id) = 1) SELECT k, doc_id, source, false AS new FROM h UNION ALL SELECT k, doc_id, source, true FROM n WHERE k NOT IN (SELECT k FROM h)")
def insert_or_ignore(t: Tables) -> DataFrame:
    """Keys enter a table once: rows whose key is there are ignored, of new ones the first by source and number stays."""
    d = t.documents.select(F.expr("doc_id div 7").alias("k"), "doc_id", "source")
    held, incoming = d.where("doc_id % 14 = 0"), d.where("doc_id % 14 <> 0")
    added = relational.insert_new(held, incoming, ["k"], ["source", "doc_id"])
    return held.withColumn("new", F.lit(False)).unionByName(added.withColumn("new", F.lit(True)))
