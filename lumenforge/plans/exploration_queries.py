"""Metrics of pairs of clips, cuts between frames, rules with a test side, concepts of search queries, and samples in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cues, hashing, text, vectors
from ..operators import experiments, ranks, sampling, scheduling
from .atoms import atoms_sql, pick, pick_sql, with_atoms
from .interval_queries import EV, seconds
from .media_queries import _HASHES, _hashes
from .registry import Tables, query

n_rows = lambda: F.count(F.lit(1))

# --- clips: four pictures each; the document of a clip's number gives its length and words ---------------------

_CLIPS = f"""{_HASHES}, f AS (SELECT vec_id // 4 AS clip, vec_id, phash FROM h), d AS (SELECT doc_id AS clip, n_chars, list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS ts FROM documents),
p AS (SELECT DISTINCT a.clip AS ka, b.clip AS kb FROM f a JOIN f b ON b.clip = a.clip + 1),
x AS (SELECT ka, kb, a.vec_id AS va, b.vec_id AS vb, hamming(a.phash, b.phash)::DOUBLE AS d FROM p JOIN f a ON a.clip = ka JOIN f b ON b.clip = kb),
l AS (SELECT ka, avg(m) AS m FROM (SELECT ka, va, min(d) AS m FROM x GROUP BY ka, va) GROUP BY ka), r AS (SELECT ka, avg(m) AS m FROM (SELECT ka, vb, min(d) AS m FROM x GROUP BY ka, vb) GROUP BY ka),
o AS (SELECT ka, count(DISTINCT va) = count(DISTINCT vb) AS same FROM x GROUP BY ka), g AS (SELECT ka, avg(d) AS mean, median(d) AS mid FROM x WHERE va % 4 = vb % 4 GROUP BY ka),
z AS (SELECT p.ka, p.kb, round(abs(da.n_chars - db.n_chars)::DOUBLE / greatest(da.n_chars, db.n_chars), 6) AS duration_delta, round(CASE WHEN len(da.ts) + len(db.ts) = 0 THEN 0 ELSE len(list_intersect(da.ts, db.ts))::DOUBLE / len(list_distinct(list_concat(da.ts, db.ts))) END, 6) AS jaccard,
round(CASE WHEN same THEN g.mean ELSE 64 END, 6) AS aligned_mean, round(CASE WHEN same THEN g.mid ELSE 64 END, 6) AS aligned_median, round(l.m, 6) AS left_best, round(r.m, 6) AS right_best, round(greatest(l.m, r.m), 6) AS best
FROM p JOIN l USING (ka) JOIN r USING (ka) JOIN o USING (ka) JOIN g USING (ka) JOIN d da ON da.clip = p.ka JOIN d db ON db.clip = p.kb)"""


@query(f"WITH {_CLIPS} SELECT *, CASE WHEN duration_delta > 0.5 THEN NULL WHEN aligned_mean <= 31 THEN 'near_exact_reencode' WHEN best <= 28 AND jaccard >= 0.05 THEN 'likely_same_episode_edit' END AS kind FROM z")
def picture_pair_metrics(t: Tables) -> DataFrame:
    """Consecutive clips: lengths, words, and how far their pictures are apart, aligned and each to its nearest; and the class of the pair."""
    f = _hashes(t).groupBy(F.floor(F.col("vec_id") / 4).alias("clip")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "phash"))), lambda x: vectors.bits(x["phash"])).alias("frames"))
    d = t.documents.select(F.col("doc_id").alias("clip"), F.col("n_chars").cast("double").alias("n"), text.tokens(F.col("text"), 3).alias("ts"))
    clips = f.join(d, "clip")
    a = clips.select(F.col("clip").alias("ka"), F.struct("frames", "n", "ts").alias("a"))
    b = clips.select((F.col("clip") - 1).alias("ka"), F.col("clip").alias("kb"), F.struct("frames", "n", "ts").alias("b"))
    alike = F.coalesce(F.try_divide(F.size(F.array_intersect("a.ts", "b.ts")), F.size(F.array_union("a.ts", "b.ts"))), F.lit(0.0))
    m = a.join(b, "ka").select("ka", "kb", F.round(F.abs(F.col("a.n") - F.col("b.n")) / F.greatest("a.n", "b.n"), 6).alias("duration_delta"), F.round(alike, 6).alias("jaccard"), *[c.alias(k) for k, c in vectors.frame_metrics(F.col("a.frames"), F.col("b.frames")).items()])
    kind = F.when(F.col("duration_delta") > 0.5, None).when(F.col("aligned_mean") <= 31, "near_exact_reencode").when((F.col("best") <= 28) & (F.col("jaccard") >= 0.05), "likely_same_episode_edit")
    return m.withColumn("kind", kind)


@query("""WITH f AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), b AS (SELECT *, list_transform(e, lambda x: least(greatest(floor((x + 0.4) / 0.1), 0), 7)) AS s FROM f), h AS (SELECT label, vec_id, e, list_transform(range(8), lambda i: len(list_filter(s, lambda x: x = i))) AS h FROM b),
p AS (SELECT label, e, h, lag(e) OVER w AS e0, lag(h) OVER w AS h0 FROM h WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
d AS (SELECT label, list_avg(list_transform(range(1, 65), lambda i: abs(e[i] - e0[i]))) AS m, sqrt(greatest(0, 1 - list_sum(list_transform(range(1, 9), lambda i: sqrt(h[i] * h0[i]::DOUBLE))) / sqrt(list_sum(h) * list_sum(h0)::DOUBLE))) AS x FROM p WHERE e0 IS NOT NULL)
SELECT label, count(*) AS pairs, round(avg(m), 6) AS motion_mean, round(max(m), 6) AS motion_max, round(avg(x), 6) AS histogram_mean, round(avg(CASE WHEN x > 0.25 THEN 1.0 ELSE 0.0 END), 6) AS cuts FROM d GROUP BY label""")
def frame_cuts(t: Tables) -> DataFrame:
    """Change between consecutive pictures of a label by pixel and by histogram, and the share of hard cuts. Pictures are numbered in
    ranges, and each joins the one before it, so a label with most pictures isn't one task."""
    e = t.embeddings.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("h", vectors.histogram(F.col("e"), -0.4, 0.4, 8))
    n = ranks.numbered(e, ["label"], ["vec_id"], "n").select("label", "n", "e", "h")
    before = n.select(F.col("label").alias("l"), (F.col("n") + 1).alias("m"), F.col("e").alias("e0"), F.col("h").alias("h0"))
    d = n.join(before, F.col("label").eqNullSafe(F.col("l")) & (F.col("n") == F.col("m")))
    motion = F.aggregate(F.zip_with("e", "e0", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("e")
    d = d.select("label", motion.alias("m"), vectors.bhattacharyya(F.col("h"), F.col("h0")).alias("x"))
    return d.groupBy("label").agg(n_rows().alias("pairs"), F.round(F.avg("m"), 6).alias("motion_mean"), F.round(F.max("m"), 6).alias("motion_max"), F.round(F.avg("x"), 6).alias("histogram_mean"), F.round(F.avg((F.col("x") > 0.25).cast("double")), 6).alias("cuts"))


# --- a rule with a test side -------------------------------------------------------------------------------------

_RULE = f"""d AS (SELECT d.doc_id, n_chars::DOUBLE AS v, l.quality = 1 AS y, CASE WHEN ('0x' || substr(sha256('rule:' || (d.doc_id // 10)), 1, 12))::UBIGINT / 281474976710656.0 < 0.6 THEN 'train' WHEN ('0x' || substr(sha256('rule:' || (d.doc_id // 10)), 1, 12))::UBIGINT / 281474976710656.0 < 0.8 THEN 'calibration' ELSE 'test' END AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL),
u AS (SELECT DISTINCT v FROM d WHERE s = 'train'), q AS (SELECT unnest(list_distinct(CASE WHEN (SELECT count(*) FROM u) > 100 THEN (SELECT quantile_cont(v, [{', '.join(str(i / 100) for i in range(101))}]) FROM u) ELSE (SELECT list(v) FROM u) END)) AS cut), k AS (SELECT unnest(['ge', 'le']) AS direction),
h AS (SELECT s, y, direction, cut, CASE direction WHEN 'ge' THEN v >= cut ELSE v <= cut END AS h FROM d, q, k),
m AS (SELECT direction, cut, round((count(*) FILTER (s = 'train' AND y AND h)::DOUBLE / greatest(count(*) FILTER (s = 'train' AND y), 1) + count(*) FILTER (s = 'train' AND NOT y AND NOT h)::DOUBLE / greatest(count(*) FILTER (s = 'train' AND NOT y), 1)) / 2, 9) AS train,
round((count(*) FILTER (s = 'test' AND y AND h)::DOUBLE / greatest(count(*) FILTER (s = 'test' AND y), 1) + count(*) FILTER (s = 'test' AND NOT y AND NOT h)::DOUBLE / greatest(count(*) FILTER (s = 'test' AND NOT y), 1)) / 2, 9) AS test,
count(*) FILTER (s = 'test' AND y AND h) AS tp, count(*) FILTER (s = 'test' AND NOT y AND h) AS fp, count(*) FILTER (s = 'test' AND y AND NOT h) AS fn, count(*) FILTER (s = 'test' AND NOT y AND NOT h) AS tn FROM h GROUP BY direction, cut HAVING count(*) FILTER (s = 'train') >= 10 AND count(*) FILTER (s = 'test') >= 5),
b AS (SELECT * FROM m ORDER BY train DESC, direction, cut LIMIT 1)"""


def _valued(t: Tables) -> DataFrame:
    d = t.labels.where("quality IS NOT NULL").join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", F.col("n_chars").cast("double").alias("v"), (F.col("quality") == 1).alias("y"), hashing.split("rule", F.floor(F.col("doc_id") / 10)).alias("s"))


@query(f"WITH {_RULE} SELECT direction, round(cut, 6) AS cut, train, test, tp, fp, fn, tn FROM b")
def held_out_rule(t: Tables) -> DataFrame:
    """The best cut through a feature on one side of a split by tens of documents, of 101 quantiles of its values, and its metrics on another."""
    return experiments.best_rule(_valued(t), "v", F.col("y"), F.col("s")).withColumn("cut", F.round("cut", 6))


@query(f"WITH {_RULE} SELECT doc_id, v, y, CASE direction WHEN 'ge' THEN v >= cut ELSE v <= cut END AS predicted FROM d, b WHERE s = 'test' AND (CASE direction WHEN 'ge' THEN v >= cut ELSE v <= cut END) <> y")
def held_out_errors(t: Tables) -> DataFrame:
    """What that rule gets wrong on the test side, a row each."""
    d = _valued(t)
    return experiments.rule_errors(d, "v", F.col("y"), F.col("s"), experiments.best_rule(d, "v", F.col("y"), F.col("s"))).drop("s")


# --- search queries ----------------------------------------------------------------------------------------------

SEARCHES = ["cutting in line at the queue", "Rude customer yells", "loud music speakerphone on bus seat", None, "roommate leaves trash", "neighbour blocks driveway", "kids taking turns and sharing", "LATE TO MEETING again", "hold the door etiquette", "bully and a bystander who intervenes", "table manners", "cute cats", "takes credit, then lies to boss", ""]
OUTCOMES = {"enumerated": ([0, 3, 9, None], 859), "witnessed": ([0, 1], 863), "active": ([True, False, True, None], 877)}


@query("WITH a AS (" + atoms_sql("documents", "doc_id", OUTCOMES) + f"), d AS (SELECT doc_id, coalesce({pick_sql('doc_id', SEARCHES, 881)}, '') AS q FROM documents), c AS (SELECT doc_id, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(q, '{p}', 'i') THEN '{n}' END" for n, p in cues.QUERY_CONCEPTS.items()) + "], lambda x: x IS NOT NULL)) AS concept FROM d) SELECT concept, count(*) AS queries, count(*) FILTER (active) AS active, sum(coalesce(enumerated, 0))::BIGINT AS enumerated, sum(witnessed)::BIGINT AS witnessed FROM c JOIN a USING (doc_id) GROUP BY concept")
def query_concepts(t: Tables) -> DataFrame:
    """Searches and their outcomes by concept; one counts for each concept that it belongs to."""
    d = with_atoms(t.documents, "doc_id", OUTCOMES).withColumn("concept", F.explode(cues.concepts(pick("doc_id", SEARCHES, 881))))
    return d.groupBy("concept").agg(n_rows().alias("queries"), F.count_if("active").alias("active"), F.sum(F.coalesce("enumerated", F.lit(0))).alias("enumerated"), F.sum("witnessed").alias("witnessed"))


@query(f"""WITH {EV}, g AS (SELECT event_type, max(s)::DOUBLE AS recent, CASE event_type WHEN 'error' THEN 0.0 ELSE 1.0 END AS weight FROM e GROUP BY event_type)
SELECT event_type, round(greatest(0.0, 3000000.0 - recent) + 1 + ('0x' || substr(sha256('j:' || event_type), 1, 12))::UBIGINT / 281474976710656.0, 6) AS score FROM g WHERE weight > 0 ORDER BY score DESC, event_type LIMIT 1""")
def jittered_pick(t: Tables) -> DataFrame:
    w = F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)
    return scheduling.staleness_pick(seconds(t), "event_type", F.col("s").cast("double"), F.lit(3000000.0), w, seed="j").select("event_type", F.round("score", 6).alias("score"))


# --- samples in rounds ---------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id, lang || '/' || (n_chars % 3) AS stratum FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('v:' || doc_id), doc_id) AS turn FROM p)
SELECT doc_id, stratum, turn FROM r ORDER BY turn, sha256('v:' || stratum), stratum LIMIT 40""")
def prior_exclusion_rounds(t: Tables) -> DataFrame:
    """A batch for review of what no earlier batch held: strata in shuffled order take turns over shuffled rows."""
    new = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return sampling.round_robin(new, "doc_id", F.concat("lang", F.lit("/"), (F.col("n_chars") % 3).cast("string")), "v", 40).select("doc_id", "stratum", "turn")


@query("""WITH r AS (SELECT doc_id, lang AS stratum, row_number() OVER (PARTITION BY lang ORDER BY sha256('bp:' || doc_id), doc_id) AS turn FROM documents) SELECT doc_id, stratum, turn FROM r ORDER BY turn, stratum LIMIT 33""")
def platform_balanced_pick(t: Tables) -> DataFrame:
    """Platforms by name take turns over their shuffled rows."""
    return sampling.round_robin(t.documents.select("doc_id", "lang"), "doc_id", F.col("lang"), "bp", 33, by_name=True).select("doc_id", "stratum", "turn")


@query()
def source_disjoint_rounds(t: Tables) -> DataFrame:
    """Cue tuples take turns, no source twice, and too few are an error. Turn by turn, so not SQL: tests compare it with the plain loop."""
    found = F.array_compact(F.array(F.when(F.col("n_chars") % 2 == 0, "even"), F.when(F.col("lang") == "en", "en"), F.when(F.col("n_chars") > 2000, "long")))
    d = t.documents.select("doc_id", "source", F.coalesce(F.nullif(F.array_join(F.array_sort(found), "+"), F.lit("")), F.lit("<no-cue>")).alias("stratum"))
    return sampling.strata_rounds(d, "doc_id", "source", "stratum", "rounds", 15)


SHARES = {"first": 1, "second": 10, "third": 9}


@query("""WITH b AS (SELECT doc_id, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT % 20 AS bucket FROM documents) SELECT CASE WHEN bucket < 1 THEN 'first' WHEN bucket < 11 THEN 'second' ELSE 'third' END AS worker, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM b GROUP BY 1""")
def assigned_workers(t: Tables) -> DataFrame:
    """The rows of each worker by buckets of a digest: 5, 50 and 45 in a hundred."""
    return t.documents.groupBy(hashing.worker(F.col("doc_id"), SHARES).alias("worker")).agg(n_rows().alias("n"), F.sum("doc_id").alias("ids"))
