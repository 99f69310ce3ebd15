"""Splits, samples, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import ranks, sampling
from .registry import Tables, query

SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
SECONDS_SQL = "CAST(floor(epoch(ts) - 1704067200) AS BIGINT)"


@query("""SELECT doc_id, source, CASE WHEN f < 0.6 THEN 'train' WHEN f < 0.8 THEN 'calibration' ELSE 'test' END AS part FROM
 (SELECT doc_id, source, ('0x' || substr(sha256('label_model_v1_split:' || source), 1, 12))::BIGINT / 281474976710656.0 AS f FROM documents)""")
def source_disjoint_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", hashing.split("label_model_v1_split", F.col("source")).alias("part"))


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(sha1('spot:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.1")
def hash_bernoulli_sample(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").where(hashing.bernoulli("spot", F.col("doc_id"), 0.1))


@query("SELECT user_id, CAST(('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 16))::UBIGINT % 7 AS BIGINT) AS shard, count(*) AS n FROM events GROUP BY 1, 2")
def stable_shard(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", hashing.shard(F.col("user_id"), 7).alias("shard"), "n")


@query("SELECT event_id, 'win_' || substr(sha256(user_id || chr(0) || event_type), 1, 20) AS window_id FROM events WHERE user_id IS NOT NULL")
def stable_window_id(t: Tables) -> DataFrame:
    return t.events.where("user_id IS NOT NULL").select("event_id", hashing.window_id("win_", F.col("user_id"), F.col("event_type")).alias("window_id"))


@query("""WITH d AS (SELECT doc_id, lang AS stratum, row_number() OVER (PARTITION BY lang ORDER BY sha256('rr:' || doc_id), doc_id) AS turn FROM documents)
 SELECT doc_id, stratum, turn FROM d ORDER BY turn, sha256('rr:' || stratum), stratum LIMIT 60""")
def stratified_round_robin(t: Tables) -> DataFrame:
    return sampling.round_robin(t.documents.select("doc_id", "lang"), "doc_id", F.col("lang"), "rr", 60).select("doc_id", "stratum", "turn")


@query("SELECT source, arg_min(doc_id, sha256('rep:' || doc_id)) AS doc_id FROM documents GROUP BY source")
def representative_per_source(t: Tables) -> DataFrame:
    return sampling.representative(t.documents.select("source", "doc_id"), "source", "doc_id", "rep")


@query("""WITH RECURSIVE d AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY lang, sha256('cohort:' || doc_id), doc_id) AS k FROM documents), f AS (SELECT CAST(0 AS BIGINT) AS k, '' AS lang, 0 AS n, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS source, false AS taken
UNION ALL SELECT k, lang, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN list_append(used, source) ELSE used END, doc_id, source, ok FROM (SELECT d.k, d.lang, CASE WHEN f.lang = d.lang THEN f.n ELSE 0 END AS n, f.used, d.doc_id, d.source, CASE WHEN f.lang = d.lang THEN f.n ELSE 0 END < 12 AND len(list_filter(f.used, lambda x: x = d.source)) < 2 AS ok FROM f JOIN d ON d.k = f.k + 1))
SELECT doc_id, lang, source FROM f WHERE taken""")
def capped_cohort(t: Tables) -> DataFrame:
    return sampling.capped_cohort(t.documents, "doc_id", "lang", "source", "cohort", 12, 2)


@query(f"""WITH u AS (SELECT user_id, count(*) AS n, sum(value) AS v FROM events GROUP BY user_id), c AS (SELECT user_id, cume_dist() OVER (ORDER BY n) AS a, cume_dist() OVER (ORDER BY round(v, 3)) AS b FROM u)
 SELECT user_id, round((a + b) / 2, 6) AS activity, CASE WHEN (a + b) / 2 <= 0.2 THEN 'low' WHEN (a + b) / 2 BETWEEN 0.4 AND 0.6 THEN 'middle' WHEN (a + b) / 2 >= 0.8 THEN 'high' ELSE 'between' END AS band FROM c""")
def activity_percentile_bands(t: Tables) -> DataFrame:
    u = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("v"))
    x = (F.col("by_n") + F.col("by_v")) / 2
    u = ranks.percentile_of(ranks.percentile_of(u, "n", "by_n"), "v", "by_v").withColumn("a", x)
    x = F.col("a")
    return u.select("user_id", F.round("a", 6).alias("activity"), F.when(x <= 0.2, "low").when(x.between(0.4, 0.6), "middle").when(x >= 0.8, "high").otherwise("between").alias("band"))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders), b AS (SELECT o_totalprice, CAST(len(list_filter(q.q, lambda x: x < o_totalprice)) AS BIGINT) AS band FROM orders, q)
 SELECT band, count(*) AS n, round(min(o_totalprice), 2) AS lowest, round(max(o_totalprice), 2) AS highest FROM b GROUP BY band""")
def quantile_bands(t: Tables) -> DataFrame:
    b = sampling.bands(t.orders.select("o_totalprice"), "o_totalprice", [0.2, 0.4, 0.6, 0.8])
    return b.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("o_totalprice"), 2).alias("lowest"), F.round(F.max("o_totalprice"), 2).alias("highest"))


@query("""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('top:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, source, k FROM d WHERE k <= 2""")
def per_group_cap(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    d = t.documents.select("doc_id", "source").withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(hashing.order("top", F.col("doc_id")), "doc_id")).cast("long"))
    return d.where("k <= 2")


@query("""WITH p AS (SELECT doc_id, source, 'new' AS cohort, row_number() OVER (ORDER BY sha256('u:' || doc_id), doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
 SELECT doc_id, source, cohort FROM p WHERE k <= 40""")
def prior_exclusion_sample(t: Tables) -> DataFrame:
    new = t.documents.select("doc_id", "source").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return new.orderBy(hashing.order("u", F.col("doc_id")), "doc_id").limit(40).select("doc_id", "source", F.lit("new").alias("cohort"))
