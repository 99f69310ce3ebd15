"""Time: overlaps, as-of, islands, tiling, queues. Seconds count from the start of the event table's year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import intervals, scheduling
from .registry import Tables, query
from .sampling_queries import SECONDS, SECONDS_SQL

EV = f"e AS (SELECT event_id, user_id, event_type, value, {SECONDS_SQL} AS s FROM events)"


def seconds(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value", F.expr(SECONDS).alias("s"))


@query(f"""WITH {EV} SELECT p.event_id AS anchor, x.event_id AS near, x.s - p.s AS rebased FROM e p JOIN e x ON p.user_id = x.user_id AND x.s <= p.s + 1800 AND x.s + 60 >= p.s - 1800 WHERE p.event_type = 'purchase' AND x.event_type = 'view'""")
def interval_overlap_context(t: Tables) -> DataFrame:
    """Views of a minute that overlap the half hour around a purchase."""
    e = seconds(t)
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("anchor"), F.col("s").alias("ps"), F.col("s").alias("pe"))
    x = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("near"), F.col("s").alias("xs"), (F.col("s") + 60).alias("xe"))
    return intervals.overlap_join(x, p, ["user_id"], ("xs", "xe"), ("ps", "pe"), 3600, True, 1800).select("anchor", "near", (F.col("xs") - F.col("ps")).alias("rebased"))


@query(f"""WITH {EV} SELECT v.event_id FROM e v WHERE v.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM e z WHERE z.event_type = 'error' AND z.user_id = v.user_id AND v.s <= z.s + 3600 AND v.s + 10 >= z.s - 3600)""")
def exclusion_zone_negatives(t: Tables) -> DataFrame:
    e = seconds(t)
    v = e.where("event_type = 'view'").select("event_id", "user_id", "s", (F.col("s") + 10).alias("se"))
    z = e.where("event_type = 'error'").select("user_id", F.col("s").alias("zs"), F.col("s").alias("ze"))
    return intervals.outside(v, z, ["user_id"], ("s", "se"), ("zs", "ze"), 3600, 7200).select("event_id")


@query(f"""WITH {EV} SELECT p.event_id, (SELECT x.value FROM e x WHERE x.user_id = p.user_id AND x.event_type = 'click' AND x.s <= p.s ORDER BY x.s DESC LIMIT 1) AS last_value FROM e p WHERE p.event_type = 'purchase'""")
def asof_last_impact(t: Tables) -> DataFrame:
    e = seconds(t)
    p, c = e.where("event_type = 'purchase'").select("event_id", "user_id", "s"), e.where("event_type = 'click'")
    return intervals.as_of(p, c, ["user_id"], "s", "s", "value", "last_value").select("event_id", "last_value")


@query("""SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, CAST(count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS user_turns_before FROM conversations""")
def previous_speaker(t: Tables) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous"), F.count(F.when(F.col("role") == "user", 1)).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("user_turns_before"))


@query(f"""WITH {EV}, g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) <= 7200 THEN 0 ELSE 1 END AS b FROM e), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, event_id) AS island FROM g)
 SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(s) AS first_s, max(s) AS last_s FROM i GROUP BY user_id, island""")
def gap_sessions(t: Tables) -> DataFrame:
    g = intervals.gap_islands(seconds(t), ["user_id"], F.col("s"), 7200, ["event_id"])
    return g.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first_s"), F.max("s").alias("last_s"))


@query(f"""WITH {EV}, x AS (SELECT *, s + CAST(value * 60 AS BIGINT) AS f FROM e WHERE value >= 0), m AS (SELECT *, CASE WHEN s <= max(f) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM x),
 g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM m), a AS (SELECT user_id, k, min(s) AS first_s, max(f) AS last_f, max(value) AS strongest, count(*) AS n FROM g GROUP BY user_id, k),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strongest DESC, first_s) AS rn FROM a) SELECT user_id, first_s, last_f, strongest, n FROM r WHERE rn <= 5""")
def overlap_merge(t: Tables) -> DataFrame:
    """Overlapping spans merged, the five strongest of each user."""
    e = seconds(t).where("value >= 0").withColumn("f", F.expr("s + CAST(round(value * 60) AS BIGINT)"))
    g = intervals.merge_overlaps(e, ["user_id"], "s", "f", ["event_id"]).groupBy("user_id", "group").agg(F.min("s").alias("first_s"), F.max("f").alias("last_f"), F.max("value").alias("strongest"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("strongest"), "first_s"))).where("rn <= 5").select("user_id", "first_s", "last_f", "strongest", "n")


@query(f"""WITH {EV}, h AS (SELECT event_type, CAST(floor(s / 3600.0) AS BIGINT) AS hour, max(value) AS peak FROM e GROUP BY 1, 2), o AS (SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY event_type ORDER BY hour) <= 2 THEN 0 ELSE 1 END AS b FROM h WHERE peak >= 30),
 i AS (SELECT *, sum(b) OVER (PARTITION BY event_type ORDER BY hour) AS k FROM o) SELECT event_type, min(hour) AS first_hour, max(hour) AS last_hour, max(peak) AS peak FROM i GROUP BY event_type, k""")
def threshold_runs(t: Tables) -> DataFrame:
    """Runs of hours whose peak reaches a threshold; a gap of one hour doesn't end a run."""
    h = seconds(t).groupBy("event_type", F.floor(F.col("s") / 3600).alias("hour")).agg(F.max("value").alias("peak")).where("peak >= 30")
    g = intervals.gap_islands(h, ["event_type"], F.col("hour"), 2, [])
    return g.groupBy("event_type", "island").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.max("peak").alias("peak")).drop("island")


@query(f"""WITH {EV}, d AS (SELECT DISTINCT user_id, CAST(floor(s / 86400.0) AS BIGINT) AS day FROM e), g AS (SELECT user_id, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM d), r AS (SELECT user_id, k, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, max(n) AS longest_run FROM r GROUP BY user_id""")
def longest_run(t: Tables) -> DataFrame:
    return intervals.longest_run(seconds(t).select("user_id", F.floor(F.col("s") / 86400).alias("day")), ["user_id"], "day")


@query(f"""WITH RECURSIVE {EV}, d AS (SELECT DISTINCT user_id, CAST(s AS DOUBLE) AS s FROM e), g AS (SELECT user_id, min(s) AS s FROM d GROUP BY user_id UNION ALL SELECT g.user_id, (SELECT min(d.s) FROM d WHERE d.user_id = g.user_id AND d.s >= g.s + 3600) AS s FROM g WHERE EXISTS (SELECT 1 FROM d WHERE d.user_id = g.user_id AND d.s >= g.s + 3600)) SELECT user_id, s FROM g""")
def greedy_thinning(t: Tables) -> DataFrame:
    """Events of a user an hour or more from the last one kept."""
    d = seconds(t).where("user_id IS NOT NULL").select("user_id", F.col("s").cast("double").alias("s")).distinct()
    return intervals.thinned(d, "user_id", "s", 3600.0, [])


@query("""WITH d AS (SELECT doc_id, n_chars::DOUBLE AS n, greatest(0.0, n_chars - 1200.0) AS last FROM documents), r AS (SELECT doc_id, n, last, unnest(range(0, CAST(floor(last / 800) AS BIGINT) + 1)) * 800.0 AS s FROM d),
 x AS (SELECT doc_id, n, CAST(s AS DOUBLE) AS s FROM r UNION ALL SELECT doc_id, n, last FROM d WHERE last - floor(last / 800) * 800 > 1e-6) SELECT doc_id, s AS start, least(n, s + 1200) AS stop FROM x""")
def tiling_windows(t: Tables) -> DataFrame:
    """Windows of 1200 characters every 800, the last one aligned to the end."""
    n = F.col("n_chars").cast("double")
    return t.documents.select("doc_id", n.alias("n"), F.explode(intervals.tiles(n, 1200.0, 800.0)).alias("start")).select("doc_id", "start", F.least("n", F.col("start") + 1200).alias("stop"))


@query("""SELECT doc_id, true AS covered, CAST(CASE WHEN n_chars <= 1200 THEN 1 ELSE floor((n_chars - 1200) / 800.0) + 1 + CASE WHEN (n_chars - 1200) % 800 > 0 THEN 1 ELSE 0 END END AS BIGINT) AS windows FROM documents""")
def tiling_coverage(t: Tables) -> DataFrame:
    """No gap between a window and the furthest end before it, and the last end is the text's."""
    w = W.partitionBy("doc_id").orderBy("start")
    x = tiling_windows(t).withColumn("before", F.coalesce(F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    g = x.groupBy("doc_id").agg(F.bool_and(F.col("before") + 1e-6 >= F.col("start")).alias("ok"), F.max("stop").alias("end"), F.count(F.lit(1)).alias("windows"))
    return g.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", (F.col("ok") & (F.col("end") >= F.col("n_chars"))).alias("covered"), "windows")


@query(f"""WITH {EV}, r AS (SELECT *, event_type = 'purchase' AS f, event_type = 'error' AS x FROM e), g AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM r),
 q AS (SELECT *, CAST(sum(CASE WHEN NOT f AND NOT x THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, k ORDER BY s, event_id) AS BIGINT) AS streak FROM g)
 SELECT event_id, streak, CASE WHEN f THEN NULL WHEN x THEN 30.0 ELSE least(7200.0, 600.0 * power(2.0, greatest(0, streak - 1))) END::DOUBLE AS cooldown FROM q""")
def cooldown_replay(t: Tables) -> DataFrame:
    r = scheduling.cooldown_replay(seconds(t), ["user_id"], ["s", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "error", 600, 30, 7200)
    return r.select("event_id", "streak", "cooldown")


@query(f"""WITH {EV}, g AS (SELECT event_type, max(s)::DOUBLE AS recent, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'error' THEN 0.0 ELSE 3.0 END AS weight FROM e GROUP BY event_type)
 SELECT event_type, recent, weight::DOUBLE AS weight, weight::DOUBLE * (greatest(0.0, 3000000.0 - recent) + 1) AS score FROM g WHERE weight > 0 ORDER BY score DESC, event_type LIMIT 1""")
def staleness_pick(t: Tables) -> DataFrame:
    w = F.when(F.col("event_type") == "view", 1.0).when(F.col("event_type") == "click", 2.0).when(F.col("event_type") == "error", 0.0).otherwise(3.0)
    return scheduling.staleness_pick(seconds(t), "event_type", F.col("s").cast("double"), F.lit(3000000.0), w).select("event_type", "recent", "weight", "score")


@query("""SELECT user_id, count(*) AS processed, CASE WHEN count(*) >= 20 AND count(*) FILTER (event_type = 'purchase')::DOUBLE / count(*) < 0.15 THEN 0 ELSE 1 END AS active FROM events GROUP BY user_id""")
def prune_underperformers(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("event_type") == "purchase").alias("hits"))
    return scheduling.prune(g, F.col("processed"), F.col("hits"), 20, 0.15).select("user_id", "processed", "active")


@query(f"""WITH {EV}, a AS (SELECT p.event_id, x.event_id AS near, x.s - p.s AS d, row_number() OVER (PARTITION BY p.event_id ORDER BY x.s DESC, x.event_id DESC) AS k FROM e p JOIN e x ON p.user_id = x.user_id AND x.s < p.s AND x.s >= p.s - 86400 WHERE p.event_type = 'purchase') SELECT event_id, near, d FROM a WHERE k <= 4""")
def nearest_before(t: Tables) -> DataFrame:
    """The four last events of the day before each purchase."""
    e = seconds(t)
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", (F.col("s") - 86400).alias("lo"), F.col("s").alias("hi"))
    x = e.select("user_id", F.col("event_id").alias("near"), F.col("s").alias("xs"), F.col("s").alias("xe"))
    j = intervals.overlap_join(p, x, ["user_id"], ("lo", "hi"), ("xs", "xe"), 172800).where("xs < hi")
    return j.withColumn("k", F.row_number().over(W.partitionBy("event_id").orderBy(F.desc("xs"), F.desc("near")))).where("k <= 4").select("event_id", "near", (F.col("xs") - F.col("hi")).alias("d"))


@query(f"""WITH {EV} SELECT event_id FROM e c WHERE event_type <> 'click' OR EXISTS (SELECT 1 FROM e a WHERE a.event_type = 'purchase' AND a.user_id = c.user_id AND abs(a.s - c.s) <= 7200)""")
def cooccur_gate(t: Tables) -> DataFrame:
    """Clicks count only beside a purchase of the same user within two hours; all else counts."""
    return intervals.beside(seconds(t), ["user_id"], "s", F.col("event_type") == "click", F.col("event_type") == "purchase", 7200).select("event_id")
