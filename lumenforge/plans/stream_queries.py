"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import intervals, ranks
from ..operators.shared import folder
from ..sources.feed import Pages
from ..streaming import crawl, jobs, status
from .interval_queries import EV, seconds
from .registry import Tables, query


@query(f"""WITH {EV}, d AS (SELECT DISTINCT event_id, user_id, s FROM e), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) < 7200 THEN 0 ELSE 1 END AS b FROM d), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM g)
 SELECT user_id, count(*) AS n FROM i GROUP BY user_id, k""")
def session_windows(t: Tables) -> DataFrame:
    """The batch form of the session stream: sessions of two hours by user. Events just two hours apart are of two sessions; Spark's own
    session windows would merge them."""
    e = seconds(t).select("event_id", "user_id", "s").distinct()
    g = intervals.gap_islands(e, ["user_id"], F.col("s"), 7199, ["event_id"])  # of whole seconds, fewer than 7,200
    return g.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n")).select("user_id", "n")


@query("""WITH e AS (SELECT DISTINCT event_id, user_id, ts FROM events), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 2 HOUR AS z, count(*) AS n FROM i GROUP BY user_id, k) SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(z, '%Y-%m-%d %H:%M:%S') AS "end", n FROM s, m WHERE z <= mark""")
def stream_dedup_sessions(t: Tables) -> DataFrame:
    """Sessions that the watermark, a day behind the newest event, has closed; open ones aren't written yet."""
    d = jobs.run_to_table(jobs.sessions(jobs.event_stream(t.spark, t.dir)), "sessions")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return d.select("user_id", shown("start"), shown("end"), "n")


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), p AS (SELECT user_id, max(k) FILTER (event_type = 'purchase') AS last FROM e GROUP BY user_id), s AS (SELECT e.user_id, count(*) FILTER (event_type NOT IN ('purchase', 'error') AND k > coalesce(last, 0)) AS streak FROM e JOIN p ON e.user_id IS NOT DISTINCT FROM p.user_id GROUP BY e.user_id)
SELECT user_id, streak, CASE WHEN streak = 0 THEN 0.0 ELSE least(7200.0, 600.0 * 2 ** least(streak - 1, 20)) END::DOUBLE AS cooldown FROM s""")
def stream_cooldown(t: Tables) -> DataFrame:
    return jobs.cooldowns(jobs.event_stream(t.spark, t.dir))


@query(f"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '(?s)://(.*)', 1) AS native_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages), c AS (SELECT page_id, regexp_extract(host, '([^.]*)$', 1) AS platform, native_id, title FROM u)
SELECT page_id, platform, native_id, platform || '__' || regexp_replace(native_id, '[^A-Za-z0-9_-]', '_', 'g') AS uid, title, CAST((row_number() OVER (PARTITION BY platform ORDER BY page_id NULLS FIRST, native_id, title NULLS FIRST) - 1) // {Pages.size} AS INTEGER) AS page FROM c WHERE platform <> ''""")
def feed_candidates(t: Tables) -> DataFrame:
    """Pages as candidates of the platforms that their hosts name, and the page of its platform's feed that each is on; a url without a
    host names none. An id is the whole url after its scheme, made safe for file names."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    d = t.pages.select("page_id", F.substring_index(host, ".", -1).alias("platform"), F.regexp_extract("url", "(?s)://(.*)", 1).alias("native_id"), title.alias("title")).where("platform <> ''")
    n = ranks.numbered(d, ["platform"], ["page_id", "native_id", "title"], "place")
    uid = F.concat("platform", F.lit("__"), F.regexp_replace("native_id", "[^A-Za-z0-9_-]", "_"))
    return n.select("page_id", "platform", "native_id", uid.alias("uid"), "title", F.floor(F.col("place") / Pages.size).cast("int").alias("page"))


# --- status machine, crawl loop and monitor ---------------------------------------------------------

#: Which change of status an event stands for.
WANTED = {"view": "enumerated", "click": "pending_transcribe", "signup": "pending_detect", "purchase": "done", "error": "error"}
_WANTED = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WANTED.items()) + " END"
#: Items that are done may be seen again.
AGAIN = status.MACHINE | {"done": ["enumerated"]}


@query(f"""WITH RECURSIVE e AS (SELECT coalesce(user_id, -1) AS uid, event_id, ts, {_WANTED} AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT uid, 0::BIGINT AS k, NULL::BIGINT AS event_id, '' AS was, NULL::VARCHAR AS wanted, '' AS status, false AS ok FROM e GROUP BY uid
 UNION ALL SELECT uid, k, event_id, status, wanted, CASE WHEN ok THEN wanted ELSE status END, ok FROM (SELECT e.uid, e.k, e.event_id, r.status, e.wanted, coalesce((r.status, e.wanted) IN ({", ".join(f"('{a}', '{b}')" for a, v in AGAIN.items() for b in v)}), false) AS ok FROM r JOIN e ON e.uid = r.uid AND e.k = r.k + 1))
SELECT uid, event_id, was, wanted, status AS now, CASE WHEN ok THEN 'accepted' ELSE 'refused' END AS verdict FROM r WHERE k > 0""")
def status_stream(t: Tables) -> DataFrame:
    """Each event of a user as a wanted change of status, accepted or refused by the machine, in a stateful stream."""
    wanted = F.lit(None).cast("string")
    for k, v in WANTED.items():
        wanted = F.when(F.col("event_type") == k, v).otherwise(wanted)
    e = jobs.event_stream(t.spark, t.dir).select(F.coalesce("user_id", F.lit(-1)).alias("uid"), "event_id", "at", wanted.alias("wanted"))
    out = jobs.run_to_table(status.changes(e, AGAIN), "status")
    return out.select("uid", "event_id", "was", "wanted", "now", "verdict")


@query("""WITH c AS (SELECT md5(coalesce(text, '')) AS uid, coalesce(lang, '') AS platform, coalesce(source, '') AS query, n_chars AS duration, doc_id AS rank FROM documents), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY uid ORDER BY rank, platform, query) = 1),
n AS (SELECT platform, query, count(*) AS new, count(*) FILTER (duration > 1200) AS skipped FROM f GROUP BY platform, query) SELECT platform, query, count(*) AS returned, coalesce(any_value(n.new), 0) AS new, coalesce(any_value(n.new - n.skipped), 0) AS enqueued, coalesce(any_value(n.skipped), 0) AS skipped, CASE WHEN coalesce(any_value(n.new), 0) > 0 THEN 0 ELSE 1 END::BIGINT AS streak FROM c LEFT JOIN n USING (platform, query) GROUP BY platform, query""")
def crawl_loop(t: Tables) -> DataFrame:
    """Documents as a stream of candidates: each text is taken once, long ones are skipped, and each query's counts and streak are kept."""
    schema = t.documents.schema
    d = t.spark.readStream.schema(schema).parquet(f"{t.dir}/documents.parque[t]")  # a file, or a folder of files
    none = lambda c: F.coalesce(c, F.lit(""))
    c = d.select(F.md5(none("text")).alias("uid"), none("lang").alias("platform"), none("source").alias("query"), F.col("n_chars").cast("long").alias("duration"), F.col("doc_id").alias("rank"))
    base = f"{folder(t.spark)}/crawl-{uuid.uuid4().hex}"
    loop = crawl.Crawl(t.spark, base, max_pending=1 << 40)
    loop.run(c, f"{base}/state")
    return loop.stats.last()


_BACKLOG = {"error": 20, "view": 1_000_000}


@query(f"""WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events), k AS (SELECT DISTINCT event_type AS name FROM events), c AS (SELECT d.day, k.name, count(e.event_id) AS value FROM d CROSS JOIN k LEFT JOIN events e ON e.event_type = k.name AND date_trunc('day', e.ts) = d.day GROUP BY d.day, k.name),
o AS (SELECT *, lag(value) OVER (PARTITION BY name ORDER BY day) AS old, CASE name {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _BACKLOG.items())} END AS most FROM c)
SELECT strftime(day, '%Y-%m-%d') AS day, name, value, value - old AS change, list_filter([CASE WHEN value >= most THEN name || '_backlog_at_least_' || most END, CASE WHEN value < old * 0.5 THEN name || '_fell' END], lambda x: x IS NOT NULL) AS alerts FROM o""")
def snapshot_alerts(t: Tables) -> DataFrame:
    """Counts of each day as snapshots, the change since the day before, and alerts on backlogs and falls."""
    e = t.events.select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), F.col("event_type").alias("name"))
    n = e.groupBy("day", "name").agg(F.count(F.lit(1)).alias("value"))
    whole = n.select("day").distinct().crossJoin(F.broadcast(n.select("name").distinct()))  # days by kinds of events
    c = whole.join(n, ["day", "name"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    rows = c.withColumn("old", F.lag("value").over(W.partitionBy("name").orderBy("day"))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return crawl.compared(rows, _BACKLOG, 0.5)
