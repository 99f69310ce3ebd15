"""Reports, merges, reconciliation and duplicates over the star tables, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contracts, vectors
from ..operators import relational
from .registry import Tables, query, shared_sql

shared_sql("corpus_report_totals", "SELECT source, count(*) AS docs, count(DISTINCT text) AS texts, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM @documents GROUP BY source", "documents")
shared_sql("report_top_rates", "SELECT d.source, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS good, round(avg(CAST(l.quality AS DOUBLE)), 6) AS rate FROM @documents d JOIN @labels l ON d.doc_id = l.doc_id GROUP BY d.source HAVING count(*) >= 5 ORDER BY rate DESC, d.source LIMIT 10", "documents labels")
shared_sql("status_counts", "SELECT o_orderstatus AS status, coalesce(o_orderpriority, 'none') AS priority, count(*) AS n FROM @orders GROUP BY 1, 2", "orders")
shared_sql("ledger_stats", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS discounted FROM @lineitem GROUP BY 1, 2, 3", "lineitem")
shared_sql("coverage_ratios", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, round(CAST(count(DISTINCT user_id) AS DOUBLE) / count(*), 6) AS ratio FROM @events GROUP BY event_type", "events")
shared_sql("language_counts", "SELECT lang, count(*) AS n FROM @documents GROUP BY lang", "documents")
shared_sql("two_key_contingency", "SELECT d.lang, CAST(sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS toxic, CAST(sum(CASE WHEN l.toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS clean, CAST(sum(CASE WHEN l.toxic IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id GROUP BY d.lang", "documents labels")
shared_sql("domain_shares", "SELECT n_regionkey, n_name, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY n_regionkey), 6) AS share FROM @customer JOIN @nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_name", "customer nation")
shared_sql("strict_counts_with_zero_groups", "SELECT n.n_name, coalesce(c.n, 0) AS n FROM @nation n LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM @customer WHERE c_acctbal > 9900 GROUP BY c_nationkey) c ON n.n_nationkey = c.c_nationkey", "nation customer")
shared_sql("multi_axis_crosstab", "SELECT coalesce(r_name, '*') AS region, coalesce(c_mktsegment, '*') AS segment, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, round(avg(o_totalprice), 3) AS mean_price FROM @orders JOIN @customer ON o_custkey = c_custkey JOIN @nation ON c_nationkey = n_nationkey JOIN @region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (c_mktsegment), (o_orderpriority), ())", "orders customer nation region")
shared_sql("yield_by_dimension", "SELECT c_mktsegment, n_name, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS rate FROM @orders JOIN @customer ON o_custkey = c_custkey JOIN @nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name", "orders customer nation")
shared_sql("having_high_rate", "SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM @events GROUP BY user_id HAVING count(*) >= 10 AND sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) >= 0.2 * count(*)", "events")
shared_sql("intersect_users", "SELECT user_id FROM @events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM @events WHERE event_type = 'error'", "events")
shared_sql("except_users", "SELECT user_id FROM @events WHERE event_type = 'view' EXCEPT SELECT user_id FROM @events WHERE event_type = 'signup' AND value > 150", "events")
shared_sql("union_exclusions", "SELECT doc_id FROM @labels WHERE toxic = 1 UNION SELECT doc_id FROM @documents WHERE n_chars < 100", "labels documents")
shared_sql("not_exists_anti_join", "SELECT c.c_custkey FROM @customer c WHERE NOT EXISTS (SELECT 1 FROM @orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice > 150000)", "customer orders")
shared_sql("semi_join_latest", "SELECT o_orderkey, o_custkey FROM @orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM @orders GROUP BY o_custkey)", "orders")
shared_sql("supplier_cover", "SELECT s_nationkey, count(*) AS suppliers, round(avg(s_acctbal), 4) AS mean_balance FROM @supplier GROUP BY s_nationkey", "supplier")
shared_sql("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM @lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus", "lineitem")
shared_sql("parts_never_ordered", "SELECT p.p_partkey FROM @part p LEFT JOIN @lineitem l ON p.p_partkey = l.l_partkey AND l.l_quantity >= 48 WHERE l.l_partkey IS NULL", "part lineitem")
shared_sql("inventory_vs_retained", "SELECT d.source, count(*) AS records, count(l.doc_id) AS retained, greatest(count(*) - count(l.doc_id), 0) AS missing FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id GROUP BY d.source", "documents labels")
shared_sql("gap_classification", "SELECT CASE WHEN l.doc_id IS NULL AND d.n_chars < 100 THEN 'too_short' WHEN l.doc_id IS NULL THEN 'unattempted' WHEN l.toxic = 1 THEN 'failed' ELSE 'done' END AS state, count(*) AS n FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id GROUP BY 1", "documents labels")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return relational.latest(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'error' DESC, ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def success_wins_merge(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "event_type", "ts")
    return relational.success_wins(e, ["user_id"], F.col("event_type") != "error", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, bool_or(event_type = 'purchase') AS any_success, count(*) AS attempts FROM events GROUP BY user_id")
def any_success(t: Tables) -> DataFrame:
    return relational.any_success(t.events, ["user_id"], F.col("event_type") == "purchase")


@query("""WITH j AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
 SELECT c_mktsegment, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hits, round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 6) AS rate FROM j JOIN customer ON o_custkey = c_custkey WHERE rn = 1 GROUP BY c_mktsegment""")
def latest_judgment_yield(t: Tables) -> DataFrame:
    last = relational.latest(t.orders.select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return relational.yields(last.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), ["c_mktsegment"], F.col("o_orderstatus") == "F")


@query("""SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT CAST(ts AS DATE)) AS days, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS spent, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id""")
def profile_event_rollup(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct(F.to_date("ts")).alias("days"),
        F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)), 4).alias("spent"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
    )


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right_only' WHEN b.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS side
 FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id""")
def coverage_reconcile(t: Tables) -> DataFrame:
    return relational.reconcile(t.documents.where("lang = 'en'"), t.labels, "doc_id")


@query("""WITH n AS (SELECT doc_id, 1 - quality AS quality, CAST(NULL AS INTEGER) AS toxic FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT -1, 1, 1)
 SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.quality, o.quality) AS quality, coalesce(n.toxic, o.toxic) AS toxic, n.doc_id IS NOT NULL AS present FROM labels o FULL JOIN n ON o.doc_id = n.doc_id""")
def upsert_overlay(t: Tables) -> DataFrame:
    """Merge without clobbering: nulls of the new side leave the old values."""
    new = t.labels.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    one = t.spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
    return relational.overlay(t.labels.select("doc_id", "quality", "toxic"), new.unionByName(one), ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def pending_work(t: Tables) -> DataFrame:
    return relational.pending(t.documents.select("doc_id"), t.labels, ["doc_id"], F.col("toxic") == 0)


@query("""SELECT a.doc_id, min(b.doc_id) AS duplicate_of FROM documents a JOIN documents b ON lower(trim(a.text)) = lower(trim(b.text)) AND abs(a.n_chars - b.n_chars) <= 2 AND b.doc_id < a.doc_id GROUP BY a.doc_id""")
def content_duplicates(t: Tables) -> DataFrame:
    return relational.content_duplicates(t.documents.where("text IS NOT NULL"), "doc_id", F.sha2(F.lower(F.trim("text")), 256), "n_chars", 2)


@query("""SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)), round_even(n_chars / 2.0, 0) ORDER BY doc_id) AS rank FROM documents) WHERE rank > 1""")
def duplicate_losers(t: Tables) -> DataFrame:
    return relational.duplicate_losers(t.documents.select("doc_id", "text", "n_chars"), [F.sha2(F.lower(F.trim("text")), 256), F.bround(F.col("n_chars") / 2)], ["doc_id"]).select("doc_id", "rank")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
 SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 4) AS cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0""")
def vector_pairs_of_first(t: Tables) -> DataFrame:
    """Cosine of the search queries, every fiftieth vector, with all vectors of equal label; a label is salted into blocks."""
    v = t.embeddings.select("vec_id", "label", F.col("embedding").alias("e"))
    v = v.withColumn("w", vectors.dot(F.col("e"), F.col("e")))  # once for each vector, not for each pair
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), "label", F.col("e").alias("ea"), F.col("w").alias("wa"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    x = v.select(F.col("vec_id").alias("b"), "label", F.col("e").alias("eb"), F.col("w").alias("wb"), F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int").alias("salt"))
    cosine = F.try_divide(vectors.dot(F.col("ea"), F.col("eb")), F.sqrt("wa") * F.sqrt("wb"))
    return q.join(x, ["label", "salt"]).where("a <> b").select("a", "b", F.round(cosine, 4).alias("cosine"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
 SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 4) AS cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id""")
def vector_pairs(t: Tables) -> DataFrame:
    """Cosine of all pairs of equal label. Each label is cut into blocks, whose pairs are the key, so a common label is spread over tasks."""
    return relational.cosine_pairs(t.embeddings, "label", "vec_id", "embedding")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, label, e, lead(e) OVER (PARTITION BY label ORDER BY vec_id) AS f, lag(e) OVER (PARTITION BY label ORDER BY vec_id) AS g FROM v)
 SELECT vec_id, label, round(list_cosine_similarity(e, f), 4) AS next_sim, round(list_cosine_similarity(e, g), 4) AS prev_sim, coalesce(list_cosine_similarity(g, f) > list_cosine_similarity(e, f), false) AS sandwich FROM n""")
def voice_sandwich(t: Tables) -> DataFrame:
    """Is the neighbour before closer to the neighbour after than the vector itself is?"""
    from pyspark.sql import Window as W

    w = W.partitionBy("label").orderBy("vec_id")
    n = t.embeddings.select("vec_id", "label", F.col("embedding").alias("e"), F.lead("embedding").over(w).alias("f"), F.lag("embedding").over(w).alias("g"))
    sim = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), vectors.cosine(F.col(a), F.col(b)))
    return n.select("vec_id", "label", F.round(sim("e", "f"), 4).alias("next_sim"), F.round(sim("e", "g"), 4).alias("prev_sim"), F.coalesce(sim("g", "f") > sim("e", "f"), F.lit(False)).alias("sandwich"))


@query("""WITH b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS t FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS t FROM documents),
 nb AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), m AS (SELECT item_id, doc_id, count(*) AS k FROM b JOIN d USING (t) GROUP BY 1, 2)
 SELECT m.doc_id, count(*) AS items, max(k) AS most FROM m JOIN nb USING (item_id) WHERE k >= 0.8 * n GROUP BY m.doc_id""")
def benchmark_overlap_exclusion(t: Tables) -> DataFrame:
    """Documents that hold 0.8 or more of the words of a benchmark item."""
    words = lambda d, k: d.select(k, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)).alias("ts"))
    m = relational.holding(words(t.benchmark, "item_id"), words(t.documents, "doc_id"), "item_id", "doc_id", "ts", 0.8)
    return m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.max("k").alias("most"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, l_partkey + 1000000000 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), f(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT CASE WHEN f.depth % 2 = 0 THEN e.dst ELSE e.src END, f.depth + 1 FROM f JOIN e ON (f.depth % 2 = 0 AND e.src = f.node) OR (f.depth % 2 = 1 AND e.dst = f.node) WHERE f.depth < 2)
 SELECT depth, count(*) AS n FROM (SELECT node, min(depth) AS depth FROM f GROUP BY node) GROUP BY depth""")
def graph_frontier(t: Tables) -> DataFrame:
    """Customers and parts within two steps of customer 1 over orders."""
    e = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + 1000000000).alias("dst")).distinct()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seed = t.spark.range(1).select(F.lit(1).cast("long").alias("node"))
    return relational.frontier(both, seed, 2).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


_TRI = "CASE {x} WHEN 1 THEN 'yes' WHEN 0 THEN 'no' ELSE 'uncertain' END"


@query(f"""WITH a AS (SELECT d.doc_id, {_TRI.format(x='l.quality')} AS q, CASE WHEN l.toxic IS NULL THEN 'uncertain' WHEN l.toxic = 1 THEN 'no' ELSE 'yes' END AS c, CASE WHEN d.n_chars >= 500 THEN 'yes' ELSE 'no' END AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
 SELECT doc_id, CASE WHEN 'no' IN (q, c, n) THEN 'no' WHEN 'uncertain' IN (q, c, n) THEN 'uncertain' ELSE 'yes' END AS verdict FROM a""")
def tri_state_scope(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    q = F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").otherwise("uncertain")
    c = F.when(F.col("toxic").isNull(), "uncertain").when(F.col("toxic") == 1, "no").otherwise("yes")
    return d.select("doc_id", contracts.tri_and(q, c, F.when(F.col("n_chars") >= 500, "yes").otherwise("no")).alias("verdict"))


@query(f"""WITH a AS (SELECT d.doc_id, {_TRI.format(x='l.quality')} AS o, CASE WHEN l.toxic IS NULL THEN 'uncertain' WHEN l.toxic = 1 THEN 'no' ELSE 'yes' END AS m, d.n_chars % 7 = 0 AS s, d.n_chars % 5 = 0 AS u, d.n_chars >= 800 AS g, d.n_chars % 3 <> 0 AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
 SELECT doc_id, CASE WHEN o = 'no' OR m = 'no' THEN 'reject' WHEN o = 'uncertain' OR m = 'uncertain' THEN 'uncertain' WHEN s THEN 'reroute_instructional_review' WHEN u AND g AND k THEN 'scene_candidate' WHEN u THEN 'reject' WHEN g AND k THEN 'strict_accept' WHEN k THEN 'recover_strict' ELSE 'uncertain' END AS disposition FROM a""")
def disposition_cascade(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    n = F.col("n_chars")
    o = F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").otherwise("uncertain")
    m = F.when(F.col("toxic").isNull(), "uncertain").when(F.col("toxic") == 1, "no").otherwise("yes")
    return d.select("doc_id", contracts.disposition(o, m, n % 7 == 0, n % 5 == 0, n >= 800, n % 3 != 0).alias("disposition"))


@query("""SELECT d.doc_id, concat_ws('|', CASE WHEN l.quality IS NOT NULL THEN 'quality' END, CASE WHEN l.toxic IS NOT NULL THEN 'toxic' END, CASE WHEN c.turns IS NOT NULL THEN 'conversation' END) AS context_available, l.quality, coalesce(c.turns, 0) AS turns
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id""")
def context_packets(t: Tables) -> DataFrame:
    turns = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("turns"))
    d = t.documents.select("doc_id").join(t.labels, "doc_id", "left").join(turns, "doc_id", "left")
    have = lambda c, n: F.when(F.col(c).isNotNull(), F.lit(n))
    return d.select("doc_id", F.concat_ws("|", have("quality", "quality"), have("toxic", "toxic"), have("turns", "conversation")).alias("context_available"), "quality", F.coalesce("turns", F.lit(0)).alias("turns"))
