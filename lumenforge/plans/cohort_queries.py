"""Cohorts, orders and set tools: interleaves, enrichment, pilots, tiers, seeding, scheduling picks, model experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import intervals, ranks
from .atoms import atoms_sql, with_atoms
from .registry import Tables, query


def n_rows() -> Column:
    return F.count(F.lit(1))


def nth(*keys: str, seed: str, key: str = "doc_id") -> Column:
    """The place of a row in the seeded order of its group."""
    return F.row_number().over(W.partitionBy(*keys).orderBy(hashing.order(seed, F.col(key)), key)).cast("long")


_NTH = "row_number() OVER (PARTITION BY {by} ORDER BY sha256('{seed}:' || doc_id), doc_id)"

# --- interleaves -----------------------------------------------------------------------------------------


@query(f"WITH r AS (SELECT doc_id, source, {_NTH.format(by='source', seed='mix')} AS turn FROM documents), k AS (SELECT *, row_number() OVER (ORDER BY turn, sha256('mix:' || source), source) AS place FROM r WHERE turn <= 50) SELECT doc_id, source, turn, place FROM k WHERE place <= 50")
def diverse_interleave(t: Tables) -> DataFrame:
    """The first fifty rows of all sources taken in turn; of a source no more than fifty can be among them."""
    r = t.documents.select("doc_id", "source").withColumn("turn", nth("source", seed="mix")).where("turn <= 50")
    top = r.withColumn("h", hashing.order("mix", F.col("source"))).orderBy("turn", "h", "source").limit(50)
    return top.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("turn", "h", "source")).cast("long")).drop("h")  # fifty rows


@query(f"WITH r AS (SELECT doc_id, lang, source, {_NTH.format(by='lang, source', seed='q')} AS turn FROM documents), g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, sha256('q:' || source), source) AS place FROM r WHERE turn <= 15) SELECT doc_id, lang, source, place FROM g WHERE place <= 15")
def platform_queues(t: Tables) -> DataFrame:
    """Fifteen rows of each platform from a queue in which its channels take turns; read place by place, the platforms take turns as well."""
    r = t.documents.select("doc_id", "lang", "source").withColumn("turn", nth("lang", "source", seed="q")).where("turn <= 15")
    place = F.row_number().over(W.partitionBy("lang").orderBy("turn", hashing.order("q", F.col("source")), "source")).cast("long")
    return r.withColumn("place", place).where("place <= 15").drop("turn")


@query(f"""WITH d AS (SELECT doc_id, source, n_chars FROM documents), u AS (SELECT doc_id, source, 'uniform' AS cohort FROM d QUALIFY row_number() OVER (ORDER BY sha256('en:' || doc_id), doc_id) <= 12),
x AS (SELECT * FROM d WHERE source NOT IN (SELECT source FROM u)), e AS (SELECT *, CASE WHEN n_chars < 700 THEN 'short' WHEN n_chars < 2500 THEN 'middle' ELSE 'long' END AS cohort FROM x), s AS (SELECT *, {_NTH.format(by='cohort', seed='en')} AS k FROM e) SELECT doc_id, source, cohort FROM u UNION ALL SELECT doc_id, source, cohort FROM s WHERE k <= 5""")
def enrichment_cohorts(t: Tables) -> DataFrame:
    """A uniform sample, then up to five rows of each outcome from sources that it hasn't used."""
    d = t.documents.select("doc_id", "source", "n_chars")
    u = d.orderBy(hashing.order("en", F.col("doc_id")), "doc_id").limit(12).select("doc_id", "source", F.lit("uniform").alias("cohort"))
    rest = d.join(F.broadcast(u.select("source").distinct()), "source", "left_anti")  # twelve sources at most
    kind = F.when(F.col("n_chars") < 700, "short").when(F.col("n_chars") < 2500, "middle").otherwise("long")
    e = rest.withColumn("cohort", kind).withColumn("k", nth("cohort", seed="en")).where("k <= 5")
    return u.unionByName(e.select("doc_id", "source", "cohort"))


@query(f"""WITH d AS (SELECT d.doc_id, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id), p AS (SELECT *, row_number() OVER (ORDER BY sha256('pi:' || doc_id), doc_id) AS k FROM d WHERE quality = 1), a AS (SELECT doc_id, source, 'positive' AS part FROM p WHERE k <= 20),
m AS (SELECT d.*, row_number() OVER (ORDER BY sha256('pi:' || d.doc_id), d.doc_id) AS k FROM d WHERE quality = 0 AND source IN (SELECT source FROM a)), r AS (SELECT d.*, row_number() OVER (ORDER BY sha256('pi:' || d.doc_id), d.doc_id) AS k FROM d WHERE quality = 0 AND source NOT IN (SELECT source FROM a))
SELECT doc_id, source, part FROM a UNION ALL SELECT doc_id, source, 'matched' FROM m WHERE k <= 10 UNION ALL SELECT doc_id, source, 'rest' FROM r WHERE k <= 10""")
def balanced_pilot(t: Tables) -> DataFrame:
    """Half positives, a quarter negatives of their sources, the rest of other sources."""
    d = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select("doc_id", "source", "quality").withColumn("h", hashing.order("pi", F.col("doc_id")))
    first = lambda x, n, part: x.orderBy("h", "doc_id").limit(n).select("doc_id", "source", F.lit(part).alias("part"))
    a = first(d.where("quality = 1"), 20, "positive")
    used, no = F.broadcast(a.select("source").distinct()), d.where("quality = 0")  # twenty sources at most
    return a.unionByName(first(no.join(used, "source", "left_semi"), 10, "matched")).unionByName(first(no.join(used, "source", "left_anti"), 10, "rest"))


@query(f"""WITH d AS (SELECT doc_id, source, unnest(list_filter(['r0', CASE WHEN doc_id % 2 = 0 THEN 'r1' END, CASE WHEN doc_id % 3 = 0 THEN 'r2' END], lambda x: x IS NOT NULL)) AS route FROM documents), k AS (SELECT *, {_NTH.format(by='source, route', seed='rt')} AS rank FROM d), b AS (SELECT doc_id, source, min(rank * 8 + CAST(substr(route, 2) AS BIGINT)) AS best FROM k WHERE rank <= 2 GROUP BY doc_id, source),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY best, doc_id) AS place FROM b) SELECT doc_id, source, best, place FROM c WHERE place <= 4""")
def route_budget(t: Tables) -> DataFrame:
    """The first two of each route of a source, then four of a source by their best rank; a window on two routes takes one place."""
    routes = F.array_compact(F.array(F.lit("r0"), F.when(F.col("doc_id") % 2 == 0, "r1"), F.when(F.col("doc_id") % 3 == 0, "r2")))
    d = t.documents.select("doc_id", "source", F.explode(routes).alias("route")).withColumn("rank", nth("source", "route", seed="rt")).where("rank <= 2")
    b = d.groupBy("doc_id", "source").agg(F.min(F.col("rank") * 8 + F.substring("route", 2, 9).cast("long")).alias("best"))
    return b.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy("best", "doc_id")).cast("long")).where("place <= 4")


@query(f"""WITH d AS (SELECT doc_id, source, array_to_string(list_sort(list_filter([CASE WHEN n_chars % 2 = 0 THEN 'even' END, CASE WHEN lang = 'en' THEN 'en' END, CASE WHEN n_chars > 2000 THEN 'long' END], lambda x: x IS NOT NULL)), '+') AS stratum FROM documents), r AS (SELECT *, {_NTH.format(by='stratum', seed='cue')} AS k FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, stratum) AS own FROM r), f AS (SELECT *, row_number() OVER (ORDER BY k, stratum) AS place FROM o WHERE own = 1) SELECT doc_id, source, stratum FROM f WHERE place <= 15""")
def cue_strata_sample(t: Tables) -> DataFrame:
    """Cue tuples take turns; of a source only the first row stays."""
    cues = F.array_join(F.array_sort(F.array_compact(F.array(F.when(F.col("n_chars") % 2 == 0, "even"), F.when(F.col("lang") == "en", "en"), F.when(F.col("n_chars") > 2000, "long")))), "+")
    d = t.documents.select("doc_id", "source", cues.alias("stratum")).withColumn("k", nth("stratum", seed="cue"))
    one = d.groupBy("source").agg(F.min_by(F.struct("doc_id", "stratum", "k"), F.struct("k", "stratum")).alias("x"))
    return one.select("x.doc_id", "source", "x.stratum", "x.k").orderBy("k", "stratum").limit(15).drop("k")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('paths:' || doc_id), doc_id) AS k FROM documents WHERE lang = 'de') WHERE k <= 25")
def seeded_sample(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'de'").orderBy(hashing.order("paths", F.col("doc_id")), "doc_id").limit(25).select("doc_id")


@query(f"WITH d AS (SELECT doc_id, lang, (doc_id * 7919) % 1009 / 1009.0 AS p FROM documents), b AS (SELECT *, CASE WHEN p <= 0.2 THEN 'low' WHEN p BETWEEN 0.4 AND 0.6 THEN 'middle' WHEN p >= 0.8 THEN 'high' END AS band FROM d), r AS (SELECT *, {_NTH.format(by='band, lang', seed='band')} AS turn FROM b WHERE band IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY turn, lang) AS place FROM r WHERE turn <= 8) SELECT doc_id, lang, band, CAST(ceil(p * 5) AS BIGINT) AS quintile FROM k WHERE place <= 8")
def score_band_sample(t: Tables) -> DataFrame:
    """Eight rows of each band of scores, languages in turn, with the quintile of the score."""
    p = ((F.col("doc_id") * 7919) % 1009) / 1009
    b = t.documents.select("doc_id", "lang", p.alias("p")).withColumn("band", F.when(F.col("p") <= 0.2, "low").when(F.col("p").between(0.4, 0.6), "middle").when(F.col("p") >= 0.8, "high")).where("band IS NOT NULL")
    r = b.withColumn("turn", nth("band", "lang", seed="band")).where("turn <= 8")
    k = r.withColumn("place", F.row_number().over(W.partitionBy("band").orderBy("turn", "lang"))).where("place <= 8")
    return k.select("doc_id", "lang", "band", F.ceil(F.col("p") * 5).alias("quintile"))


@query(f"WITH r AS (SELECT doc_id, lang, n_chars, {_NTH.format(by='lang', seed='rev')} AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, k FROM r WHERE k <= n // 3 AND k <= 10")
def third_of_stratum(t: Tables) -> DataFrame:
    """A third of each stratum in seeded order, ten at most."""
    n = t.documents.groupBy("lang").agg(n_rows().alias("n"))
    r = t.documents.select("doc_id", "lang").withColumn("k", nth("lang", seed="rev")).where("k <= 10")
    return r.join(n, "lang").where("k <= floor(n / 3)").select("doc_id", "lang", "k")


# --- candidates and sets -----------------------------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id, source FROM documents WHERE doc_id % 9 = 0), n AS (SELECT doc_id, source, source IN (SELECT source FROM p) AND doc_id % 4 = 1 AS matched FROM documents WHERE doc_id % 9 > 0 AND doc_id % 4 < 2), k AS (SELECT *, row_number() OVER (PARTITION BY matched ORDER BY source, doc_id) AS place FROM n), m AS (SELECT count(*) AS c FROM k WHERE matched)
SELECT doc_id, source, matched FROM k, m WHERE matched OR place <= greatest(0, (SELECT count(*) FROM documents) // 3 - c)""")
def matched_negatives(t: Tables) -> DataFrame:
    """Negatives of the positives' sources, all of them, then others up to a share of the table."""
    d = t.documents.select("doc_id", "source")
    src = d.where("doc_id % 9 = 0").select("source").distinct().withColumn("known", F.lit(True))
    n = d.where("doc_id % 9 > 0 AND doc_id % 4 < 2").join(src, "source", "left").select("doc_id", "source", (F.coalesce("known", F.lit(False)) & (F.col("doc_id") % 4 == 1)).alias("matched"))
    have = F.broadcast(n.agg(F.count_if("matched").alias("have")))  # one row, as the next
    room = F.broadcast(d.agg(F.floor(n_rows() / 3).alias("third")))
    placed = ranks.numbered(n.where("NOT matched"), [], ["source", "doc_id"], "place").join(have, F.lit(True)).join(room, F.lit(True))
    rest = placed.where("place < greatest(0, third - have)").select(*n.columns)
    return n.where("matched").unionByName(rest)


@query("WITH c AS (SELECT doc_id, doc_id % 8 > 0 AS ok, 'clip_' || doc_id % 5 AS view FROM documents), s AS (SELECT doc_id, lang AS scene FROM documents WHERE doc_id % 3 > 0), r AS (SELECT doc_id, quality FROM labels) SELECT 'positive:' || c.doc_id AS item, view, scene, quality AS proposal FROM c JOIN s ON c.doc_id = s.doc_id LEFT JOIN r ON c.doc_id = r.doc_id WHERE ok AND view <> 'clip_4'")
def positive_manifest(t: Tables) -> DataFrame:
    """Clips that were cut, with their scene, and the proposal where there is one."""
    c = t.documents.where("doc_id % 8 > 0").select("doc_id", F.concat(F.lit("clip_"), F.col("doc_id") % 5).alias("view")).where("view <> 'clip_4'")
    s = t.documents.where("doc_id % 3 > 0").select("doc_id", F.col("lang").alias("scene"))
    r = t.labels.select("doc_id", F.col("quality").alias("proposal"))
    return c.join(s, "doc_id").join(r, "doc_id", "left").select(F.concat(F.lit("positive:"), "doc_id").alias("item"), "view", "scene", "proposal")


TIERS = {"event": ([1, 1, 0, -1], 613), "source_band": ([1, 0, 0, -1], 617), "semantics": ([1, 1, 0, -1], 619), "picture": ([1, 0, -1], 631), "gates": ([0, 0, 0, 1], 641), "status": (["proposed", "proposed", "withdrawn"], 643)}
_TIERS = f"a AS ({atoms_sql('documents', 'doc_id', TIERS)})"


@query(f"WITH {_TIERS} SELECT doc_id, CASE WHEN event = 1 AND source_band = 1 THEN 'both_high' ELSE 'any_high' END AS tier FROM a WHERE (event = 1 OR source_band = 1) AND status = 'proposed' AND NOT (semantics = -1 OR picture = -1)")
def high_band_tiers(t: Tables) -> DataFrame:
    """Items high on either target, tagged where they are on both; proposals only, none that a named function votes against."""
    d = with_atoms(t.documents, "doc_id", TIERS)
    a, b = (d.where(f"{c} = 1").select("doc_id", F.lit(True).alias(c)) for c in ("event", "source_band"))
    against = d.where("semantics = -1 OR picture = -1").select("doc_id").distinct()
    either = a.join(b, "doc_id", "full").join(d.where("status = 'proposed'").select("doc_id"), "doc_id", "left_semi").join(against, "doc_id", "left_anti")
    return either.select("doc_id", F.when(F.col("event") & F.col("source_band"), "both_high").otherwise("any_high").alias("tier"))


@query(f"WITH {_TIERS} SELECT doc_id FROM a WHERE semantics = 1 AND picture = 1 AND gates = 0")
def both_families_tier(t: Tables) -> DataFrame:
    """Items on which both families vote for and no gate is failed or unknown."""
    votes = with_atoms(t.documents, "doc_id", TIERS).select("doc_id", "gates", F.create_map(F.lit("explicit_semantics"), "semantics", F.lit("visual_depiction"), "picture").alias("fv"))
    return votes.where((F.col("fv")["explicit_semantics"] == 1) & (F.col("fv")["visual_depiction"] == 1) & (F.col("gates") == 0)).select("doc_id")


@query("WITH a AS (SELECT doc_id, 'staging' AS route FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'authority' FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'scan' FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, list_sort(list(route)) AS routes FROM a GROUP BY doc_id")
def review_route_merge(t: Tables) -> DataFrame:
    """The review routes that several ledgers of cues give an item."""
    d = t.documents
    ledger = lambda m, r: d.where(f"doc_id % {m} = 0").select("doc_id", F.lit(r).alias("route"))
    return ledger(5, "staging").unionByName(ledger(7, "authority")).unionByName(ledger(3, "scan")).groupBy("doc_id").agg(F.array_sort(F.collect_list("route")).alias("routes"))


@query("WITH t AS (SELECT unnest(['queue', 'noise', 'seat', 'litter']) AS term), p AS (SELECT n_name AS platform FROM nation) SELECT term, platform FROM t, p WHERE NOT (term = 'queue' AND platform IN ('FRANCE', 'CHINA'))")
def taxonomy_seeding(t: Tables) -> DataFrame:
    """Every term of a configured list on every platform, but what is there already: terms are exploded in each platform's row."""
    seeds = t.nation.select(F.col("n_name").alias("platform"), F.explode(F.array(*[F.lit(x) for x in ("queue", "noise", "seat", "litter")])).alias("term"))
    held = t.nation.where("n_name IN ('FRANCE', 'CHINA')").select(F.col("n_name").alias("platform"), F.lit("queue").alias("term"))
    return seeds.join(held, ["term", "platform"], "left_anti").select("term", "platform")


# --- scheduling ------------------------------------------------------------------------------------------------

_Q = "q AS (SELECT o_custkey AS query, o_orderpriority AS family, CAST(o_orderkey % 4 AS INTEGER) AS priority, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 1000 END AS last_used, o_orderkey % 300 AS cooldown, o_orderkey FROM orders)"


def _queue(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("query"), F.col("o_orderpriority").alias("family"), (k % 4).cast("int").alias("priority"), F.when(k % 5 > 0, k % 1000).alias("last_used"), (k % 300).alias("cooldown"), k)


@query(f"WITH {_Q} SELECT o_orderkey, family, priority, last_used FROM q WHERE cooldown < 100 ORDER BY priority DESC, coalesce(last_used, 0), sha256('pick:' || o_orderkey) LIMIT 1")
def next_query(t: Tables) -> DataFrame:
    """The ready query of the highest priority that was used longest ago; a seeded digest breaks ties."""
    return _queue(t).where("cooldown < 100").orderBy(F.desc("priority"), F.coalesce("last_used", F.lit(0)), hashing.order("pick", F.col("o_orderkey"))).limit(1).select("o_orderkey", "family", "priority", "last_used")


@query(f"WITH {_Q}, r AS (SELECT DISTINCT family FROM q WHERE cooldown = 0) SELECT q.family, max(coalesce(last_used, 0)) AS recent FROM q JOIN r ON q.family = r.family GROUP BY q.family")
def ready_families(t: Tables) -> DataFrame:
    """Families with a ready query, and when each was used last."""
    q = _queue(t)
    return q.join(q.where("cooldown = 0").select("family").distinct(), "family").groupBy("family").agg(F.max(F.coalesce("last_used", F.lit(0))).alias("recent"))


@query(f"WITH {_Q}, w AS (SELECT *, CASE family WHEN '1-URGENT' THEN 0.0 WHEN '2-HIGH' THEN 2.0 ELSE 1.0 END AS weight FROM q) SELECT family, min(cooldown - 50) AS wait FROM w WHERE weight > 0 AND cooldown > 50 GROUP BY family")
def cooldown_wait(t: Tables) -> DataFrame:
    """How long until the first query of each family of positive weight is ready."""
    w = F.when(F.col("family") == "1-URGENT", 0.0).when(F.col("family") == "2-HIGH", 2.0).otherwise(1.0)
    return _queue(t).where((w > 0) & (F.col("cooldown") > 50)).groupBy("family").agg(F.min(F.col("cooldown") - 50).alias("wait"))


@query("WITH q AS (SELECT doc_id FROM labels) SELECT d.doc_id, n_chars FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM q) ORDER BY n_chars DESC, doc_id LIMIT 30")
def newest_unqueued(t: Tables) -> DataFrame:
    """The newest files that aren't queued yet (length stands for time)."""
    return t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id"), "doc_id", "left_anti").orderBy(F.desc("n_chars"), "doc_id").limit(30)


RANK = {"posterior": ([0.2, 0.6, 0.9, 0.97], 647), "reaction": ([None, 0.5, 0.8, 1.0], 653), "severity": ([1, 3, 5, None], 659), "strength": ([1, 2, 4, 5], 661)}


@query(f"WITH a AS ({atoms_sql('documents', 'doc_id', RANK)}) SELECT doc_id, round(posterior * coalesce(reaction, 0.5) * coalesce(severity, 1) * coalesce(strength, 1) / 25.0, 9) AS score FROM a ORDER BY score DESC, doc_id LIMIT 100")
def ranked_review(t: Tables) -> DataFrame:
    """The hundred items to review first: posterior times reaction times severity and strength."""
    f = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    d = with_atoms(t.documents, "doc_id", RANK)
    score = F.round(F.col("posterior") * f("reaction", 0.5) * f("severity", 1) * f("strength", 1) / 25.0, 9)
    return d.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(100)


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal FROM events WHERE user_id IS NOT NULL), s AS (SELECT user_id, count(*) AS n FROM o GROUP BY user_id),
p AS (SELECT user_id, n, CASE WHEN n > 2 THEN [0, n - 1, n // 2] ELSE range(n) END AS held FROM s UNION ALL
SELECT user_id, n, list_append(held, list_extract(list_sort([struct_pack(d := -list_min(list_transform(held, lambda h: abs(h - i))), i := i) FOR i IN range(0, n) IF NOT list_contains(held, i)]), 1).i) FROM p WHERE len(held) < n),
f AS (SELECT user_id, arg_max(held, len(held)) AS places FROM p GROUP BY user_id) SELECT o.user_id, o.event_id, o.ordinal, CAST(list_position(f.places, o.ordinal) - 1 AS BIGINT) AS place FROM o JOIN f USING (user_id)""")
def farthest_first_order(t: Tables) -> DataFrame:
    """The place of each of a user's rows in an order that covers them evenly at every length: first, last and middle, then always the
    one farthest from those taken. Places come from a sort by a distance that each row knows by itself, in ranges."""
    o = ranks.numbered(t.events.where("user_id IS NOT NULL").select("user_id", "event_id"), ["user_id"], ["event_id"], "ordinal")
    n = o.groupBy("user_id").agg(n_rows().alias("n"))
    key = ranks.spread_out(F.col("n"), F.col("ordinal"))
    d = o.join(n, "user_id").withColumn("key", key).select("user_id", "event_id", "ordinal", F.col("key.d").alias("d"), F.col("key.i").alias("i"))
    return ranks.numbered(d, ["user_id"], ["d", "i"], "place").select("user_id", "event_id", "ordinal", "place")


@query("""WITH RECURSIVE s AS (SELECT user_id, epoch(ts) AS x, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, event_id) AS k, event_id FROM events WHERE user_id IS NOT NULL), g AS (SELECT user_id, k, x AS last, event_id, true AS kept FROM s WHERE k = 1
UNION ALL SELECT s.user_id, s.k, CASE WHEN s.x - g.last > 3600 THEN s.x ELSE g.last END, s.event_id, s.x - g.last > 3600 FROM g JOIN s ON s.user_id = g.user_id AND s.k = g.k + 1) SELECT user_id, event_id FROM g WHERE kept""")
def preferred_thinning(t: Tables) -> DataFrame:
    """Events more than an hour after the last one kept; of those at one time the preferred kind is met first."""
    x = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    d = t.events.where("user_id IS NOT NULL").select("user_id", "event_id", x.alias("x"), F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("rank"))
    return intervals.thinned(d, "user_id", "x", 3600.0, ["rank", "event_id"], strict=True).select("user_id", "event_id")


@query("WITH s AS (SELECT user_id, event_id, epoch(ts) AS a, epoch(ts) + 5000 AS b, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END AS strength FROM events WHERE user_id IS NOT NULL), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s), g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b, event_id) AS island FROM m), w AS (SELECT user_id, island, min(a) AS lo, max(b) AS hi, max(strength) AS strength FROM g GROUP BY user_id, island), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, lo) AS k FROM w) SELECT user_id, CAST(round(lo) AS BIGINT) AS lo, CAST(round(hi) AS BIGINT) AS hi, strength FROM r WHERE k <= 5")
def strongest_windows(t: Tables) -> DataFrame:
    """Overlapping windows merged with their strongest anchor, then the five strongest of each source."""
    a = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    strength = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    s = t.events.where("user_id IS NOT NULL").select("user_id", "event_id", a.alias("a"), (a + 5000).alias("b"), strength.alias("strength"))
    m = intervals.merge_overlaps(s, ["user_id"], "a", "b", ["b", "event_id"]).groupBy("user_id", "group").agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.max("strength").alias("strength"))
    k = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("strength"), "lo"))
    return m.withColumn("k", k).where("k <= 5").select("user_id", F.round("lo").cast("long").alias("lo"), F.round("hi").cast("long").alias("hi"), "strength")


# --- experiments -------------------------------------------------------------------------------------------------

_SC = "s AS (SELECT l.doc_id, d.source, l.quality = 1 AS y, round(((d.n_chars * 7919) % 1009) / 1009.0, 6) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _scored(t: Tables) -> DataFrame:
    d = t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id")
    return d.select("doc_id", "source", (F.col("quality") == 1).alias("y"), F.round(((F.col("n_chars").cast("long") * 7919) % 1009) / 1009.0, 6).alias("p"))


@query(f"""WITH {_SC}, g AS (SELECT p, count(*) FILTER (y) AS pos, count(*) AS n FROM s GROUP BY p), c AS (SELECT p, pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k FROM g), a AS (SELECT sum(pos * tp::DOUBLE / k) / sum(pos) AS ap FROM c), f AS (SELECT count(*) FILTER (y AND p >= 0.5) AS tp, count(*) FILTER (NOT y AND p >= 0.5) AS fp, count(*) FILTER (y AND p < 0.5) AS fn FROM s) SELECT round(ap, 6) AS average_precision, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM a, f""")
def average_precision(t: Tables) -> DataFrame:
    """Average precision and F1 at one half; the curve is summed in ranges of scores."""
    s = _scored(t).withColumn("q", -F.col("p"))
    g = s.groupBy("q").agg(F.count_if("y").alias("pos"), n_rows().alias("n"))
    c = ranks.running(g, "q", ["pos", "n"]).select("pos", F.col("pos_upto").alias("tp"), F.col("n_upto").alias("k"))
    a = c.agg((F.sum(F.col("pos") * F.col("tp") / F.col("k")) / F.sum("pos")).alias("ap"))
    hit = F.col("p") >= 0.5
    f = s.agg(F.count_if(F.col("y") & hit).alias("tp"), F.count_if(~F.col("y") & hit).alias("fp"), F.count_if(F.col("y") & ~hit).alias("fn"))
    return a.withColumn("one", F.lit(1)).join(f.withColumn("one", F.lit(1)), "one").select(F.round("ap", 6).alias("average_precision"), F.round(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


@query(f"""WITH {_SC}, q AS (SELECT unnest(list_distinct(quantile_cont(p, [{', '.join(str(i / 20) for i in range(21))}]))) AS cut FROM s), d AS (SELECT unnest(['ge', 'le']) AS side), m AS (SELECT side, cut, round((count(*) FILTER (y AND h) / greatest(count(*) FILTER (y), 1)::DOUBLE + count(*) FILTER (NOT y AND NOT h) / greatest(count(*) FILTER (NOT y), 1)::DOUBLE) / 2, 9) AS score FROM (SELECT side, cut, y, CASE side WHEN 'ge' THEN p >= cut ELSE p <= cut END AS h FROM s, q, d) GROUP BY side, cut)
SELECT side, round(cut, 6) AS cut, score FROM m ORDER BY score DESC, side, cut LIMIT 1""")
def balanced_threshold(t: Tables) -> DataFrame:
    """Of 21 quantiles and two directions, the rule with the best balanced accuracy; the first of equal ones."""
    s = _scored(t)
    q = ranks.quantiles(s, "p", [i / 20 for i in range(21)]).select(F.array_distinct("q").alias("cuts"))  # one row
    d = s.join(F.broadcast(q), F.lit(True)).select("y", "p", F.explode("cuts").alias("cut")).withColumn("side", F.explode(F.array(F.lit("ge"), F.lit("le"))))
    hit = F.when(F.col("side") == "ge", F.col("p") >= F.col("cut")).otherwise(F.col("p") <= F.col("cut"))
    y = F.col("y")
    rate = lambda a, b: F.count_if(a) / F.greatest(F.count_if(b), F.lit(1))
    m = d.groupBy("side", "cut").agg(F.round((rate(y & hit, y) + rate(~y & ~hit, ~y)) / 2, 9).alias("score"))
    return m.orderBy(F.desc("score"), "side", "cut").limit(1).select("side", F.round("cut", 6).alias("cut"), "score")


@query(f"WITH {_SC}, e AS (SELECT source, CASE WHEN y THEN 'miss' ELSE 'false_hit' END AS kind, doc_id FROM s WHERE (p >= 0.7) <> y) SELECT source, kind, doc_id, count(*) OVER (PARTITION BY source, kind) AS of_kind FROM e")
def rule_error_lists(t: Tables) -> DataFrame:
    """Each item that a frozen rule gets wrong, by source and kind of error, with how many of the kind there are."""
    e = _scored(t).where((F.col("p") >= 0.7) != F.col("y")).select("source", F.when(F.col("y"), "miss").otherwise("false_hit").alias("kind"), "doc_id")
    return e.join(e.groupBy("source", "kind").agg(n_rows().alias("of_kind")), ["source", "kind"])




VOTE = {"v1": ([-1, 0, 1, 1], 673), "v2": ([-1, 0, 1], 677), "v3": ([0, 1, 1, -1], 683)}


@query(f"WITH a AS ({atoms_sql('documents', 'doc_id', VOTE)}), l AS (SELECT doc_id AS item, 'v1' AS lf, v1 AS vote FROM a UNION ALL SELECT doc_id, 'v2', v2 FROM a UNION ALL SELECT doc_id, 'v3', v3 FROM a UNION ALL SELECT doc_id, 'v1', -v1 FROM a WHERE doc_id % 40 = 3) SELECT item, CASE WHEN min(vote) FILTER (lf = 'v1') <> max(vote) FILTER (lf = 'v1') THEN NULL ELSE max(vote) FILTER (lf = 'v1') END AS v1, max(vote) FILTER (lf = 'v2') AS v2, max(vote) FILTER (lf = 'v3') AS v3, min(vote) FILTER (lf = 'v1') <> max(vote) FILTER (lf = 'v1') AS conflict FROM l GROUP BY item")
def vote_matrix(t: Tables) -> DataFrame:
    """Items by functions, one aggregate for each function; two different votes of one function are named a conflict."""
    a = with_atoms(t.documents, "doc_id", VOTE)
    rows = a.select(F.col("doc_id").alias("item"), F.explode(F.array(*[F.struct(F.lit(v).alias("lf"), F.col(v).alias("vote")) for v in VOTE])).alias("x")).select("item", "x.*")
    again = a.where("doc_id % 40 = 3").select(F.col("doc_id").alias("item"), F.lit("v1").alias("lf"), (-F.col("v1")).alias("vote"))
    of = lambda v: F.when(F.col("lf") == v, F.col("vote"))
    g = rows.unionByName(again).groupBy("item").agg(*[F.max(of(v)).alias(v) for v in VOTE], (F.min(of("v1")) != F.max(of("v1"))).alias("conflict"))
    return g.select("item", F.when(~F.col("conflict"), F.col("v1")).alias("v1"), "v2", "v3", "conflict")


@query("WITH c AS (SELECT source, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source), z AS (SELECT *, k::DOUBLE / n AS p, 1.959963984540054 AS z FROM c) SELECT source, n, round(greatest(0, (p + z * z / (2 * n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 6) AS high FROM z")
def wilson_bounds(t: Tables) -> DataFrame:
    """Both bounds of the interval of a share."""
    c = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), n_rows().alias("n"))
    z = 1.959963984540054
    p, n = F.col("k") / F.col("n"), F.col("n")
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    mid, scale = p + z * z / (2 * n), 1 + z * z / n
    return c.select("source", "n", F.round(F.greatest(F.lit(0.0), (mid - half) / scale), 6).alias("low"), F.round(F.least(F.lit(1.0), (mid + half) / scale), 6).alias("high"))
