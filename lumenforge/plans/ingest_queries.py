"""Ingest: posts and their context, media timing, source contexts, second lexicon, probes, recovery, batches with retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import json_walk, text
from ..operators import intervals, similar
from ..operators.shared import written
from .atoms import atoms_sql, pick, pick_sql, with_atoms
from .registry import Tables, query


def n_rows() -> Column:
    return F.count(F.lit(1))


# --- posts ----------------------------------------------------------------------------------------------

POST = {"dash": (["https://v/dash", None, None], 701), "hls": (["https://v/hls", None], 709), "adult": ([False, False, True, None], 719), "forum": (["pics", "u_bob", "driving", "news", None], 727), "parent": (["t3_a", "t3_b", None], 733)}


@query(f"SELECT doc_id, 'reddit__' || doc_id AS uid, coalesce(dash, hls) AS media, forum, parent FROM ({atoms_sql('documents', 'doc_id', POST)}) WHERE coalesce(dash, hls) IS NOT NULL AND NOT coalesce(adult, false)")
def video_posts(t: Tables) -> DataFrame:
    """Posts with a stream that has sound, none for adults; the parent is kept for the search by crossposts."""
    d = with_atoms(t.documents, "doc_id", POST)
    media = F.coalesce("dash", "hls")
    return d.where(media.isNotNull() & ~F.coalesce("adult", F.lit(False))).select("doc_id", F.concat(F.lit("reddit__"), "doc_id").alias("uid"), media.alias("media"), "forum", "parent")


@query(f"SELECT DISTINCT parent, forum FROM ({atoms_sql('documents', 'doc_id', POST)}) WHERE parent IS NOT NULL AND forum NOT LIKE 'u\\_%' ESCAPE '\\'")
def crosspost_forums(t: Tables) -> DataFrame:
    """Forums that each parent was crossposted to; pages of users are no forums."""
    d = with_atoms(t.documents, "doc_id", POST)
    return d.where(F.col("parent").isNotNull() & ~F.startswith("forum", F.lit("u_"))).select("parent", "forum").distinct()


@query("WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN '[deleted]' ELSE text END AS body, (conv_id * 7 + turn * 13) % 29 AS score FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS k FROM c WHERE coalesce(body, '') NOT IN ('', '[deleted]', '[removed]')) SELECT conv_id, k AS place, score, body FROM r WHERE k <= 60")
def top_comments(t: Tables) -> DataFrame:
    """The sixty best comments of each post, without deleted ones."""
    c = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 5 == 3, "[deleted]").otherwise(F.col("text")).alias("body"), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 29).alias("score"))
    k = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("score"), "turn")).cast("long")
    return c.where(~F.coalesce("body", F.lit("")).isin("", "[deleted]", "[removed]")).select("conv_id", k.alias("place"), "score", "body").where("place <= 60")


CONTEXT = {
    "content": (["organic_capture"] * 3 + ["staged_prank_or_experiment", "news_or_documentary", "vlog_or_commentary_only", "compilation", "odd"], 739), "domain": (["interpersonal_social", "traffic_driving", "property", "violence_crime", "none_apparent", "unclear", "odd"], 743),
    "polarity": (["violation", "both", "none", "odd"], 751), "stance": (["condemns_actor", "no_comments", "odd"], 757), "behavior": (["cuts the line", None, " "], 761), "fields": (["title", "comments", "smell"], 769),
}


@query(f"""SELECT doc_id, CASE WHEN content = 'odd' THEN 'content_type' WHEN domain = 'odd' THEN 'norm_domain' WHEN polarity = 'odd' THEN 'polarity' WHEN stance = 'odd' THEN 'crowd_stance' WHEN fields = 'smell' THEN 'evidence_fields' WHEN trim(behavior) = '' THEN 'inferred_behavior' END AS problem,
CASE WHEN domain IN ('interpersonal_social', 'traffic_driving', 'property') AND behavior IS NOT NULL THEN 'yes' WHEN domain IN ('none_apparent', 'violence_crime') THEN 'no' ELSE 'unclear' END AS social_norm_apparent, content = 'organic_capture' AS organic_capture_ok,
CASE content WHEN 'staged_prank_or_experiment' THEN 'instructional_review' WHEN 'news_or_documentary' THEN 'commentary_review' WHEN 'vlog_or_commentary_only' THEN 'commentary_review' END AS reroute_hint FROM ({atoms_sql('documents', 'doc_id', CONTEXT)})""")
def source_context_contract(t: Tables) -> DataFrame:
    """What a model said about a source, the first field that isn't allowed, and what follows from the others in code."""
    allowed = {
        "content": ("content_type", ["organic_capture", "staged_prank_or_experiment", "scripted_fiction_or_comedy", "news_or_documentary", "police_or_bodycam", "compilation", "vlog_or_commentary_only", "tutorial_or_lecture", "animation_or_game", "music_or_other", "unclear"]),
        "domain": ("norm_domain", ["interpersonal_social", "traffic_driving", "property", "authority_legal", "safety_physical", "violence_crime", "none_apparent", "unclear"]),
        "polarity": ("polarity", ["violation", "correct_example", "both", "none", "unclear"]),
        "stance": ("crowd_stance", ["condemns_actor", "defends_actor", "split_or_debated", "spectacle_only", "no_comments", "unclear"]),
        "fields": ("evidence_fields", ["title", "description", "tags", "subreddit", "comments", "transcript"]),
    }
    problem = F.lit(None).cast("string")
    for c, (name, values) in allowed.items():
        problem = F.coalesce(problem, F.when(~F.coalesce(F.col(c).isin(values), F.lit(False)), name))
    problem = F.coalesce(problem, F.when(F.trim("behavior") == "", "inferred_behavior"))
    social = F.when(F.col("domain").isin("interpersonal_social", "traffic_driving", "property") & F.col("behavior").isNotNull(), "yes").when(F.col("domain").isin("none_apparent", "violence_crime"), "no").otherwise("unclear")
    hint = F.when(F.col("content") == "staged_prank_or_experiment", "instructional_review").when(F.col("content").isin("news_or_documentary", "vlog_or_commentary_only"), "commentary_review")
    return with_atoms(t.documents, "doc_id", CONTEXT).select("doc_id", problem.alias("problem"), social.alias("social_norm_apparent"), (F.col("content") == "organic_capture").alias("organic_capture_ok"), hint.alias("reroute_hint"))


# --- media ------------------------------------------------------------------------------------------------

MEDIA = {"vs": ([0.0, 0.2, 0.9, None], 773), "vd": ([10.0, 7.0, 4.0, None], 787), "audio_s": ([0.0, 0.1, None], 797), "audio_d": ([10.0, 9.5, None], 809), "video": ([True] * 5 + [False], 811)}


@query(f"""WITH a AS (SELECT *, CASE WHEN video THEN vs END AS v0, CASE WHEN video THEN vd END AS v1 FROM ({atoms_sql('documents', 'doc_id', MEDIA)})), b AS (SELECT *, least(v0, audio_s) AS s, greatest(v0 + v1, audio_s + audio_d) AS e FROM a), c AS (SELECT *, CASE WHEN v0 IS NOT NULL THEN greatest(0, v0 - s) END AS gap, CASE WHEN v1 IS NOT NULL AND e - s > 0 THEN least(1.0, greatest(0.0, v1 / (e - s))) END AS cover FROM b)
SELECT doc_id, CAST(s AS DOUBLE) AS timeline_start, CAST(e AS DOUBLE) AS timeline_end, round(CAST(cover AS DOUBLE), 6) AS coverage, CASE WHEN NOT video THEN ['no_video_stream'] ELSE list_filter([CASE WHEN gap IS NULL THEN 'unknown_video_start' WHEN gap > 0.5 THEN 'delayed_video_start' END, CASE WHEN cover IS NULL THEN 'unknown_video_coverage' WHEN cover < 0.8 THEN 'short_video_coverage' END], lambda x: x IS NOT NULL) END AS flags FROM c""")
def media_timing(t: Tables) -> DataFrame:
    """The timeline over a medium's streams (first start, last end), how much of it has pictures, and what is wrong with it."""
    d = with_atoms(t.documents, "doc_id", MEDIA)
    on = lambda c: F.when(F.col("video"), F.col(c))
    streams = F.array(F.struct(on("vs").alias("start"), (on("vs") + on("vd")).alias("end")), F.struct(F.col("audio_s").alias("start"), (F.col("audio_s") + F.col("audio_d")).alias("end")))
    d = d.withColumns({"s": F.array_min(F.transform(streams, lambda x: x["start"])), "e": F.array_max(F.transform(streams, lambda x: x["end"]))})
    gap = F.when(on("vs").isNotNull(), F.greatest(F.lit(0.0), on("vs") - F.col("s")))
    cover = F.when(on("vd").isNotNull() & (F.col("e") - F.col("s") > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), on("vd") / (F.col("e") - F.col("s")))))
    flags = F.array_compact(F.array(F.when(gap.isNull(), "unknown_video_start").when(gap > 0.5, "delayed_video_start"), F.when(cover.isNull(), "unknown_video_coverage").when(cover < 0.8, "short_video_coverage")))
    return d.select("doc_id", F.col("s").alias("timeline_start"), F.col("e").alias("timeline_end"), F.round(cover, 6).alias("coverage"), F.when(~F.col("video"), F.array(F.lit("no_video_stream"))).otherwise(flags).alias("flags"))


#: Chains of transforms as long as the document's number says, up to sixty steps, ending in one of these.
TRANSFORMS = ['{"op": "crop"}', '{"op": "mute", "audio_removed": true}', '{"output_audio_removed": true}', '{"audio_removed": false}', '{"audio_removed": "true"}', '{"op": "x", "note": "prior_transform"}']


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, CAST(repeat('{{"op": "cut", "audio_removed": false, "prior_transform": ', (doc_id % 61)::INTEGER) || {pick_sql('doc_id', TRANSFORMS, 821)} || repeat('}}', (doc_id % 61)::INTEGER) AS JSON) AS x FROM documents),
w AS (SELECT doc_id, x, coalesce(CAST(json_extract(x, '$.audio_removed') AS VARCHAR) = 'true', false) OR coalesce(CAST(json_extract(x, '$.output_audio_removed') AS VARCHAR) = 'true', false) AS removed FROM c UNION ALL SELECT doc_id, json_extract(x, '$.prior_transform'), coalesce(CAST(json_extract(x, '$.prior_transform.audio_removed') AS VARCHAR) = 'true', false) OR coalesce(CAST(json_extract(x, '$.prior_transform.output_audio_removed') AS VARCHAR) = 'true', false) FROM w WHERE json_extract(x, '$.prior_transform') IS NOT NULL)
SELECT doc_id, bool_or(removed) AS removed FROM w GROUP BY doc_id""")
def audio_removed(t: Tables) -> DataFrame:
    """Whether a transform, or one before it in its chain, however long, took the sound away."""
    n = (F.col("doc_id") % 61).cast("int")
    x = F.concat(F.repeat(F.lit('{"op": "cut", "audio_removed": false, "prior_transform": '), n), pick("doc_id", TRANSFORMS, 821), F.repeat(F.lit("}"), n))
    return t.documents.select("doc_id", json_walk.in_chain(x, "prior_transform", ["audio_removed", "output_audio_removed"]).alias("removed"))


# --- recovery ------------------------------------------------------------------------------------------------

_EV = "e AS (SELECT user_id, event_id, event_type, value, epoch(ts) AS t0, epoch(ts) + value AS t1 FROM events WHERE user_id IS NOT NULL)"


@query(f"""WITH {_EV}, k AS (SELECT * FROM e WHERE event_type = 'error'), c AS (SELECT * FROM e WHERE event_type = 'purchase' AND value >= 5 AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = e.user_id AND k.t0 BETWEEN e.t0 - 7200 AND e.t1 + 7200)), g AS (SELECT *, CASE WHEN t0 - max(t1) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 7200 THEN 0 ELSE 1 END AS b FROM c), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t0, event_id) AS island FROM g), w AS (SELECT user_id, island, min(t0) AS lo, max(t1) AS hi, max(value) AS peak FROM i GROUP BY user_id, island), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY peak DESC, lo) AS k FROM w)
SELECT user_id, CAST(floor(lo) AS BIGINT) AS lo, CAST(floor(hi) AS BIGINT) AS hi, peak FROM r WHERE k <= 4""")
def recovery_windows(t: Tables) -> DataFrame:
    """Vocal events away from every known reaction, merged where they are near each other, the four loudest of each source."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = t.events.where("user_id IS NOT NULL").select("user_id", "event_id", "event_type", "value", at.alias("t0"), (at + F.col("value")).alias("t1"))
    known = e.where("event_type = 'error'").select("user_id", F.col("t0").alias("k0"), F.col("t0").alias("k1"))
    c = intervals.outside(e.where("event_type = 'purchase' AND value >= 5"), known, ["user_id"], ("t0", "t1"), ("k0", "k1"), 7200.0, 14400.0)
    w = W.partitionBy("user_id").orderBy("t0", "event_id")
    g = c.withColumn("b", F.when(F.col("t0") - F.max("t1").over(w.rowsBetween(W.unboundedPreceding, -1)) <= 7200, 0).otherwise(1)).withColumn("island", F.sum("b").over(w))
    m = g.groupBy("user_id", "island").agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"), F.max("value").alias("peak"))
    k = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("peak"), "lo"))
    return m.withColumn("k", k).where("k <= 4").select("user_id", F.floor("lo").alias("lo"), F.floor("hi").alias("hi"), "peak")


@query(f"""WITH {_EV}, z AS (SELECT user_id, t0, t1 FROM e WHERE event_type = 'signup'), n AS (SELECT user_id, event_id, t0 AS a, t0 + 1800 AS b FROM e WHERE event_type = 'view') SELECT event_id FROM n WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.user_id = n.user_id AND z.t0 <= n.b AND n.a <= z.t1)""")
def decontaminated_negatives(t: Tables) -> DataFrame:
    """Negative windows without those that a new reaction window touches."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = t.events.where("user_id IS NOT NULL").select("user_id", "event_id", "event_type", at.alias("t0"), (at + F.col("value")).alias("t1"))
    n = e.where("event_type = 'view'").select("user_id", "event_id", F.col("t0").alias("a"), (F.col("t0") + 1800).alias("b"))
    z = e.where("event_type = 'signup'").select("user_id", F.col("t0").alias("z0"), F.col("t1").alias("z1"))
    return intervals.outside(n, z, ["user_id"], ("a", "b"), ("z0", "z1"), 0.0, 3600.0).select("event_id")


BATCH = {"first": (["ok", "ok", "error"], 823), "second": (["ok", "error"], 827), "written": ([True, False, False], 829)}


@query(f"WITH a AS ({atoms_sql('documents', 'doc_id', BATCH)}) SELECT doc_id, CASE WHEN written THEN 'skipped' WHEN first = 'ok' THEN 'first_round' WHEN second = 'ok' THEN 'second_round' ELSE 'pending' END AS state FROM a")
def two_round_batch(t: Tables) -> DataFrame:
    """A batch in two rounds: what has an output is skipped, what failed is tried once more, what fails again stays pending."""
    d = with_atoms(t.documents, "doc_id", BATCH)
    todo = d.join(d.where("written").select("doc_id"), "doc_id", "left_anti")
    one = todo.where("first = 'ok'").select("doc_id", F.lit("first_round").alias("state"))
    again = todo.join(one.select("doc_id"), "doc_id", "left_anti")
    two = again.select("doc_id", F.when(F.col("second") == "ok", "second_round").otherwise("pending").alias("state"))
    return d.where("written").select("doc_id", F.lit("skipped").alias("state")).unionByName(one).unionByName(two)


@query("WITH o AS (SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE doc_id % 4 > 0 GROUP BY source), l AS (SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE doc_id % 4 = 0 GROUP BY source) SELECT source, coalesce(o.n, 0) + coalesce(l.n, 0) AS n, coalesce(o.chars, 0) + coalesce(l.chars, 0) AS chars, coalesce(l.n, 0) AS late FROM o FULL JOIN l USING (source)")
def late_enrichment(t: Tables) -> DataFrame:
    """Counters of each source after late rows came in: sums that add up, so what was counted isn't read again."""
    per = lambda cond, late: t.documents.where(cond).groupBy("source").agg(n_rows().alias("n"), F.sum("n_chars").alias("chars"), (n_rows() if late else F.lit(0).cast("long")).alias("late"))
    return per("doc_id % 4 > 0", False).unionByName(per("doc_id % 4 = 0", True)).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "late")])


@query("WITH b AS (SELECT o_custkey % 25 AS queue, count(*) AS backlog, date_diff('day', min(o_orderdate), TIMESTAMP '1998-08-02') AS age FROM orders GROUP BY 1) SELECT queue, backlog, backlog >= 60 OR age >= 2400 AS due FROM b")
def batches_due(t: Tables) -> DataFrame:
    """Queues whose batch is due: enough rows wait, or the oldest has waited long enough."""
    b = t.orders.groupBy((F.col("o_custkey") % 25).alias("queue")).agg(n_rows().alias("backlog"), F.date_diff(F.lit("1998-08-02").cast("date"), F.to_date(F.min("o_orderdate"))).alias("age"))
    return b.select("queue", "backlog", ((F.col("backlog") >= 60) | (F.col("age") >= 2400)).alias("due"))


# --- windows of events -------------------------------------------------------------------------------------------


@query("SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 21600 AS start, count(*) AS n, max(value) AS peak FROM events GROUP BY 1, 2")
def tumbling_windows(t: Tables) -> DataFrame:
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return t.events.groupBy("event_type", (s - s % 21600).alias("start")).agg(n_rows().alias("n"), F.max("value").alias("peak"))


@query("WITH e AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), w AS (SELECT event_type, unnest([s - s % 10800 - 10800, s - s % 10800]) AS start FROM e) SELECT event_type, start, count(*) AS n FROM w GROUP BY event_type, start")
def sliding_windows(t: Tables) -> DataFrame:
    """Windows of six hours every three: each event counts in two."""
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    w = t.events.select("event_type", F.explode(F.array(s - s % 10800 - 10800, s - s % 10800)).alias("start"))
    return w.groupBy("event_type", "start").agg(n_rows().alias("n"))


# --- text features --------------------------------------------------------------------------------------------------

SAID = ["stop it", "oh wow", "you should be ashamed", "mind your own business", "you idiot", "apologize now", "she said so", "are you okay", None, "oh oh oh oh oh oh oh"]
_SAID = f"trim(regexp_replace(lower(coalesce({pick_sql('doc_id', SAID, 839)}, '')), '\\s+', ' ', 'g'))"
_BANK = text.INTERVENTIONS | text.INTERVENTIONS_V2
_rx = lambda p: f"regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}')"


@query(f"WITH d AS (SELECT doc_id, {_SAID} AS x FROM documents) SELECT doc_id, {', '.join(f'{_rx(p)} AS {n}' for n, p in _BANK.items())}, {_rx(text.GENERIC_AFFECT)} AS generic_affect_only, {' OR '.join(_rx(_BANK[n]) for n in (*text.ACTIVE, *text.INTERVENTIONS_V2))} AS any_active FROM d")
def intervention_features_v2(t: Tables) -> DataFrame:
    """All mechanisms of the second lexicon, affect alone, and whether any active one is there."""
    return t.documents.select("doc_id", *[c.alias(n) for n, c in text.interventions(pick("doc_id", SAID, 839), second=True).items()])


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')[1:400]) AS tok FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 4096 AS bucket, count(*) AS n FROM w GROUP BY 1, 2), l AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM b GROUP BY doc_id) SELECT b.doc_id, bucket, round(n / len, 9) AS weight FROM b JOIN l ON b.doc_id = l.doc_id""")
def hashed_words(t: Tables) -> DataFrame:
    """Words of a text (the probe's own four hundred) in 4,096 buckets by a digest, of length one."""
    toks = F.slice(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != ""), 1, 400)
    w = t.documents.where("text IS NOT NULL").select("doc_id", F.explode(toks).alias("tok"))
    b = w.groupBy("doc_id", (F.conv(F.substring(F.md5("tok"), 1, 8), 16, 10).cast("long") % 4096).alias("bucket")).agg(n_rows().alias("n"))
    length = b.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    return b.join(length, "doc_id").select("doc_id", "bucket", F.round(F.col("n") / F.col("len"), 9).alias("weight"))


@query("""WITH m AS (SELECT label AS clip, (min(vec_id) + max(vec_id)) // 2 AS middle FROM embeddings GROUP BY label), o AS (SELECT label AS clip, vec_id % 4 AS track, vec_id < middle AS pre, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE AS g FROM embeddings JOIN m ON m.clip = label), p AS (SELECT clip, track, count(*) FILTER (pre) AS n0, count(*) FILTER (NOT pre) AS n1, avg(x) FILTER (pre) AS x0, avg(x) FILTER (NOT pre) AS x1, avg(y) FILTER (pre) AS y0, avg(y) FILTER (NOT pre) AS y1, avg(g) FILTER (pre) AS g0, avg(g) FILTER (NOT pre) AS g1 FROM o GROUP BY clip, track),
d AS (SELECT clip, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS head, abs(g1 - g0) AS gaze FROM p WHERE n0 >= 2 AND n1 >= 2) SELECT clip, count(*) AS tracks, round(max(head), 6) AS head, round(max(gaze), 6) AS gaze, count(*) FILTER (head >= 8 OR gaze >= 0.08) AS reactors, round(avg(CASE WHEN head >= 8 OR gaze >= 0.08 THEN 1.0 ELSE 0.0 END), 6) AS synchrony FROM d GROUP BY clip""")
def track_synchrony(t: Tables) -> DataFrame:
    """How far tracks of faces move and look elsewhere across the middle of each clip, and the share that react together."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    m = t.embeddings.groupBy(F.col("label").alias("clip")).agg(F.expr("(min(vec_id) + max(vec_id)) div 2").alias("middle"))
    o = t.embeddings.join(m, F.col("label") == F.col("clip")).select("clip", (F.col("vec_id") % 4).alias("track"), (F.col("vec_id") < F.col("middle")).alias("pre"), (e(1) * 100).alias("x"), (e(2) * 100).alias("y"), e(3).alias("g"))
    side = lambda c, pre: F.avg(F.when(F.col("pre") == pre, F.col(c)))
    p = o.groupBy("clip", "track").agg(F.count_if("pre").alias("n0"), F.count_if(~F.col("pre")).alias("n1"), *[(side(c, False) - side(c, True)).alias(f"d{c}") for c in "xyg"]).where("n0 >= 2 AND n1 >= 2")
    d = p.select("clip", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("head"), F.abs("dg").alias("gaze"))
    moved = (F.col("head") >= 8) | (F.col("gaze") >= 0.08)
    return d.groupBy("clip").agg(n_rows().alias("tracks"), F.round(F.max("head"), 6).alias("head"), F.round(F.max("gaze"), 6).alias("gaze"), F.count_if(moved).alias("reactors"), F.round(F.avg(moved.cast("double")), 6).alias("synchrony"))


@query("""WITH t AS (SELECT doc_id, n_chars, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS ts FROM documents), r AS (SELECT min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars, ts, len(ts) AS n FROM t WHERE len(ts) > 0 GROUP BY ts), k AS (SELECT doc_id, n, unnest(ts) AS tok FROM r),
s AS (SELECT a.doc_id AS ka, b.doc_id AS kb, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM k a JOIN k b ON a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT ka, kb, round(k::DOUBLE / (na + nb - k), 6) AS jaccard, abs(x.n_chars - y.n_chars) <= 0.02 * greatest(x.n_chars, y.n_chars) AS same_length FROM s JOIN r x ON x.doc_id = ka JOIN r y ON y.doc_id = kb WHERE k::DOUBLE / (na + nb - k) >= 0.5""")
def episode_pairs(t: Tables) -> DataFrame:
    """Documents whose words are alike, pair by pair, with whether their lengths are. Documents of the same words stand for each other: the
    first of them is in the pairs, so copies make none. Found through the rare words that blocks of documents share."""
    d = t.documents.select("doc_id", "n_chars", F.array_sort(text.tokens(F.col("text"), 3)).alias("ts")).where(F.size("ts") > 0)
    first = d.groupBy(F.xxhash64("ts").alias("__h"), F.md5(F.array_join("ts", " ")).alias("__m")).agg(F.min_by(F.struct("doc_id", "n_chars", "ts"), "doc_id").alias("x")).select("x.*")
    r = written(first, "word-sets")
    j = similar.similar_pairs(r, "doc_id", "ts", 0.5)
    a, b = r.select(F.col("doc_id").alias("ka"), F.col("n_chars").alias("na")), r.select(F.col("doc_id").alias("kb"), F.col("n_chars").alias("nb"))
    near = F.abs(F.col("na") - F.col("nb")) <= 0.02 * F.greatest("na", "nb")
    return j.join(a, "ka").join(b, "kb").select("ka", "kb", F.round("jaccard", 6).alias("jaccard"), near.alias("same_length"))
