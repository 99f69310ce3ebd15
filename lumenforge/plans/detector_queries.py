"""Detection queries over the conversations: each turn is a transcript whose words take 0.4 s."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import detector
from .atoms import pick, pick_sql
from .registry import Tables, query

ADDED = ["oh my god that's so rude", "oh my god", "How dare you! sir, excuse me", "easy now", "calm down Sir... that's not okay", "", "are you serious, not cool"]
_q = lambda s: s.replace("'", "''")
_ADDED = "list_extract([" + ", ".join(f"'{_q(x)}'" for x in ADDED) + "], 1 + (conv_id * 31 + turn) % 7)"
_WORDS = f"""t AS (SELECT conv_id, turn, list_filter(string_split_regex(trim({_ADDED} || ' ' || coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM conversations),
w AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM t),
k AS (SELECT conv_id, turn, i, word, i * 0.4 AS lo, i * 0.4 + 0.3 AS hi, regexp_replace(lower(word), '[^a-z0-9'']+', '', 'g') AS token FROM w),
s AS (SELECT *, CAST(sum(length(token) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(token) - 1 AS INTEGER) AS a, CAST(sum(length(token) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS b, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS n FROM k WHERE token <> '')"""


def _transcripts(t: Tables) -> DataFrame:
    added = F.element_at(F.array(*[F.lit(x) for x in ADDED]), ((F.col("conv_id") * 31 + F.col("turn")) % 7 + 1).cast("int"))
    ws = F.filter(F.split(F.trim(F.concat_ws(" ", added, F.coalesce("text", F.lit("")))), r"\s+"), lambda x: x != "")
    return t.conversations.select("conv_id", "turn", F.transform(ws, lambda w, i: F.struct(w.alias("word"), (i * 0.4).alias("start"), (i * 0.4 + 0.3).alias("end"))).alias("words"))


@query(f"WITH {_WORDS} SELECT conv_id, turn, n AS place, token, a, b FROM s")
def normalised_words(t: Tables) -> DataFrame:
    """Tokens that are left of each word, with their span in the text that they make."""
    d = _transcripts(t).select("conv_id", "turn", F.posexplode(detector.spanned(F.col("words"))).alias("place", "w"))
    return d.select("conv_id", "turn", F.col("place").cast("long").alias("place"), "w.token", "w.a", "w.b")


BANK = [(p, tier, None, ()) for tier, ps in text.PHRASES.items() for p in ps] + [(p, tier, window, tiers) for (tier, window, tiers), ps in text.CONDITIONAL_PHRASES.items() for p in ps]
_BANK = "bank AS (" + " UNION ALL ".join(f"SELECT '{_q(p)}' AS phrase, '{_q(' '.join(w for w in (''.join(ch for ch in x.lower() if ch.isascii() and (ch.isalnum() or ch == chr(39))) for x in p.split()) if w))}' AS norm, {t} AS tier, CAST({w if w else 'NULL'} AS DOUBLE) AS win, CAST([{', '.join(map(str, ts))}] AS INTEGER[]) AS tiers" for p, t, w, ts in BANK) + ")"


@query(f"""WITH {_WORDS}, {_BANK}, x AS (SELECT conv_id, turn, string_agg(token, ' ' ORDER BY i) AS t FROM s GROUP BY conv_id, turn),
f AS (SELECT x.conv_id, x.turn, bank.*, string_split_regex(t, '\\b' || norm || '\\b') AS parts FROM x JOIN bank ON contains(t, norm)),
g AS (SELECT *, unnest(range(1, len(parts))) AS k FROM f), h AS (SELECT *, CAST(list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * length(norm) AS INTEGER) AS lo FROM g),
c AS (SELECT h.conv_id, h.turn, h.phrase, h.tier, h.win, h.tiers, h.lo AS place, min(s.lo) AS start, max(s.hi) AS "end" FROM h JOIN s ON s.conv_id = h.conv_id AND s.turn = h.turn AND s.a < h.lo + length(h.norm) AND s.b > h.lo GROUP BY ALL),
o AS (SELECT * FROM c WHERE win IS NULL OR EXISTS (SELECT 1 FROM c z WHERE z.conv_id = c.conv_id AND z.turn = c.turn AND z.win IS NULL AND list_contains(c.tiers, z.tier) AND abs(z.start - c.start) <= c.win))
SELECT o.conv_id, o.turn, o.phrase, o.tier, CAST(o.start AS DOUBLE) AS start, CAST(o."end" AS DOUBLE) AS "end", string_agg(s.word, ' ' ORDER BY s.i) AS context FROM o JOIN s ON s.conv_id = o.conv_id AND s.turn = o.turn AND s.hi >= o.start - 5 AND s.lo <= o."end" + 5 GROUP BY o.conv_id, o.turn, o.phrase, o.tier, o.place, o.start, o."end" """)
def phrase_detections(t: Tables) -> DataFrame:
    """The phrases of all tiers with times and context; those of doubt only beside an unconditional one."""
    return detector.phrases(_transcripts(t), ["conv_id", "turn"], "words", BANK)


_QUOTES = f"""{_WORDS}, k2 AS (SELECT conv_id, turn, list(token ORDER BY i) AS toks, list(CAST(lo AS DOUBLE) ORDER BY i) AS los, list(CAST(hi AS DOUBLE) ORDER BY i) AS his FROM s GROUP BY conv_id, turn),
q AS (SELECT *, CASE turn % 3 WHEN 0 THEN toks[3:8] WHEN 1 THEN list_concat(toks[2:4], ['drifted', 'words']) ELSE list_concat(toks[1:1], ['zzz']) END AS q1, CASE WHEN turn % 4 = 3 THEN list_concat(toks[9:10], ['off']) ELSE toks[9:12] END AS q2 FROM k2),
p AS (SELECT *, list_transform(range(1, len(toks) + 1), lambda i: len(list_filter(range(1, len(q1) + 1), lambda n: toks[i:i + n - 1] = q1[1:n]))) AS p1, list_transform(range(1, len(toks) + 1), lambda i: len(list_filter(range(1, len(q2) + 1), lambda n: toks[i:i + n - 1] = q2[1:n]))) AS p2 FROM q)"""


def _quoted(t: Tables) -> DataFrame:
    d = _transcripts(t).select("conv_id", "turn", detector.spanned(F.col("words")).alias("w")).where(F.size("w") > 0).withColumn("toks", F.col("w.token"))
    odd = lambda a, n, *more: F.concat(F.slice("toks", a, n), F.array(*[F.lit(x) for x in more]))
    q1 = F.when(F.col("turn") % 3 == 0, F.slice("toks", 3, 6)).when(F.col("turn") % 3 == 1, odd(2, 3, "drifted", "words")).otherwise(odd(1, 1, "zzz"))
    q2 = F.when(F.col("turn") % 4 == 3, odd(9, 2, "off")).otherwise(F.slice("toks", 9, 4))
    d = d.withColumns({"q1": q1, "q2": q2})
    return d.withColumns({"p1": detector.prefix_at(F.col("toks"), F.col("q1")), "p2": detector.prefix_at(F.col("toks"), F.col("q2"))})


def _located_sql(least: int) -> str:
    return f"""WITH {_QUOTES}, m AS (SELECT *, list_max(p1) AS most FROM p) SELECT conv_id, turn, CAST(CASE WHEN most >= {least} THEN most ELSE 0 END AS INTEGER) AS length, CASE WHEN most >= {least} THEN los[list_position(p1, most)] END AS start, CASE WHEN most >= {least} THEN his[list_position(p1, most) + most - 1] END AS "end",
CAST(CASE WHEN most >= {least} THEN len(list_filter(p1, lambda n: n = most)) ELSE 0 END AS INTEGER) AS places FROM m"""


def _located(t: Tables, least: int) -> DataFrame:
    d = _quoted(t).withColumn("at", detector.located(F.col("p1"), least))
    i = F.get("at.places", F.lit(0))
    return d.select("conv_id", "turn", "at.length", F.get("w", i)["start"].alias("start"), F.when(F.col("at.length") > 0, F.get("w", i + F.col("at.length") - 1)["end"]).alias("end"), F.size("at.places").alias("places"))


query(_located_sql(3), name="quote_location")(lambda t: _located(t, 3))
query(_located_sql(2), name="quote_location_short")(lambda t: _located(t, 2))


@query(f"""WITH {_QUOTES}, m AS (SELECT *, CASE WHEN list_max(p1) >= 2 THEN list_max(p1) ELSE 0 END AS n1, CASE WHEN list_max(p2) >= 2 THEN list_max(p2) ELSE 0 END AS n2 FROM p),
e AS (SELECT conv_id, turn, n1, n2, len(q1) AS l1, len(q2) AS l2, los, his, unnest(list_filter(range(0, len(toks)), lambda i: p1[i + 1] = n1)) AS i, [j FOR j IN range(0, len(toks)) IF p2[j + 1] = n2] AS js FROM m WHERE n1 > 0 AND n2 > 0),
x AS (SELECT * FROM (SELECT *, unnest(js) AS j FROM e)), y AS (SELECT conv_id, turn, i, j + n2 - 1 AS z, his[j + n2] - los[i + 1] AS d FROM x WHERE j + n2 - 1 >= i AND his[j + n2] - los[i + 1] > 0 AND his[j + n2] - los[i + 1] <= 6),
b AS (SELECT conv_id, turn, count(*) AS n, arg_min(struct_pack(d := d, i := i, z := z), struct_pack(d := d, i := i, z := z)) AS best FROM y GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, CASE WHEN n IS NULL THEN 'unresolved' WHEN n1 = len(q1) AND n2 = len(q2) THEN CASE n WHEN 1 THEN 'exact_unique' ELSE 'exact_ambiguous' END WHEN n = 1 THEN 'prefix_unique' ELSE 'prefix_ambiguous' END AS confidence,
CAST(coalesce(n, 0) AS INTEGER) AS candidates, round(best.d, 3) AS duration, CAST(best.i AS INTEGER) AS first_word, CAST(best.z AS INTEGER) AS last_word FROM m LEFT JOIN b ON m.conv_id = b.conv_id AND m.turn = b.turn""")
def span_recovery(t: Tables) -> DataFrame:
    """From a start quote to an end quote, the shortest span of at most 6 s, and how sure it is."""
    d = _quoted(t).withColumns({"at1": detector.located(F.col("p1"), 2), "at2": detector.located(F.col("p2"), 2)})
    return d.select("conv_id", "turn", detector.recovered(F.col("w"), F.col("at1"), F.size("q1"), F.col("at2"), F.size("q2"), 6.0).alias("r")).select("conv_id", "turn", "r.*")


@query("""WITH s AS (SELECT user_id, epoch(ts) AS lo, epoch(ts) + value AS hi FROM events), g AS (SELECT user_id, lead(lo) OVER (PARTITION BY user_id ORDER BY lo, hi) - hi AS gap FROM s) SELECT user_id, count(*) FILTER (gap > 3600) AS pauses FROM g GROUP BY user_id""")
def speech_pauses(t: Tables) -> DataFrame:
    """Gaps between the end of one word and the start of the next that are longer than a limit; events stand for words."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return detector.pauses(t.events.select("user_id", at.alias("lo"), (at + F.col("value")).alias("hi")), ["user_id"], "lo", "hi", 3600.0)


@query(f"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(CASE WHEN turn % 4 = 3 THEN replace(coalesce(text, ''), ' ', '') ELSE coalesce(text, '') END, '\\s+', ' ', 'g')) AS x, turn * 5.0 AS lo, CASE WHEN turn % 5 = 4 THEN turn * 5.0 - 1 ELSE turn * 5.0 + 4 END AS hi FROM conversations),
u AS (SELECT *, CASE WHEN contains(x, ' ') OR length(x) < 2 THEN string_split(x, ' ') ELSE regexp_extract_all(x, '.') END AS us FROM t WHERE x <> ''), e AS (SELECT *, unnest(us) AS word, generate_subscripts(us, 1) AS i, greatest(hi - lo, 0) / len(us) AS step FROM u)
SELECT conv_id, turn, i - 1 AS place, word, round(CAST(lo + (i - 1) * step AS DOUBLE), 3) AS start, round(CAST(CASE WHEN i = len(us) THEN hi ELSE lo + i * step END AS DOUBLE), 3) AS "end" FROM e""")
def pseudo_word_times(t: Tables) -> DataFrame:
    """Words of segments that have no times, spread over the segment; text without blanks goes by characters."""
    said = F.when(F.col("turn") % 4 == 3, F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(""))).otherwise(F.coalesce("text", F.lit("")))
    lo = F.col("turn") * 5.0
    words = detector.pseudo_words(said, lo, F.when(F.col("turn") % 5 == 4, lo - 1).otherwise(lo + 4))
    return t.conversations.select("conv_id", "turn", F.posexplode(words).alias("place", "w")).select("conv_id", "turn", F.col("place").cast("long").alias("place"), "w.*")


ANSWERS = [
    '{"is_target": "yes", "hard_negative_type": "none", "modality": "witnessed", "agent": "human", "reactions": [{"quote": "so rude", "tag": "a"}, {"quote": "stop", "tag": "b"}]}',
    '```json\n{"is_target": "no", "hard_negative_type": "staged", "modality": null, "agent": null, "reactions": []}\n```',
    '{"is_target": "yes", "hard_negative_type": "none", "modality": "commentary", "reactions": [{"quote": "one", "tag": "x"}, {"quote": "two", "ta',
    '{"is_target": "yes", "reactions": [{"tag": "no quote"}, {"quote": "kept"}, {"quote": "cut',
    "not json at all",
]
WANTED = [("yes", "none", "witnessed", "human", ["so rude", "stop"]), ("no", "staged", None, None, []), ("yes", "none", "commentary", "human", ["one"]), ("yes", "none", "witnessed", "human", ["kept"]), ("no", "none", "witnessed", "human", [])]


@query("WITH a(k, is_target, hard_negative_type, modality, agent, quotes) AS (VALUES " + ", ".join(f"({i}, " + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else "CAST([" + ", ".join(repr(y) for y in x) + "] AS VARCHAR[])" for x in w) + ")" for i, w in enumerate(WANTED)) + ") SELECT doc_id, is_target, hard_negative_type, modality, agent, quotes FROM documents JOIN a ON doc_id % 5 = k")
def salvaged_answers(t: Tables) -> DataFrame:
    """Model answers, fenced, whole or broken off; SQL states what each of the five must give."""
    d = t.documents.select("doc_id", detector.model_answer(F.element_at(F.array(*[F.lit(x) for x in ANSWERS]), (F.col("doc_id") % 5 + 1).cast("int"))).alias("a"))
    return d.select("doc_id", "a.is_target", "a.hard_negative_type", "a.modality", "a.agent", F.col("a.reactions.quote").alias("quotes"))


EVIDENCE = ["  The   AND ", "none", "", None, "zzz not said", "of"]
_N = "trim(regexp_replace(lower(coalesce({}, '')), '\\s+', ' ', 'g'))"


@query(f"WITH d AS (SELECT doc_id, {_N.format(pick_sql('doc_id', EVIDENCE, 37))} AS e, {_N.format('text')} AS h FROM documents) SELECT doc_id, e NOT IN ('', 'none') AND contains(h, e) AS grounded FROM d")
def evidence_grounded(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", detector.grounded(pick("doc_id", EVIDENCE, 37), F.col("text")).alias("grounded"))


_CUE = "CASE turn % 6 WHEN 1 THEN 'stop that and be careful' WHEN 2 THEN 'are you okay' WHEN 3 THEN 'she said stop' WHEN 4 THEN 'leave me alone' ELSE 'hm' END"
_HIT = {n: f"regexp_matches({_CUE}, '{_q(text.INTERVENTIONS[n])}')" for n in text.INTERVENTIONS}


@query(f"""WITH c AS (SELECT conv_id, turn, turn * 4.0 AS lo, list_filter([{', '.join(f"CASE WHEN {_HIT[n]} THEN '{n}' END" for n in text.ACTIVE)}], lambda x: x IS NOT NULL) AS m, {_HIT['self_defense']} AS d, {_HIT['reported']} AS r FROM conversations)
SELECT conv_id, turn, CAST(greatest(0, lo - 5) AS DOUBLE) AS window_start, CAST(lo + 6 AS DOUBLE) AS window_end, m AS mechanisms, d AS self_defense, r AS reported FROM c WHERE len(m) > 0""")
def reaction_candidates(t: Tables) -> DataFrame:
    """Segments that may hold a reaction, with windows 5 s before to 3 s after."""
    return _candidates(t).select("conv_id", "turn", "window_start", "window_end", "mechanisms", "self_defense", "reported")


def _candidates(t: Tables) -> DataFrame:
    k = F.col("turn") % 6
    said = F.when(k == 1, "stop that and be careful").when(k == 2, "are you okay").when(k == 3, "she said stop").when(k == 4, "leave me alone").otherwise("hm")
    d = t.conversations.select("conv_id", "turn", said.alias("said"), (F.col("turn") * 4.0).alias("lo"), (F.col("turn") * 4.0 + 3).alias("hi"))
    return detector.reaction_candidates(d, "said", "lo", "hi")


@query(f"""WITH c AS (SELECT conv_id, turn * 4.0 AS lo, list_filter([{', '.join(f"CASE WHEN {_HIT[n]} THEN '{n}' END" for n in text.ACTIVE)}], lambda x: x IS NOT NULL) AS m, NOT {_HIT['self_defense']} AND NOT {_HIT['reported']} AS ok FROM conversations)
SELECT conv_id, count(*) AS total, count(*) FILTER (ok) AS active, count(*) FILTER (ok AND lo < 10) AS before, count(*) FILTER (ok AND lo > 10) AS after, count(*) FILTER (ok AND list_contains(m, 'direct')) AS direct, count(*) FILTER (ok AND list_contains(m, 'warning')) AS warning FROM c WHERE len(m) > 0 GROUP BY conv_id""")
def candidate_scan_counts(t: Tables) -> DataFrame:
    """Candidates of each clip, those that are neither defence nor report, by side of a boundary and by mechanism."""
    ok = ~F.col("self_defense") & ~F.col("reported")
    n = lambda c: F.count_if(ok & c)
    has = lambda m: F.array_contains("mechanisms", m)
    return _candidates(t).groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("active"), n(F.col("lo") < 10).alias("before"), n(F.col("lo") > 10).alias("after"), n(has("direct")).alias("direct"), n(has("warning")).alias("warning"))


# fixed values: cues of titles, transcripts and pictures
CAPTURE = r"(?:caught|captured|footage|video|cctv|dashcam|camera|on tape)"
EVENT = r"(?:attack|assault|beat|beating|hit|strik|kick|punch|harass|steal|rob|confront|berat|fight|brawl|road rage|reckless|dangerous driv|overtak|bully|abuse|slap|shove|spit)"
ACTOR = r"(?:driver|motorist|customer|passenger|man|woman|teacher|student|police|cop|officer|guard|worker|waiter|bystander|mob|group|crowd|boss|employee)"
ACTION = r"(?:attacks?|assaults?|beats?|hits?|strikes?|kicks?|punches?|harasses?|steals?|robs?|confronts?|berates?|bullies?|threatens?|abuses?|slaps?|shoves?|spits?)"
TITLE_CUES = {"capture_before_event": rf"\b{CAPTURE}\b.{{0,70}}\b{EVENT}", "event_before_capture": rf"\b{EVENT}.{{0,70}}\b{CAPTURE}\b", "actor_action": rf"\b{ACTOR}\b.{{0,45}}\b{ACTION}\b"}
DISCUSSION = r"\b(discusses?|talks? about|interview|explains?|reacts? to|speaks? about|accuses?|alleges?|claims?)\b"
ANIMAL = r"\b(dog|cat|snake|shark|bear|monkey|ape|lion|tiger|leopard|animal)\b"
PRIORS = {
    "reported_speech": r"\b(?:said|says|told|reported|claimed|claims|alleged|allegedly)\b",
    "attribution": r"\b(?:according to|officials say|police say|sources say)\b",
    "retrospective": r"\b(?:happened|remember|recalled|used to|had been|years ago|last year)\b",
    "news_frame": r"\b(?:breaking news|our reporter|joining us|in the studio|the report)\b",
    "explicit_demo": r"\b(?:role[- ]?play|demonstration|demo|scenario|vignette|act it out)\b",
    "watch_transition": r"\b(?:watch this|let'?s watch|look at this|here'?s an example|what happens)\b",
    "direct_exchange": r"\b(?:please|thank you|excuse me|i'?m sorry|can you|would you|stop it)\b",
    "visual_deixis": r"\b(?:as you can see|on screen|in this footage|the video shows)\b",
    "first_person_count": r"\b(?:i|i'm|i've|me|my|we|we're|our)\b",
    "second_person_count": r"\b(?:you|you're|you've|your)\b",
}
DEIXIS = r"\b(?:you can see|as you can see|watch as|watch this|take a look|shows? the moment|video shows?|footage shows?|surveillance (?:video|footage) shows?|this is the (?:recording|video|footage)|caught on (?:camera|video|cctv)|on camera,? you can see)\b"
SEEN_ACTION = r"\b(?:attack(?:s|ed|ing)?|assault(?:s|ed|ing)?|hit(?:s|ting)?|kick(?:s|ed|ing)?|punch(?:es|ed|ing)?|tak(?:e|es|ing)|confront(?:s|ed|ing|ation)?|slap(?:s|ped|ping)?|shov(?:e|es|ed|ing)|grab(?:s|bed|bing)?|yell(?:s|ed|ing)?)\b"

TITLES = ["CCTV footage of a brawl", "Man punches waiter in cafe", "Road rage caught on camera", "Host discusses video of attack", "Dog bites man who hits it on tape", "cooking pasta", None, "customer calmly berates boss"]


@query(f"""WITH d AS (SELECT doc_id, coalesce({pick_sql('doc_id', TITLES, 41)}, '') AS t FROM documents) SELECT doc_id, list_filter([{', '.join(f"CASE WHEN regexp_matches(t, '{p}', 'i') THEN '{n}' END" for n, p in TITLE_CUES.items())}], lambda x: x IS NOT NULL) AS cues, regexp_matches(t, '{DISCUSSION}', 'i') AS discussion_only, regexp_matches(t, '{ANIMAL}', 'i') AS animal FROM d""")
def title_event_cues(t: Tables) -> DataFrame:
    title = F.coalesce(pick("doc_id", TITLES, 41), F.lit(""))
    return t.documents.select("doc_id", F.array_compact(F.array(*[F.when(title.rlike("(?i)" + p), F.lit(n)) for n, p in TITLE_CUES.items()])).alias("cues"), title.rlike("(?i)" + DISCUSSION).alias("discussion_only"), title.rlike("(?i)" + ANIMAL).alias("animal"))


SPOKEN = ["You can see he hits the car? I said stop it", "according to police, it happened last year", "watch this scenario please", "we're told, you know", "he grabs my bag", "as you can see, take a look at your camera"]
_SPOKEN = "list_extract([" + ", ".join(f"'{_q(x)}'" for x in SPOKEN) + "], 1 + (conv_id * 7 + turn) % 6) || ' ' || coalesce(text, '')"


def _spoken(t: Tables) -> DataFrame:
    s = F.element_at(F.array(*[F.lit(x) for x in SPOKEN]), ((F.col("conv_id") * 7 + F.col("turn")) % 6 + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", F.concat(s, F.lit(" "), F.coalesce("text", F.lit(""))).alias("said"))


# RE2 takes letters outside ASCII for no letters at \\b; the engine, as the cues mean it, for letters
@query(f"""WITH c AS (SELECT conv_id, turn, regexp_replace({_SPOKEN}, '[^\\x00-\\x7F]', 'z', 'g') AS s FROM conversations) SELECT conv_id, turn, {', '.join(f"CAST(len(regexp_extract_all(lower(s), '{_q(p)}')) AS INTEGER) AS {n}" for n, p in PRIORS.items())}, CAST(length(s) - length(replace(s, '?', '')) AS INTEGER) AS question_marks FROM c""")
def scene_prior_counts(t: Tables) -> DataFrame:
    """How often each cue of reporting, demonstration and person stands in a transcript."""
    return _spoken(t).select("conv_id", "turn", *[F.regexp_count(F.lower("said"), F.lit(p)).alias(n) for n, p in PRIORS.items()], (F.length("said") - F.length(F.replace("said", F.lit("?"), F.lit("")))).alias("question_marks"))


@query(f"""WITH c AS (SELECT conv_id, turn, {_SPOKEN} AS s, turn * 4.0 AS lo, turn * 4.0 + 3 AS hi FROM conversations), h AS (SELECT *, string_agg(s, ' ') OVER w AS near, min(lo) OVER w AS a, max(hi) OVER w AS b FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
x AS (SELECT conv_id, turn, a, b, list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(near), '{DEIXIS}', '', 'g'), '{SEEN_ACTION}'))) AS actions FROM h WHERE regexp_matches(lower(s), '{DEIXIS}')) SELECT conv_id, turn, CAST(greatest(0, a - 2) AS DOUBLE) AS start, CAST(b + 2 AS DOUBLE) AS "end", actions FROM x WHERE len(actions) > 0""")
def deixis_scenes(t: Tables) -> DataFrame:
    d = _spoken(t).withColumns({"lo": F.col("turn") * 4.0, "hi": F.col("turn") * 4.0 + 3})
    return detector.located_scenes(d, ["conv_id"], "turn", "said", "lo", "hi", DEIXIS, SEEN_ACTION)


@query("""WITH w AS (SELECT conv_id, turn * 6.0 AS wa, turn * 6.0 + 6 AS wb FROM conversations), a AS (SELECT conv_id, turn * 5.0 AS aa, turn * 5.0 + 1 AS ab, role FROM conversations)
SELECT w.conv_id, CAST(wa AS DOUBLE) AS wa, CAST(wb AS DOUBLE) AS wb, list_sort(list_distinct(list(role))) AS kinds FROM w JOIN a ON a.conv_id = w.conv_id AND wa < ab AND aa < wb GROUP BY w.conv_id, wa, wb""")
def window_anchor_kinds(t: Tables) -> DataFrame:
    c = t.conversations
    w = c.select("conv_id", (F.col("turn") * 6.0).alias("wa"), (F.col("turn") * 6.0 + 6).alias("wb"))
    a = c.select("conv_id", (F.col("turn") * 5.0).alias("aa"), (F.col("turn") * 5.0 + 1).alias("ab"), "role")
    return detector.kinds_in(w, a, ["conv_id"], ("wa", "wb"), ("aa", "ab"), "role", 60.0)
