"""Text functions as Column expressions: normalising, token sets, cue banks, language tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: cue patterns by intervention mechanism
INTERVENTIONS = {
    "direct": r"\b(?:stop|don'?t|do not|leave .* alone|back off|cut it out|knock it off|shut up|get (?:away|out|off)|enough|what are you doing|you can'?t|you shouldn'?t)\b",
    "distract": r"\b(?:come with me|let'?s go|look over here|can you help me|what time is it|change the subject)\b",
    "delegate": r"\b(?:call|tell|get|find|report to)\s+(?:the\s+)?(?:police|security|manager|teacher|staff|parent|supervisor)\b",
    "support": r"\b(?:are you (?:okay|alright)|is (?:he|she|they) (?:okay|alright)|if (?:he|she|they) is (?:okay|alright)|i'?m here|i'?ll help|help (?:him|her|them)|you'?re safe|come with us)\b",
    "evaluation": r"\b(?:not (?:okay|cool|right|acceptable)|what'?s wrong with you|what is your problem|disgusting|rude|shame on you|too much noise|that was wrong)\b",
    "warning": r"\b(?:watch out|be careful|you'?ll hurt|going to hurt|dangerous)\b",
    "delayed_followup": r"\b(?:later|afterward|afterwards|eventually|the next day|i reported|i told .* later)\b",
    "self_defense": r"\b(?:i didn'?t|i was just|leave me alone|don'?t touch me|get away from me|i'?m sorry|it wasn'?t me)\b",
    "reported": r"\b(?:he said|she said|they said|according to|reportedly|the video shows|you can see|we see|this footage)\b",
}
ACTIVE = ("direct", "distract", "delegate", "support", "evaluation", "warning")
GENERIC_AFFECT = r"^(?:\W*(?:oh|wow|whoa|woah|gosh|god|ah|ha|haha|lol|what|no|yes|yeah|okay|omg)\W*){1,5}$"
# fixed values: added cues of the second lexicon
INTERVENTIONS_V2 = {
    "evaluation_extra": r"\b(?:(?:that'?s |it'?s |so )?not fair|how dare you|you (?:can'?t|cannot) (?:treat|talk to|do that to)|who do you think you are|have you no shame|you should be ashamed|that'?s (?:messed|f\W?\w*ed) up|unbelievable|out of line|uncalled for)\b",
    "demand_repair": r"\b(?:apologi[zs]e|say (?:you'?re )?sorry|(?:show|have) some respect|watch (?:it|yourself|where you'?re going)|mind your (?:own )?(?:business|manners))\b",
    "targeted_insult": r"\byou(?:'?re| are)? (?:a |an |such a |nothing but a )?(?:idiot|jerk|asshole|bitch|liar|creep|animal|pig|disgrace|psycho|lunatic|monster)\b",
}
# fixed values: reaction phrases by tier
PHRASES = {
    1: ["that's so rude", "that's rude", "how rude", "so rude", "how dare you", "how could you", "how could she", "how could he", "that's not okay", "that's not cool", "not cool", "uncool", "that's inappropriate", "inappropriate", "out of line", "way out of line", "you can't do that", "you can't say that", "you can't talk to", "you don't say that", "that was uncalled for", "uncalled for", "have some respect", "show some respect", "respect your", "shame on you", "shameful", "disgraceful", "disgusting behavior", "that's messed up", "that's wrong", "that's not right"],
    2: ["excuse me", "i'm sorry what", "are you kidding", "are you serious", "you can't be serious", "is this for real", "what is wrong with you", "what's wrong with you", "what is your problem", "did you just", "did he just", "did she just", "i can't believe", "unbelievable", "wow just wow", "are you for real", "no way", "no he didn't", "no she didn't"],
    3: ["in this house we", "in this family we", "not in public"],
}
# fixed values: phrases kept only beside an unconditional one (window in seconds, tiers)
CONDITIONAL_PHRASES = {
    (2, 3.0, (1,)): ["oh my god"],
    (4, 5.0, (1, 2)): ["sir", "ma'am", "young man", "young lady", "watch your mouth", "watch your tone", "watch it", "language", "easy", "settle down", "calm down"],
}
# fixed values: norm categories; the first that matches counts
NORM_CATEGORIES = [
    ("affect_only", r"^(?:surprise|shock|concern|confusion|frustration|anger|fear|disbelief|amusement|excitement|annoyance|distress|panic|outrage)$"),
    ("traffic_driving", r"driv|traffic|road|pedestrian|crosswalk|parking|lane|speed|right of way|tailgat|merge|vehicle"),
    ("violence_conflict", r"aggress|violence|violen|assault|fight|threat|attack|abuse|intimidat|harm|weapon|hitting|self.?defen[cs]e"),
    ("safety_physical", r"safety|danger|caution|hazard|injur|protect|emergency|fire|supervis"),
    ("interpersonal_social", r"respect|polite|courtes|manner|civil|rude|kind|empath|fair|honest|accountab|apolog|consent|privacy|personal space|boundar|consideration|patien|queue|line|turn|greet|hospitalit|gratitude|sharing|professional|decen|dignit|toleran|inclusion|harass|discriminat|bully|mock|humiliat|gossip|interrupt|noise|quiet|clean|hygien|space|help|care|support|lying|cheat|loyal|trust|fidelity|etiquette|modest|decorum|public behavior|social"),
    ("authority_legal", r"authorit|police|law|legal|compliance|arrest|court|rules?$|regulation|obey|order"),
    ("property", r"property|theft|steal|vandal|damage|litter|belongings|borrow"),
]
# fixed values: order of norm categories, most social first
NORM_PRIORITY = ["interpersonal_social", "property", "traffic_driving", "authority_legal", "safety_physical", "violence_conflict", "affect_only", "other_unmapped", "missing"]
# fixed values: families of query texts that automatic expansion may not propose
SCOPE_BLOCKS = [
    ("authority_or_police", r"\bpolice\b|\bcops?\b|\blaw enforcement\b|\bsheriffs?\b|\btroopers?\b|\bbody\s*cam\b|\btraffic stop\b|\b(officer|deputy)\s+(arrests?|detains?|shoots?|rescues?|confronts?)\b|\b(arrested|arrest|detained)\b"),
    ("weapon_or_mass_violence", r"\bmass shooting\b|\bschool shooting\b|\bactive shooter\b|\bgunman\b|\bshootout\b|\bshooting caught\b|\b(stabbing|knife attack|terrorist attack|hostage)\b"),
    ("accident_or_disaster_spectacle", r"\b(car|bus|truck|train|plane|motorcycle)\s+(accident|crash|wreck)\b|\b(accident|crash|wreck)\s+(caught|compilation|footage|video)\b|\b(crash|accident) compilation\b|\bnatural disaster\b|\b(explosion|building collapse)\s+(caught|footage|video)\b"),
    ("nonhuman_spectacle", r"\banimal fights?\b|\b(cat|dog|snake|bear|shark|lion|tiger)\s+vs\b|\bvs\s+(cat|dog|snake|bear|shark|lion|tiger)\b|\b(pet|wild|zoo)?\s*(animal|snake|bear|shark|lion|tiger)\s+attacks?\b|\b(cat|dog|pet)\s+(attacks?|bites?|fights?)\s+(cat|dog|person|owner)\b"),
    ("gameplay_or_virtual", r"\bgame\s*play\b|\bfortnite\b|\bgta\b|\broblox\b|\bminecraft\b|\bvideo game\b|\bstreamer highlights?\b"),
    ("sports_or_combat_entertainment", r"\bwwe\b|\baew\b|\bwrestl|\bsmackdown\b|\bcm punk\b|\bboxing (match|fight|knockout)\b|\b(mma|ufc) (fight|knockout)\b"),
    ("produced_or_adult_spectacle", r"\bdhar\s*mann\b|\bsocial experiment\b|\bprank compilation\b|\b(exhibitionis|nude|naked|nsfw|porn|onlyfans)\w*\b"),
    ("technical_or_business_topic", r"\b(search engine optimization|digital marketing|site backup)\b|\b(nfc|dim[_ -]?weight)\b|\bsoftware tutorial\b"),
]
# fixed values: stop words that vote for a language of Latin script; ambiguous ones count half
STOPWORDS = {
    "english": ["the", "you", "that", "what", "this", "is", "are", "don't", "not", "hell", "get", "your", "why", "stop", "of", "and"],
    "spanish": ["que", "qué", "por", "está", "estás", "eso", "los", "las", "una", "pero", "hombre", "haciendo", "usted", "mira"],
    "portuguese": ["que", "você", "não", "isso", "está", "fazendo", "uma", "cara", "meu", "aqui", "por", "voce", "nao"],
    "french": ["que", "vous", "pas", "est", "les", "qu'est", "fais", "quoi", "c'est", "mais", "pourquoi", "arrête"],
    "german": ["das", "sie", "nicht", "was", "ist", "der", "die", "und", "machst", "warum", "aufhören", "doch"],
    "italian": ["che", "non", "cosa", "sei", "sta", "stai", "perché", "una", "questo", "fai", "basta"],
    "indonesian_malay": ["yang", "itu", "kamu", "tidak", "apa", "ini", "kenapa", "jangan", "orang", "saja"],
    "tagalog": ["ang", "mo", "ka", "hindi", "ano", "yan", "bakit", "wag", "naman", "iyan"],
    "turkish": ["bir", "ne", "yapıyorsun", "değil", "sen", "bu", "niye", "yapma", "hayır"],
    "vietnamese": ["không", "cái", "làm", "gì", "này", "sao", "đừng", "bạn"],
}
AMBIGUOUS = ["que", "por", "una", "est", "les", "not", "no", "die", "der"]

# fixed values: code points of the scripts that are told apart; other letters count as latin
SCRIPTS = [
    ("cyrillic", 0x0400, 0x04FF),
    ("greek", 0x0370, 0x03FF),
    ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F),
    ("hebrew", 0x0590, 0x05FF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("hangul", 0xAC00, 0xD7AF),
    ("cjk", 0x4E00, 0x9FFF),
    ("kana", 0x3040, 0x30FF),
]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it: transform over an array of one binds it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def squeeze(c: Column) -> Column:
    """White space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise_query(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normalise_token(c: Column) -> Column:
    """ASCII form: letters, digits and the apostrophe."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9']+", "")


def normalise_token_unicode(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_'’]+", "")


def tokens(c: Column, least: int = 1) -> Column:
    """Distinct lower-case ASCII words of `least` letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"([a-z]{{{least},}})"), 1))


def title_tokens(c: Column, stop: list[str]) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]{3,})"), 1), lambda w: ~w.isin(stop))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of arrays of distinct tokens; two empty ones score `both_empty` (the two conventions are 1 and 0)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dice(a: Column, b: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / n)


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(F.lower(c), F.lit(pattern)), F.lit(False))


def interventions(c: Column, second: bool = False) -> dict[str, Column]:
    """One boolean for each mechanism, generic_affect_only, and any_active."""
    text = squeeze(F.coalesce(c, F.lit("")))
    bank = INTERVENTIONS | (INTERVENTIONS_V2 if second else {})
    out = {name: matches(text, p) for name, p in bank.items()}
    active = [out[n] for n in (*ACTIVE, *(INTERVENTIONS_V2 if second else ()))]
    any_active = active[0]
    for x in active[1:]:
        any_active = any_active | x
    return out | {"generic_affect_only": matches(text, GENERIC_AFFECT), "any_active": any_active}


def norm_category(c: Column) -> Column:
    text = squeeze(F.lower(F.coalesce(c, F.lit(""))))
    out = F.when(text == "", F.lit("missing"))
    for name, pattern in NORM_CATEGORIES:
        out = out.when(F.regexp_like(text, F.lit(pattern)), F.lit(name))
    return out.otherwise("other_unmapped")


def query_family(source: Column, category: Column) -> Column:
    src, cat = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    return (
        F.when(cat.startswith("instr_") | (src == "instructional"), "instructional")
        .when(cat.startswith("comm_") | (src == "commentary"), "commentary")
        .when(cat.startswith("null_") | (src == "null"), "negative")
        .otherwise("witnessed")
    )


def policy_reason(query: Column, patterns: list[str]) -> Column:
    """blocked_theme: and the first pattern that matches, else null."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(matches(query, p), F.lit(f"blocked_theme:{p}")).otherwise(out)
    return out


def scope_gate(query: Column, automatic: Column, longest: int = 120) -> Column:
    """The reason: allowed ones are not_automatic_expansion and within_ordinary_social_scope."""
    text = squeeze(F.coalesce(query, F.lit("")))
    out = F.when(~automatic, "not_automatic_expansion").when(text == "", "empty_query").when(F.length(text) > longest, "query_too_long")
    for name, pattern in SCOPE_BLOCKS:
        out = out.when(matches(text, pattern), name)
    return out.otherwise("within_ordinary_social_scope")


def _scripts(letters: Column) -> Column:
    """(letters, script) of each script among the letters of a text, latin first: letters that no other script has."""
    ranges: dict[str, str] = {}
    for name, lo, hi in SCRIPTS:
        ranges[name] = ranges.get(name, "") + f"\\x{{{lo:X}}}-\\x{{{hi:X}}}"
    # letters before all scripts go first: of most Latin texts nothing is left to search
    rest = F.regexp_replace(letters, rf"[\x{{0}}-\x{{{min(lo for _, lo, _ in SCRIPTS) - 1:X}}}]+", "")
    own = lambda x, r: F.length(x) - F.length(F.regexp_replace(x, f"[{r}]+", ""))
    counts = lambda x: F.array(*[F.when(x == "", 0).otherwise(own(x, r)) for r in ranges.values()])
    latin = lambda ns: F.length(letters) - F.aggregate(ns, F.lit(0), lambda m, n: m + n)
    return let(let(rest, counts), lambda ns: F.array(F.struct(latin(ns).alias("n"), F.lit("latin").alias("s")), *[F.struct(ns[i].alias("n"), F.lit(s).alias("s")) for i, s in enumerate(ranges)]))


def _tag(c: Column, least_letters: int) -> Column:
    """n (letters), and most (n and s) of the commonest script of a text, if it has enough letters."""
    first = lambda a: let(F.array_max(F.transform(a, lambda y: y["n"])), lambda m: F.element_at(F.filter(a, lambda x: x["n"] == m), 1))
    letters = F.regexp_replace(F.coalesce(c, F.lit("")), r"\P{L}+", "")
    return let(letters, lambda x: F.struct(F.length(x).alias("n"), F.when(F.length(x) >= least_letters, let(_scripts(x), first)).alias("most")))


def _fraction(tag: Column, least_letters: int) -> Column:
    return F.when(tag["n"] < least_letters, 0.0).otherwise(F.round(tag["most"]["n"] / tag["n"], 3))


def _language(c: Column, tag: Column, least_letters: int) -> Column:
    words = F.split(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}'\s]+", "")), r"\s+")
    # a text's words are searched once, for those of all banks
    known = F.array_intersect(words, F.array(*[F.lit(w) for w in dict.fromkeys(w for ws in STOPWORDS.values() for w in ws)]))
    half = F.array(*[F.lit(w) for w in AMBIGUOUS])
    banks = F.array(*[F.struct(F.lit(name).alias("l"), F.array(*[F.lit(w) for w in ws]).alias("w")) for name, ws in STOPWORDS.items()])
    weight = lambda hit: F.size(F.array_except(hit, half)) + 0.5 * F.size(F.array_intersect(hit, half))
    votes = lambda ws: F.transform(banks, lambda b: F.struct(let(F.array_intersect(b["w"], ws), weight).alias("n"), b["l"].alias("l")))
    ranked = let(known, lambda ws: F.sort_array(votes(ws), asc=False))
    latin = let(ranked, lambda r: F.when((r[0]["n"] >= 1.5) & (r[0]["n"] > r[1]["n"]), r[0]["l"]).otherwise("unknown_latin"))
    script = tag["most"]["s"]
    return F.when(tag["n"] < least_letters, "too_short").when(script == "latin", latin).otherwise(F.concat(F.lit("script:"), script))


def script_fraction(c: Column, least_letters: int = 6) -> Column:
    """The share of letters that the commonest script has; 0 for texts with too few letters."""
    return let(_tag(c, least_letters), lambda t: _fraction(t, least_letters))


def language_guess(c: Column, least_letters: int = 6) -> Column:
    """Language of a Latin text by stop words (unknown_latin on a tie or too few), script:<name> for others, or too_short. Of equally common
    scripts Latin counts, then the first in the list."""
    return let(_tag(c, least_letters), lambda t: _language(c, t, least_letters))


def language_tag(c: Column, least_letters: int = 6) -> Column:
    """Both of these, as language and script_fraction; letters are counted once."""
    return let(_tag(c, least_letters), lambda t: F.struct(_language(c, t, least_letters).alias("language"), _fraction(t, least_letters).alias("script_fraction")))


def iso_duration(c: Column) -> Column:
    """Seconds of an ISO 8601 duration such as PT1H2M3S; null if it isn't one."""
    part = lambda u: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, rf"(\d+){u}", 1), F.lit("")), F.lit("999999")), F.lit(0))
    return F.when(F.regexp_like(c, F.lit(r"^PT(?:\d+H)?(?:\d+M)?(?:\d+S)?$")), (part("H") * 3600 + part("M") * 60 + part("S")).cast("long"))


def json_object(c: Column) -> Column:
    """The text from the first brace to the last, without code fences: what a model's answer holds of JSON."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def quoted(c: Column) -> Column:
    """A string as JSON, characters outside ASCII as they are."""
    shown = F.to_json(F.array(c))
    return F.substring(shown, F.lit(2), F.length(shown) - 2)


def context_prompt(platform: Column, fields: dict[str, Column], comments: Column, scores: str = "score", body: str = "body") -> Column:
    """The lines of a prompt on one source: its platform, each field that isn't null or empty, and its comments, an array of structs."""
    line = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), quoted(c)))
    said = F.transform(F.coalesce(comments, F.array()), lambda x: F.concat(F.lit("comment (score "), F.coalesce(x[scores].cast("string"), F.lit("None")), F.lit("): "), quoted(F.coalesce(x[body], F.lit("")))))
    return F.concat_ws("\n", F.concat(F.lit("platform: "), F.coalesce(platform, F.lit("None"))), *[line(k, c) for k, c in fields.items()], said)
