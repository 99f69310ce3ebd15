"""Cues of authority, staging and dialogue in titles, channels, tags and spoken text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

# fixed values: titles of scripted series, games, compilations and recurring brands, matched in any case
TITLE_JUNK = [
    r"\bfull\s+(movie|film|episode)\b", r"\bepisode\s+\d+\b", r"\bofficial\s+trailer\b",
    r"\bgameplay\b", r"\bwalkthrough\b", r"\blet'?s\s+play\b", r"\bgta\s*[v5]?\b", r"\bfivem\b",
    r"\bminecraft\b", r"\broblox\b", r"\bwwe\b", r"\baew\b", r"\bsmackdown\b", r"\bwrestl",
    r"\bcompilation\b",
    r"\bs\d{1,2}e\d{1,2}\b", r"\bep\.?\s*#?\s*\d+", r"\bdhar\s*mann\b",
    r"(?:dash\s*cam|bad\s+driv|idiot\s+driv|road\s+rage|car\s+crashes?)[^\n]*#\s*\d+",
    r"\bvines\b", r"\bpick.?up\s+lines?\b", r"\breddit\s+(?:cheating|stor(?:y|ies))\b", r"#reddit\b",
    r"\bwalang\s+hanggang\s+paalam\b",
    r"\bgets\s+grounded\b", r"\bmisbehaves\s+at\b",
    r"\bkitchen\s*nightmare", r"\bhell'?s\s*kitchen\b", r"\bhotel\s*hell\b",
    r"\bmaster\s*chef\b", r"\bgordon\s*ramsay\b",
    r"\bdramatize\s*me\b", r"\bownage\s*pranks?\b", r"\bprank\s*invasion\b",
    r"\bkissing\s*prank", r"\btelenovela\b", r"\bteleserye\b", r"\btry\s*not\s*to\s*laugh\b",
]
# fixed values: cues of authority
AUTHORITY_TAGS = ["arrest", "authority", "detention", "police order"]
AUTHORITY_NORMS = ["authority assertion", "compliance with authority", "compliance with police orders", "law enforcement", "law enforcement action", "law enforcement involvement", "obey police orders", "respect law enforcement", "surrender"]
AUTHORITY = {
    "under_or_threatened_arrest": r"\b(?:(?:you(?:'re| are)|you'?re)\s+under\s+arrest|(?:i(?:'m| am)|we(?:'re| are))\s+going\s+to\s+arrest\s+you)\b",
    "jail_or_citation": r"\b(?:(?:you(?:'re| are)|he(?:'s| is)|she(?:'s| is)|they(?:'re| are))\s+going\s+to\s+(?:go\s+to\s+)?jail|(?:i(?:'m| am)|we(?:'re| are))\s+(?:going\s+to\s+)?send(?:ing)?\s+you\s+to\s+jail|receive\s+(?:a\s+)?citation|issue\s+(?:you\s+)?(?:a\s+)?citation)\b",
    "stay_where_you_are": r"\bstay\s+where\s+you\s+are\b",
    "give_yourself_up": r"\bgive\s+yourself\s+up\b",
    "get_on_floor_or_ground": r"\b(?:get|lay|lie|stay)\s+(?:down\s+)?(?:on\s+)?the\s+(?:floor|ground)\b",
    "hands_command": r"\b(?:show\s+(?:me\s+)?your\s+hands|(?:put|get|keep)\s+your\s+hands?\s+(?:behind|out(?:\s+of\s+your\s+pockets?)?|where\s+i\s+can\s+see))\b",
    "stop_resisting": r"\bstop\s+resisting\b",
    "unlock_command": r"\bunlock\s+(?:the\s+)?(?:door|window|car|vehicle|it)\b",
    "drop_weapon": r"\b(?:drop|put\s+down)\s+(?:the\s+)?(?:gun|weapon|knife)\b",
    "breath_test": r"\b(?:breath|breathalyser|breathalyzer|drugs?)\s+test\b",
    "failed_to_stop": r"\b(?:fail(?:ed)?|refus(?:e|ed))\s+to\s+stop\b",
}
# fixed values: cues of staging
TITLE_STAGING = r"\b(?:prank(?:ster|sters|ed|ing|s)?|social experiment|hidden camera)\b"
TITLE_PROGRAMME = r"\bwhat\s+would\s+you\s+do\b|\bwwyd\b"
PROGRAMME_CHANNEL = "what would you do?"
TITLE_INITIATED = (
    r"\b(?:trying to|attempting to|how to)\s+(?:kiss|hit on|pick up|touch|hug|scare|annoy|fight|propose to)\s+(?:random\s+)?(?:girls|women|men|guys|strangers|people)\b"
    r"|\b(?:kissing|hitting on|picking up|hugging|scaring|annoying)\s+(?:random\s+)?(?:girls|women|men|guys|strangers|people)\b"
)
REVEAL = (
    r"\b(?:it(?:'s| is)|this is|that(?:'s| is)|we(?:'re| are)(?: just)?(?: doing)?|just doing) (?:a )?(?:joke|prank)\b"
    r"|\b(?:you(?:'re| are)|we(?:'re| are)) on camera\b|\b(?:we are|we're) (?:filming|recording) (?:this|you)\b"
)
INTRO = r"\b(?:what(?:'s| is) up|yo) (?:guys|everybody)\b|\b(?:hello|hey) (?:guys|everybody|ladies and gentlemen)\b"
PLAN = r"\btoday (?:i(?:'m| am)|we(?:'re| are)) (?:going to|gonna)\b|\blet(?:'s| us) see (?:how|if|what)\b|\bgoing (?:up|around) to (?:people|strangers)\b"
CALL = r"\b(?:leave|put) (?:it|your idea|your ideas) in the comments\b|\b(?:like and subscribe|subscribe to (?:my|the) channel)\b"
# fixed values: cues of dialogue and of social action
FIRST_PERSON = r"\b(?:i|i'm|i've|i'll|me|my|mine|we|we're|us|our|ours)\b"
SECOND_PERSON = r"\b(?:you|you're|you've|you'll|your|yours)\b"
SOCIAL_ACTION = r"\b(?:apolog(?:ize|ise|ized|ised|izing|ising)|ask(?:ed|ing)?|attack(?:ed|ing)?|beat(?:en|ing)?|bull(?:y|ied|ying)|cheat(?:ed|ing)?|comfort(?:ed|ing)?|confront(?:ed|ing)?|exclude(?:d|s|ing)?|fight(?:ing)?|forgiv(?:e|es|ing|en)|grab(?:bed|bing)?|help(?:ed|ing)?|hit(?:ting)?|hug(?:ged|ging)?|ignore(?:d|s|ing)?|insult(?:ed|ing)?|interrupt(?:ed|ing)?|invite(?:d|s|ing)?|lie|lied|lying|mock(?:ed|ing)?|push(?:ed|ing)?|refus(?:e|ed|es|ing)|respect(?:ed|ing)?|share(?:d|s|ing)?|shout(?:ed|ing)?|steal|stole|stolen|stealing|thank(?:ed|ing)?|threaten(?:ed|ing)?|touch(?:ed|ing)?|yell(?:ed|ing)?)\b"
# fixed values: domains of social behaviour
SOCIAL_DOMAINS = ["interpersonal_treatment", "communicative_act", "role_or_care_obligation", "shared_space_convention", "solo_social_convention"]


# The concepts that a search query may belong to, each with its pattern.
QUERY_CONCEPTS = {
    "queue_line_cutting": r"queue|line cut|cutting in line|jump.*line",
    "interruption": r"interrupt|talk over|speaks over",
    "public_noise": r"loud music|speakerphone|quiet zone|library noise|noise complaint",
    "littering_shared_cleanup": r"litter|leave.*trash|shopping cart|dog poop|pick up after dog",
    "customer_worker_treatment": r"rude customer|berat.*cashier|yell.*server|customer.*employee|abuse.*staff",
    "sharing_turn_taking": r"shar(?:e|ing)|taking turns|turn taking",
    "borrowing_returning": r"borrow|return.*item|take.*without asking",
    "roommate_chores": r"roommate|housemate|chores|clean.*shared",
    "neighbor_etiquette": r"neighbor|neighbour|driveway|property line",
    "transit_seating": r"bus seat|train seat|public transport|subway etiquette|priority seat",
    "personal_space": r"personal space|too close|touch.*without",
    "phone_etiquette": r"phone etiquette|speakerphone|texting etiquette|group chat",
    "door_elevator": r"hold.*door|elevator etiquette|block.*doorway",
    "gossip_credit_exclusion": r"gossip|takes credit|steal.*credit|exclude.*coworker|left out",
    "apology_honesty": r"apolog|honesty|lying|lies to|deceiv",
    "bullying_bystander": r"bully|bystander.*interven|stand.*up for",
    "dining_guest": r"table manners|dining etiquette|dinner guest|overstay|tipping etiquette",
    "punctuality": r"punctual|late.*meeting|arriv.*late|on time",
}


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?i)" + pattern)


def authority(tag: Column, norm: Column, said: Column) -> Column:
    """Sorted ids of the cues in one reaction: its tag, a command with such a norm, phrases in its own span (not in the context,
    where others speak)."""
    t, n = (squeeze(F.lower(F.coalesce(x, F.lit("")))) for x in (tag, norm))
    ids = [F.when(t.isin(AUTHORITY_TAGS), F.concat(F.lit("tag:"), t)), F.when((t == "command") & n.isin(AUTHORITY_NORMS), F.concat(F.lit("conjunction:command+norm:"), n))]
    ids += [F.when(_has(said, p), F.lit(f"phrase:{name}")) for name, p in AUTHORITY.items()]
    return F.array_sort(F.array_compact(F.array(*ids)))


def staging(title: Column, said: Column, channel: Column) -> dict[str, Column]:
    """What title, transcript and channel say of staging; only audited cues exclude from the organic route."""
    official = F.lower(F.trim(F.coalesce(channel, F.lit("")))) == PROGRAMME_CHANNEL
    named, begun, reveal = _has(title, TITLE_STAGING), _has(title, TITLE_INITIATED), _has(said, REVEAL)
    setup = _has(said, INTRO) & (_has(said, PLAN) | _has(said, CALL))
    return {
        "title_staging": named,
        "title_programme": _has(title, TITLE_PROGRAMME),
        "official_channel": official,
        "title_initiated": begun,
        "explicit_reveal": reveal,
        "creator_setup": setup,
        "explicit_candidate": named | reveal | setup | official,
        "organic_exclusion": named | begun | official,
        "audited_title": named | begun,
        "examples": F.slice(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(f"(?i)({TITLE_STAGING})"), 1), 1, 3),
    }


def dialogue(quote: Column, polarity: Column) -> dict[str, Column]:
    return {
        "non_explanation": F.lower(F.trim(F.coalesce(polarity, F.lit("")))) != "explanation",
        "dialogue_exchange": _has(quote, FIRST_PERSON) & _has(quote, SECOND_PERSON),
        "social_action": _has(quote, SOCIAL_ACTION),
    }


def social_text(domain: Column, grounded: list[Column], procedural: Column, personal: Column, texts: list[Column], norm: Column, polarity: Column, route: Column) -> dict[str, Column]:
    """strict and relabel by the atomic fields, and the rule that the given route breaks, if any."""
    atomic = domain.isin(SOCIAL_DOMAINS) & (procedural == "no") & (personal == "no")
    for g in grounded:
        atomic = atomic & (g == "yes")
    for x in texts:
        atomic = atomic & (F.trim(F.coalesce(x, F.lit(""))) != "")
    strict = atomic & (norm == "yes") & (polarity == "yes")
    relabel = atomic & ~((norm == "yes") & (polarity == "yes"))
    problem = F.when((route == "strict_social_alignment") != strict, "strict_route_mismatch").when((route == "relabel_required") != relabel, "relabel_route_mismatch").when((route == "instructional_retrieval_only") & atomic, "grounded_needs_strict_or_relabel")
    return {"strict": strict, "relabel": relabel, "problem": problem}


def junk_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike("(?i)" + "|".join(TITLE_JUNK))


def concepts(query: Column) -> Column:
    """The names of all concepts that a search query belongs to, whatever its case."""
    return F.array_compact(F.array(*[F.when(F.coalesce(query, F.lit("")).rlike(f"(?i){p}"), F.lit(n)) for n, p in QUERY_CONCEPTS.items()]))
