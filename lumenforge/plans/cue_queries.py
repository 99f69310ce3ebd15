"""Cues of authority, staging and dialogue, and the contract of instructional social texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cues
from .atoms import atoms_sql, with_atoms
from .registry import Tables, query

_has = lambda c, p: f"regexp_matches(coalesce({c}, ''), '{p.replace(chr(39), chr(39) * 2)}', 'i')"
_norm = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"
_in = lambda c, vs: f"{c} IN ({', '.join(repr(v) for v in vs)})"

REACTION = {"tag": (["arrest", "Command", "rude", None, " police  order "], 853), "norm": (["law enforcement", "Surrender", "queueing", None], 857), "said": (["You are under arrest", "show me your hands and get on the ground", "drop the knife", "that is rude", None, "he refused to stop for a breath test", "unlock the door"], 859)}


@query(f"""WITH a AS (SELECT doc_id, {_norm('tag')} AS t, {_norm('norm')} AS n, said FROM ({atoms_sql('documents', 'doc_id', REACTION)})) SELECT doc_id, list_sort(list_filter([CASE WHEN {_in('t', cues.AUTHORITY_TAGS)} THEN 'tag:' || t END, CASE WHEN t = 'command' AND {_in('n', cues.AUTHORITY_NORMS)} THEN 'conjunction:command+norm:' || n END, {', '.join(f"CASE WHEN {_has('said', p)} THEN 'phrase:{k}' END" for k, p in cues.AUTHORITY.items())}], lambda x: x IS NOT NULL)) AS cue_ids FROM a""")
def authority_cues(t: Tables) -> DataFrame:
    return with_atoms(t.documents, "doc_id", REACTION).select("doc_id", cues.authority(F.col("tag"), F.col("norm"), F.col("said")).alias("cue_ids"))


SOURCE = {
    "title": (["Kissing random girls", "PRANK on a prankster, hidden camera", "What would you do", "queue fight", "how to annoy strangers", None], 863), "channel": ([" What Would You Do? ", "Bob", None, "news"], 877),
    "said": (["hey guys today we're going to go", "it's a prank", "hello everybody, like and subscribe", "stop it", None, "you are on camera", "what's up guys"], 881),
}


@query(f"""WITH a AS (SELECT doc_id, title, {_has('title', cues.TITLE_STAGING)} AS named, {_has('title', cues.TITLE_PROGRAMME)} AS prog, lower(trim(coalesce(channel, ''))) = '{cues.PROGRAMME_CHANNEL}' AS official, {_has('title', cues.TITLE_INITIATED)} AS begun, {_has('said', cues.REVEAL)} AS reveal, {_has('said', cues.INTRO)} AND ({_has('said', cues.PLAN)} OR {_has('said', cues.CALL)}) AS setup FROM ({atoms_sql('documents', 'doc_id', SOURCE)}))
SELECT doc_id, named AS title_staging, prog AS title_programme, official AS official_channel, begun AS title_initiated, reveal AS explicit_reveal, setup AS creator_setup, named OR reveal OR setup OR official AS explicit_candidate, named OR begun OR official AS organic_exclusion, named OR begun AS audited_title, regexp_extract_all(coalesce(title, ''), '(?i){cues.TITLE_STAGING}')[1:3] AS examples FROM a""")
def staging_cues(t: Tables) -> DataFrame:
    found = cues.staging(F.col("title"), F.col("said"), F.col("channel"))
    return with_atoms(t.documents, "doc_id", SOURCE).select("doc_id", *[v.alias(k) for k, v in found.items()])


DEMO = {"quote": (["I asked you to share", "you pushed me", "water boils", None, "they were helping", "my turn"], 883), "polarity": (["violation", " Explanation", None], 887)}


@query(f"SELECT doc_id, lower(trim(coalesce(polarity, ''))) <> 'explanation' AS non_explanation, {_has('quote', cues.FIRST_PERSON)} AND {_has('quote', cues.SECOND_PERSON)} AS dialogue_exchange, {_has('quote', cues.SOCIAL_ACTION)} AS social_action FROM ({atoms_sql('documents', 'doc_id', DEMO)})")
def instructional_cues(t: Tables) -> DataFrame:
    return with_atoms(t.documents, "doc_id", DEMO).select("doc_id", *[v.alias(k) for k, v in cues.dialogue(F.col("quote"), F.col("polarity")).items()])


YES, NO = ["yes"] * 8 + ["no", "uncertain"], ["no"] * 8 + ["yes", "uncertain"]
TEXT = {
    "domain": (cues.SOCIAL_DOMAINS * 3 + ["procedural_skill", "unclear"], 907), "g1": (YES, 911), "g2": (YES, 919), "g3": (YES, 929), "g4": (YES, 937), "g5": (YES, 941), "procedural": (NO, 947), "personal": (NO, 953), "quote": (["she thanked him"] * 8 + [" ", None], 967),
    "norm": (YES[5:], 971), "polarity": (YES[5:], 977), "route": (["strict_social_alignment", "strict_social_alignment", "relabel_required", "instructional_retrieval_only", "reject"], 983),
}


@query(f"""WITH a AS (SELECT *, {_in('domain', cues.SOCIAL_DOMAINS)} AND g1 = 'yes' AND g2 = 'yes' AND g3 = 'yes' AND g4 = 'yes' AND g5 = 'yes' AND procedural = 'no' AND personal = 'no' AND trim(coalesce(quote, '')) <> '' AS atomic FROM ({atoms_sql('documents', 'doc_id', TEXT)})), b AS (SELECT *, atomic AND norm = 'yes' AND polarity = 'yes' AS strict, atomic AND (norm <> 'yes' OR polarity <> 'yes') AS relabel FROM a)
SELECT doc_id, strict, relabel, CASE WHEN (route = 'strict_social_alignment') <> strict THEN 'strict_route_mismatch' WHEN (route = 'relabel_required') <> relabel THEN 'relabel_route_mismatch' WHEN route = 'instructional_retrieval_only' AND atomic THEN 'grounded_needs_strict_or_relabel' END AS problem FROM b""")
def social_text_contract(t: Tables) -> DataFrame:
    c = F.col
    out = cues.social_text(c("domain"), [c(f"g{i}") for i in range(1, 6)], c("procedural"), c("personal"), [c("quote")], c("norm"), c("polarity"), c("route"))
    return with_atoms(t.documents, "doc_id", TEXT).select("doc_id", *[v.alias(k) for k, v in out.items()])
