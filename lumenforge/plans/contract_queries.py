"""Contracts: scope labels, dispositions, gates and bands, over atomic classifications of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contracts as c, cues
from ..functions import text
from .atoms import atoms_sql, with_atoms
from .registry import Tables, query

SCOPE = {"actor": (c.ACTORS[:3] * 2 + c.ACTORS, 31), "behaviour": (c.BEHAVIOURS[:4] * 2 + c.BEHAVIOURS, 37), "context": (c.CONTEXTS[:3] * 2 + c.CONTEXTS, 41), "expectation": (c.EXPECTATIONS[:4] * 2 + c.EXPECTATIONS, 43)}
YES = ["yes", "yes", "yes", "no", "uncertain"]
_in = lambda col, values: f"{col} IN ({', '.join(repr(v) for v in values)})"
NORM = f"CASE WHEN actor = 'nonhuman' OR {_in('behaviour', c.BEHAVIOURS[4:7])} OR {_in('context', c.CONTEXTS[3:5])} OR {_in('expectation', c.EXPECTATIONS[4:9])} THEN 'no' WHEN actor IN ('none', 'uncertain') OR behaviour IN ('none', 'uncertain') OR context IN ('none', 'uncertain') OR expectation = 'uncertain' THEN 'uncertain' ELSE 'yes' END"


def _scope() -> dict:
    return c.scope_labels(F.col("actor"), F.col("behaviour"), F.col("context"), F.col("expectation"))


@query(f"""SELECT doc_id, CASE WHEN {_in('actor', c.ACTORS[:3])} THEN 'yes' WHEN actor = 'uncertain' THEN 'uncertain' ELSE 'no' END AS social_actor_grounded,
CASE WHEN behaviour IN ('abstract_topic_or_trait', 'none') THEN 'no' WHEN behaviour = 'uncertain' THEN 'uncertain' ELSE 'yes' END AS concrete_behavior,
CASE WHEN {_in('context', c.CONTEXTS[:3])} THEN 'yes' WHEN context = 'uncertain' THEN 'uncertain' ELSE 'no' END AS target_or_shared_context_grounded, {NORM} AS is_social_norm FROM ({atoms_sql('documents', 'doc_id', SCOPE)})""")
def scope_labels(t: Tables) -> DataFrame:
    return with_atoms(t.documents, "doc_id", SCOPE).select("doc_id", *[v.alias(k) for k, v in _scope().items()])


EVENT = SCOPE | {"signal": (YES, 47), "mode": (c.GROUNDING_MODES, 53), "observable": (YES, 59), "after": (YES, 61), "targets": (YES, 67), "role": (c.RESPONDER_ROLES, 71)}
_and = lambda *p: f"CASE WHEN 'no' IN ({', '.join(p)}) THEN 'no' WHEN 'uncertain' IN ({', '.join(p)}) THEN 'uncertain' ELSE 'yes' END"


@query(f"""WITH a AS ({atoms_sql('documents', 'doc_id', EVENT)}), b AS (SELECT *, {NORM} AS norm, {_and('observable', 'after', 'targets')} AS reaction FROM a)
SELECT doc_id, CASE WHEN mode IN ('physical_action_visible', 'situated_speech_audiovisual') THEN 'yes' WHEN mode = 'uncertain' THEN 'uncertain' ELSE 'no' END AS event_audiovisually_grounded,
{_and('norm', 'signal')} AS norm_event_supported, reaction AS reaction_grounded,
CASE WHEN reaction = 'no' THEN 'no' WHEN role = 'unknown' THEN 'uncertain' WHEN role NOT IN ('independent_bystander', 'organic_audience') THEN 'no' ELSE reaction END AS independent_bystander_signal FROM b""")
def event_support(t: Tables) -> DataFrame:
    d = with_atoms(t.documents, "doc_id", EVENT)
    grounded = c.tri_and(F.col("observable"), F.col("after"), F.col("targets"))
    return d.select(
        "doc_id", c.audiovisually_grounded(F.col("mode")).alias("event_audiovisually_grounded"), c.tri_and(_scope()["is_social_norm"], F.col("signal")).alias("norm_event_supported"),
        grounded.alias("reaction_grounded"), c.bystander_signal(grounded, F.col("role")).alias("independent_bystander_signal"),
    )


LABELS = {"relation": (c.LABEL_RELATIONS, 73), "bounds": (YES, 79), "excluded": (YES, 83)}


@query(f"""SELECT doc_id, CASE relation WHEN 'exact' THEN 'yes' WHEN 'broad_but_correct' THEN 'yes' WHEN 'unsupported' THEN 'no' ELSE 'uncertain' END AS alignment,
CASE relation WHEN 'exact' THEN 'aligned' WHEN 'broad_but_correct' THEN 'aligned' WHEN 'wrong_but_relabelable' THEN 'repairable_relabel_review' WHEN 'unsupported' THEN 'unsupported_review' ELSE 'uncertain_review' END AS disposition,
{_and('bounds', 'excluded')} AS clean_span FROM ({atoms_sql('documents', 'doc_id', LABELS)})""")
def label_dispositions(t: Tables) -> DataFrame:
    d = with_atoms(t.documents, "doc_id", LABELS)
    return d.select("doc_id", c.label_alignment(F.col("relation")).alias("alignment"), c.label_disposition(F.col("relation")).alias("disposition"), c.tri_and(F.col("bounds"), F.col("excluded")).alias("clean_span"))


DEMO = SCOPE | {
    "performed": (["yes"] * 5 + c.TRI, 89), "acted": (["yes"] * 5 + c.TRI, 97), "grounded": (["yes"] * 5 + c.TRI, 101), "connected": (["yes"] * 5 + c.TRI, 103), "medium": (c.PERFORMED_MEDIA * 3 + c.OTHER_MEDIA, 107),
    "quality": (c.CLEAR_DEMOS * 4 + c.UNCLEAR_DEMOS, 109), "alignment": (["exact", "repairable", "mismatch", "uncertain"], 113), "basis": (["exact_video"] * 3 + c.BOUNDARY_BASES, 127), "lo": ([0.0, 1.5, 4.0, None], 131), "hi": ([1.5, 3.0, 8.0, None], 137),
}
_ATOMS = ["performed", "acted", "grounded", "connected"]


@query(f"""WITH a AS ({atoms_sql('documents', 'doc_id', DEMO)}), b AS (SELECT *, {NORM} AS norm, [performed, acted, grounded, connected] AS atoms FROM a)
SELECT doc_id, CASE WHEN norm = 'no' THEN 'out_of_scope_review' WHEN norm = 'uncertain' OR list_contains(atoms, 'uncertain') OR medium = 'uncertain' THEN 'uncertain'
WHEN list_contains(atoms, 'no') OR NOT {_in('medium', c.PERFORMED_MEDIA)} OR quality NOT LIKE 'clear_%' THEN 'text_only_instructional' WHEN alignment = 'uncertain' THEN 'uncertain'
WHEN basis <> 'exact_video' OR NOT coalesce(lo >= 0 AND lo < hi, false) THEN 'instructional_source_needs_recut' WHEN alignment = 'exact' THEN 'instructional_demo_candidate' ELSE 'instructional_demo_candidate_after_relabel' END AS disposition FROM b""")
def instructional_disposition(t: Tables) -> DataFrame:
    col = F.col
    out = c.instructional_disposition(_scope()["is_social_norm"], [col(x) for x in _ATOMS], col("medium"), col("quality"), col("alignment"), col("basis"), col("lo"), col("hi"))
    return with_atoms(t.documents, "doc_id", DEMO).select("doc_id", out.alias("disposition"))


CLIP = {
    "decision": (["accept"] * 3 + ["accept_after_relabel", "reject"], 139), "occurrence": (c.OCCURRENCES[:2] * 4 + c.OCCURRENCES, 149), "identity": (["yes"] * 6 + c.TRI, 151), "grounded": (["yes"] * 6 + c.TRI, 157), "relation": (c.SPAN_RELATIONS[:2] * 2 + c.SPAN_RELATIONS, 163),
    "signal": (["no"] * 6 + c.TRI, 167), "transform": (["none"] * 3 + c.TRANSFORMS, 173), "sanitised": (["yes"] * 4 + c.TRI, 179), "quality": (c.CLEAR_DEMOS * 4 + c.UNCLEAR_DEMOS, 181), "basis": (["exact_video"] * 3 + c.BOUNDARY_BASES, 191), "authenticity": (c.AUTHENTICITIES, 193),
}


@query(f"""SELECT doc_id, CASE WHEN decision = 'reject' THEN 'reject' WHEN occurrence = 'uncertain' THEN 'uncertain' WHEN occurrence NOT LIKE 'on_camera_%' THEN 'text_only'
WHEN 'uncertain' IN (identity, grounded) THEN 'uncertain' WHEN 'no' IN (identity, grounded) THEN 'text_only'
WHEN relation NOT LIKE 'separate_%' AND NOT (relation IN ('overlaps_behavior', 'same_utterance') AND transform = 'mute_and_crop' AND sanitised = 'yes') THEN 'text_only'
WHEN signal = 'uncertain' THEN 'uncertain' WHEN signal = 'yes' THEN 'text_only' WHEN transform <> 'none' AND sanitised <> 'yes' THEN 'uncertain' WHEN quality NOT LIKE 'clear_%' OR basis <> 'exact_video' THEN 'text_only'
WHEN authenticity IN ('scripted', 'animation') THEN 'reroute_instructional_review' WHEN authenticity = 'uncertain' THEN 'uncertain' WHEN authenticity = 'news_or_commentary' THEN 'text_only' ELSE 'recover_commentary_visual' END AS disposition FROM ({atoms_sql('documents', 'doc_id', CLIP)})""")
def commentary_disposition(t: Tables) -> DataFrame:
    return with_atoms(t.documents, "doc_id", CLIP).select("doc_id", c.commentary_disposition(*[F.col(x) for x in CLIP]).alias("disposition"))


OCCURRED = {
    "is_social_norm": (["yes"] * 9 + c.TRI, 197), "occurred_event_grounded": (["yes"] * 6 + c.TRI, 199), "social_actor_grounded": (["yes"] * 9 + c.TRI, 211), "behavior_semantically_specific": (["yes"] * 6 + c.TRI, 223),
    "target_or_shared_context_grounded": (["yes"] * 9 + c.TRI, 227), "normative_stance_grounded": (["yes"] * 9 + c.TRI, 229),
}
CLAIM = OCCURRED | {"scope": (c.EVENT_SCOPES[:2] * 3 + c.EVENT_SCOPES, 233), "stance": (c.STANCES[:3] * 2 + c.STANCES, 239), "quote": (["he shoved in", "they cut the line", "she shouted", "so rude", " ", None], 241), "route": (c.EVENT_ROUTES[:1] * 3 + c.EVENT_ROUTES, 251)}


@query(f"""WITH a AS ({atoms_sql('documents', 'doc_id', CLAIM)}), b AS (SELECT *, {' AND '.join(f"{x} = 'yes'" for x in OCCURRED)} AND {_in('scope', c.EVENT_SCOPES[:2])} AND {_in('stance', c.STANCES[:3])} AND trim(coalesce(quote, '')) <> '' AS strict FROM a)
SELECT doc_id, strict, CASE WHEN (route = 'strict_visual_search') <> strict THEN 'strict_route_mismatch' WHEN route = 'instructional_definition_retrieval' AND scope <> 'generic_or_hypothetical' THEN 'definition_needs_generic_scope'
WHEN route = 'instructional_definition_retrieval' AND occurred_event_grounded <> 'no' THEN 'definition_claims_event' WHEN route = 'exploratory_contested' AND stance <> 'contested' THEN 'contested_needs_contested_stance'
WHEN route = 'exploratory_ambiguous' AND scope NOT IN ('aggregate_examples', 'ambiguous_or_unresolved') AND behavior_semantically_specific = 'yes' THEN 'ambiguous_needs_ambiguity' END AS problem FROM b""")
def occurred_event_contract(t: Tables) -> DataFrame:
    out = c.occurred_event({x: F.col(x) for x in OCCURRED}, F.col("scope"), F.col("stance"), [F.col("quote")], F.col("route"))
    return with_atoms(t.documents, "doc_id", CLAIM).select("doc_id", *[v.alias(k) for k, v in out.items()])


REACTION = {
    "grounded": (["yes"] * 3 + [*c.TRI, None], 257), "before": (["yes"] * 4 + c.TRI, 263), "targets": (["yes"] * 3 + [*c.TRI, None], 269), "role": (["separate_bystander", "organic_audience", "authority_or_host", "offscreen_or_unresolved", "participant", None], 271),
    "content": ([*c.TARGETED_RESPONSES, "generic_affect"], 277), "staging": (["no_clear_staging_evidence"] * 3 + ["clearly_staged", None], 281), "trigger": ([*c.SOCIAL_TRIGGERS, "technical_fault"], 283), "error": ([None] * 30 + ["timeout"], 293),
}
_STRICT = f"coalesce(grounded = 'yes' AND before = 'yes' AND targets = 'yes' AND role IN ('separate_bystander', 'organic_audience') AND {_in('content', c.TARGETED_RESPONSES)} AND staging = 'no_clear_staging_evidence', false)"


def _strict(**more) -> Column:
    return c.strict_reaction(*[F.col(x) for x in ("grounded", "before", "targets", "role", "content", "staging")], **more)


@query(f"""SELECT doc_id, {_STRICT} AS strict, {_STRICT} AND {_in('trigger', c.SOCIAL_TRIGGERS)} AS strict_social, {_STRICT.replace("'organic_audience')", "'organic_audience', 'authority_or_host')")} AS with_authority FROM ({atoms_sql('documents', 'doc_id', REACTION)})""")
def strict_reactions(t: Tables) -> DataFrame:
    d = with_atoms(t.documents, "doc_id", REACTION)
    return d.select("doc_id", _strict().alias("strict"), _strict(trigger=F.col("trigger")).alias("strict_social"), _strict(authority=True).alias("with_authority"))


@query(f"""WITH a AS ({atoms_sql('documents', 'doc_id', REACTION, 'doc_id // 6 AS item')}) SELECT item, CASE WHEN bool_or(error IS NOT NULL) THEN 'model_error_or_missing' WHEN bool_or({_STRICT}) THEN 'predicted_strict_reaction'
WHEN bool_or(coalesce(grounded IN ('yes', 'uncertain'), false) OR coalesce(targets IN ('yes', 'uncertain'), false) OR coalesce(role IN ('separate_bystander', 'organic_audience', 'offscreen_or_unresolved'), false)) THEN 'predicted_near_miss' ELSE 'predicted_clean_negative' END AS outcome FROM a GROUP BY item""")
def model_outcomes(t: Tables) -> DataFrame:
    """One outcome of each item's candidates: an error, any strict one, any near miss, or none."""
    is_ = lambda x, v: F.coalesce(F.col(x).isin(v), F.lit(False))
    near = is_("grounded", ["yes", "uncertain"]) | is_("targets", ["yes", "uncertain"]) | is_("role", ["separate_bystander", "organic_audience", "offscreen_or_unresolved"])
    found = with_atoms(t.documents, "doc_id", REACTION).groupBy(F.expr("doc_id div 6").alias("item")).agg(F.bool_or(F.col("error").isNotNull()).alias("e"), F.bool_or(_strict()).alias("s"), F.bool_or(near).alias("n"))
    return found.select("item", F.when(F.col("e"), "model_error_or_missing").when(F.col("s"), "predicted_strict_reaction").when(F.col("n"), "predicted_near_miss").otherwise("predicted_clean_negative").alias("outcome"))


PARENT = {
    "title": (["a man cuts the line", "she shouts at a waiter", "police arrest in the park", "car crash", "funny prank", "fortnite match", "mass strike", "argument on a train", "  two  people argue ", None, "neighbours argue", "queue jumper"], 307), "agent": ([None, "human", "human", "human", "animal"], 311),
    "scene": (["action"] * 5 + ["narration", "mixed", None], 313), "people": (["3", "4", "5", "9", "2", "many", None], 317), "role": (["bystander"] * 4 + ["victim", None], 331), "strength": (["3", "4", "5", "2", "strong", ""], 337), "reactions": ([0, 1, 2, 3], 347),
}
_TITLE = "trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))"
_SCOPE = f"CASE WHEN q = '' THEN 'empty_query' WHEN length(q) > 120 THEN 'query_too_long' {' '.join(f"WHEN regexp_matches(lower(q), '{p}') THEN '{n}'" for n, p in text.SCOPE_BLOCKS)} ELSE 'within_ordinary_social_scope' END"
_INT = lambda x: f"CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE TRY_CAST({x} AS INTEGER) END"


@query(f"""WITH a AS (SELECT *, {_TITLE} AS q, {_INT('people')} AS n, {_INT('strength')} AS s FROM ({atoms_sql('documents', 'doc_id', PARENT)})), b AS (SELECT *, {_SCOPE} AS scope FROM a)
SELECT doc_id, CASE WHEN scope <> 'within_ordinary_social_scope' THEN 'title_scope:' || scope {' '.join(f"WHEN regexp_matches(q, '{p}', 'i') THEN '{n}'" for n, p in c.TITLE_BLOCKS)} WHEN agent <> 'human' THEN 'nonhuman_agent' WHEN scene IS NULL OR scene <> 'action' THEN 'not_live_action'
WHEN n IS NULL OR s IS NULL THEN 'invalid_scene_metadata' WHEN n < 3 THEN 'fewer_than_three_people' WHEN role IS NULL OR role <> 'bystander' THEN 'reactor_not_distinct_bystander' WHEN s < 3 THEN 'weak_or_uncertain_reaction' WHEN reactions < 1 THEN 'no_saved_reaction' ELSE 'strong_in_scope_bystander_parent' END AS reason FROM b""")
def snowball_parent_gate(t: Tables) -> DataFrame:
    d = with_atoms(t.documents, "doc_id", PARENT)
    flat = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    return d.select("doc_id", c.parent_gate(text.scope_gate(flat, F.lit(True)), *[F.col(x) for x in ("title", "agent", "scene", "people", "role", "strength", "reactions")]).alias("reason"))


SEEN = {f"{n}{i}": (v, s + 2 * i) for i in (1, 2) for n, v, s in (("seen", ["yes"] * 4 + c.TRI, 349), ("needed", ["no"] * 4 + ["yes"], 359), ("shown", ["no"] * 4 + ["yes", None], 367), ("said", ["a man", "two women", "a queue", "none", "", None], 373), ("sure", [0.9, 0.8, 0.6, 0.55, None], 379))}
SEEN |= {"found": (["yes"] * 5 + c.TRI, 389), "same": (["yes"] * 5 + c.TRI, 397), "independent": (["yes"] * 5 + c.TRI, 401), "usable": (["yes"] * 5 + c.TRI, 409), "exact": (c.TRI, 419)}
_BLIND = lambda i: f"coalesce(seen{i} = 'yes' AND needed{i} = 'no' AND shown{i} = 'no' AND said{i} NOT IN ('', 'none'), false) AND coalesce(sure{i}, 0) >= 0.6"


@query(f"""WITH a AS (SELECT *, {_BLIND(1)} AS p, {_BLIND(2)} AS q FROM ({atoms_sql('documents', 'doc_id', SEEN)})), b AS (SELECT *, p AND q AND found = 'yes' AND same = 'yes' AND independent = 'yes' AND usable = 'yes' AS aligned FROM a)
SELECT doc_id, CASE WHEN aligned AND exact = 'yes' THEN 'blind_dual_exact_candidate' WHEN aligned THEN 'blind_dual_relabel_candidate' WHEN p AND q THEN 'blind_event_semantic_conflict_review' WHEN p OR q THEN 'single_blind_event_review' ELSE 'low_evidence_review' END AS band FROM b""")
def blind_evidence_bands(t: Tables) -> DataFrame:
    pass_ = lambda i: c.blind_event(F.col(f"seen{i}"), F.col(f"needed{i}"), F.col(f"shown{i}"), [F.col(f"said{i}")], F.col(f"sure{i}"))
    band = c.evidence_band(pass_(1), pass_(2), [F.col(x) for x in ("found", "same", "independent", "usable")], F.col("exact"))
    return with_atoms(t.documents, "doc_id", SEEN).select("doc_id", band.alias("band"))


TIER = {"origin": (["retro_instr_scan", "search", "related", None], 421), "polarity": (["violation", " Correct", "contrast", "explanation", "", None], 431)}


@query(f"""WITH a AS (SELECT doc_id, coalesce(origin = 'retro_instr_scan', false) AS retro, lower(trim(coalesce(polarity, 'unknown'))) IN ('violation', 'correct', 'contrast') AS shown FROM ({atoms_sql('documents', 'doc_id', TIER)}))
SELECT doc_id, CASE WHEN retro AND shown THEN 'tier_1_both' WHEN retro THEN 'tier_1_retro_out_of_combination_support' WHEN shown THEN 'tier_2_polarity_only' ELSE 'tier_3_lower_priority_preserved' END AS tier FROM a""")
def combined_review_tiers(t: Tables) -> DataFrame:
    return with_atoms(t.documents, "doc_id", TIER).select("doc_id", c.review_tier(F.coalesce(F.col("origin") == "retro_instr_scan", F.lit(False)), F.col("polarity")).alias("tier"))


AUDIT = {
    "pillar": (["instructional", "witnessed", "commentary"], 433), "decision": (["accept", "accept_after_trim", "accept_with_repairs", "accept_after_splice", "accept_after_relabel", "reject", None], 439), "norm": (YES, 443), "event": (YES, 449), "label": (YES, 457), "first": (YES, 461), "aimed": (YES, 463), "judged": (YES, 467),
    "rubric": (["instructional_recut_v1", "v2", "v2", None], 479), "batch": (["recut_7", "b1", "b2"], 487), "repair": ([None, None, "trim"], 491),
}
_OK = "CASE pillar WHEN 'instructional' THEN coalesce(decision IN ('accept', 'accept_after_trim', 'accept_with_repairs'), false) WHEN 'witnessed' THEN coalesce(decision = 'accept_after_splice', false) ELSE coalesce(decision IN ('accept', 'accept_after_relabel'), false) END"


@query(f"""WITH a AS ({atoms_sql('documents', 'doc_id', AUDIT)}), b AS (SELECT doc_id, pillar, unnest(['is_social_norm', CASE pillar WHEN 'commentary' THEN 'concrete_behavior' ELSE 'visual_event' END, 'label_supported', 'strict_keep', CASE pillar WHEN 'witnessed' THEN 'causal_reaction' WHEN 'commentary' THEN 'normative_stance' END]) AS axis,
unnest([norm = 'yes', event = 'yes', label = 'yes', {_OK}, CASE pillar WHEN 'witnessed' THEN first = 'yes' AND aimed = 'yes' AND judged = 'yes' WHEN 'commentary' THEN first = 'yes' END]) AS held FROM a)
SELECT pillar, axis, count(*) AS reviewed, count(*) FILTER (held) AS held, count(*) FILTER (held)::DOUBLE / count(*) AS rate FROM b WHERE axis IS NOT NULL GROUP BY pillar, axis""")
def evidence_axes(t: Tables) -> DataFrame:
    """Reviewed items by pillar and axis of evidence, and how many hold it."""
    yes = lambda x: F.col(x) == "yes"
    p = F.col("pillar")
    axis = lambda name, held, when=None: (F.struct(F.lit(name).alias("axis"), held.alias("held")) if when is None else F.when(when, F.struct(F.lit(name).alias("axis"), held.alias("held"))))
    axes = F.array_compact(
        F.array(
            axis("is_social_norm", yes("norm")), axis("label_supported", yes("label")), axis("strict_keep", c.accepted(p, F.col("decision"))),
            axis("concrete_behavior", yes("event"), p == "commentary"), axis("visual_event", yes("event"), p != "commentary"),
            axis("causal_reaction", yes("first") & yes("aimed") & yes("judged"), p == "witnessed"), axis("normative_stance", yes("first"), p == "commentary"),
        )
    )
    d = with_atoms(t.documents, "doc_id", AUDIT).select("pillar", F.explode(axes).alias("x")).groupBy("pillar", "x.axis")
    return d.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if("x.held").alias("held")).withColumn("rate", F.col("held") / F.col("reviewed"))


@query(f"""SELECT doc_id, CASE WHEN rubric = 'instructional_recut_v1' OR starts_with(batch, 'recut_') OR repair IS NOT NULL THEN 'repair' ELSE 'source' END AS stage FROM ({atoms_sql('documents', 'doc_id', AUDIT)})""")
def artifact_stage(t: Tables) -> DataFrame:
    repaired = F.coalesce(F.col("rubric") == "instructional_recut_v1", F.lit(False)) | F.coalesce(F.col("batch").startswith("recut_"), F.lit(False)) | F.col("repair").isNotNull()
    return with_atoms(t.documents, "doc_id", AUDIT).select("doc_id", F.when(repaired, "repair").otherwise("source").alias("stage"))


DETECTED = {
    "target": (["yes"] * 6 + ["no", "error"], 499), "negative": (["none"] * 4 + [None, "staged", "spectacle"], 503), "modality": (["witnessed"] * 3 + ["commentary", None], 509), "scene": (["action", "narration", "narration", None], 521), "people": (["1", "0", "2", "several", None], 523),
    "quotes": ([0, 1, 2, 3], 541), "cues": ([0, 1, 2], 547), "origin": (["search", "null", "instr"], 557),
}


@query(f"""WITH a AS (SELECT *, coalesce(TRY_CAST(people AS INTEGER), 0) AS n FROM ({atoms_sql('documents', 'doc_id', DETECTED)})),
b AS (SELECT *, CASE WHEN target = 'error' THEN NULL WHEN target <> 'yes' OR coalesce(negative, 'none') <> 'none' THEN 'drop:' || coalesce(negative, 'none') END AS verdict,
CASE WHEN target = 'error' THEN 'witnessed' WHEN target <> 'yes' OR coalesce(negative, 'none') <> 'none' THEN NULL WHEN coalesce(modality, 'witnessed') = 'witnessed' AND scene = 'narration' AND n <= 1 THEN 'commentary' ELSE coalesce(modality, 'witnessed') END AS how FROM a),
d AS (SELECT *, CASE WHEN verdict IS NOT NULL THEN 0 WHEN target = 'error' THEN cues WHEN how = 'commentary' THEN quotes WHEN quotes > 0 THEN quotes ELSE cues END AS kept FROM b)
SELECT doc_id, coalesce(verdict, 'none') AS verdict, how AS modality, kept, CASE WHEN origin = 'null' AND verdict IS NOT NULL THEN 'verified_negative' WHEN kept > 0 AND how = 'commentary' THEN 'discussion' WHEN kept > 0 THEN 'hit' WHEN verdict IS NOT NULL THEN 'dropped' ELSE 'miss' END AS route FROM d""")
def detector_routing(t: Tables) -> DataFrame:
    """Detector results to a verdict, a modality, what is kept, and the terminal route: a hard negative drops all; an error falls
    back to cues; a lone narrator is commentary; cues stand in for quotes that weren't found."""
    d = with_atoms(t.documents, "doc_id", DETECTED)
    error = F.col("target") == "error"
    drop = ~error & ((F.col("target") != "yes") | (F.coalesce("negative", F.lit("none")) != "none"))
    lone = F.coalesce(F.col("scene") == "narration", F.lit(False)) & (F.coalesce(F.col("people").try_cast("int"), F.lit(0)) <= 1)
    said = F.coalesce("modality", F.lit("witnessed"))
    d = d.withColumn("how", F.when(error, "witnessed").when(~drop, F.when((said == "witnessed") & lone, "commentary").otherwise(said)))
    d = d.withColumn("kept", F.when(drop, 0).when(error, F.col("cues")).when(F.col("how") == "commentary", F.col("quotes")).when(F.col("quotes") > 0, F.col("quotes")).otherwise(F.col("cues")))
    route = F.when(drop & (F.col("origin") == "null"), "verified_negative").when((F.col("kept") > 0) & (F.col("how") == "commentary"), "discussion").when(F.col("kept") > 0, "hit").when(drop, "dropped").otherwise("miss")
    return d.select("doc_id", F.when(drop, F.concat(F.lit("drop:"), F.coalesce("negative", F.lit("none")))).otherwise("none").alias("verdict"), F.col("how").alias("modality"), "kept", route.alias("route"))


POLICY = {"query": (["stop that", "blocked thing", "police chase", "queue", "rude nation"], 563), "auto": ([True, True, False], 569), "old": (["", "blocked_theme:x", "auto_scope:v1:y", "manual: keep out", None], 571)}


@query(f"""WITH a AS (SELECT *, query AS q FROM ({atoms_sql('documents', 'doc_id', POLICY)})), b AS (SELECT *, CASE WHEN regexp_matches(query, 'thing', 'i') THEN 'blocked_theme:thing' WHEN regexp_matches(query, 'ation', 'i') THEN 'blocked_theme:ation' WHEN auto AND {_SCOPE} <> 'within_ordinary_social_scope' THEN 'auto_scope:' || {_SCOPE} END AS reason FROM a)
SELECT doc_id, CASE WHEN reason IS NOT NULL OR starts_with(coalesce(old, ''), 'blocked_theme:') OR starts_with(coalesce(old, ''), 'auto_scope:') THEN reason ELSE old END AS policy_reason FROM b""")
def policy_refresh(t: Tables) -> DataFrame:
    """Exclusions that the configuration owns are renewed or lifted; a reason that a person gave stays."""
    d = with_atoms(t.documents, "doc_id", POLICY)
    scope = text.scope_gate(F.col("query"), F.lit(True))
    auto = F.when(F.col("auto") & (scope != "within_ordinary_social_scope"), F.concat(F.lit("auto_scope:"), scope))
    reason = F.coalesce(text.policy_reason(F.col("query"), ["thing", "ation"]), auto)
    return d.select("doc_id", F.when(reason.isNotNull() | F.coalesce(F.col("old").rlike("^(blocked_theme:|auto_scope:)"), F.lit(False)), reason).otherwise(F.col("old")).alias("policy_reason"))


#: Titles as they come, in front of the document's own first words.
CANDIDATE = {"title": (["queue row", "Full  Movie 2020", "GTA 5 online", "neighbour shouts", None, "minecraft base", "S01E04", "Ep. #12", "Dash cam fails #3", "let's play it", "a skit", "Wrestling", "Hells kitchen", "gameplays", "Try not to LAUGH"], 577), "channel": (["Alice", " Clip Farm ", "CLIP FARM", "", None, "bob"], 587), "duration": ([30.0, 600.0, 1800.0, 1800.5, None], 593)}
_JUNK = "|".join(cues.TITLE_JUNK).replace("'", "''")


@query(f"""SELECT doc_id, CASE WHEN duration > 1800 THEN 'too_long' WHEN regexp_matches(title || ' ' || coalesce(text, ''), '{_JUNK}', 'i') THEN 'junk_title' WHEN lower(trim(channel)) IN ('clip farm', 'soap hub') THEN 'blocked_channel' ELSE 'kept' END AS outcome FROM (SELECT a.*, text FROM ({atoms_sql('documents', 'doc_id', CANDIDATE)}) a JOIN documents d ON a.doc_id = d.doc_id)""")
def candidate_prefilter(t: Tables) -> DataFrame:
    """Length, title and channel before anything is fetched; an unknown length passes. The blocklist is a configured list: broadcast by its size."""
    d = with_atoms(t.documents, "doc_id", CANDIDATE, "text")
    blocked = t.spark.createDataFrame([("clip farm",), ("soap hub",)], "blocked string")
    d = d.join(F.broadcast(blocked), F.lower(F.trim("channel")) == F.col("blocked"), "left")
    junk = cues.junk_title(F.concat("title", F.lit(" "), F.coalesce("text", F.lit(""))))
    return d.select("doc_id", F.when(F.col("duration") > 1800, "too_long").when(junk, "junk_title").when(F.col("blocked").isNotNull(), "blocked_channel").otherwise("kept").alias("outcome"))


PROVENANCE = {"query": (["q1", "q2", None], 599), "conflict": ([True, False, False, None], 601)}


@query(f"""WITH a AS (SELECT CASE WHEN conflict THEN '<provenance_conflict>' ELSE query END AS q, doc_id % 3 = 0 AS hit, doc_id % 5 = 0 AS strict FROM ({atoms_sql('documents', 'doc_id', PROVENANCE)}))
SELECT coalesce(q, '<missing>') AS query, count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (hit)::DOUBLE / count(*) AS hit_rate, count(*) FILTER (strict) AS stricts, count(*) FILTER (strict)::DOUBLE / count(*) AS strict_rate FROM a GROUP BY 1""")
def yield_by_attributed_query(t: Tables) -> DataFrame:
    """Several outcomes by the query that they are owed to; where sources of provenance conflict, to none."""
    d = with_atoms(t.documents, "doc_id", PROVENANCE)
    owed = F.coalesce(F.when(F.coalesce("conflict", F.lit(False)), "<provenance_conflict>").otherwise(F.col("query")), F.lit("<missing>"))
    hit, strict = F.count_if(F.col("doc_id") % 3 == 0), F.count_if(F.col("doc_id") % 5 == 0)
    n = F.count(F.lit(1))
    return d.groupBy(owed.alias("query")).agg(n.alias("n"), hit.alias("hits"), (hit / n).alias("hit_rate"), strict.alias("stricts"), (strict / n).alias("strict_rate"))
