"""Tri-state logic and rule cascades. yes, no and uncertain are values; a null is an error, not a third state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tri_and(*parts: Column) -> Column:
    """no if any is no, else uncertain if any is uncertain, else yes."""
    any_ = lambda v: reduce(lambda a, b: a | b, [p == v for p in parts])
    return F.when(any_("no"), "no").when(any_("uncertain"), "uncertain").otherwise("yes")


def checked(c: Column, allowed: list[str], name: str) -> Column:
    """The value, or an error that names the column when it's null or not allowed."""
    return F.when(F.coalesce(c.isin(allowed), F.lit(False)), c).otherwise(F.raise_error(F.concat(F.lit(f"invalid {name}: "), F.coalesce(c, F.lit("null")))).cast("string"))


def social_norm(actor: Column, behaviour: Column, context: Column, expectation: Column) -> Column:
    """The scope gate from four classifications: outside is no, unresolved is uncertain."""
    outside = (
        (actor == "nonhuman")
        | behaviour.isin("technical_procedure", "accident_or_involuntary_event", "abstract_topic_or_trait")
        | context.isin("private_self_only", "nonhuman_or_object_only")
        | expectation.isin("technical_correctness", "legal_rule_only", "health_or_physical_safety_only", "personal_preference", "none")
    )
    open_ = actor.isin("none", "uncertain") | behaviour.isin("none", "uncertain") | context.isin("none", "uncertain") | (expectation == "uncertain")
    return F.when(outside, "no").when(open_, "uncertain").otherwise("yes")


def disposition(observed: Column, norm: Column, staged_title: Column, authority_text: Column, quality_ok: Column, label_ok: Column) -> Column:
    """Rules in order; the first that applies decides. Nothing is ever deleted: a rejected row is a row."""
    scene = F.when(quality_ok & label_ok, "scene_candidate").otherwise("reject")
    return (
        F.when((observed == "no") | (norm == "no"), "reject")
        .when((observed == "uncertain") | (norm == "uncertain"), "uncertain")
        .when(staged_title, "reroute_instructional_review")
        .when(authority_text, scene)
        .when(quality_ok & label_ok, "strict_accept")
        .when(label_ok, "recover_strict")
        .otherwise("uncertain")
    )


def gate(checks: dict[str, Column]) -> dict[str, Column]:
    """failed and unknown gates as arrays of names; a null is unknown."""
    names = lambda test: F.filter(F.array(*[F.when(test(c), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return {"failed_gates": names(lambda c: c.isNotNull() & ~c), "unknown_gates": names(lambda c: c.isNull())}


# --- atomic classifications ------------------------------------------------------------------------

# fixed values: what each classification may be
ACTORS = ["person", "human_group", "institution", "nonhuman", "none", "uncertain"]
BEHAVIOURS = ["physical_action", "speech_act", "omission", "institutional_action", "technical_procedure", "accident_or_involuntary_event", "abstract_topic_or_trait", "none", "uncertain"]
CONTEXTS = ["person", "human_group", "shared_social_context", "private_self_only", "nonhuman_or_object_only", "none", "uncertain"]
EXPECTATIONS = ["interpersonal_treatment", "shared_coordination", "civic_or_institutional_duty", "conventional_role_obligation", "technical_correctness", "legal_rule_only", "health_or_physical_safety_only", "personal_preference", "none", "uncertain"]
GROUNDING_MODES = ["physical_action_visible", "situated_speech_audiovisual", "description_only", "absent", "uncertain"]
RESPONDER_ROLES = ["independent_bystander", "organic_audience", "affected_party", "participant", "camera_operator", "host", "authority", "unknown"]
LABEL_RELATIONS = ["exact", "broad_but_correct", "wrong_but_relabelable", "unsupported", "uncertain"]
TRI = ["yes", "no", "uncertain"]
PERFORMED_MEDIA = ["live_action", "animation", "puppet_or_toy", "game_or_simulation", "hidden_camera_or_social_experiment"]
OTHER_MEDIA = ["talking_head_only", "text_or_graphic_only", "generic_broll", "screen_tutorial", "audio_only", "uncertain"]
CLEAR_DEMOS = ["clear_visual", "clear_audiovisual"]
UNCLEAR_DEMOS = ["incomplete_or_ambiguous", "none", "uncertain"]
BOUNDARY_BASES = ["exact_video", "frame_grid_only", "none"]
OCCURRENCES = ["on_camera_visual_action", "on_camera_speech_act", "offscreen_only", "described_over_broll", "uncertain", "none"]
SPAN_RELATIONS = ["separate_before_behavior", "separate_after_behavior", "overlaps_behavior", "same_utterance", "not_found", "uncertain"]
TRANSFORMS = ["none", "temporal_cut", "crop", "mute_and_crop"]
AUTHENTICITIES = ["organic", "organic_news_footage", "hidden_camera_genuine", "scripted", "animation", "news_or_commentary", "uncertain"]
EVENT_SCOPES = ["bounded_occurrence", "repeated_specific_occurrence", "aggregate_examples", "generic_or_hypothetical", "ambiguous_or_unresolved", "no_candidate_event"]
STANCES = ["unambiguous_external", "contemporaneous_bystander", "affected_party_objection", "contested", "missing_or_unresolved"]
EVENT_ROUTES = ["strict_visual_search", "instructional_definition_retrieval", "exploratory_contested", "exploratory_ambiguous", "none"]
TARGETED_RESPONSES = ["targeted_objection", "correction_or_sanction", "protective_intervention", "interposition_or_separation"]
SOCIAL_TRIGGERS = ["interpersonal_treatment", "shared_public_conduct"]
#: Titles that make a parent unfit for expansion, in order.
TITLE_BLOCKS = [
    ("road_accident_or_rage", r"\b(road rage|accidents?|crash(?:es)?|wreck(?:s)?|car chase|vehicle pursuit|dash\s*cam)\b"),
    ("produced_or_compilation", r"\b(pranks?|compilation|movie|scripted|drama|episode|teleserye|skit)\b"),
    ("gameplay", r"\b(game\s*play|fortnite|gta|roblox|minecraft|save the world pve)\b"),
    ("police_or_arrest", r"\b(police|cops?|officers?|sheriffs?|body\s*cam|arrest(?:ed|ing|s)?|drug dealer)\b"),
    ("protest_or_spectacle", r"\b(mass strike|protests?|riot(?:s|ing)?)\b"),
    ("sexualized_prank", r"\b(sex prank|foursome|legs open)\b"),
]


def tri_of(c: Column, yes: list[str], no: list[str]) -> Column:
    """yes or no by list, else uncertain."""
    return F.when(c.isin(yes), "yes").when(c.isin(no), "no").otherwise("uncertain")


def scope_labels(actor: Column, behaviour: Column, context: Column, expectation: Column) -> dict[str, Column]:
    """The four labels that follow from the classifications of actor, behaviour, context and expectation."""
    return {
        "social_actor_grounded": tri_of(actor, ACTORS[:3], ["nonhuman", "none"]),
        "concrete_behavior": tri_of(behaviour, BEHAVIOURS[:6], ["abstract_topic_or_trait", "none"]),
        "target_or_shared_context_grounded": tri_of(context, CONTEXTS[:3], ["private_self_only", "nonhuman_or_object_only", "none"]),
        "is_social_norm": social_norm(actor, behaviour, context, expectation),
    }


def audiovisually_grounded(mode: Column) -> Column:
    return tri_of(mode, GROUNDING_MODES[:2], GROUNDING_MODES[2:4])


def bystander_signal(grounded: Column, role: Column) -> Column:
    """The strict subtype: a reaction by a third party. An unknown role is open, any other role isn't one."""
    return F.when(grounded == "no", "no").when(role == "unknown", "uncertain").when(~role.isin(RESPONDER_ROLES[:2]), "no").otherwise(grounded)


def label_alignment(relation: Column) -> Column:
    return tri_of(relation, ["exact", "broad_but_correct"], ["unsupported"])


def label_disposition(relation: Column) -> Column:
    return (
        F.when(relation.isin("exact", "broad_but_correct"), "aligned").when(relation == "wrong_but_relabelable", "repairable_relabel_review")
        .when(relation == "unsupported", "unsupported_review").when(relation == "uncertain", "uncertain_review")
    )


def ordered(start: Column, end: Column) -> Column:
    """Whether both bounds are there, in order, and not negative; never null."""
    return F.coalesce((start >= 0) & (start < end), F.lit(False))


def instructional_disposition(norm: Column, atoms: list[Column], medium: Column, quality: Column, alignment: Column, basis: Column, start: Column, end: Column) -> Column:
    """The review route of a demonstration. A mismatched label is repaired, not a reason to drop the clip."""
    some = lambda v: reduce(lambda a, b: a | b, [x == v for x in atoms])
    return (
        F.when(norm == "no", "out_of_scope_review")
        .when((norm == "uncertain") | some("uncertain") | (medium == "uncertain"), "uncertain")
        .when(some("no") | ~medium.isin(PERFORMED_MEDIA) | ~quality.isin(CLEAR_DEMOS), "text_only_instructional")
        .when(alignment == "uncertain", "uncertain")
        .when((basis != "exact_video") | ~ordered(start, end), "instructional_source_needs_recut")
        .when(alignment == "exact", "instructional_demo_candidate")
        .otherwise("instructional_demo_candidate_after_relabel")
    )


def commentary_disposition(decision: Column, occurrence: Column, identity: Column, context: Column, relation: Column, signal: Column, transform: Column, sanitised: Column, quality: Column, basis: Column, authenticity: Column) -> Column:
    """Whether the text label of a commentary can supervise a clip of the event itself."""
    stripped = relation.isin("overlaps_behavior", "same_utterance") & (transform == "mute_and_crop") & (sanitised == "yes")
    return (
        F.when(~decision.isin("accept", "accept_after_relabel"), "reject")
        .when(~occurrence.isin(OCCURRENCES[:2]), F.when(occurrence == "uncertain", "uncertain").otherwise("text_only"))
        .when((identity != "yes") | (context != "yes"), F.when((identity == "uncertain") | (context == "uncertain"), "uncertain").otherwise("text_only"))
        .when(~relation.isin(SPAN_RELATIONS[:2]) & ~stripped, "text_only")
        .when(signal != "no", F.when(signal == "uncertain", "uncertain").otherwise("text_only"))
        .when((transform != "none") & (sanitised != "yes"), "uncertain")
        .when(~quality.isin(CLEAR_DEMOS) | (basis != "exact_video"), "text_only")
        .when(authenticity.isin("scripted", "animation"), "reroute_instructional_review")
        .when(authenticity.isin(AUTHENTICITIES[:3]), "recover_commentary_visual")
        .when(authenticity == "uncertain", "uncertain")
        .otherwise("text_only")
    )


def occurred_event(atoms: dict[str, Column], scope: Column, stance: Column, quotes: list[Column], route: Column) -> dict[str, Column]:
    """strict, and the first rule that the given route breaks (null: none). atoms by name, occurred_event_grounded and
    behavior_semantically_specific among them."""
    all_ = lambda cs: reduce(lambda a, b: a & b, cs)
    strict = all_([c == "yes" for c in atoms.values()]) & scope.isin(EVENT_SCOPES[:2]) & stance.isin(STANCES[:3]) & all_([F.trim(F.coalesce(q, F.lit(""))) != "" for q in quotes])
    problem = (
        F.when((route == "strict_visual_search") != strict, "strict_route_mismatch")
        .when((route == "instructional_definition_retrieval") & (scope != "generic_or_hypothetical"), "definition_needs_generic_scope")
        .when((route == "instructional_definition_retrieval") & (atoms["occurred_event_grounded"] != "no"), "definition_claims_event")
        .when((route == "exploratory_contested") & (stance != "contested"), "contested_needs_contested_stance")
        .when((route == "exploratory_ambiguous") & ~scope.isin("aggregate_examples", "ambiguous_or_unresolved") & (atoms["behavior_semantically_specific"] == "yes"), "ambiguous_needs_ambiguity")
    )
    return {"strict": strict, "problem": problem}


def strict_reaction(grounded: Column, before: Column, targets: Column, role: Column, content: Column, staging: Column, trigger: Column | None = None, authority: bool = False) -> Column:
    """A grounded, targeted response in time, by a third party, not staged; missing evidence is false. trigger: only social ones."""
    is_ = lambda c, v: F.coalesce(c.isin(v), F.lit(False))
    roles = ["separate_bystander", "organic_audience"] + ["authority_or_host"] * authority
    out = is_(grounded, ["yes"]) & is_(before, ["yes"]) & is_(targets, ["yes"]) & is_(role, roles) & is_(content, TARGETED_RESPONSES) & is_(staging, ["no_clear_staging_evidence"])
    return out if trigger is None else out & is_(trigger, SOCIAL_TRIGGERS)


def parent_gate(scope_reason: Column, title: Column, agent: Column, scene_type: Column, people: Column, role: Column, strength: Column, reactions: Column) -> Column:
    """Why a parent must not be expanded, the first of ordered reasons, or that it may. people and strength are strings: what isn't a
    whole number is invalid, what is missing is 0."""
    flat = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    number = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(c.try_cast("int"))
    n, s = number(people), number(strength)
    out = F.when(scope_reason != "within_ordinary_social_scope", F.concat(F.lit("title_scope:"), scope_reason))
    for reason, pattern in TITLE_BLOCKS:
        out = out.when(flat.rlike("(?i)" + pattern), reason)
    return (
        out.when(agent.isNotNull() & (agent != "human"), "nonhuman_agent")
        .when(F.coalesce(scene_type, F.lit("")) != "action", "not_live_action")
        .when(n.isNull() | s.isNull(), "invalid_scene_metadata")
        .when(n < 3, "fewer_than_three_people")
        .when(F.coalesce(role, F.lit("")) != "bystander", "reactor_not_distinct_bystander")
        .when(s < 3, "weak_or_uncertain_reaction")
        .when(reactions < 1, "no_saved_reaction")
        .otherwise("strong_in_scope_bystander_parent")
    )


def blind_event(observable: Column, needed: Column, presentation: Column, described: list[Column], confidence: Column, least: float = 0.6) -> Column:
    """Whether one observer saw the event without help from metadata, with all of it described, and sure enough."""
    said = [F.coalesce(~c.isin("", "none"), F.lit(False)) for c in described]
    parts = [F.coalesce(observable == "yes", F.lit(False)), F.coalesce(needed == "no", F.lit(False)), F.coalesce(presentation == "no", F.lit(False)), *said]
    return reduce(lambda a, b: a & b, parts) & (F.coalesce(confidence, F.lit(0.0)) >= least)


def evidence_band(first: Column, second: Column, agreement: list[Column], exact: Column) -> Column:
    """Five bands from two blind observers and the alignment of what they saw (agreement: yes, no or uncertain)."""
    aligned = reduce(lambda a, b: a & b, [c == "yes" for c in agreement], first & second)
    return (
        F.when(aligned & (exact == "yes"), "blind_dual_exact_candidate").when(aligned, "blind_dual_relabel_candidate")
        .when(first & second, "blind_event_semantic_conflict_review").when(first | second, "single_blind_event_review").otherwise("low_evidence_review")
    )


def review_tier(retro: Column, polarity: Column) -> Column:
    """Two audited cues, two by two: where the items came from, and whether they show rather than explain."""
    shown = F.lower(F.trim(F.coalesce(polarity, F.lit("unknown")))).isin("violation", "correct", "contrast")
    return (
        F.when(retro & shown, "tier_1_both").when(retro, "tier_1_retro_out_of_combination_support")
        .when(shown, "tier_2_polarity_only").otherwise("tier_3_lower_priority_preserved")
    )


def accepted(pillar: Column, decision: Column) -> Column:
    """Whether a reviewer's decision counts as accepted, by pillar."""
    d = F.coalesce(decision, F.lit(""))
    return (
        F.when(pillar == "instructional", d.isin("accept", "accept_after_trim", "accept_with_repairs"))
        .when(pillar == "witnessed", d == "accept_after_splice").when(pillar == "commentary", d.isin("accept", "accept_after_relabel")).otherwise(False)
    )
