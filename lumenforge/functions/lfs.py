"""Labelling functions as Column expressions: records, atomic contracts, the rules of a registry, cues of texts, scenes and pictures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as words

# fixed values: pillars and their targets, evidence families, atomic families with their fields
TARGETS = {
    "witnessed": ["norm_event_supported", "reaction_grounded", "independent_bystander_signal", "event_audiovisually_grounded", "clean_pre_reaction_span"],
    "instructional": ["explicit_social_rule_grounded", "demonstration_present", "event_audiovisually_grounded", "label_alignment", "clean_demo_span"],
    "commentary": ["commentary_text_label_supported", "occurred_event_supported", "event_present_in_source", "event_audiovisually_grounded", "clean_action_span"],
}
FAMILIES = ["event_action", "reaction", "temporal_causal_grounding", "actor_role_binding", "social_context", "explicit_semantics", "visual_depiction", "source_format_provenance", "contradiction_hard_negative", "semantic_model_judgment", "retrieval_lineage"]
_SOCIAL = ["social_actor_grounded", "concrete_behavior", "target_or_shared_context_grounded", "is_social_norm"]
ATOMIC = {
    "witnessed": {"social_scope": _SOCIAL, "distinct_reactor": ["distinct_bystander", "reactor_non_authority", "reactor_on_scene"], "causal_response": ["reaction_targets_event", "action_before_reaction"], "observable_reaction": ["reaction_observable"], "clean_training_span": ["pre_reaction_action_complete", "reaction_excluded_from_training_clip"], "organic_source": ["organic_authenticity"]},
    "instructional": {"social_scope": _SOCIAL, "demonstration": ["demo_event_observable", "demo_action_complete"], "same_event_grounding": ["actor_action_target_same_event"], "semantic_alignment": ["demo_matches_extracted_norm"], "polarity_alignment": ["demo_matches_polarity"], "clean_training_span": ["demo_temporally_localized", "label_explanation_outside_training_clip"]},
    "commentary": {"social_scope": _SOCIAL, "occurred_event_text": ["occurred_event_grounded", "behavior_semantically_specific", "normative_stance_grounded"], "same_event_grounding": ["actor_action_target_same_event"], "visual_localization": ["event_visible", "event_temporally_localized"], "semantic_alignment": ["visual_event_matches_repaired_label"], "clean_training_span": ["label_bearing_text_absent"]},
}
EVIDENCE_OF = {
    "social_scope": "social_context", "distinct_reactor": "actor_role_binding", "causal_response": "temporal_causal_grounding", "observable_reaction": "reaction", "clean_training_span": "contradiction_hard_negative", "organic_source": "source_format_provenance",
    "demonstration": "event_action", "same_event_grounding": "temporal_causal_grounding", "semantic_alignment": "explicit_semantics", "polarity_alignment": "explicit_semantics", "occurred_event_text": "event_action", "visual_localization": "visual_depiction",
}
DEFAULT_TARGET = {"witnessed": "norm_event_supported", "instructional": "demonstration_present", "commentary": "occurred_event_supported"}
USES = ["review_routing", "review_ranking", "strict_route_exclusion", "shadow_lf_vote", "acceptance_gate"]
OCCURRED = r"\b(?:happened|occurred|saw|witnessed|caught on (?:camera|video|cctv)|yesterday|last (?:week|night|year)|this (?:man|woman|guy|lady|person)\b.{0,40}\b(?:did|was|got))\b"
REPORTED = r"\b(?:said|says|told|reported|reportedly|according to|claimed|alleged(?:ly)?|happened|recalled|had been)\b"
HYPOTHETICAL = r"\b(?:imagine|what if|hypothetically|let'?s say|suppose|would you|if (?:you|someone|somebody)|in general|people (?:who|that) (?:always|never))\b"
FOOTAGE = r"\b(?:you can see|as you can see|watch (?:this|as)|take a look|(?:video|footage|clip) shows?|caught on (?:camera|video|cctv)|in this (?:video|footage|clip))\b"
TRANSITION = r"\b(?:watch this|let'?s watch|look at this|here'?s an example|role[- ]?play|demonstration|scenario|act it out|what happens)\b"
AUDIO_PEAK = 0.2


def record(target: str | Column, lf_id: str | Column, family: str | Column, vote: Column, reason: str | Column) -> Column:
    """A vote as a struct; only an abstention carries its reason."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(target).alias("target"), lit(lf_id).alias("lf_id"), lit(family).alias("family"), vote.cast("int").alias("vote"), F.when(vote == 0, lit(reason)).alias("abstain_reason"))


def vote(positive: Column, negative: Column | None = None) -> Column:
    """1, else -1, else 0; what is unknown counts as not met."""
    out = F.when(F.coalesce(positive, F.lit(False)), 1)
    return (out if negative is None else out.when(F.coalesce(negative, F.lit(False)), -1)).otherwise(0)


def record_problem(c: dict[str, Column]) -> Column:
    """The first rule that a vote record breaks, null if it's valid. c: the record's columns by name."""
    missing = lambda x: F.coalesce(x, F.lit("")) == ""
    target = reduce(lambda a, b: a | b, [(c["pillar"] == p) & c["target"].isin(t) for p, t in TARGETS.items()])
    none = lambda x: ~F.coalesce(x, F.lit(False))
    return (
        F.when(none(c["pillar"].isin(list(TARGETS))), "pillar").when(none(target), "target")
        .when(missing(c["item_id"]) | missing(c["lf_id"]) | missing(c["version"]), "identifier").when(none(c["family"].isin(FAMILIES)), "family")
        .when(none(c["vote"].isin(-1, 0, 1)), "vote").when((c["vote"] == 0) & missing(c["reason"]), "abstain_without_reason").when((c["vote"] != 0) & c["reason"].isNotNull(), "reason_without_abstain")
        .when(none(c["confidence"].isNull() | c["confidence"].between(0.0, 1.0)), "confidence").when(none(c["sha256"].isNull() | c["sha256"].rlike("^[0-9a-f]{64}$")), "sha256")
    )


def family_vote(fields: list[Column]) -> Column:
    """-1 if any field is no, 1 if all are yes, else 0; a missing field is uncertain."""
    known = F.array(*[F.coalesce(f, F.lit("uncertain")) for f in fields])
    return F.when(F.array_contains(known, "no"), -1).when(F.forall(known, lambda x: x == "yes"), 1).otherwise(0)


def atomic_records(pillar: str, field) -> Column:
    """One vote for each atomic family, in the family's name; field: gives a column by name."""
    return F.array(*[record(DEFAULT_TARGET[pillar], f"atomic_{pillar}_{name}_v1", EVIDENCE_OF[name], family_vote([field(x) for x in fields]), "unresolved_atomic_fields") for name, fields in ATOMIC[pillar].items()])


def review_band(pillar: str, field) -> Column:
    """A negative family sends to rejection review; else by how many of the core families are positive."""
    votes = F.array(*[family_vote([field(x) for x in fields]) for fields in ATOMIC[pillar].values()])
    positive, core = F.size(F.filter(votes, lambda v: v == 1)), len(ATOMIC[pillar])
    return (
        F.when(F.array_contains(votes, -1), "likely_reroute_or_reject_review").when(positive == core, "complete_manual_review_candidate")
        .when(positive >= max(2, core - 2), "targeted_missing_evidence_review").otherwise("low_priority_preserved")
    )


def rule_problem() -> Column:
    """The first rule of the registry's contract that a row (rule_id, uses, status, accepts, tp, fp, precision, triggers, target, confirmations,
    selected, wilson) breaks, null if it's valid."""
    col = F.col
    held = F.coalesce(col("accepts"), F.lit(True))
    off = F.abs(col("precision") - col("tp") / (col("tp") + col("fp"))) > 1e-9 * F.greatest(F.abs(col("precision")), F.lit(1.0))
    contract = (col("target") == "final_pillar_acceptance") & (col("confirmations") >= 2) & (col("selected") >= 50) & (col("precision") >= 0.9) & (col("wilson") >= 0.8)
    quiet = F.exists("uses", lambda u: u.isin(USES[:3])) & ~F.array_contains("uses", "acceptance_gate")
    return (
        F.when(F.coalesce("rule_id", F.lit("")) == "", "rule_id").when(F.exists("uses", lambda u: ~u.isin(USES)), "unknown_use").when(held, "automatic_acceptance")
        .when(col("tp").isNotNull() & off, "metric_arithmetic").when((col("status") == "audited_for_declared_use") & ((F.size("uses") == 0) | col("tp").isNull()), "active_without_use_or_evidence")
        .when((col("status") == "failed_transfer") & (F.size("uses") > 0), "failed_with_uses").when(~col("status").isin("audited_for_declared_use", "failed_transfer"), "status")
        .when(quiet & (F.size("triggers") == 0), "no_triggers").when(F.array_contains("uses", "acceptance_gate") & ~F.coalesce(contract, F.lit(False)), "promotion_contract")
    )


def registry_records(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """signals (item_id, pillar, rule_id, value) with the rules' votes: a failed rule abstains by construction, one without an audited contract to
    vote does, one that isn't triggered does. The rules are a configured list: broadcast."""
    d = signals.join(F.broadcast(rules), "rule_id").where((F.col("rule_pillar") == F.col("pillar")) | (F.col("rule_pillar") == "all"))
    target = F.create_map(*[F.lit(x) for p in DEFAULT_TARGET.items() for x in p])[F.col("pillar")]
    active, votes = F.col("status") == "audited_for_declared_use", F.array_contains("uses", "shadow_lf_vote") & F.col("vote_target").isNotNull()
    hit = F.coalesce(F.array_contains("triggers", F.col("value")), F.lit(False))
    v = F.when(active & votes & hit, F.col("vote_when_triggered")).otherwise(0)
    reason = F.when(~active, "failed_transfer_registry_enforced").when(~votes, "retrieval_or_ranking_use_only_never_a_label").otherwise("rule_not_triggered")
    r = record(F.when(active & votes, F.col("vote_target")).otherwise(target), F.concat(F.lit("registry_"), F.col("rule_id")), F.when(~active, "semantic_model_judgment").when(~votes, "retrieval_lineage").otherwise(F.col("vote_family")), v, reason)
    return d.select("item_id", "pillar", r.alias("r"), F.when(active & votes & hit, F.col("audited_precision")).alias("confidence")).select("item_id", "pillar", "r.*", "confidence")


def combined(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """item_id with the sorted sets of triggered rules, review routes, exclusions and rankings; never a label."""
    d = signals.join(F.broadcast(rules), "rule_id").where((F.col("status") == "audited_for_declared_use") & F.coalesce(F.array_contains("triggers", F.col("value")), F.lit(False)))
    set_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    found = d.groupBy("item_id").agg(F.array_sort(F.collect_set("rule_id")).alias("triggered"), set_of("routes").alias("routes"), set_of("exclusions").alias("exclusions"), F.array_sort(F.collect_set(F.when(F.array_contains("uses", "review_ranking"), F.col("rule_id")))).alias("rankings"))
    return found


def witnessed_records(role: Column, people: Column, scene: Column, active: Column, generic: Column, texts: Column, peak: Column) -> Column:
    """Six votes on a clip from its scene block, the language of its reactions, and the peak of scored sounds."""
    content = F.when(active, 1).when((texts > 0) & generic, -1).otherwise(0)
    return F.array(
        record("independent_bystander_signal", "det_witnessed_scene_reactor_role_v1", "actor_role_binding", vote(role == "bystander", role.isin("victim", "camera_person")), "reactor_role_missing_or_mixed"),
        record("independent_bystander_signal", "det_witnessed_scene_n_people_v1", "social_context", vote(people >= 3, people <= 1), "n_people_missing_or_two_person_scene"),
        record("norm_event_supported", "det_witnessed_scene_action_type_v1", "event_action", vote(scene == "action", scene == "narration"), "scene_type_missing_or_mixed"),
        *[record(t, f"det_witnessed_reaction_content_{t}_v1", "reaction", content, "no_classifiable_reaction_text") for t in ("norm_event_supported", "reaction_grounded")],
        record("reaction_grounded", "det_witnessed_audio_event_peak_v1", "reaction", vote(peak >= AUDIO_PEAK), "no_scored_audio_peak_above_threshold"),
    )


def instructional_records(polarity: Column, said: Column) -> Column:
    transition = words.matches(said, TRANSITION)
    return F.array(
        record("demonstration_present", "det_instructional_explanation_polarity_v1", "explicit_semantics", F.when(polarity == "explanation", -1).otherwise(0), "polarity_not_explanation"),
        record("demonstration_present", "det_instructional_demo_transition_cue_v1", "visual_depiction", vote(transition, words.matches(said, REPORTED)), "no_transition_or_offscreen_language"),
    )


def commentary_records(quote: Column, context: Column) -> Column:
    """Hypothetical framing is judged on the quote, the event and the footage on the quote with its surroundings."""
    occurred = words.matches(context, OCCURRED) | words.matches(context, REPORTED)
    return F.array(
        record("occurred_event_supported", "det_commentary_occurred_event_language_v2", "event_action", vote(occurred, words.matches(quote, HYPOTHETICAL)), "no_event_time_reference_in_window"),
        record("occurred_event_supported", "det_commentary_footage_deixis_v2", "visual_depiction", vote(words.matches(context, FOOTAGE)), "no_footage_deixis_in_window"),
    )


def visual_records(pillar: str, people: Column, present: Column, pairs: Column, scenes: Column, faces: Column, many: Column, motion: Column) -> Column:
    """Votes from features of pictures; scenes: six probabilities (roleplay, interaction, talking head, lecture, slide, b-roll) or null."""
    p = lambda i: F.get(scenes, F.lit(i))
    if pillar == "witnessed":
        shown = F.greatest(p(2), p(3), p(4), p(5))
        return F.array(
            record("independent_bystander_signal", "vis_witnessed_person_count_v1", "visual_depiction", F.when(people.isNull(), 0).otherwise(vote(people >= 3.0, (people <= 1.2) | F.coalesce(present < 0.3, F.lit(False)))), "person_counts_unavailable_or_ambiguous"),
            record("norm_event_supported", "vis_witnessed_interaction_scene_v1", "visual_depiction", vote((p(1) >= 0.45) & (p(1) > shown), (shown >= 0.5) & (shown > p(1))), "clip_scores_unavailable_or_ambiguous"),
            record("independent_bystander_signal", "vis_witnessed_staged_roleplay_v1", "source_format_provenance", F.when(F.coalesce((p(0) >= 0.5) & (p(0) > p(1)), F.lit(False)), -1).otherwise(0), "no_dominant_staged_roleplay_score"),
        )
    if pillar == "instructional":
        shown, demo = F.greatest(p(2), p(3), p(4), p(5)), F.greatest(p(0), p(1))
        return F.array(
            record("demonstration_present", "vis_instructional_demo_scene_v1", "visual_depiction", vote((demo >= 0.45) & (demo > shown), (shown >= 0.5) & (shown > demo)), "clip_scores_unavailable_or_ambiguous"),
            record("demonstration_present", "vis_instructional_person_pair_v1", "visual_depiction", vote(pairs >= 0.5, present < 0.2), "person_presence_ambiguous"),
        )
    still = (faces < 0.1) & many.isNotNull() & (motion < 0.05)
    return F.array(record("event_present_in_source", "vis_commentary_scene_activity_v1", "visual_depiction", vote((faces >= 0.5) & (many >= 0.2), still), "face_motion_evidence_ambiguous"))
