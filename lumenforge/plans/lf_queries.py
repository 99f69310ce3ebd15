"""The labelling-function layer: records and their validation, atomic contracts, the registry, materialisation by pillar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lfs
from ..functions import text as words
from ..operators import intervals
from .atoms import atoms_sql, with_atoms
from .registry import Tables, query

_in = lambda col, values: f"{col} IN ({', '.join(repr(v) for v in values)})"

RECORD = {
    "pillar": (["witnessed", "instructional", "commentary", "witnessed", "instructional", "commentary", "other"], 31), "target": ([t for ts in lfs.TARGETS.values() for t in ts] + [None], 37), "item_id": (["i"] * 20 + ["", None], 41), "lf_id": (["f"] * 20 + [None], 43), "version": (["v1"] * 20 + [""], 47),
    "family": ([*lfs.FAMILIES, "hunch"], 53), "vote": ([-1, 0, 1, 1, 0, -1, 2], 59), "reason": ([None, None, "r", ""], 61), "confidence": ([None, 0.0, 0.5, 1.0, 1.5], 67), "sha256": ([None, "ab" * 32, "AB" * 32, "ab"], 71),
}


@query(f"""SELECT doc_id, CASE WHEN pillar = 'other' THEN 'pillar' WHEN target IS NULL OR NOT ({' OR '.join(f"(pillar = '{p}' AND {_in('target', t)})" for p, t in lfs.TARGETS.items())}) THEN 'target' WHEN coalesce(item_id, '') = '' OR coalesce(lf_id, '') = '' OR coalesce(version, '') = '' THEN 'identifier'
WHEN NOT {_in('family', lfs.FAMILIES)} THEN 'family' WHEN vote NOT IN (-1, 0, 1) THEN 'vote' WHEN vote = 0 AND coalesce(reason, '') = '' THEN 'abstain_without_reason' WHEN vote <> 0 AND reason IS NOT NULL THEN 'reason_without_abstain'
WHEN confidence < 0 OR confidence > 1 THEN 'confidence' WHEN NOT regexp_full_match(sha256, '[0-9a-f]{{64}}') THEN 'sha256' END AS problem FROM ({atoms_sql('documents', 'doc_id', RECORD)})""")
def lf_record_problems(t: Tables) -> DataFrame:
    """The first rule of the record contract that each record breaks, if any."""
    return with_atoms(t.documents, "doc_id", RECORD).select("doc_id", lfs.record_problem({x: F.col(x) for x in RECORD}).alias("problem"))


FIELDS = sorted({f for p in lfs.ATOMIC.values() for fs in p.values() for f in fs})
ANSWERS = {f: (["yes"] * 9 + ["no", "uncertain", None], 73 + 6 * i) for i, f in enumerate(FIELDS)}
_FAM = lambda fs: f"CASE WHEN 'no' IN ({', '.join(f'coalesce({f}, chr(32))' for f in fs)}) THEN -1 WHEN {' AND '.join(f'coalesce({f} = chr(121) || chr(101) || chr(115), false)' for f in fs)} THEN 1 ELSE 0 END"


def _atomic_sql() -> str:
    parts = [f"SELECT doc_id, '{p}' AS pillar, '{lfs.DEFAULT_TARGET[p]}' AS target, 'atomic_{p}_{n}_v1' AS lf_id, '{lfs.EVIDENCE_OF[n]}' AS family, {_FAM(fs)} AS vote FROM a" for p, group in lfs.ATOMIC.items() for n, fs in group.items()]
    return f"WITH a AS ({atoms_sql('documents', 'doc_id', ANSWERS)}), v AS ({' UNION ALL '.join(parts)})"


@query(_atomic_sql() + " SELECT doc_id, pillar, target, lf_id, family, vote, CASE WHEN vote = 0 THEN 'unresolved_atomic_fields' END AS abstain_reason FROM v")
def atomic_lf_records(t: Tables) -> DataFrame:
    """One vote for each family of atomic answers; fields of one phrase don't count as several votes."""
    d = with_atoms(t.documents, "doc_id", ANSWERS)
    all_ = F.array(*[F.struct(F.lit(p).alias("pillar"), lfs.atomic_records(p, F.col).alias("r")) for p in lfs.ATOMIC])
    return d.select("doc_id", F.explode(all_).alias("x")).select("doc_id", "x.pillar", F.explode("x.r").alias("r")).select("doc_id", "pillar", "r.*")


@query(_atomic_sql() + """ SELECT doc_id, pillar, CASE WHEN min(vote) = -1 THEN 'likely_reroute_or_reject_review' WHEN sum(vote) = 6 THEN 'complete_manual_review_candidate' WHEN sum(vote) >= 4 THEN 'targeted_missing_evidence_review' ELSE 'low_priority_preserved' END AS band FROM v GROUP BY doc_id, pillar""")
def atomic_review_bands(t: Tables) -> DataFrame:
    d = with_atoms(t.documents, "doc_id", ANSWERS)
    return d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(p).alias("pillar"), lfs.review_band(p, F.col).alias("band")) for p in lfs.ATOMIC])).alias("x")).select("doc_id", "x.*")


#: Rules as a registry states them: id, pillar, status, uses, accepts automatically, hits, false hits, precision, triggers, routes, exclusions, target of its vote, family, vote, then the promotion contract.
RULES = [
    ("scan", "witnessed", "audited_for_declared_use", ["review_routing", "shadow_lf_vote"], False, 6, 12, 6 / 18, ["true"], ["scan_review"], [], "reaction_grounded", "reaction", 1, None, None, None, None),
    ("authority", "witnessed", "audited_for_declared_use", ["review_routing", "strict_route_exclusion"], False, 9, 1, 0.9, ["true"], ["authority_review"], ["strict_witnessed"], None, None, None, None, None, None, None),
    ("staging", "witnessed", "audited_for_declared_use", ["strict_route_exclusion", "shadow_lf_vote"], False, 38, 0, 1.0, ["true"], ["staging_review"], ["strict_witnessed"], "independent_bystander_signal", "source_format_provenance", -1, None, None, None, None),
    ("channel", "all", "failed_transfer", [], False, 1, 3, 0.25, [], [], [], None, None, None, None, None, None, None),
    ("polarity", "instructional", "audited_for_declared_use", ["review_ranking"], False, 20, 5, 0.8, ["violation", "correct", "contrast"], ["priority_review"], [], None, None, None, None, None, None, None),
    ("gate", "commentary", "audited_for_declared_use", ["acceptance_gate"], False, 57, 3, 0.95, [], [], [], None, None, None, "final_pillar_acceptance", 2, 60, 0.86),
    ("gate_few", "commentary", "audited_for_declared_use", ["acceptance_gate"], False, 9, 1, 0.9, [], [], [], None, None, None, "final_pillar_acceptance", 1, 10, 0.59),
    ("sum_off", "witnessed", "audited_for_declared_use", ["review_ranking"], False, 9, 1, 0.91, ["true"], [], [], None, None, None, None, None, None, None),
    ("accepts", "witnessed", "audited_for_declared_use", ["review_ranking"], True, 9, 1, 0.9, ["true"], [], [], None, None, None, None, None, None, None),
    ("odd_use", "witnessed", "audited_for_declared_use", ["delete"], False, 9, 1, 0.9, ["true"], [], [], None, None, None, None, None, None, None),
    ("failed_used", "witnessed", "failed_transfer", ["review_ranking"], False, 1, 9, 0.1, ["true"], [], [], None, None, None, None, None, None, None),
    ("silent", "witnessed", "audited_for_declared_use", ["review_routing"], False, 9, 1, 0.9, [], [], [], None, None, None, None, None, None, None),
    ("draft", "witnessed", "draft", [], False, None, None, None, [], [], [], None, None, None, None, None, None, None),
    ("no_proof", "witnessed", "audited_for_declared_use", ["review_ranking"], False, None, None, None, ["true"], [], [], None, None, None, None, None, None, None),
]
_RULE = "rule_id string, rule_pillar string, status string, uses array<string>, accepts boolean, tp int, fp int, precision double, triggers array<string>, routes array<string>, exclusions array<string>, vote_target string, vote_family string, vote_when_triggered int, target string, confirmations int, selected int, wilson double"
_NAMES = [x.split()[0] for x in _RULE.split(", ")]


def _lit(v, kind: str) -> str:
    if isinstance(v, list):
        return f"CAST([{', '.join(repr(x) for x in v)}] AS VARCHAR[])"
    return f"CAST(NULL AS {kind.replace('string', 'VARCHAR')})" if v is None else str(v).lower() if isinstance(v, bool) else repr(v)


RULES_SQL = "rules AS (" + " UNION ALL ".join("SELECT " + ", ".join(f"{_lit(v, k.split()[1])} AS {k.split()[0]}" for v, k in zip(r, _RULE.split(", "), strict=True)) for r in RULES) + ")"
VALID = ["scan", "authority", "staging", "channel", "polarity", "gate"]


def rules(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(RULES, _RULE)


#: What the declarations of a measured rule vary in, picked by its counts.
_USES = [["review_routing", "shadow_lf_vote"], ["acceptance_gate"], ["review_ranking"], [], ["delete"]]
_MEASURED = f"""c AS (SELECT coalesce(source, '') || '/' || coalesce(lang, '') AS rule_id, count(*) FILTER (quality = 1) AS tp, count(*) FILTER (quality = 0) AS fp FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1),
rules AS (SELECT rule_id, CASE tp % 5 {" ".join(f"WHEN {i} THEN {u!r}::VARCHAR[]" for i, u in enumerate(_USES))} END AS uses, CASE WHEN fp % 4 = 3 THEN 'failed_transfer' WHEN fp % 9 = 8 THEN 'draft' ELSE 'audited_for_declared_use' END AS status, (tp + fp) % 13 = 12 AS accepts, tp, fp,
 tp::DOUBLE / nullif(tp + fp, 0) + CASE WHEN (tp + 2 * fp) % 11 = 10 THEN 0.01 ELSE 0 END AS precision, CASE WHEN tp % 3 > 0 THEN ['true'] ELSE []::VARCHAR[] END AS triggers, 'final_pillar_acceptance' AS target, tp % 4 AS confirmations, tp + fp AS selected, tp::DOUBLE / nullif(tp + fp, 0) AS wilson FROM c)"""


@query(f"""WITH {_MEASURED} SELECT rule_id, tp, fp, CASE WHEN len(list_filter(uses, lambda u: u NOT IN ({', '.join(repr(u) for u in lfs.USES)}))) > 0 THEN 'unknown_use' WHEN accepts THEN 'automatic_acceptance' WHEN abs(precision - tp::DOUBLE / (tp + fp)) > 1e-9 THEN 'metric_arithmetic'
WHEN status = 'audited_for_declared_use' AND (len(uses) = 0 OR tp IS NULL) THEN 'active_without_use_or_evidence' WHEN status = 'failed_transfer' AND len(uses) > 0 THEN 'failed_with_uses' WHEN status NOT IN ('audited_for_declared_use', 'failed_transfer') THEN 'status'
WHEN list_has_any(uses, ['review_routing', 'review_ranking', 'strict_route_exclusion']) AND NOT list_contains(uses, 'acceptance_gate') AND len(triggers) = 0 THEN 'no_triggers'
WHEN list_contains(uses, 'acceptance_gate') AND NOT coalesce(target = 'final_pillar_acceptance' AND confirmations >= 2 AND selected >= 50 AND precision >= 0.9 AND wilson >= 0.8, false) THEN 'promotion_contract' END AS problem FROM rules""")
def registry_problems(t: Tables) -> DataFrame:
    """A registry of rules, one for each source and language with what the labels say of it, against the contract: uses, metrics that add
    up, triggers, and what an acceptance gate must have proven."""
    none = lambda c: F.coalesce(c, F.lit(""))
    d = t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    c = d.groupBy(F.concat(none("source"), F.lit("/"), none("lang")).alias("rule_id")).agg(F.count_if(F.col("quality") == 1).alias("tp"), F.count_if(F.col("quality") == 0).alias("fp"))
    tp, fp, n = F.col("tp"), F.col("fp"), F.col("tp") + F.col("fp")
    uses = F.lit(None).cast("array<string>")
    for i, u in enumerate(_USES):
        uses = F.when(tp % 5 == i, F.array(*[F.lit(x) for x in u]).cast("array<string>")).otherwise(uses)
    share = F.try_divide(tp.cast("double"), n.cast("double"))
    rules_ = c.select(
        "rule_id", "tp", "fp", uses.alias("uses"), F.when(fp % 4 == 3, "failed_transfer").when(fp % 9 == 8, "draft").otherwise("audited_for_declared_use").alias("status"), (n % 13 == 12).alias("accepts"),
        (share + F.when((tp + 2 * fp) % 11 == 10, 0.01).otherwise(0.0)).alias("precision"), F.when(tp % 3 > 0, F.array(F.lit("true"))).otherwise(F.array().cast("array<string>")).alias("triggers"),
        F.lit("final_pillar_acceptance").alias("target"), (tp % 4).alias("confirmations"), n.alias("selected"), share.alias("wilson"),
    )
    return rules_.select("rule_id", "tp", "fp", lfs.rule_problem().alias("problem"))


SIGNAL = {"scan": (["true", "false", None], 331), "authority": (["true", "false"], 337), "staging": (["true", "false", "false"], 347), "channel": (["true", "false"], 349), "polarity": (["violation", "correct", "explanation", "contrast"], 353)}
PILLAR_OF = {"polarity": "instructional"}
SIGNALS_SQL = f"a AS ({atoms_sql('documents', 'doc_id', SIGNAL)}), s AS (" + " UNION ALL ".join(f"SELECT doc_id AS item_id, '{PILLAR_OF.get(r, 'witnessed')}' AS pillar, '{r}' AS rule_id, {r} AS value FROM a" for r in SIGNAL) + ")"


def signals(t: Tables) -> DataFrame:
    """Outputs of registered mechanisms, pruned to rules that the registry has."""
    d = with_atoms(t.documents, "doc_id", SIGNAL)
    outputs = F.create_map(*[x for r in SIGNAL for x in (F.lit(r), F.col(r))])
    kept = F.map_filter(outputs, lambda k, _: k.isin(VALID))
    return d.select(F.col("doc_id").alias("item_id"), F.explode(kept).alias("rule_id", "value")).withColumn("pillar", F.when(F.col("rule_id") == "polarity", "instructional").otherwise("witnessed"))


def _registry(t: Tables) -> DataFrame:
    return rules(t).where(F.col("rule_id").isin(VALID)).select("rule_id", "rule_pillar", "status", "uses", "triggers", "routes", "exclusions", "vote_target", "vote_family", "vote_when_triggered", F.col("precision").alias("audited_precision"))


@query(f"""WITH {RULES_SQL}, {SIGNALS_SQL}, j AS (SELECT s.*, r.*, status = 'audited_for_declared_use' AS active, list_contains(uses, 'shadow_lf_vote') AND vote_target IS NOT NULL AS votes, coalesce(list_contains(triggers, value), false) AS hit FROM s JOIN rules r ON s.rule_id = r.rule_id AND r.rule_pillar IN (s.pillar, 'all'))
SELECT item_id, pillar, CASE WHEN active AND votes THEN vote_target WHEN pillar = 'instructional' THEN 'demonstration_present' ELSE 'norm_event_supported' END AS target, 'registry_' || rule_id AS lf_id, CASE WHEN NOT active THEN 'semantic_model_judgment' WHEN NOT votes THEN 'retrieval_lineage' ELSE vote_family END AS family,
CASE WHEN active AND votes AND hit THEN vote_when_triggered ELSE 0 END AS vote, CASE WHEN NOT active THEN 'failed_transfer_registry_enforced' WHEN NOT votes THEN 'retrieval_or_ranking_use_only_never_a_label' WHEN NOT hit THEN 'rule_not_triggered' END AS abstain_reason, CASE WHEN active AND votes AND hit THEN precision END AS confidence FROM j""")
def registry_lf_records(t: Tables) -> DataFrame:
    return lfs.registry_records(signals(t), _registry(t))


@query(f"""WITH {RULES_SQL}, {SIGNALS_SQL}, j AS (SELECT s.item_id, r.* FROM s JOIN rules r ON s.rule_id = r.rule_id WHERE status = 'audited_for_declared_use' AND list_contains(triggers, value))
SELECT item_id, list_sort(list_distinct(list(rule_id))) AS triggered, list_sort(list_distinct(flatten(list(routes)))) AS routes, list_sort(list_distinct(flatten(list(exclusions)))) AS exclusions, list_sort(coalesce(list_distinct(list(rule_id) FILTER (list_contains(uses, 'review_ranking'))), [])) AS rankings FROM j GROUP BY item_id""")
def combined_signals(t: Tables) -> DataFrame:
    return lfs.combined(signals(t), _registry(t))


@query(f"""WITH {RULES_SQL}, {SIGNALS_SQL}, j AS (SELECT s.item_id, r.* FROM s JOIN rules r ON s.rule_id = r.rule_id WHERE status = 'audited_for_declared_use' AND list_contains(triggers, value)),
c AS (SELECT item_id, len(flatten(list(routes))) AS n_routes, len(flatten(list(exclusions))) AS n_excluded, count(*) FILTER (list_contains(uses, 'review_ranking')) AS n_ranked FROM j GROUP BY item_id)
SELECT count(*) AS items, count(*) FILTER (n_routes > 0) AS routed, count(*) FILTER (n_excluded > 0) AS excluded, count(*) FILTER (n_ranked > 0) AS ranked FROM c""")
def combined_route_sums(t: Tables) -> DataFrame:
    c = lfs.combined(signals(t), _registry(t))
    some = lambda x: F.count_if(F.size(x) > 0)
    return c.agg(F.count(F.lit(1)).alias("items"), some("routes").alias("routed"), some("exclusions").alias("excluded"), some("rankings").alias("ranked"))


#: Reactions of witnessed clips: the turns of a conversation, two to a clip; a turn whose clip number can't be read is skipped.
CLIP_IDX = "CASE WHEN turn % 7 = 5 THEN 'x' ELSE CAST(turn {div} 2 AS {str}) END"
SCENE = {"role": (["bystander", "bystander", "victim", "camera_person", "mixed", None], 359), "people": ([0, 1, 2, 3, 5, None], 367), "scene": (["action", "action", "narration", "mixed", None], 373), "peak": ([None, 0.05, 0.2, 0.6], 379)}
_SAID = "CASE turn % 5 WHEN 1 THEN 'stop that' WHEN 2 THEN 'oh wow' WHEN 3 THEN ' ' WHEN 4 THEN 'how rude' ELSE 'oh' END"


def _reactions(t: Tables) -> DataFrame:
    said = F.when(F.col("turn") % 5 == 1, "stop that").when(F.col("turn") % 5 == 2, "oh wow").when(F.col("turn") % 5 == 3, " ").when(F.col("turn") % 5 == 4, "how rude").otherwise("oh")
    clip = F.expr(CLIP_IDX.format(div="div", str="string")).try_cast("int")
    return t.conversations.select("conv_id", "turn", clip.alias("clip"), F.nullif(F.trim(said), F.lit("")).alias("said"), (F.col("turn") * 3.0).alias("lo"), F.when(F.col("turn") % 11 == 7, F.col("turn") * 3.0).otherwise(F.col("turn") * 3.0 + 2).alias("hi")).where("clip IS NOT NULL")


_REACTIONS = f"r AS (SELECT conv_id, turn, TRY_CAST({CLIP_IDX.format(div='//', str='VARCHAR')} AS INTEGER) AS clip, nullif(trim({_SAID}), '') AS said, turn * 3.0 AS lo, CASE WHEN turn % 11 = 7 THEN turn * 3.0 ELSE turn * 3.0 + 2 END AS hi FROM conversations), k AS (SELECT * FROM r WHERE clip IS NOT NULL)"


def _clips(t: Tables) -> DataFrame:
    cues = words.interventions(F.col("said"))
    d = _reactions(t).withColumns({"active": cues["any_active"], "generic": cues["generic_affect_only"]})
    said = F.col("said").isNotNull()
    found = d.groupBy("conv_id", "clip").agg(F.count_if(said).alias("texts"), F.bool_or(said & F.col("active")).alias("active"), F.bool_and(F.col("generic") | ~said).alias("generic"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and(F.col("lo") < F.col("hi")).alias("bounds_valid"))
    return found.join(with_atoms(t.conversations.select("conv_id").distinct(), "conv_id", SCENE), "conv_id").withColumn("item_id", F.concat(F.lit("witnessed:"), F.col("conv_id"), F.lit(":clip_"), F.col("clip")))


_ACTIVE = " OR ".join(f"regexp_matches(lower(said), '{words.INTERVENTIONS[n].replace(chr(39), chr(39) * 2)}')" for n in words.ACTIVE)
_CLIPS = f"""{_REACTIONS}, g AS (SELECT conv_id, clip, count(said) AS texts, coalesce(bool_or({_ACTIVE}), false) AS active, bool_and(said IS NULL OR regexp_matches(lower(said), '{words.GENERIC_AFFECT}')) AS generic, min(lo) AS lo, max(hi) AS hi, bool_and(lo < hi) AS bounds_valid FROM k GROUP BY conv_id, clip),
sc AS ({atoms_sql('(SELECT DISTINCT conv_id FROM conversations)', 'conv_id', SCENE)}), c AS (SELECT g.*, sc.role, sc.people, sc.scene, sc.peak, 'witnessed:' || g.conv_id || ':clip_' || clip AS item_id FROM g JOIN sc ON g.conv_id = sc.conv_id)"""
_CONTENT = "CASE WHEN active THEN 1 WHEN texts > 0 AND generic THEN -1 ELSE 0 END"
_WIT = [
    ("independent_bystander_signal", "det_witnessed_scene_reactor_role_v1", "actor_role_binding", "CASE role WHEN 'bystander' THEN 1 WHEN 'victim' THEN -1 WHEN 'camera_person' THEN -1 ELSE 0 END", "reactor_role_missing_or_mixed"),
    ("independent_bystander_signal", "det_witnessed_scene_n_people_v1", "social_context", "CASE WHEN people >= 3 THEN 1 WHEN people <= 1 THEN -1 ELSE 0 END", "n_people_missing_or_two_person_scene"),
    ("norm_event_supported", "det_witnessed_scene_action_type_v1", "event_action", "CASE scene WHEN 'action' THEN 1 WHEN 'narration' THEN -1 ELSE 0 END", "scene_type_missing_or_mixed"),
    ("norm_event_supported", "det_witnessed_reaction_content_norm_event_supported_v1", "reaction", _CONTENT, "no_classifiable_reaction_text"),
    ("reaction_grounded", "det_witnessed_reaction_content_reaction_grounded_v1", "reaction", _CONTENT, "no_classifiable_reaction_text"),
    ("reaction_grounded", "det_witnessed_audio_event_peak_v1", "reaction", "CASE WHEN peak >= 0.2 THEN 1 ELSE 0 END", "no_scored_audio_peak_above_threshold"),
]
_records_sql = lambda rows, source: " UNION ALL ".join(f"SELECT item_id, '{a}' AS target, '{b}' AS lf_id, '{c}' AS family, {v} AS vote, CASE WHEN {v} = 0 THEN '{r}' END AS abstain_reason FROM {source}" for a, b, c, v, r in rows)


@query(f"WITH {_CLIPS} {_records_sql(_WIT, 'c')}")
def witnessed_lf_records(t: Tables) -> DataFrame:
    """Six votes for each clip from its reactions and its source's scene."""
    col = F.col
    r = lfs.witnessed_records(col("role"), col("people"), col("scene"), col("active"), col("generic"), col("texts"), col("peak"))
    return _clips(t).select("item_id", F.explode(r).alias("r")).select("item_id", "r.*")


@query(f"WITH {_CLIPS} SELECT item_id, lo, hi, texts, bounds_valid, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE conv_id % 4 <> 1 END AS media_decodes, list_filter([CASE WHEN conv_id % 4 = 1 THEN 'media_decodes' END, CASE WHEN NOT bounds_valid THEN 'bounds_valid' END], lambda x: x IS NOT NULL) AS failed_gates, CASE WHEN conv_id % 4 = 0 THEN ['media_decodes'] ELSE [] END AS unknown_gates FROM c")
def witnessed_gates(t: Tables) -> DataFrame:
    """Clip windows (first start, last end over the reactions) and the gates that no vote can outweigh."""
    from ..functions.contracts import gate

    d = _clips(t).withColumn("media_decodes", F.when(F.col("conv_id") % 4 != 0, F.col("conv_id") % 4 != 1))
    found = gate({"media_decodes": F.col("media_decodes"), "bounds_valid": F.col("bounds_valid")})
    return d.select("item_id", "lo", "hi", "texts", "bounds_valid", "media_decodes", *[v.alias(k) for k, v in found.items()])


_CUE = "CASE (conv_id + turn) % 6 WHEN 0 THEN ' watch this scenario' WHEN 1 THEN ' she said it happened' WHEN 2 THEN ' imagine that' WHEN 3 THEN ' as you can see' ELSE '' END"
_POLARITY = "list_extract(['violation', 'correct', 'contrast', 'explanation', NULL], 1 + (conv_id * 383 + turn) % 5)"
_INS = [
    ("demonstration_present", "det_instructional_explanation_polarity_v1", "explicit_semantics", "CASE WHEN polarity = 'explanation' THEN -1 ELSE 0 END", "polarity_not_explanation"),
    ("demonstration_present", "det_instructional_demo_transition_cue_v1", "visual_depiction", f"CASE WHEN regexp_matches(lower(said), '{lfs.TRANSITION.replace(chr(39), chr(39) * 2)}') THEN 1 WHEN regexp_matches(lower(said), '{lfs.REPORTED}') THEN -1 ELSE 0 END", "no_transition_or_offscreen_language"),
]


def _said(t: Tables) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 6
    cue = F.when(k == 0, " watch this scenario").when(k == 1, " she said it happened").when(k == 2, " imagine that").when(k == 3, " as you can see").otherwise("")
    return t.conversations.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), cue).alias("said"))


@query(f"WITH d AS (SELECT 'instructional:' || conv_id || ':demo_' || turn AS item_id, {_POLARITY} AS polarity, coalesce(text, '') || {_CUE} AS said FROM conversations) {_records_sql(_INS, 'd')}")
def instructional_lf_records(t: Tables) -> DataFrame:
    """Votes for each demonstration of a source: demonstrations are an array whose places number the items."""
    polarity = F.element_at(F.array(*[F.lit(x) for x in ("violation", "correct", "contrast", "explanation", None)]), ((F.col("conv_id") * 383 + F.col("turn")) % 5 + 1).cast("int"))
    demos = _said(t).withColumn("polarity", polarity).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "polarity", "said"))).alias("demos"))
    d = demos.select("conv_id", F.posexplode("demos").alias("i", "x")).select(F.concat(F.lit("instructional:"), F.col("conv_id"), F.lit(":demo_"), F.col("x.turn")).alias("item_id"), "x.polarity", "x.said")
    return d.select("item_id", F.explode(lfs.instructional_records(F.col("polarity"), F.col("said"))).alias("r")).select("item_id", "r.*")


_OCC = f"(regexp_matches(lower(context), '{lfs.OCCURRED}') OR regexp_matches(lower(context), '{lfs.REPORTED}'))"
_COM = [
    ("occurred_event_supported", "det_commentary_occurred_event_language_v2", "event_action", f"CASE WHEN {_OCC} THEN 1 WHEN regexp_matches(lower(said), '{lfs.HYPOTHETICAL.replace(chr(39), chr(39) * 2)}') THEN -1 ELSE 0 END", "no_event_time_reference_in_window"),
    ("occurred_event_supported", "det_commentary_footage_deixis_v2", "visual_depiction", f"CASE WHEN regexp_matches(lower(context), '{lfs.FOOTAGE}') THEN 1 ELSE 0 END", "no_footage_deixis_in_window"),
]


@query(f"""WITH d AS (SELECT conv_id, turn, coalesce(text, '') || {_CUE} AS said, turn * 15.0 AS lo, turn * 15.0 + 4 AS hi FROM conversations), s AS (SELECT * FROM d WHERE turn % 2 = 0),
c AS (SELECT 'commentary:' || s.conv_id || ':stmt_' || s.turn AS item_id, s.said, s.said || ' ' || string_agg(d.said, ' ' ORDER BY d.lo) AS context FROM s JOIN d ON d.conv_id = s.conv_id AND d.hi >= s.lo - 20 AND d.lo <= s.hi + 20 GROUP BY s.conv_id, s.turn, s.said) {_records_sql(_COM, 'c')}""")
def commentary_lf_records(t: Tables) -> DataFrame:
    """Votes for each statement from its quote and the transcript 20 s around it: a range join on the source, cut into buckets."""
    d = _said(t).withColumns({"lo": F.col("turn") * 15.0, "hi": F.col("turn") * 15.0 + 4})
    s = d.where("turn % 2 = 0").select("conv_id", "turn", "said", "lo", "hi")
    near = intervals.overlap_join(s, d.select("conv_id", F.col("said").alias("heard"), F.col("lo").alias("from"), F.col("hi").alias("to")), ["conv_id"], ("lo", "hi"), ("from", "to"), bucket=60.0, pad=20.0)
    around = near.groupBy("conv_id", "turn", "said").agg(F.array_sort(F.collect_list(F.struct("from", "heard"))).alias("w"))
    c = around.select(F.concat(F.lit("commentary:"), F.col("conv_id"), F.lit(":stmt_"), F.col("turn")).alias("item_id"), "said", F.concat_ws(" ", "said", F.array_join("w.heard", " ")).alias("context"))
    return c.select("item_id", F.explode(lfs.commentary_records(F.col("said"), F.col("context"))).alias("r")).select("item_id", "r.*")


PICTURE = {"people": ([0.5, 1.2, 2.0, 3.0, 4.5, None], 389), "present": ([0.1, 0.25, 0.6, 1.0, None], 397), "pairs": ([0.0, 0.5, 0.8, None], 401), "faces": ([0.0, 0.05, 0.5, 0.9, None], 409), "many": ([0.0, 0.2, 0.6, None], 419), "motion": ([0.01, 0.05, 0.3, None], 421)}
PROBS = {f"p{i}": ([0.05, 0.2, 0.45, 0.5, 0.7], 431 + 2 * i) for i in range(6)}
_SHOWN = "greatest(p2, p3, p4, p5)"
_VIS = {
    "witnessed": [
        ("independent_bystander_signal", "vis_witnessed_person_count_v1", "visual_depiction", "CASE WHEN people IS NULL THEN 0 WHEN people >= 3 THEN 1 WHEN people <= 1.2 OR coalesce(present < 0.3, false) THEN -1 ELSE 0 END", "person_counts_unavailable_or_ambiguous"),
        ("norm_event_supported", "vis_witnessed_interaction_scene_v1", "visual_depiction", f"CASE WHEN p0 IS NULL THEN 0 WHEN p1 >= 0.45 AND p1 > {_SHOWN} THEN 1 WHEN {_SHOWN} >= 0.5 AND {_SHOWN} > p1 THEN -1 ELSE 0 END", "clip_scores_unavailable_or_ambiguous"),
        ("independent_bystander_signal", "vis_witnessed_staged_roleplay_v1", "source_format_provenance", "CASE WHEN p0 >= 0.5 AND p0 > p1 THEN -1 ELSE 0 END", "no_dominant_staged_roleplay_score"),
    ],
    "instructional": [
        ("demonstration_present", "vis_instructional_demo_scene_v1", "visual_depiction", f"CASE WHEN p0 IS NULL THEN 0 WHEN greatest(p0, p1) >= 0.45 AND greatest(p0, p1) > {_SHOWN} THEN 1 WHEN {_SHOWN} >= 0.5 AND {_SHOWN} > greatest(p0, p1) THEN -1 ELSE 0 END", "clip_scores_unavailable_or_ambiguous"),
        ("demonstration_present", "vis_instructional_person_pair_v1", "visual_depiction", "CASE WHEN pairs >= 0.5 THEN 1 WHEN present < 0.2 THEN -1 ELSE 0 END", "person_presence_ambiguous"),
    ],
    "commentary": [("event_present_in_source", "vis_commentary_scene_activity_v1", "visual_depiction", "CASE WHEN faces >= 0.5 AND many >= 0.2 THEN 1 WHEN faces < 0.1 AND many IS NOT NULL AND motion < 0.05 THEN -1 ELSE 0 END", "face_motion_evidence_ambiguous")],
}
_PICTURES = f"v AS (SELECT 'clip:' || vec_id AS item_id, vec_id, {', '.join(PICTURE)}, {', '.join(f'CASE WHEN vec_id % 9 > 0 THEN {p} END AS {p}' for p in PROBS)} FROM ({atoms_sql('embeddings', 'vec_id', PICTURE | PROBS)}))"


def _pictures(t: Tables) -> DataFrame:
    d = with_atoms(t.embeddings, "vec_id", PICTURE | PROBS)
    return d.select("vec_id", F.concat(F.lit("clip:"), F.col("vec_id")).alias("item_id"), *PICTURE, F.when(F.col("vec_id") % 9 > 0, F.array(*PROBS)).alias("scenes"))


def _visual(t: Tables, pillar: str) -> DataFrame:
    r = lfs.visual_records(pillar, *[F.col(x) for x in ("people", "present", "pairs", "scenes", "faces", "many", "motion")])
    return _pictures(t).select("item_id", F.explode(r).alias("r")).select("item_id", "r.*")


for _p in _VIS:
    query(f"WITH {_PICTURES} {_records_sql(_VIS[_p], 'v')}", name=f"visual_lf_{_p}")(lambda t, p=_p: _visual(t, p))


@query(f"""WITH {_PICTURES}, x AS ({_records_sql(_VIS['commentary'], 'v')}), n AS (SELECT 'commentary' AS pillar, doc_id // 3 AS uid, doc_id % 3 AS idx, 'clip:' || doc_id AS item_id FROM documents)
SELECT n.pillar, n.uid, n.idx, coalesce(x.vote, 0) AS vote, x.item_id IS NOT NULL AS seen FROM n LEFT JOIN x ON n.item_id = x.item_id""")
def attached_visual_votes(t: Tables) -> DataFrame:
    """Votes from pictures joined to items by pillar, source and index; items without features keep a place."""
    pictures = _pictures(t)
    r = lfs.visual_records("commentary", *[F.col(x) for x in ("people", "present", "pairs", "scenes", "faces", "many", "motion")])
    votes = pictures.select(F.lit("commentary").alias("pillar"), F.expr("vec_id div 3").alias("uid"), (F.col("vec_id") % 3).alias("idx"), F.explode(r).alias("r")).select("pillar", "uid", "idx", "r.vote", F.lit(True).alias("seen"))
    items = t.documents.select(F.lit("commentary").alias("pillar"), F.expr("doc_id div 3").alias("uid"), (F.col("doc_id") % 3).alias("idx"))
    return items.join(votes, ["pillar", "uid", "idx"], "left").select("pillar", "uid", "idx", F.coalesce("vote", F.lit(0)).alias("vote"), F.coalesce("seen", F.lit(False)).alias("seen"))
