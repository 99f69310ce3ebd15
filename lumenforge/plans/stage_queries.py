"""Queries over the batch stages: prompts, tries by a worker in two rounds with an outage, spans of demos, records and sinks. Each turn of
the conversations is a transcript; the worker is a rule that stands in for a model and answers in its JSON."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detector, stages
from ..operators.shared import folder, written
from .detector_queries import _WORDS, _transcripts
from .registry import Tables, query

ASK = {"candid": "Return JSON with is_target, modality, reactions.", "instr": "Return JSON with is_instructional, demos."}
LEAST = {"candid": 6, "instr": 10}

_SAID = f"""{_WORDS}, said AS (SELECT conv_id, turn, ws, array_to_string(ws, ' ') AS x, len(ws) AS n, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'instr' ELSE 'candid' END AS kind FROM t)"""
_LOW = "lower(x)"
_KIND = f"""{_SAID}, o AS (SELECT *, CASE WHEN n < CASE kind WHEN 'instr' THEN 10 ELSE 6 END THEN 'no_call' WHEN contains({_LOW}, 'easy now') THEN 'error'
WHEN kind = 'instr' AND contains({_LOW}, 'calm down') THEN 'instructional' WHEN contains({_LOW}, 'so rude') OR contains({_LOW}, 'how dare you') THEN 'witnessed' WHEN contains({_LOW}, 'not cool') THEN 'commentary' ELSE 'none' END AS found FROM said)"""


def rule(row: dict) -> str:
    """The stand-in for a model: what it says of the text between a prompt's triple quotes."""
    said = row["prompt"].split('"""')[1]
    low, words = said.lower(), said.split()
    if "easy now" in low:
        raise ValueError("refused")
    if row["kind"] == "instr":
        demo = {"polarity": "violation", "norm": "calm", "start_quote": " ".join([*words[:3], "indeed"]), "end_quote": " ".join(words[-3:]), "explanation": words[-1]}
        return json.dumps({"is_instructional": "yes", "genre": "workplace", "norms": [], "demos": [demo], "expected_behavior": None} if "calm down" in low else {"is_instructional": "no"})
    for phrase, modality in (("so rude", "witnessed"), ("how dare you", "witnessed"), ("not cool", "commentary")):
        if phrase in low:
            return json.dumps({"is_target": "yes", "hard_negative_type": "none", "modality": modality, "agent": "human", "reactions": [{"quote": phrase, "norm": "respect", "signal": "rebuke"}]})
    return json.dumps({"is_target": "no", "hard_negative_type": "other", "reactions": []})


def steady() -> Callable[[dict], str]:
    return rule


def contended() -> Callable[[dict], str]:
    """A worker that loses what it runs on, at the first text it meets that says so."""

    def work(row: dict) -> str:
        if "oh my god" in row["prompt"].lower():
            raise stages.Transient("taken")
        return rule(row)

    return work


def queue(t: Tables) -> DataFrame:
    """conv_id, turn, words, kind and prompt (null: no call) of each turn."""
    d = _transcripts(t).withColumn("kind", F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "instr").otherwise("candid"))
    title = F.concat(F.lit("turn "), F.col("turn"))
    one = {k: stages.prompt(F.col("words"), title, ASK[k], LEAST[k], k == "candid") for k in ASK}
    return d.withColumn("prompt", F.when(F.col("kind") == "instr", one["instr"]).otherwise(one["candid"]))


def answered(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The queue, and the settled outcome of each call by conv_id, turn and kind: a round that an outage breaks off, one that goes on, and a
    round of candid prompts for what turned out not to be instructional."""
    spark, keys = t.spark, ["conv_id", "turn", "kind"]
    rows = written(queue(t), "queue")
    stage = stages.Stage(spark, f"{folder(spark)}/lumenforge/stage-{uuid.uuid4().hex}", keys)
    calls = rows.where("prompt IS NOT NULL").select(*keys, "prompt")
    stage.run("1a", calls, contended)
    stage.run("1b", calls, steady)
    no = stage.settled(calls.schema).where("kind = 'instr' AND outcome = 'ok' AND get_json_object(result, '$.is_instructional') = 'no'").select("conv_id", "turn")
    candid = stages.prompt(F.col("words"), F.concat(F.lit("turn "), F.col("turn")), ASK["candid"], LEAST["candid"], True)
    again = rows.where("kind = 'instr'").join(no, ["conv_id", "turn"]).select("conv_id", "turn", F.lit("candid").alias("kind"), candid.alias("prompt"))
    stage.run("2", again, steady)
    return rows, stage.settled(calls.schema)


@query(f"""WITH {_SAID} SELECT conv_id, turn, CASE WHEN kind = 'instr' AND n >= 10 THEN 'Title: "turn ' || turn || '"' || chr(10) || chr(10) || 'Transcript:' || chr(10) || '\"\"\"' || x || '\"\"\"' || chr(10) || chr(10) || '{ASK["instr"]}'
WHEN kind = 'candid' AND n >= 6 THEN 'Title: "turn ' || turn || '"' || chr(10) || chr(10) || 'Timing: ' || CAST(round_even((n - 1) * 0.4::DOUBLE + 0.3::DOUBLE, 0) AS BIGINT) || ' s, ' || n || ' words, 0 pauses (few breaks, likely narration).' || chr(10) || chr(10) || 'Transcript:' || chr(10) || '\"\"\"' || x || '\"\"\"' || chr(10) || chr(10) || '{ASK["candid"]}' END AS prompt FROM said""")
def detector_prompts(t: Tables) -> DataFrame:
    """The message of each transcript, whole; null where it is too short for a call."""
    return queue(t).select("conv_id", "turn", "prompt")


@query(f"""WITH {_KIND} SELECT conv_id, turn, CASE WHEN found = 'none' THEN 'miss' ELSE found END AS state, CASE WHEN found = 'no_call' THEN 0 WHEN kind = 'instr' AND found NOT IN ('error', 'instructional') THEN 2 ELSE 1 END AS rounds FROM o""")
def staged_detection(t: Tables) -> DataFrame:
    """What two rounds of calls make of each transcript: an outage leaves rows pending, which the next run takes up; a worker's error is its
    row's outcome; what isn't instructional is asked again as candid."""
    rows, done = answered(t)
    per = done.groupBy("conv_id", "turn").agg(F.max_by(F.struct("kind", "outcome", "result"), F.col("kind") == "candid").alias("r"), F.count(F.lit(1)).cast("int").alias("rounds"))
    a = detector.model_answer(F.col("r.result"))
    state = F.when(F.col("rounds").isNull(), "no_call").when(F.col("r.outcome") != "ok", F.col("r.outcome")).when(F.col("r.kind") == "instr", "instructional")
    return rows.join(per, ["conv_id", "turn"], "left").select("conv_id", "turn", state.when(a["is_target"] == "yes", a["modality"]).otherwise("miss").alias("state"), F.coalesce("rounds", F.lit(0)).alias("rounds"))


_SPANS = f"""{_KIND}, q AS (SELECT o.conv_id, o.turn, o.n, list(s.token ORDER BY s.i) AS toks, list(CAST(s.lo AS DOUBLE) ORDER BY s.i) AS los, list(CAST(s.hi AS DOUBLE) ORDER BY s.i) AS his, list(s.token ORDER BY s.i) FILTER (s.i < 3) AS q0, list(s.token ORDER BY s.i) FILTER (s.i >= o.n - 3) AS q2 FROM o JOIN s ON s.conv_id = o.conv_id AND s.turn = o.turn WHERE found = 'instructional' GROUP BY o.conv_id, o.turn, o.n),
q1 AS (SELECT *, list_append(q0, 'indeed') AS qa FROM q),
p AS (SELECT *, list_transform(range(1, len(toks) + 1), lambda i: len(list_filter(range(1, len(qa) + 1), lambda n: toks[i:i + n - 1] = qa[1:n]))) AS p1, list_transform(range(1, len(toks) + 1), lambda i: len(list_filter(range(1, len(q2) + 1), lambda n: toks[i:i + n - 1] = q2[1:n]))) AS p2 FROM q1),
l AS (SELECT conv_id, turn, los, his, list_max(p1) AS m1, list_position(p1, list_max(p1)) AS a1, coalesce(list_max(p2), 0) AS m2, list_position(p2, list_max(p2)) AS a2 FROM p),
z AS (SELECT conv_id, turn, 0 AS demo, CASE WHEN m1 >= 3 THEN los[a1] END AS start, CASE WHEN m2 >= 3 THEN his[a2 + m2 - 1] WHEN m1 >= 3 THEN his[a1 + m1 - 1] END AS "end" FROM l)"""


@query(f"""WITH {_SPANS} SELECT conv_id, turn, demo, start, "end", CASE WHEN "end" > start THEN greatest(start - 1, 0) END AS clip_start, CASE WHEN "end" > start THEN "end" + 1 END AS clip_end FROM z""")
def instructional_spans(t: Tables) -> DataFrame:
    """Times of the enacted scenes that answers quote, and of their clips."""
    rows, done = answered(t)
    # only instr rows have such outcomes, and only a yes has scenes: other words needn't be moved
    yes = done.where("kind = 'instr' AND outcome = 'ok' AND get_json_object(result, '$.is_instructional') = 'yes'").select("conv_id", "turn", "result")
    a = rows.where("kind = 'instr'").join(yes, ["conv_id", "turn"])
    return stages.demo_spans(a, ["conv_id", "turn"], "words", "result").drop("polarity", "norm", "explanation")


@query(f"""WITH {_KIND}, r AS (SELECT *, CASE WHEN turn % 5 = 0 THEN 'null' ELSE 'seed' END AS known FROM o WHERE found NOT IN ('error', 'instructional', 'no_call')),
x AS (SELECT CASE WHEN known = 'null' AND found = 'none' THEN 'null_verified' WHEN found = 'commentary' THEN 'discussion' WHEN found = 'witnessed' AND turn > 0 THEN 'hit' WHEN found = 'witnessed' THEN 'truncated' ELSE 'drop' END AS route, conv_id, turn, CASE WHEN found = 'none' THEN 0 ELSE 1 END AS statements FROM r)
SELECT route, count(*) AS n, sum(statements)::BIGINT AS statements, sum(conv_id * 100 + turn)::BIGINT AS ids FROM x GROUP BY route""")
def detection_sinks(t: Tables) -> DataFrame:
    """What each sink holds, read back: records with their statements, written by route in one pass."""
    rows, done = answered(t)
    a = detector.model_answer(F.col("result"))
    d = done.where("kind = 'candid' AND outcome = 'ok'").select("conv_id", "turn", a.alias("a"))
    kept = F.when(F.col("a.is_target") == "yes", F.size("a.reactions")).otherwise(0)
    known = F.when(F.col("turn") % 5 == 0, "null").otherwise("seed")
    verdict = F.when(F.col("a.is_target") != "yes", F.concat(F.lit("drop:"), F.col("a.hard_negative_type")))
    # the first turn has no seconds before it that a clip could take
    route = stages.routes(known, kept, F.col("a.modality"), verdict, F.when(F.col("turn") > 0, kept).otherwise(0))
    statements = F.transform("a.reactions", lambda r: F.struct(r["quote"].alias("quote")))
    out = d.select("conv_id", "turn", F.col("a.modality").alias("modality"), kept.alias("n_statements"), statements.alias("statements"), route.alias("route"))
    back = stages.sink_routes(out, f"{folder(t.spark)}/lumenforge/sinks-{uuid.uuid4().hex}")
    return back.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("statements")).cast("long").alias("statements"), F.sum(F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("ids"))
