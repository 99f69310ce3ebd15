"""Batch stages: tries with outages, a ledger that survives a kill, prompts, spans of demos, routes and sinks."""

import json
import os
import time
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lumenforge.operators import stages

ROWS = "k long, x string"
WORDS = "array<struct<word: string, start: double, end: double>>"


def worker(log: str | None = None, down: str = ""):
    """Upper-cases x, notes each call in a file of its own, fails on "bad" and on null, and is down at one value."""

    def start():
        def work(row):
            if log:
                open(f"{log}/{row['k']}-{uuid.uuid4().hex}", "w").close()
            if row["x"] == "bad":
                raise ValueError("no")
            if down and row["x"] == down:
                raise stages.Transient("taken")
            return row["x"].upper()

        return work

    return start


def got(df):
    return {(r.k, r.outcome, r.result) for r in df.collect()}


@pytest.mark.parametrize("threads", [1, 4])
def test_an_outage_leaves_the_rest_of_a_task_pending(spark, threads):
    rows = spark.createDataFrame([(i, "stop" if i == 100 else "bad" if i == 7 else f"x{i}") for i in range(300)], ROWS).coalesce(1)
    out = {r.k: r for r in stages.attempts(rows, ["k"], worker(down="stop"), threads).collect()}
    assert len(out) == 300 and out[7].outcome == "error" and out[7].message == "ValueError: no"
    assert all(out[i].outcome == "ok" and out[i].result == f"X{i}" for i in range(100) if i != 7)
    assert out[100].outcome == "pending" and all(out[i].outcome == "pending" for i in range(100 + threads, 300))


def test_a_worker_that_cannot_start_leaves_all_pending_and_none_is_made_without_rows(spark, tmp_path):
    def start():
        open(f"{tmp_path}/made-{uuid.uuid4().hex}", "w").close()
        raise stages.Transient("full")

    none = spark.createDataFrame([], ROWS)
    assert stages.attempts(none, ["k"], start).count() == 0 and os.listdir(tmp_path) == []
    out = stages.attempts(spark.createDataFrame([(1, "a"), (2, None)], ROWS).coalesce(1), ["k"], start).collect()
    assert [(r.k, r.outcome, r.message) for r in out] == [(1, "pending", "full"), (2, "pending", "full")] and len(os.listdir(tmp_path)) == 1


def test_runs_go_on_where_an_outage_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(i, "stop" if i % 10 == 3 else "bad" if i == 5 else f"x{i}") for i in range(60)], ROWS)
    stage = stages.Stage(spark, str(tmp_path / "stage"), ["k"])
    stage.run("1", rows, worker(down="stop"))
    first = stage.settled(rows.schema).count()
    assert first < 60 and stage.pending(rows).count() == 60 - first
    stage.run("2", rows, worker())
    assert got(stage.settled(rows.schema)) == {(i, "error", None) if i == 5 else (i, "ok", "STOP" if i % 10 == 3 else f"X{i}") for i in range(60)}
    assert stage.pending(rows).count() == 0 and [r.k for r in stage.pending(rows, errors=False).collect()] == [5]
    stage.run("3", rows.withColumn("x", F.lit("mended")), worker(), again=True)
    assert (5, "ok", "MENDED") in got(stage.settled(rows.schema)) and stage.settled(rows.schema).where("run = '3'").count() == 1


def test_a_killed_run_calls_only_for_parts_that_were_not_finished(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    log.mkdir()
    rows = spark.createDataFrame([(i, f"x{i}") for i in range(40)], ROWS)
    path, real, tried = str(tmp_path / "stage"), stages.attempts, []

    def killed(*a, **kw):
        tried.append(1)
        if len(tried) == 3:
            raise InterruptedError
        return real(*a, **kw)

    monkeypatch.setattr(stages, "attempts", killed)
    with pytest.raises(InterruptedError):
        stages.Stage(spark, path, ["k"]).run("1", rows, worker(str(log)))
    before = {f.split("-")[0] for f in os.listdir(log)}
    assert 0 < len(before) < 40
    monkeypatch.setattr(stages, "attempts", real)
    stage = stages.Stage(spark, path, ["k"])  # another session
    stage.run("1", rows.unionByName(spark.createDataFrame([(99, "later")], ROWS)), worker(str(log)))
    assert len(os.listdir(log)) == 40  # each row once; the queue is the one that was written down
    stage.run("1", rows, worker(str(log)))
    assert len(os.listdir(log)) == 40 and stage.settled(rows.schema).count() == 40
    stage.run("2", rows.unionByName(spark.createDataFrame([(99, "later")], ROWS)), worker(str(log)))
    assert len(os.listdir(log)) == 41 and (99, "ok", "LATER") in got(stage.settled(rows.schema))


def test_null_and_repeated_keys_and_empty_queues(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a"), (1, "bad"), (1, "b"), (1, "b"), (2, None)], ROWS)
    stage = stages.Stage(spark, str(tmp_path / "stage"), ["k"])
    stage.run("1", rows.where("false"), worker())
    assert stage.settled(rows.schema).count() == 0
    stage.run("2", rows, worker())
    assert got(stage.settled(rows.schema)) == {(None, "ok", "A"), (1, "ok", "B"), (2, "error", None)}
    assert stage.pending(rows).count() == 0


def test_prompt(spark):
    talk = [(f" w{i} ", i * 3.0, i * 3.0 + 1) for i in range(8)]
    long = [(f"w{i}", None, None) for i in range(30_000)]
    rows = [(1, "A title", talk), (2, None, talk[:5]), (3, "", talk[:2] + [(None, 9.0, 9.5)] + talk[2:6]), (4, "t", []), (5, "t", None), (6, None, long)]
    df = spark.createDataFrame(rows, f"id long, title string, words {WORDS}")
    out = {r.id: r.p for r in df.select("id", stages.prompt(F.col("words"), F.col("title"), "Answer.", 6, True).alias("p")).collect()}
    assert out[1] == 'Title: "A title"\n\nTiming: 22 s, 8 words, 7 pauses (many breaks, likely action).\n\nTranscript:\n"""w0 w1 w2 w3 w4 w5 w6 w7"""\n\nAnswer.'
    assert out[2] is None and out[4] is None and out[5] is None
    assert out[3].startswith("Timing: 16 s, 7 words, ") and out[6].count(" w29999") == 1
    cut = df.where("id = 6").select(stages.prompt(F.col("words"), F.col("title"), "", 6, False, most=100).alias("p")).first().p
    assert len(cut.split('"""')[1]) == 100


def test_demo_spans(spark):
    words = [(w, i * 1.0, i + 0.5) for i, w in enumerate("One two, three four five -- six seven eight one two three nine".split())]
    demo = lambda a, b: {"polarity": "correct", "norm": "n", "start_quote": a, "end_quote": b, "explanation": "e"}
    answer = {"is_instructional": "yes", "demos": [demo("one TWO three", "six seven eight"), demo("two three four drifted", None), demo("nothing of it", "three four five"), demo("one two", "six seven eight"), demo("six seven eight", "one two three"), None]}
    rows = [(1, words, json.dumps(answer)), (2, words, '{"is_instructional": "no", "demos": []}'), (3, words, "not json"), (4, words, None), (5, None, json.dumps(answer)), (6, [], json.dumps({"is_instructional": "yes"}))]
    out = stages.demo_spans(spark.createDataFrame(rows, f"id long, words {WORDS}, answer string"), ["id"], "words", "answer").orderBy("id", "demo").collect()
    assert [(r.demo, r.start, r.end, r.clip_start, r.clip_end) for r in out if r.id == 1] == [
        (0, 0.0, 8.5, 0.0, 9.5),  # the last word has no letters and keeps its place in time
        (1, 1.0, 3.5, 0.0, 4.5),  # a prefix of three words; no end quote
        (2, None, 4.5, None, None),
        (3, None, 8.5, None, None),  # two words are too few
        (4, 6.0, 2.5, None, None),  # the end before the start: no clip
    ]
    assert {(r.id, r.start) for r in out if r.id != 1} == {(5, None)}


def test_demo_spans_of_long_transcripts(spark):
    """Time grows with the words: what a quote's prefixes are is found once for each place, not again for each pair of places."""
    n = 20_000
    words = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.concat(F.lit("w"), i).alias("word"), i.cast("double").alias("start"), (i + 0.5).alias("end")))
    demo = {"start_quote": "w19000 w19001 w19002 indeed", "end_quote": "w19997 w19998 w19999"}
    df = spark.range(1).select("id", words.alias("words"), F.lit(json.dumps({"is_instructional": "yes", "demos": [demo]})).alias("answer"))
    began = time.monotonic()
    out = stages.demo_spans(df, ["id"], "words", "answer").collect()
    assert [(r.start, r.end, r.clip_start, r.clip_end) for r in out] == [(19000.0, 19999.5, 18999.0, 20000.5)]
    assert time.monotonic() - began < 30


def test_routes_and_sinks(spark, tmp_path):
    rows = [(1, "null", 0, None, "drop:other", 0), (2, "seed", 2, "commentary", None, 0), (3, "seed", 2, "witnessed", None, 2), (4, "seed", 2, "witnessed", None, 0), (5, "seed", 0, None, "drop:other", 0), (6, None, 0, None, None, None), (7, "null", 1, "witnessed", None, 1), (8, "seed", 1, None, None, 1)]
    df = spark.createDataFrame(rows, "id long, known string, kept int, modality string, verdict string, clips int")
    out = df.select("id", F.array(F.lit("é"), F.lit(None)).alias("quotes"), stages.routes(*[F.col(c) for c in ("known", "kept", "modality", "verdict", "clips")]).alias("route"))
    want = {1: "null_verified", 2: "discussion", 3: "hit", 4: "truncated", 5: "drop", 6: "miss", 7: "hit", 8: "hit"}
    path = str(tmp_path / "sinks")
    back = stages.sink_routes(out, path)
    assert {r.id: r.route for r in back.collect()} == want and {tuple(r.quotes) for r in back.collect()} == {("é", None)}
    assert "PartitionFilters: [isnotnull(route" in back.where("route = 'hit'")._jdf.queryExecution().toString()
    with pytest.raises(AnalysisException):
        stages.sink_routes(out, path)
