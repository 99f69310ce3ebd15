"""Corpus scans over files, numbered errors, sealed outputs, adapters, and streams of several files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.plans import catalog
from lumenforge.sources import corpus, feed
from lumenforge.streaming import jobs

ROW = T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.IntegerType())])


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))


def test_three_layouts_and_transcripts(spark, tmp_path):
    put(tmp_path / "data/hits/x__1/metadata.json", {"title": "a"})
    put(tmp_path / "data/hits/x__2/metadata.json", {"title": "b"})
    put(tmp_path / "data/discussion/y__1.json", {"statements": []})
    put(tmp_path / "data/transcripts/x__1.json", {"segments": [{"start": 0.5, "end": 2, "text": "hey"}]})
    put(tmp_path / "data/transcripts/x__2.json", "{broken")
    got = {(r.pillar, r.uid): r.segments for r in corpus.with_segments(corpus.corpus(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert set(got) == {("witnessed", "x__1"), ("witnessed", "x__2"), ("commentary", "y__1")}
    assert [s.text for s in got["witnessed", "x__1"]] == ["hey"] and got["witnessed", "x__2"] == [] and got["commentary", "y__1"] == []
    assert corpus.corpus(spark, str(tmp_path / "none")).count() == 0


def test_sidecars_first_folder_wins(spark, tmp_path):
    put(tmp_path / "raw/x__1.info.json", {"title": "first", "description": "d" * 5000, "tags": [], "duration": 3})
    put(tmp_path / "talk/x__1.info.json", {"title": "second"})
    put(tmp_path / "talk/y__2.info.json", {"title": "", "tags": ["t"]})
    put(tmp_path / "talk/odd.info.json", {"title": "no platform"})
    got = {r.uid: r for r in corpus.sidecars(spark, str(tmp_path), ["raw", "talk", "none"]).collect()}
    assert set(got) == {"x__1", "y__2"} and got["x__1"].title == "first" and len(got["x__1"].description) == 4000 and got["x__1"].tags is None
    assert got["y__2"].title is None and got["y__2"].tags == ["t"] and got["y__2"].source == "y"


def test_feature_index_last_row_wins(spark, tmp_path):
    rows = [{"uid": "u", "pillar": "witnessed", "clip": "a/clip_3.mp4", "keypoints": {"n": i}} for i in (1, 2)] + [{"uid": "u", "pillar": "witnessed", "clip": "a/clip_3.mp4", "error": "x", "keypoints": {"n": 9}}]
    put(tmp_path / "a.jsonl", "\n".join(map(json.dumps, rows)) + "\n")
    put(tmp_path / "b.jsonl", json.dumps({"uid": "v", "pillar": "commentary", "clip": "whole.mp4", "low_level": {"m": 0.5}}) + "\n")
    put(tmp_path / "c.jsonl", json.dumps({"uid": "v", "pillar": "commentary", "low_level": {"m": 0.7}}) + "\n")
    got = {(r.pillar, r.uid, r.idx): r for r in corpus.feature_index(spark, [str(tmp_path / f"{x}.jsonl") for x in "abc"]).collect()}
    assert got["witnessed", "u", 3].keypoints == {"n": 2.0} and got["commentary", "v", 0].low_level == {"m": 0.7} and len(got) == 2


def test_numbered_errors_and_gzip(spark, tmp_path):
    put(tmp_path / "ok.jsonl", '{"kind": "query", "n": 1}\n\n{"kind": "other", "n": 2}\n')
    assert corpus.numbered_jsonl(spark, str(tmp_path / "ok.jsonl"), ROW).count() == 2
    put(tmp_path / "bad.jsonl", '{"kind": "query", "n": 1}\n\n{"kind": oops}\n')
    with pytest.raises(ValueError, match=r"bad\.jsonl:3:"):
        corpus.numbered_jsonl(spark, str(tmp_path / "bad.jsonl"), ROW)
    with gzip.open(tmp_path / "t.jsonl.gz", "wt") as f:
        f.write('{"kind": "query", "n": 1}\n{"kind": "run", "n": 2}\n')
    assert [r.n for r in corpus.trajectory(spark, str(tmp_path / "t.jsonl.gz"), ROW).collect()] == [1]


def test_sealed_outputs(spark, tmp_path):
    d = spark.range(5).withColumn("x", F.col("id") * 2)
    s = corpus.seal_all({"one": (d, ["id"]), "two": (d.limit(2), ["id"])}, str(tmp_path / "out")).collect()
    assert [(r.output, r.n) for r in sorted(s)] == [("one", 5), ("two", 2)] and len({r.manifest_sha256 for r in s}) == 1
    with pytest.raises(Exception, match="exist"):
        corpus.seal_all({"one": (d, ["id"])}, str(tmp_path / "out"))


def test_unknown_platforms_give_nothing(spark):
    assert list(feed.read_pages("nowhere", 0, 3)) == [] and len(list(feed.read_pages("alpha", 1, 2))) == feed.Pages.size


def test_pages_of_every_platform_are_candidates(spark, tmp_path):
    urls = ["https://a.example.net/en/1?x=2#top", "https://b.example.net/en/1", "http://A.example.ORG/ä b", None, "no host", *[f"https://c.net/{i}" for i in range(4)], "https://a.dev", "https://a.example.net/en/1?x=2#top"]
    rows = [(i, u, f"<head><TITLE lang='en'>t\n{i}</title></head>" if i else None) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = {r.page_id: r for r in catalog.queries()["feed_candidates"](spark, str(tmp_path)).collect()}
    assert set(out) == {0, 1, 2, 5, 6, 7, 8, 9, 10}  # no platform is left out; what names none has no candidate
    assert (out[0].platform, out[0].native_id, out[0].uid, out[0].title) == ("net", "a.example.net/en/1?x=2#top", "net__a_example_net_en_1_x_2_top", None)
    assert (out[2].platform, out[2].uid, out[2].title) == ("org", "org__A_example_ORG___b", "t\n2") and out[9].uid == "dev__a_dev"
    assert out[1].uid != out[0].uid == out[10].uid  # one path on two hosts is two candidates
    assert [out[i].page for i in (0, 1, 5, 6, 7, 8, 10)] == [0, 0, 0, 0, 0, 1, 1] and out[2].page == out[9].page == 0


def test_stream_over_several_files_keeps_the_last_state(spark, tmp_path):
    kinds = ["view", "view", "purchase", "error", "view", "view"]
    rows = [(i, f"2024-01-01 0{i}:00:00", 7, k, 1.0, "{}") for i, k in enumerate(kinds)]
    for i in range(0, 6, 2):
        d = spark.createDataFrame(rows[i : i + 2], "event_id long, s string, user_id long, event_type string, value double, props string")
        d.withColumn("ts", F.expr("cast(s as timestamp_ntz)")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / f"f{i}" / "events.parquet"))
    stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f*" / "events.parquet")).withColumn("at", F.to_timestamp(F.col("ts").cast("string")))
    got = jobs.cooldowns(stream, str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0].streak == 2 and got[0].cooldown == 1200.0


def test_alerts(spark):
    d = spark.createDataFrame([("a", 1, 9), ("b", 5, 9), ("c", 5, 1)], "k string, errors int, n int")
    got = {r.k: r.alerts for r in jobs.alerts(d, {"errors": F.col("errors") > 3, "few": F.col("n") < 2}).collect()}
    assert got == {"b": ["errors"], "c": ["errors", "few"]}
