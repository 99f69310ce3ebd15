"""Streams over several batches, with restarts and replays; the release and re-processing; walks of JSON; tracks; experiments on small rows."""

import json
import math
import random
import time
from datetime import timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.functions import json_walk
from lumenforge.operators import detector, experiments, intervals, labelmodel, ranks, relational, reviews, tracks
from lumenforge.sources import cursor, release
from lumenforge.streaming import crawl, status

CHANGE = "uid long, event_id long, s string, wanted string"


def batches(spark, path, parts, schema):
    """Each part as a file of its own, in order."""
    for i, rows in enumerate(parts):
        d = spark.createDataFrame(rows, schema)
        d = d.withColumn("at", F.to_timestamp("s")).drop("s") if "s string" in schema else d
        d.coalesce(1).write.mode("append").json(f"{path}/{i:03d}")


def one_by_one(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/*")


def run(df, sink, checkpoint):
    out = []
    q = df.writeStream.foreachBatch(lambda b, n: out.append((n, b.collect()))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    sink += [r for _, rows in out for r in rows]


def test_status_machine_over_batches_and_a_restart(spark, tmp_path):
    day = lambda d, h: f"2024-01-{d:02d} {h:02d}:00:00"
    batches(spark, tmp_path / "in", [[(1, 1, day(1, 1), "enumerated"), (1, 2, day(1, 2), "done"), (2, 3, day(1, 1), "enumerated")], [(1, 4, day(1, 3), "pending_transcribe")]], CHANGE)
    schema = "uid long, event_id long, at timestamp, wanted string"
    got = []
    run(status.changes(one_by_one(spark, tmp_path / "in", schema), patience=timedelta(days=3)), got, str(tmp_path / "state"))
    assert [(r.event_id, r.was, r.now, r.verdict) for r in sorted(got, key=lambda r: r.event_id)] == [(1, "", "enumerated", "accepted"), (2, "enumerated", "enumerated", "refused"), (3, "", "enumerated", "accepted"), (4, "enumerated", "pending_transcribe", "accepted")]
    # a restart goes on from the state: one change is late, one is allowed; the other item has waited for too long
    more = [[(1, 5, day(1, 2), "error"), (1, 6, day(1, 4), "pending_detect")], [(3, 7, day(9, 1), "enumerated")], [(3, 8, day(9, 2), "skipped")]]
    batches(spark, tmp_path / "in2", more, CHANGE)
    for i in range(3):
        (tmp_path / "in2" / f"{i:03d}").rename(tmp_path / "in" / f"{i + 2:03d}")
    again = []
    run(status.changes(one_by_one(spark, tmp_path / "in", schema), patience=timedelta(days=3)), again, str(tmp_path / "state"))
    known = {r.event_id: (r.was, r.now, r.verdict) for r in again if r.event_id is not None}
    assert known == {5: ("pending_transcribe", "pending_transcribe", "late"), 6: ("pending_transcribe", "pending_detect", "accepted"), 7: ("", "enumerated", "accepted"), 8: ("enumerated", "skipped", "accepted")}
    assert {(r.uid, r.now) for r in again if r.verdict == "stalled"} == {(1, "pending_detect"), (2, "enumerated")}


CANDIDATE = "uid string, platform string, query string, duration double, rank long"


def test_crawl_waits_while_too_much_is_pending(spark, tmp_path):
    batches(spark, tmp_path / "in", [[("a", "p", "q", 10.0, 1), ("b", "p", "q", 9000.0, 2), ("a", "p", "r", 10.0, 3)], [("c", "p", "q", 5.0, 1), ("a", "p", "q", 5.0, 2)], [("a", "p", "q", 1.0, 1), ("d", "p", "r", 5.0, 2)]], CANDIDATE)
    seen = []

    def pause(seconds):  # a later stage finishes what is pending
        seen.append(loop.pending())
        loop.finish(len(seen), loop.seen.before().where("status = 'pending_transcribe'").select("uid"))

    loop = crawl.Crawl(spark, str(tmp_path / "out"), max_pending=1, wait=0, pause=pause)
    loop.run(one_by_one(spark, tmp_path / "in", CANDIDATE), str(tmp_path / "state"))
    assert seen == [1, 1] and loop.pauses == 2  # before the second and the third batch
    assert {(r.uid, r.query, r.status, r.batch) for r in loop.seen.before().collect()} == {("a", "q", "pending_transcribe", 0), ("b", "q", "skipped", 0), ("c", "q", "pending_transcribe", 1), ("d", "r", "pending_transcribe", 2)}
    want = {("q", 5, 3, 2, 1, 1), ("r", 2, 1, 1, 0, 0)}
    stats = lambda: {(r.query, r.returned, r.new, r.enqueued, r.skipped, r.streak) for r in loop.stats.last().collect()}
    assert stats() == want
    loop.pending = lambda: 0
    loop.batch(spark.createDataFrame([("a", "p", "q", 1.0, 1), ("d", "p", "r", 5.0, 2)], CANDIDATE), 2)  # replayed
    assert stats() == want and loop.seen.before().count() == 4


def test_replayed_snapshots_add_nothing(spark, tmp_path):
    m = crawl.Monitor(spark, str(tmp_path), {"pending": 5}, fall=0.5)
    counts = lambda **k: spark.createDataFrame(list(k.items()), "name string, value long")
    assert {tuple(r) for r in m.take(counts(pending=3, done=10), 0).select("name", "change").collect()} == {("pending", None), ("done", None)}
    for _ in range(2):
        got = {r.name: (r.value, r.change, r.alerts) for r in m.take(counts(pending=7, done=4), 1).collect()}
        assert got == {"pending": (7, 4, ["pending_backlog_at_least_5"]), "done": (4, -6, ["done_fell"])}
    assert m.snapshots.before().count() == 4 and m.snapshots.numbers() == [0, 1]
    assert {r.name: r.alerts for r in m.take(counts(pending=1), 2).collect()}["done"] == ["done_fell"]


class Listed(cursor.Remote):
    """Posts of three sections; every page that is asked for is written down."""

    POSTS = {"one": [(f"o{i}", 100 - i, f"t{i}") for i in range(5)], "two": [], "three": [(f"h{i}", 50 - i, "t") for i in range(3)]}

    def page(self, section, before, most):
        with open(self.options["log"], "a") as f:
            f.write(f"{section}:{before}\n")
        return [p for p in self.POSTS[section] if before is None or p[1] < before][:most]


def test_cursor_source_goes_on_where_it_was(spark, tmp_path):
    assert cursor.parsed("2:17") == (2, 17) and cursor.parsed("0:") == (0, None)
    assert cursor.following("1:", 3, [("a", 9, ""), ("b", 4, "")], 2) == "1:4" and cursor.following("1:4", 3, [("c", 3, "")], 2) == "2:" and cursor.following("2:", 3, [], 2) == "3:"
    reader = cursor._Stream({"sections": "one,two,three", "most": "2", "remote": f"{__name__}:Listed", "log": str(tmp_path / "log")})
    at, got, ends = reader.initialOffset(), [], []
    for _ in range(9):
        start = at
        rows, at = reader.read(start)
        rows = list(rows)
        ends.append(at["cursor"])
        assert list(reader.readBetweenOffsets(start, at)) == rows  # a replayed batch is the same
        got += rows
        reader = cursor._Stream({"sections": "one,two,three", "most": "2", "remote": f"{__name__}:Listed", "log": str(tmp_path / "log")})  # a restart
    assert [r[1] for r in got] == ["o0", "o1", "o2", "o3", "o4", "h0", "h1", "h2"]
    assert ends == ["0:99", "0:97", "1:", "2:", "2:49", "3:", "3:", "3:", "3:"]
    # as a stream, stopped after some pages and started again from its checkpoint
    cursor.register(spark)
    kept = []
    for _ in range(3):
        posts = spark.readStream.format("lumenforge_posts").options(sections="one,two,three", most="2", remote=f"{__name__}:Listed", log=str(tmp_path / "log")).load()
        q = posts.writeStream.foreachBatch(lambda b, n: kept.extend(r.id for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
        for _ in range(200):
            if len(kept) >= 3 or not q.isActive:
                break
            time.sleep(0.1)
        q.stop()
    assert len(kept) == len(set(kept)) and set(kept) <= {r[1] for r in got} and len(kept) >= 3


CONTRACT = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("x", T.StringType()), T.StructField("pillar", T.StringType(), False)])


def test_release_by_pillar(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"x{i}", release.PILLARS[i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, x string, pillar string").withColumn("more", F.lit(1))
    path = str(tmp_path / "r")
    assert {r.pillar: r.n for r in release.release(df, path, CONTRACT, ["id"]).collect()} == dict.fromkeys(release.PILLARS, 10)
    one = release.read(spark, path, CONTRACT).where("pillar = 'witnessed'")
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(pillar" in plan and sorted(r.id for r in one.collect()) == list(range(0, 30, 3))
    assert all(r.intact for r in release.verified(spark, path, CONTRACT).collect())
    with pytest.raises(Exception, match="exist"):
        release.release(df, path, CONTRACT, ["id"])
    for bad, said in ((df.drop("x"), "missing"), (df.withColumn("x", F.lit(1)), "not string"), (df.union(df.limit(1)), "stands 2 times"), (df.withColumn("pillar", F.when(F.col("id") > 3, F.col("pillar"))), "null in pillar")):
        with pytest.raises(release.ContractError, match=said):
            release.release(bad, str(tmp_path / "no"), CONTRACT, ["id"])
    spark.createDataFrame([(99, "added")], "id long, x string").write.mode("append").parquet(f"{path}/data/pillar=witnessed")
    assert {r.pillar for r in release.verified(spark, path, CONTRACT).collect() if not r.intact} == {"witnessed"}


@pytest.mark.parametrize("stop", [0, 1, 2, 3, 4, 5])
def test_reprocessing_that_was_killed_ends_the_same(spark, tmp_path, stop):
    table = release.Reprocessing(spark, str(tmp_path / "t"), buckets=2)
    table.start(spark.range(20).select("id", (F.col("id") * 2).alias("x")), "id")
    reason = F.when(F.col("id") % 3 == 0, "third").when(F.col("id") == 5, "five")
    with pytest.raises(InterruptedError):
        table.run("a", reason, stop_after=stop)
    table.run("a", reason)
    assert table.run("a", reason) == 0  # all is in the journal
    assert sorted(r.id for r in table.rows().collect()) == [i for i in range(20) if i % 3 and i != 5]
    assert {(r.id, r.reason, r.run) for r in table.quarantine().collect()} == {(i, "third", "a") for i in range(0, 20, 3)} | {(5, "five", "a")}
    assert sum(r.kept for r in table.journal().collect()) == 12 and sum(r.taken for r in table.journal().collect()) == 8


def test_json_walks(spark):
    chain = lambda n, end: '{"op": "cut", "prior_transform": ' * n + end + "}" * n
    rows = [(0, chain(50, '{"audio_removed": true}'), True), (1, chain(50, '{"output_audio_removed": true}'), True), (2, chain(50, '{"audio_removed": "true"}'), False), (3, '{"audio_removed": true, "prior_transform": {}}', True), (4, '{"x": {"audio_removed": true}}', False), (5, None, False), (6, "no json", False), (7, '[{"audio_removed": true}]', False), (8, '{"note": "audio_removed", "prior_transform": null}', False)]
    df = spark.createDataFrame(rows, "id int, x string, want boolean")
    assert df.where(~json_walk.in_chain(F.col("x"), "prior_transform", ["audio_removed", "output_audio_removed"]).eqNullSafe(F.col("want"))).count() == 0
    deep = json.dumps({"uid": " a ", "rows": [{"item_id": "witnessed:b:1"}, {"candidate_id": "other:c:1", "video_id": ""}, ["uid", {"source_uid": "d", "uid": 7}]]})
    deep = '[{"x": ' * 60 + deep + "}]" * 60
    docs = spark.createDataFrame([(deep,), (deep,), ("{broken",), (None,), ('"uid"',)], "x string")
    assert sorted(r.uid for r in json_walk.harvested(docs, "x").collect()) == ["a", "b", "d"]


def test_tracks(spark):
    r = random.Random(3)
    rows = []
    for clip in range(3):
        for frame in range(40):
            for box in range(r.randint(0, 4)):
                x, y = r.random() * 3, r.random() * 2
                rows.append((clip, frame, box, x, y, x + 1, y + 1))
    iou = lambda a, b: (lambda s: s / (2 - s))(max(0, 1 - abs(a[0] - b[0])) * max(0, 1 - abs(a[1] - b[1])))
    want = {}
    for clip in range(3):
        last = []
        for frame in range(40):
            own = [(x[2], x[3:5]) for x in rows if x[:2] == (clip, frame)]
            pairs = sorted(((iou(b, p), t, i) for t, b in enumerate(last) for i, (_, p) in enumerate(own)), reverse=True)
            taken = {}
            for s, t, i in pairs:
                if s >= 0.15 and t not in taken.values() and i not in taken:
                    taken[i] = t
            for i, (box, p) in enumerate(own):
                if i not in taken:
                    taken[i] = len(last)
                    last.append(p)
                last[taken[i]] = p
                want[clip, frame, box] = taken[i]
    df = spark.createDataFrame(rows, "clip long, frame long, box long, x0 double, y0 double, x1 double, y1 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # frames go on in the next batch
    try:
        assert {(x.clip, x.frame, x.box): x.track for x in tracks.link(df).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tracks.link(df.limit(0)).count() == 0


def test_places_and_even_orders(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", (i * 7919) % 1009, i) for i in range(600)]
    df = spark.createDataFrame([*rows, (None, 3, 601), (None, 2, 600)], "g string, v int, i int").repartition(5)
    got = ranks.numbered(df, ["g"], ["v", "i"], "place").collect()
    for g in {r.g for r in got}:
        own = sorted((r.place, r.v, r.i) for r in got if r.g == g)
        assert [p for p, _, _ in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert len(got) == 602
    for n in (1, 2, 3, 4, 9, 10, 64, 101):
        held = [0, n - 1, n // 2] if n > 2 else list(range(n))
        while len(held) < n:
            held.append(max((i for i in range(n) if i not in held), key=lambda i: (min(abs(i - h) for h in held), -i)))
        key = ranks.spread_out(F.lit(n).cast("long"), F.col("id"))
        assert [r.id for r in spark.range(n).orderBy(key).collect()] == held
    lost = relational.duplicate_losers(spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(12)], "id int, t string"), [F.upper("t")], ["id"])
    assert sorted((r.id, r["rank"]) for r in lost.collect()) == [(2, 2), (3, 3), (4, 2), (5, 4), (6, 5), (7, 6), (8, 3), (9, 7), (10, 8), (11, 9)]


@pytest.mark.parametrize("small", [0, experiments.SMALL])
def test_gradient_steps_equal_numpy(spark, monkeypatch, small):
    monkeypatch.setattr(experiments, "SMALL", small)
    r = np.random.default_rng(4)
    n, dim = 80, 6
    x, y, g = r.normal(size=(n, dim)) * (r.random((n, dim)) < 0.5), r.integers(0, 2, n), r.integers(0, 2, n)
    rows = [(int(g[i]), [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]], float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "grp int, idx array<int>, val array<double>, y double").repartition(20).cache()
    got = experiments.train_logistic(df, 3, dim, epochs=7)
    for k in (0, 1):
        w, padded, label = np.zeros(dim + 1), np.hstack([x[g == k], np.ones(((g == k).sum(), 1))]), y[g == k]
        for _ in range(7):
            w -= 0.5 * (padded.T @ (1 / (1 + np.exp(-(padded @ w))) - label) / len(label) + 1e-4 * w)
        assert np.allclose(w, got[k])
    assert not got[2].any()
    p = experiments.predict_logistic(df, got, ["grp", "y"]).collect()
    assert len(p) == n and all(0 < q.p < 1 for q in p)


def test_isotonic_and_thresholds(spark):
    r = random.Random(6)
    rows = [(round(r.random(), 1), r.random() < 0.5) for _ in range(80)]
    df = spark.createDataFrame(rows, "p double, y boolean")
    steps = experiments.isotonic(df, "p", "y")
    at = sorted({p for p, _ in rows})
    mean = lambda a, b: (lambda v: sum(v) / len(v))([y for p, y in rows if a <= p <= b])
    want = {x: max(min(mean(a, b) for b in at if b >= x) for a in at if a <= x) for x in at}
    got = {x.p: x.q for x in df.select("p", experiments.calibrated(F.col("p"), steps).alias("q")).distinct().collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x]) for x in want)
    assert spark.range(1).select(experiments.calibrated(F.lit(-1.0), steps).alias("q")).first().q == steps[0][1]
    d = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, True), (0.6, False), (0.5, True), (0.4, False)], "p double, y boolean")
    best = experiments.precise_threshold(d, "p", "y", 0.8, 3).first()
    assert (best.threshold, best.tp, best.selected) == (0.5, 4, 5)
    assert experiments.precise_threshold(d.where("not y"), "p", "y").count() == 0


def test_forest_never_sees_the_sources_it_predicts(spark, tmp_path):
    """Folds, threshold and metrics over the written predictions, stated in SQL."""
    r = random.Random(9)
    rows = [(i, f"s{i % 10}", i % 10 % 5, float(i % 2), float(i % 2) + r.gauss(0, 0.4), None if i % 7 == 0 else r.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, source string, fold int, label double, a double, b double").cache()
    made = []

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, d):
            made.append({x.fold for x in d.select("fold").distinct().collect()})
            return self.inner.fit(d)

    model = experiments.estimators(["a", "b"], trees=10)["random_forest"]
    out = experiments.out_of_fold(df, Watched(model), "fold", 5, ["id", "label"]).withColumn("y", F.col("label") == 1)
    out.write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    assert made == [{0, 1, 2, 3, 4} - {i} for i in range(5)] and p.count() == 200
    con = duckdb.connect()
    want = con.execute(f"""WITH g AS (SELECT p, count(*) FILTER (y) AS k, count(*) AS n FROM read_parquet('{tmp_path}/p/*.parquet') GROUP BY p), c AS (SELECT p, sum(k) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS selected FROM g)
        SELECT p, tp, selected FROM c WHERE selected >= 3 AND tp / selected >= 0.8 ORDER BY tp DESC, tp / selected DESC, p DESC LIMIT 1""").fetchall()
    best = experiments.precise_threshold(p, "p", "y").first()
    assert [(best.threshold, best.tp, best.selected)] == want and best.tp > 60
    one = experiments.out_of_fold(df.withColumn("label", F.lit(1.0)), model, "fold", 5, ["id", "label"])
    assert {x.p for x in one.collect()} == {1.0}


def test_items_without_votes_count_in_the_fit(spark):
    votes = spark.createDataFrame([(str(i), "f", 1) for i in range(5)], "item_id string, family string, vote int")
    items = spark.createDataFrame([(str(i),) for i in range(50)], "item_id string")
    some, whole = labelmodel.fit(votes, ["f"], rounds=1), labelmodel.fit(votes, ["f"], rounds=1, items=items)
    assert whole.prior < some.prior and labelmodel.patterns(votes, ["f"], items) == [((0,), 45), ((1,), 5)]


def test_windows_end_with_the_medium(spark):
    def by_hand(total, size, stride):
        if total <= size:
            return [(0.0, total)]
        starts, v = [], 0.0
        while v + size < total:
            starts.append(v)
            v += stride
        if not starts or abs(starts[-1] - (total - size)) > 0.25:
            starts.append(total - size)
        return [(x, min(total, x + size)) for x in starts]

    totals = [0.0, 3.0, 6.0, 6.1, 6.3, 9.0, 9.2, 9.26, 12.0, 30.5]
    got = spark.createDataFrame([(x,) for x in totals], "t double").select("t", intervals.with_tail(F.col("t"), 6.0, 3.0).alias("w")).collect()
    assert {r.t: [tuple(x) for x in r.w] for r in got} == {x: by_hand(x, 6.0, 3.0) for x in totals}
    assert spark.range(1).select(intervals.with_tail(F.lit(None).cast("double"), 6.0, 3.0).alias("w")).first().w is None


def test_judgments_of_unknown_pairs_are_an_error(spark):
    pairs = spark.createDataFrame([(1, "A", True), (2, "B", None)], "pair_id int, positive_side string, vlm_correct boolean")
    said = spark.createDataFrame([(1, "A", "sure", ["x"]), (2, "A", None, []), (2, "cant_tell", "sure", ["x", "y"])], "pair_id int, choice string, confidence string, flags array<string>")
    r = reviews.scored_pairs(pairs, said).first()
    assert (r.pairs, r.both_saw, r.vlm_correct, r.decided, r.cant_tell, r.correct, r.sure, r.sure_correct, r.decided_on_both, r.human_correct) == (2, 1, 1, 2, 1, 1, 1, 1, 1, 1)
    assert [tuple(x) for x in r.flags] == [("x", 2), ("y", 1)]
    with pytest.raises(ValueError, match="9"):
        reviews.scored_pairs(pairs, said.withColumn("pair_id", F.lit(9)))


def test_spans_are_found_in_time_linear_in_the_words(spark):
    words = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.concat(F.lit("It's"), F.lit("!!"), i.cast("string")).alias("word"), i.cast("double").alias("start"), (i + 1).cast("double").alias("end")))
    small = spark.createDataFrame([(3,), (0,), (1,)], "n int").where("n > 0").select("n", words.alias("w")).select("n", detector.spanned(F.col("w")).alias("s")).collect()
    assert {r.n: [(x.token, x.a, x.b) for x in r.s] for r in small} == {3: [("it's1", 0, 5), ("it's2", 6, 11), ("it's3", 12, 17)], 1: [("it's1", 0, 5)]}
    took = []
    for n in (20_000, 20_000, 160_000):
        began = time.time()
        spark.createDataFrame([(n,)], "n int").select(detector.spanned(words).alias("s")).select(F.element_at("s", -1).alias("x")).collect()
        took.append(time.time() - began)
    assert took[2] < 24 * max(took[1], 0.5)


def test_events_just_two_hours_apart_are_of_two_sessions(spark, tmp_path):
    from lumenforge.plans import catalog
    from lumenforge.streaming import jobs

    # the last event, of another user, closes the sessions before
    rows = [(1, "2024-01-01 00:00:00", 7), (2, "2024-01-01 02:00:00", 7), (2, "2024-01-01 02:00:00", 7), (3, "2024-01-01 03:59:59", 7), (4, "2024-01-01 00:00:00", None), (5, "2024-01-09 00:00:00", 8)]
    d = spark.createDataFrame(rows, "event_id long, s string, user_id long").select("event_id", F.col("s").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    d.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["session_windows"](spark, str(tmp_path)).collect()
    assert sorted((r.user_id or 0, r.n) for r in got) == [(0, 1), (7, 1), (7, 2), (8, 1)]
    one = tmp_path / "stream" / "events.parquet"
    one.parent.mkdir()
    one.write_bytes(next((tmp_path / "events.parquet").glob("part-*")).read_bytes())
    got = jobs.run_to_table(jobs.sessions(jobs.event_stream(spark, str(one.parent))), "sessions").collect()
    assert sorted((r.user_id or 0, str(r.start)[11:], str(r.end)[11:], r.n) for r in got) == [(0, "00:00:00", "02:00:00", 1), (7, "00:00:00", "02:00:00", 1), (7, "02:00:00", "05:59:59", 2)]


@pytest.fixture(scope="module")
def late_words(spark, tmp_path_factory):
    """A folder of documents whose label is told by a word that comes after 400 others."""
    d = str(tmp_path_factory.mktemp("late-words"))
    rows = [(i, f"s{i % 30}", "en", "A title. " + "word " * 400 + ("early" if i // 30 % 2 else "late")) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i // 30 % 2) for i, *_ in rows], "doc_id long, quality int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d


def test_probe_slices_read_whole_texts(spark, late_words):
    from lumenforge.plans import catalog

    r = catalog.queries()["leakage_probe_slices"](spark, late_words).where("channel = 'transcript_text'").collect()
    assert r and {x.auroc for x in r} == {1.0}


def test_probes_read_whole_texts(spark, late_words):
    from lumenforge.plans import catalog

    assert {x.channel: x.auroc for x in catalog.queries()["leakage_probes"](spark, late_words).collect()}["transcript_text"] == 1.0


def test_rows_of_training_are_packed_into_bounded_blocks(spark, monkeypatch):
    rows = [(i % 2, list(range(i % 7)), [0.5] * (i % 7), float(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "grp int, idx array<int>, val array<double>, y double").repartition(3).cache()
    want = experiments.train_logistic(df, 2, 7, epochs=5)
    blocks = []
    kept = experiments.written
    monkeypatch.setattr(experiments, "written", lambda df, name: blocks.append(kept(df, name)) or blocks[-1])
    monkeypatch.setattr(experiments, "SMALL", 0)
    monkeypatch.setattr(experiments, "BLOCK", 10)
    assert np.allclose(experiments.train_logistic(df, 2, 7, epochs=5), want)
    sizes = [[*np.frombuffer(r.sizes, np.int32)] for r in blocks[0].collect()]
    assert sum(map(len, sizes)) == 60 and all(sum(x) <= 10 or len(x) == 1 for x in sizes)
