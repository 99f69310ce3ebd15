"""Operators on literal rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.functions import contracts, hashing, stats, text, vectors
from lumenforge.operators import intervals, labelmodel, relational, sampling, scheduling
from lumenforge.sources import feed, ledgers

VOTES = "item_id string, lf_id string, family string, vote int"


def test_any_negative_wins_in_a_family(spark):
    v = spark.createDataFrame([("a", "l1", "reaction", 1), ("a", "l2", "reaction", -1), ("a", "l3", "social", 1), ("b", "l1", "reaction", 0)], VOTES)
    assert {(r.item_id, r.family): r.vote for r in labelmodel.collapse(v).collect()} == {("a", "reaction"): -1, ("a", "social"): 1}
    assert [r.majority for r in labelmodel.majority(labelmodel.collapse(v)).collect()] == [0]


def test_fit_finds_the_accurate_family(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        y = 1 if rnd.random() < 0.5 else -1
        for f, a in (("good", 0.92), ("fair", 0.8), ("noisy", 0.58)):
            rows.append((str(i), f, f, y if rnd.random() < a else -y))
    m = labelmodel.fit(labelmodel.collapse(spark.createDataFrame(rows, VOTES)), ["good", "fair", "noisy"])
    assert m.accuracy["good"] > 0.8 and m.accuracy["good"] > m.accuracy["noisy"]
    assert all(0.55 <= a <= 0.95 for a in m.accuracy.values())


def test_gates_come_before_the_posterior(spark):
    d = spark.range(1).select(F.lit(0.99).alias("p"), F.create_map(F.lit("f"), F.lit(1)).alias("v"), F.array(F.lit("g")).alias("some"), F.array().cast("array<string>").alias("none"))
    band = lambda a, b: labelmodel.band(F.col("p"), F.col("v"), F.col(a), F.col(b))
    r = d.select(band("some", "none").alias("x"), band("none", "some").alias("y"), band("none", "none").alias("z")).first()
    assert tuple(r) == ("gate_failed_review", "insufficient_evidence_abstain", "high_confidence_candidate")


def test_splits_keep_groups_together(spark):
    d = spark.range(100).select((F.col("id") % 25).cast("string").alias("g")).withColumn("s", hashing.split("x", F.col("g")))
    assert d.groupBy("g").agg(F.countDistinct("s").alias("n")).where("n > 1").isEmpty()
    assert {r.s for r in d.select("s").distinct().collect()} == {"train", "calibration", "test"}


def test_cooldown_doubles_and_resets(spark):
    d = spark.createDataFrame([("q", 1, 0, "complete"), ("q", 2, 0, "complete"), ("q", 3, 0, "failed"), ("q", 4, 2, "complete")], "q string, t int, found int, status string")
    r = scheduling.cooldown_replay(d, ["q"], ["t"], F.col("found") > 0, F.col("status") != "complete", 600, 30, 1e6).orderBy("t").collect()
    assert [(x.streak, x.cooldown) for x in r] == [(1, 600.0), (2, 1200.0), (2, 30.0), (0, None)]


def test_thinning_and_tiles(spark):
    d = spark.createDataFrame([(k, float(x), x) for k in "ab" for x in (9, 1, 4, 6, 14)] + [("c", 5.0, 2), ("c", 5.0, 1)], "k string, t double, r int")
    got = sorted((x.k, x.t, x.r) for x in intervals.thinned(d, "k", "t", 5.0, ["r"]).collect())
    assert got == [(k, float(x), x) for k in "ab" for x in (1, 6, 14)] + [("c", 5.0, 1)]
    assert [x.t for x in intervals.thinned(d.where("k = 'a'"), "k", "t", 5.0, [], strict=True).orderBy("t").collect()] == [1.0, 9.0]
    assert list(spark.range(1).select(intervals.tiles(F.lit(29.0), 12.0, 8.0).alias("w")).first().w) == [0.0, 8.0, 16.0, 17.0]


def test_running_totals_and_quantiles_are_exact(spark):
    import numpy as np

    from lumenforge.operators import ranks

    x = [(i * 37) % 101 / 7 for i in range(400)]
    d = spark.createDataFrame([(v,) for v in x], "v double")
    assert np.allclose(ranks.quantiles(d, "v", [0, 0.1, 0.5, 0.93, 1]).first().q, np.quantile(x, [0, 0.1, 0.5, 0.93, 1]))
    assert all(abs(r.p - np.mean(np.array(x) <= r.v)) < 1e-12 for r in ranks.percentile_of(d, "v", "p").collect())
    assert ranks.percentile_of(d.limit(0), "v", "p").count() == 0


def test_scripts(spark):
    said = {"Все люди рождаются": "script:cyrillic", "すべての人間は": "script:kana", "人人生而自由在尊严": "script:cjk", "மனிதப் பிறவியினர்": "script:tamil", "มนุษย์ทั้งหลาย": "script:thai", "সমস্ত মানুষ স্বাধীন": "script:bengali", "why are you doing that": "english", "abc": "too_short"}
    d = spark.createDataFrame(list(said.items()), "t string, want string")
    assert all(r.got == r.want for r in d.select("want", text.language_guess(F.col("t")).alias("got")).collect())


@pytest.mark.parametrize(("closed", "n"), [(True, 2), (False, 1)])
def test_overlap_bounds(spark, closed, n):
    a = spark.createDataFrame([("k", 0.0, 10.0)], "k string, a double, b double")
    b = spark.createDataFrame([("k", 10.0, 20.0), ("k", 3.0, 4.0), ("j", 3.0, 4.0)], "k string, c double, d double")
    assert intervals.overlap_join(a, b, ["k"], ("a", "b"), ("c", "d"), 4.0, closed).count() == n


def test_tri_state(spark):
    d = spark.createDataFrame([("no", "uncertain"), ("yes", "uncertain"), ("yes", "yes")], "a string, b string")
    assert [r.v for r in d.select(contracts.tri_and(F.col("a"), F.col("b")).alias("v")).collect()] == ["no", "uncertain", "yes"]
    with pytest.raises(Exception, match="invalid a"):
        d.select(contracts.checked(F.col("a"), ["yes"], "a")).collect()


def test_wilson_and_auroc(spark):
    d = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "p double, y boolean")
    assert stats.auroc(d, "p", "y").first().auroc == 0.875
    low, _ = stats.wilson(F.lit(32), F.lit(32))
    r = spark.range(1).select(low.alias("a"), stats.wilson(F.lit(0), F.lit(0))[0].alias("b")).first()
    assert round(r.a, 4) == 0.8928 and r.b is None


def test_cues(spark):
    d = spark.createDataFrame([("Stop it, are you okay?",), ("oh wow",), (None,)], "t string")
    c = text.interventions(F.col("t"))
    rows = d.select(c["direct"].alias("a"), c["support"].alias("b"), c["generic_affect_only"].alias("c"), c["any_active"].alias("d")).collect()
    assert [tuple(r) for r in rows] == [(True, True, False, True), (False, False, True, False), (False, False, False, False)]


def test_success_is_not_replaced_by_failure(spark):
    d = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 2, False)], "k string, t int, ok boolean")
    assert {r.k: r.t for r in relational.success_wins(d, ["k"], F.col("ok"), [F.col("t")]).collect()} == {"a": 1, "b": 2}


def test_ledger_modes(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnope\n{"a": 2}\n')
    s = T.StructType([T.StructField("a", T.LongType())])
    assert sorted(r.a for r in ledgers.read_jsonl(spark, str(tmp_path / "x.jsonl"), s, "drop").collect()) == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        ledgers.read_jsonl(spark, str(tmp_path / "x.jsonl"), s).collect()
    with pytest.raises(Exception, match="bad line"):
        ledgers.check_lines(ledgers.read_jsonl(spark, str(tmp_path / "x.jsonl"), s, "keep")).collect()
    ledgers.seal(spark.range(3), str(tmp_path / "out"))
    with pytest.raises(Exception):  # noqa: B017
        ledgers.seal(spark.range(3), str(tmp_path / "out"))


def test_feed_streams_what_it_reads(spark, tmp_path):
    feed.register(spark)
    one = spark.read.format("lumenforge_feed").option("platforms", "a,b").option("pages", "2").load()
    q = spark.readStream.format("lumenforge_feed").option("platforms", "a,b").option("pages", "2").load().writeStream.format("memory").queryName("feed_rows").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    assert {r.uid for r in one.collect()} >= {r.uid for r in spark.table("feed_rows").collect()}
    assert spark.table("feed_rows").count() > 0


def test_entry_works_without_the_other_subpackage():
    import __spark_entry__ as e

    assert "flagship_shadow_rank" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_perceptual_hash_and_hamming(spark):
    import numpy as np

    r = np.random.default_rng(4)
    pictures = r.random((3, 16, 16))
    k, x = np.arange(16)[:, None], np.arange(16)
    basis = np.cos(np.pi * (2 * x + 1) * k / 32) * np.where(k == 0, np.sqrt(1 / 16), np.sqrt(2 / 16))
    want = []
    for p in pictures:
        c = (basis @ p @ basis.T)[:8, :8].ravel()
        want.append("".join("1" if v > np.median(c[1:]) else "0" for v in c))
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(pictures)] + [(3, None), (4, [1.0])], "id long, px array<double>")
    got = df.select("id", vectors.perceptual_hash(F.col("px"), 16).alias("h")).orderBy("id").collect()
    assert [g["h"] for g in got] == [*want, None, None]
    pair = spark.createDataFrame([("0011", "0101"), ("1", "1")], "a string, b string")
    assert [g[0] for g in pair.select(vectors.hamming(F.col("a"), F.col("b"))).collect()] == [2, 0]


def test_context_prompt(spark):
    rows = [(None, None, None), ("é \"q\"\n", "", [(3, "hi"), (None, None)])]
    df = spark.createDataFrame(rows, "title string, tags string, comments array<struct<score: int, body: string>>")
    got = [g[0] for g in df.select(text.context_prompt(F.lit("yt"), {"title": F.col("title"), "tags": F.col("tags")}, F.col("comments"))).collect()]
    assert got[0] == "platform: yt"
    assert got[1].startswith('platform: yt\ntitle: "é \\"q\\"\\n"\ncomment (score 3): "hi"')
    assert "tags" not in got[1] and got[1].endswith('comment (score None): ""')


def test_capped_cohort_is_the_sequential_fill(spark):
    """Many sources with a hot one in one stratum, and as many strata that all draw on the same few sources first."""
    rnd = random.Random(9)
    rows = [(i, "many", "hot" if i % 3 else f"s{i}") for i in range(2400)]
    rows += [(3000 + i, f"t{i % 70:02}", f"u{rnd.randrange(3) if rnd.random() < 0.9 else rnd.randrange(400)}") for i in range(4200)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string")
    hashed = df.withColumn("h", hashing.order("cohort", F.col("doc_id"))).collect()
    for per_stratum, cap in ((12, 2), (3, 5)):
        used, filled, want = {}, {}, set()
        for x in sorted(hashed, key=lambda x: (x.lang, x.h, x.doc_id)):
            if filled.get(x.lang, 0) < per_stratum and used.get(x.source, 0) < cap:
                used[x.source] = used.get(x.source, 0) + 1
                filled[x.lang] = filled.get(x.lang, 0) + 1
                want.add((x.doc_id, x.lang, x.source))
        got = sampling.capped_cohort(df, "doc_id", "lang", "source", "cohort", per_stratum, cap).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_tracks_follow_boxes(spark):
    """Two boxes that cross frames keep their tracks, the larger overlap wins, and one that jumps begins a new track."""
    from lumenforge.operators import tracks

    box = lambda x: (float(x), 0.0, float(x + 10), 10.0)
    rows = [(7, 0, 0, *box(0)), (7, 0, 1, *box(30)), (7, 1, 0, *box(32)), (7, 1, 1, *box(3)), (7, 2, 0, *box(5)), (7, 2, 1, *box(90)), (7, 2, 2, *box(8)), (8, 5, 0, *box(0))]
    d = spark.createDataFrame(rows, "clip long, frame long, box long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.clip, r.frame, r.box): r.track for r in tracks.link(d).collect()}
    assert [got[7, 0, 0], got[7, 0, 1], got[7, 1, 0], got[7, 1, 1]] == [0, 1, 1, 0]
    assert got[7, 2, 0] == 0 and {got[7, 2, 1], got[7, 2, 2]} == {2, 3} and got[8, 5, 0] == 0


def test_language_tag_searches_a_text_twice(spark):
    texts = ["The cat is not what you think of, and that is why", "Привет всем, как дела?", "漢字かな交じり文です漢字", "ab", None, "Ελληνικά and латиница ok", "abcdef абвгде", "Աբգդեզ mot"]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)
    x = d.select("text", text.language_tag(F.col("text")).alias("x")).select("text", "x.*")
    got = {r.text: (r.language, r.script_fraction) for r in x.collect()}
    assert got == {texts[0]: ("english", 1.0), texts[1]: ("script:cyrillic", 1.0), texts[2]: ("script:cjk", 0.5), "ab": ("too_short", 0.0), None: ("too_short", 0.0), texts[5]: ("script:cyrillic", 0.381), texts[6]: ("unknown_latin", 0.5), texts[7]: ("unknown_latin", 1.0)}
    assert x._jdf.queryExecution().optimizedPlan().toString().count("coalesce(text#") == 2


def test_long_segments_are_cut_once(spark):
    import time

    from lumenforge.operators import detector

    n = 20_000
    d = spark.range(1).select(F.explode(detector.pseudo_words(F.repeat(F.lit("so  it "), n // 2), F.lit(0.0), F.lit(float(n)))).alias("w"))
    start = time.time()
    r = d.agg(F.count(F.lit(1)).alias("n"), F.sum("w.start").alias("s"), F.max("w.end").alias("e")).first()
    assert (r.n, r.s, r.e) == (n, n * (n - 1) / 2, float(n))
    assert time.time() - start < 20  # a text that was cut again for each word took minutes


def test_similar_pairs_are_all_found_and_few_others_compared(spark, monkeypatch):
    from lumenforge.operators import similar

    rnd = random.Random(5)
    sets = [sorted({f"w{int(rnd.paretovariate(0.6)) % 4000}" for _ in range(rnd.choice((1, 2, 3, 8, 40, 80)))}) for _ in range(300)]
    sets += [sorted({*(w for w in s if rnd.random() < 0.8), f"x{i}"}) for i, s in enumerate(sets[:100])]
    jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    d = spark.createDataFrame(list(enumerate([*sets, []])), "k long, ts array<string>")
    left = []
    kept = similar.written
    monkeypatch.setattr(similar, "written", lambda df, name: left.append((name, kept(df, name))) or left[-1][1])
    monkeypatch.setattr(similar, "BLOCK", 500)
    monkeypatch.setattr(similar, "ROWS", 1000)
    for least, frequent in ((0.8, 0), (0.5, 50), (0.5, 500_000)):
        monkeypatch.setattr(similar, "FREQUENT", frequent)
        want = {(i, j): jaccard(sets[i], sets[j]) for i in range(400) for j in range(i + 1, 400)}
        got = {(r.ka, r.kb): r.jaccard for r in similar.similar_pairs(d, "k", "ts", least).collect()}
        assert got == {p: x for p, x in want.items() if x >= least}
        if frequent < 500_000:  # tokens that aren't put in order come by hash
            continue
        # fewer are compared than share a token of their prefixes, which is what a join by these tokens compares
        f = Counter(w for x in sets for w in x)
        first = [{*sorted(x, key=lambda w: (f[w], w))[: len(x) - math.ceil(len(x) * least) + 1]} for x in sets]
        plain = sum(1 for i, j in want if first[i] & first[j] and min(len(sets[i]), len(sets[j])) >= least * max(len(sets[i]), len(sets[j])))
        assert dict(left)["near-pairs"].count() < plain


@pytest.mark.parametrize("name", ["vector_pairs", "vector_pairs_of_first"])
def test_lengths_of_vectors_are_taken_once(spark, name):
    from lumenforge.plans import catalog

    from .conftest import SF

    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join ")[0].count("aggregate(") == 1  # of each pair its product alone


def test_blocks_of_sets_are_bounded_in_bytes(spark, monkeypatch):
    from lumenforge.operators import similar

    rnd = random.Random(8)
    sets = [sorted({f"w{rnd.randrange(3000)}" for _ in range(rnd.choice((2, 30, 200, 900)))}) for _ in range(200)]
    sets += [sorted({*(w for w in s if rnd.random() < 0.9), f"x{i}"}) for i, s in enumerate(sets[:60])]
    jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    left = {}
    kept = similar.written
    monkeypatch.setattr(similar, "written", lambda df, name: left.setdefault(name, kept(df, name)))
    monkeypatch.setattr(similar, "BLOCK", 20_000)
    for least in (0.3, 0.5, 0.8):
        left.clear()
        got = {(r.ka, r.kb): r.jaccard for r in similar.similar_pairs(spark.createDataFrame(list(enumerate(sets)), "k long, ts array<string>"), "k", "ts", least).collect()}
        want = {(i, j): jaccard(sets[i], sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets))}
        assert got == {p: x for p, x in want.items() if x >= least}
        for r in left["blocks"].collect():
            assert len(r["keys"]) == 8 or sum(len(v) for v in r if isinstance(v, bytes | bytearray)) <= 2 * 20_000


def test_cosines_of_all_pairs_by_blocks(spark, monkeypatch):
    from lumenforge.operators import relational

    monkeypatch.setattr(relational, "BLOCK", 5)
    rnd = random.Random(9)
    vector = lambda n: [rnd.uniform(-1, 1) for _ in range(n)]
    rows = [(i * 7 % 53, i % 2 if i < 45 else 2, vector(4)) for i in range(50)]
    rows += [(60, 0, None), (61, 0, [0.0] * 4), (62, 0, [1.0, None, 0.0, 0.0]), (63, 0, vector(3)), (64, 0, vector(3)), (65, 0, []), (66, None, vector(4)), (None, 0, vector(4)), (67, 3, vector(4))]
    d = spark.createDataFrame(rows, "k long, g int, v array<double>")

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return None
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 4)

    want = {(k, m): cosine(v, w) for k, g, v in rows for m, h, w in rows if None not in (k, m, g) and g == h and k < m}
    p = relational.cosine_pairs(d, "g", "k", "v")
    got = p.collect()
    assert len(got) == len(want) and {(r.a, r.b): r.cosine for r in got} == want
    assert " Join " not in p._jdf.queryExecution().optimizedPlan().toString()  # a row for each vector and block, not for each pair
    assert relational.cosine_pairs(d.limit(0), "g", "k", "v").count() == 0
