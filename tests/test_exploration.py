"""Pairs of clips, histograms, held-out rules, concepts, workers, and samples in rounds against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.functions import cues, hashing, vectors
from lumenforge.operators import experiments, sampling, scheduling
from lumenforge.plans import catalog

from .conftest import SF


def test_frame_metrics_equal_numpy(spark):
    rng = random.Random(5)
    frames = lambda n: [rng.randrange(-(2**63), 2**63) for _ in range(n)]
    rows = [(i, frames(rng.randint(1, 5)), frames(rng.randint(1, 5))) for i in range(30)] + [(30, [-1, 0], [0, -1]), (31, [], [1]), (32, None, [1])]
    df = spark.createDataFrame(rows, "i long, a array<long>, b array<long>")
    out = {r.i: r for r in df.select("i", *[c.alias(k) for k, c in vectors.frame_metrics(F.col("a"), F.col("b")).items()]).collect()}
    for i, a, b in rows[:31]:
        d = np.array([[bin((x ^ y) & (2**64 - 1)).count("1") for y in b] for x in a], float)
        diagonal = np.diag(d) if len(a) == len(b) else [64.0]
        left, right = d.min(1).mean(), d.min(0).mean()
        want = [np.mean(diagonal), np.median(diagonal), left, right, max(left, right)]
        assert np.allclose([out[i][k] for k in ("aligned_mean", "aligned_median", "left_best", "right_best", "best")], want, atol=1e-6)
    assert out[31].best is None and out[32].aligned_mean is None
    bits = spark.createDataFrame([("1" * 64,), ("0" * 64,), ("1" + "0" * 63,), ("101",)], "t string").select(vectors.bits(F.col("t")).alias("b")).collect()
    assert [r.b for r in bits] == [-1, 0, -(2**63), 5]


def test_histograms_and_their_distance(spark):
    df = spark.createDataFrame([([-9.0, -0.4, -0.31, 0.0, 0.39, 0.4, 7.0],)], "v array<double>")
    assert df.select(vectors.histogram(F.col("v"), -0.4, 0.4, 8).alias("h")).first().h == [3, 0, 0, 0, 1, 0, 0, 3]
    rows = [([1, 3], [2, 6]), ([1, 0], [0, 1]), ([4, 1], [1, 4]), ([0, 0], [1, 1])]
    out = [r.d for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select(vectors.bhattacharyya(F.col("a"), F.col("b")).alias("d")).collect()]
    assert out[0] == pytest.approx(0, abs=1e-7) and out[1] == 1 and out[2] == pytest.approx(math.sqrt(1 - 4 / 5)) and out[3] is None


def plain_rule(rows):
    train, test = ([r for r in rows if r[2] == s] for s in ("train", "test"))
    cuts = sorted({v for v, _, _ in train})
    if len(cuts) > 100:
        cuts = sorted(set(np.quantile(cuts, np.linspace(0, 1, 101))))

    def score(part, hit):
        rate = lambda want: sum(hit(v) == y for v, y, _ in part if y == want) / max(1, sum(y == want for _, y, _ in part))
        return (rate(True) + rate(False)) / 2

    best = None
    for d in ("ge", "le"):
        for c in cuts:
            hit = (lambda v, c=c: v >= c) if d == "ge" else (lambda v, c=c: v <= c)
            s = round(score(train, hit), 9)
            if best is None or s > best[0]:
                best = s, d, c, round(score(test, hit), 9), sum(hit(v) != y for v, y, _ in test)
    return best


@pytest.mark.parametrize("kinds", [7, 100, 5000])
def test_best_rule_equals_the_plain_loop(spark, kinds):
    rng = random.Random(kinds)
    rows = [(float(rng.randrange(kinds)), None, rng.choice(["train", "train", "calibration", "test"])) for _ in range(900)]
    rows = [(v, rng.random() < (0.75 if v < kinds / 3 else 0.3), s) for v, _, s in rows]
    df = spark.createDataFrame([*rows, (None, True, "train"), (3.0, None, "test")], "v double, y boolean, s string")
    r = experiments.best_rule(df, "v", F.col("y"), F.col("s")).first()
    train, direction, cut, test, wrong = plain_rule(rows)
    assert (r.direction, r.train, r.test, r.fp + r.fn) == (direction, train, test, wrong) and r.cut == pytest.approx(cut)
    errors = experiments.rule_errors(df, "v", F.col("y"), F.col("s"), experiments.best_rule(df, "v", F.col("y"), F.col("s")))
    assert errors.count() == wrong and errors.columns == ["v", "y", "s", "predicted"]


def test_a_rule_needs_rows_on_both_sides(spark):
    few = [(float(i), i > 4, "train") for i in range(10)]
    for rows in (few + few[:0], few + [(1.0, True, "test")] * 4, []):
        assert experiments.best_rule(spark.createDataFrame(rows, "v double, y boolean, s string"), "v", F.col("y"), F.col("s")).count() == 0


def plain_rounds(rows, seed, count):
    key = lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0])
    groups = {}
    for r in sorted((r for r in rows if r[1] is not None), key=key):
        groups.setdefault(r[2], []).append(r)
    used, out, names = set(), [], sorted(groups)
    while names and len(out) < count:
        for n in list(names):
            while groups[n] and groups[n][0][1] in used:
                groups[n].pop(0)
            if groups[n] and len(out) < count:
                out.append(groups[n].pop(0))
                used.add(out[-1][1])
            if not groups[n]:
                names.remove(n)
    return out


def test_rounds_over_strata_equal_the_plain_loop(spark):
    rng = random.Random(2)
    # one stratum and one source hold a third of the rows each
    rows = [(i, "hot" if rng.random() < 0.33 else None if rng.random() < 0.05 else f"s{rng.randrange(60)}", "a" if rng.random() < 0.33 else rng.choice(["b", "c+d", "e"])) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, source string, cues string").withColumn("cues", F.coalesce("cues", F.lit("none")))  # not nullable, as in the query
    for count in (1, 7, 40, 58):
        got = [(r.id, r.source, r.cues) for r in sampling.strata_rounds(df, "id", "source", "cues", "x", count).orderBy("place").collect()]
        assert got == plain_rounds(rows, "x", count) and len(got) == count


def test_too_few_rows_for_the_rounds_are_an_error(spark):
    df = spark.createDataFrame([(1, "s", "a"), (2, "s", "b"), (3, None, "a")], "id long, source string, cues string")
    for d, count in ((df, 2), (df.where("false"), 1)):
        with pytest.raises(Exception, match="wanted"):
            sampling.strata_rounds(d, "id", "source", "cues", "x", count).collect()
    assert [r.id for r in sampling.strata_rounds(df.where("id = 2"), "id", "source", "cues", "x", 1).collect()] == [2]


def test_concepts(spark):
    rows = [("Jump the LINE, rude customer", ["queue_line_cutting", "customer_worker_treatment"]), ("speakerphone", ["public_noise", "phone_etiquette"]), ("sharing", ["sharing_turn_taking"]), ("cats", []), ("", []), (None, [])]
    out = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(rows)], "i long, q string").select("i", cues.concepts(F.col("q")).alias("c")).collect()
    assert {r.i: r.c for r in out} == {i: c for i, (_, c) in enumerate(rows)}


def test_workers_and_jitter(spark):
    keys = [f"u{i}" for i in range(500)]
    out = {r.k: r.w for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.worker(F.col("k"), {"x": 1, "y": 10, "z": 9}).alias("w")).collect()}
    for k in keys:
        b = int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") % 20
        assert out[k] == ("x" if b < 1 else "y" if b < 11 else "z")
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 5.0)], "k string, at double")
    draw = lambda s, k: int(hashlib.sha256(f"{s}:{k}".encode()).hexdigest()[:12], 16) / 16**12
    for seed in "pqrst":
        assert scheduling.staleness_pick(df, "k", F.col("at"), F.lit(9.0), F.lit(1.0), seed).first().k == max("abc", key=lambda k: draw(seed, k))
    assert scheduling.staleness_pick(df, "k", F.col("at"), F.lit(9.0), F.lit(1.0)).first().k == "a"


def test_rounds_over_the_documents(spark):
    rows = catalog.queries()["source_disjoint_rounds"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars").collect()
    stratum = lambda r: "+".join(sorted(n for n, c in (("even", r.n_chars % 2 == 0), ("en", r.lang == "en"), ("long", r.n_chars > 2000)) if c)) or "<no-cue>"
    want = plain_rounds([(r.doc_id, r.source, stratum(r)) for r in docs], "rounds", 15)
    assert [(r.doc_id, r.source, r.stratum) for r in sorted(rows, key=lambda r: r.place)] == want
