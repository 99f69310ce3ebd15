"""Model experiments: batch-gradient logistic regression, isotonic calibration, forests with predictions out of fold, choice of thresholds.

Rows stay in Spark. What comes to the driver is bounded by the model: sums of gradients, counts of distinct scores, fitted trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: Of the probe, fixed values.
EPOCHS, RATE, L2 = 60, 0.5, 1e-4
#: Values (of all rows together) up to which the driver takes the steps itself, in place of a job for each.
SMALL = 2_000_000
#: Values of a block of rows that a task reads at once, in each epoch; a row is never cut.
BLOCK = 500_000
_BLOCK = "grp binary, sizes binary, idx binary, val binary, y binary"
#: Distinct scores that isotonic regression takes, at most; the label model has at most 3 to the number of families.
MOST_SCORES = 100_000


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            v = np.frombuffer(x)
            total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def summed(partial: DataFrame, size: int) -> np.ndarray:
    """The sum of a column of packed vectors: in tasks first, and in fewer tasks again, so the driver adds about the root of their number."""
    n = partial.rdd.getNumPartitions()
    if n > 16:
        partial = partial.coalesce(math.isqrt(n)).mapInArrow(_sums, "sums binary")
    total = np.zeros(size)
    for r in partial.collect():
        total += np.frombuffer(r["sums"])
    return total


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of rows (grp, idx, val, y): grp, how many values each has, idx, val and y."""
    at, val = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
    return b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy(zero_copy_only=False), at, val, b.column(3).to_numpy()


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows as blocks of packed arrays of `most` values, so that an epoch takes no row apart."""
    kinds = (np.int32, np.int32, np.int32, np.float64, np.float64)
    for b in batches:
        upto, i = np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(_arrays(b.slice(i, j - i)), kinds, strict=True)], ["grp", "sizes", "idx", "val", "y"])
            i = j


def _gradient(g: np.ndarray, sizes: np.ndarray, at: np.ndarray, val: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum over rows of each group's gradient."""
    groups, width = w.shape
    dim = width - 1
    row = np.repeat(np.arange(len(g)), sizes)
    place = g[row].astype(np.int64) * width + at
    logit = np.bincount(row, w.ravel()[place] * val, len(g)) + w[g, dim]
    off = 1 / (1 + np.exp(-logit)) - y
    total = np.bincount(place, off[row] * val, groups * width)
    return (total + np.bincount(g.astype(np.int64) * width + dim, off, groups * width)).reshape(groups, width)


def _step(weights: np.ndarray, gradient: np.ndarray, counts: np.ndarray, rate: float, l2: float) -> np.ndarray:
    out, some = weights.copy(), counts > 0
    out[some] -= rate * (gradient[some] / counts[some, None] + l2 * weights[some])
    return out


def train_logistic(rows: DataFrame, groups: int, dim: int, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> np.ndarray:
    """Weights (with the bias last) of one model for each group, by full-batch gradient steps from zero.

    rows: grp int (from 0), idx array<int>, val array<double>, y double; read twice, so they should be a written table. They are packed into
    blocks, which each epoch reads. All groups take a step in one job, or, with SMALL values or fewer, on the driver. A group without rows
    keeps zeros.
    """
    width = dim + 1
    sc = rows.sparkSession.sparkContext
    counts, values = np.zeros(groups), 0
    for r in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("idx") + 1).alias("m")).collect():  # a row for each group
        counts[r["grp"]], values = r["n"], values + r["m"]
    weights = np.zeros((groups, width))
    data = rows.select(F.col("grp").cast("int"), F.col("idx").cast("array<int>"), F.col("val").cast("array<double>"), F.col("y").cast("double"))
    held = [_arrays(b) for b in data.toArrow().combine_chunks().to_batches()] if values <= SMALL else None
    blocks = None if held is not None else written(data.mapInArrow(lambda batches, most=BLOCK: _packed(batches, most), _BLOCK), "steps")
    for _ in range(epochs):
        if held is not None:
            gradient = np.zeros((groups, width))
            for b in held:
                gradient += _gradient(*b, weights)
            weights = _step(weights, gradient, counts, rate, l2)
            continue
        shared = sc.broadcast(weights)

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, kinds = np.zeros((groups, width)), (np.int32, np.int32, np.int32, np.float64, np.float64)
            for b in batches:
                for r in range(b.num_rows):
                    total += _gradient(*(np.frombuffer(c[r].as_buffer(), t) for c, t in zip(b.columns, kinds, strict=True)), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        gradient = summed(blocks.mapInArrow(partial, "sums binary"), groups * width).reshape(groups, width)
        weights = _step(weights, gradient, counts, rate, l2)
        shared.destroy()
    return weights


def predict_logistic(rows: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns `keep` and p of rows as train_logistic takes them."""
    shared, dim = rows.sparkSession.sparkContext.broadcast(weights), weights.shape[1] - 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            g = b.column(0).to_numpy()
            at, val = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
            row = np.repeat(np.arange(len(g)), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            p = 1 / (1 + np.exp(-(np.bincount(row, w[g[row], at] * val, len(g)) + w[g, dim])))
            yield pa.RecordBatch.from_arrays([*b.columns[3:], pa.array(p)], [*keep, "p"])

    return rows.select(F.col("grp").cast("int").alias("__grp"), F.col("idx").cast("array<int>").alias("__idx"), F.col("val").cast("array<double>").alias("__val"), *keep).mapInArrow(run, f"{schema}, p double")


def logistic_sql(rows: str, groups: str, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> str:
    """The same as a chain of CTEs w0 .. w<epochs> (grp, pos, w). rows: a relation (grp, id, pos, val, y) with a row of val 1 for the bias
    of each id; groups: a relation (grp, pos) of all places."""
    step = """
, w{i} AS MATERIALIZED (SELECT o.grp, o.pos, o.w - {rate} * (coalesce(g.g, 0) / s.n + {l2} * o.w) AS w FROM w{before} o JOIN sizes s ON s.grp = o.grp LEFT JOIN (
  SELECT r.grp, r.pos, sum(r.val * p.off) AS g FROM {rows} r JOIN (SELECT r.grp, r.id, 1 / (1 + exp(-sum(r.val * w.w))) - any_value(r.y) AS off FROM {rows} r JOIN w{before} w ON w.grp = r.grp AND w.pos = r.pos GROUP BY r.grp, r.id) p
  ON p.grp = r.grp AND p.id = r.id GROUP BY r.grp, r.pos) g ON g.grp = o.grp AND g.pos = o.pos)"""
    return f"sizes AS MATERIALIZED (SELECT grp, count(DISTINCT id) AS n FROM {rows} GROUP BY grp), w0 AS MATERIALIZED (SELECT grp, pos, 0.0::DOUBLE AS w FROM {groups})" + "".join(step.format(i=i, before=i - 1, rows=rows, rate=rate, l2=l2) for i in range(1, epochs + 1))


def scales(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Of each group an array of (median, mean, sd), in the order of the features: exact medians by counts of distinct values, mean and
    deviation (1 where it's 0) with the medians put in for what is missing. A feature without any value has median 0."""
    long = rows.select(group, F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("at", "v"))
    w = W.partitionBy(group, "at").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    c = long.where("v IS NOT NULL").groupBy(group, "at", "v").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy(group, "at")))
    holds = lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r)
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    middle = c.groupBy(group, "at").agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("median"))
    sums = long.groupBy(group, "at").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("k"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    m = F.coalesce("median", F.lit(0.0))
    d = sums.join(middle, [group, "at"], "left").withColumn("median", m).fillna(0.0, ["s", "q"])
    gap = F.col("n") - F.col("k")
    d = d.withColumn("mean", (F.col("s") + gap * F.col("median")) / F.col("n"))
    var = (F.col("q") + gap * F.col("median") * F.col("median")) / F.col("n") - F.col("mean") * F.col("mean")
    d = d.withColumn("sd", F.when(var > 1e-12, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(1.0))
    return d.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "median", "mean", "sd"))), lambda x: F.struct(x["median"], x["mean"], x["sd"])).alias("scale"))


def scaled(features: list[str], scale: str = "scale") -> Column:
    """The array of standardised values, medians put in for what is missing."""
    values = [(F.coalesce(F.col(f).cast("double"), F.col(scale)[i]["median"]) - F.col(scale)[i]["mean"]) / F.col(scale)[i]["sd"] for i, f in enumerate(features)]
    return F.array(*values)


def isotonic(scored: DataFrame, p: str, y: str) -> list[tuple[float, float]]:
    """Steps (from this score on, rate) of the non-decreasing fit of y on p: pool adjacent violators over counts of distinct scores."""
    rows = scored.groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y)).alias("k")).orderBy(p).limit(MOST_SCORES + 1).collect()
    if len(rows) > MOST_SCORES:
        raise ValueError(f"more than {MOST_SCORES} distinct scores: round them first")
    blocks: list[list] = []  # first score, positives, count
    for r in rows:
        blocks.append([r[p], r["k"], r["n"]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, k, n = blocks.pop()
            blocks[-1][1] += k
            blocks[-1][2] += n
    return [(x, k / n) for x, k, n in blocks]


def calibrated(p: Column, steps: list[tuple[float, float]]) -> Column:
    """The rate of the last step that p reaches; below the first, that of the first; without steps, p."""
    out = p if not steps else F.lit(steps[0][1])
    for x, rate in steps[1:]:
        out = F.when(p >= x, rate).otherwise(out)
    return F.when(p.isNotNull(), out)


def precise_threshold(scored: DataFrame, p: str, y: str, floor: float = 0.8, least: int = 3) -> DataFrame:
    """threshold, tp, selected, precision and recall of the score with the highest recall among those whose precision reaches the floor
    with `least` rows selected; then of the highest precision, then score. No row if none does."""
    from .ranks import running

    g = scored.where(F.col(p).isNotNull()).groupBy((-F.col(p)).alias("q")).agg(F.count_if(F.col(y)).alias("k"), F.count(F.lit(1)).alias("n"))
    c = running(g, "q", ["k", "n"]).select((-F.col("q")).alias("threshold"), F.col("k_upto").alias("tp"), F.col("n_upto").alias("selected"))
    positives = F.broadcast(scored.agg(F.count_if(F.col(y)).alias("positives")))  # one row
    ok = c.withColumn("precision", F.col("tp") / F.col("selected")).where((F.col("selected") >= least) & (F.col("precision") >= floor)).join(positives, F.lit(True))
    best = ok.agg(F.max_by(F.struct("threshold", "tp", "selected", "precision", "positives"), F.struct("tp", "precision", "threshold")).alias("b")).where("b IS NOT NULL").select("b.*")
    return best.select("threshold", "tp", "selected", F.round("precision", 6).alias("precision"), F.round(F.try_divide("tp", "positives"), 6).alias("recall"))


def estimators(features: list[str], seed: int = 0, trees: int = 500) -> dict:
    """Pipelines over columns `features` (null: missing) and `label`: medians for what is missing, and the model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"{c}__" for c in features]
    fill = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw")]
    return {
        "logistic": Pipeline(stages=[*fill, StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", weightCol="weight", maxIter=200, regParam=1e-3)]),
        "random_forest": Pipeline(stages=[*fill, RandomForestClassifier(featuresCol="raw", weightCol="weight", numTrees=trees, minInstancesPerNode=4, maxDepth=8, seed=seed)]),
    }


def balanced(df: DataFrame) -> DataFrame:
    """Adds weight: both labels weigh the same in sum."""
    share = F.broadcast(df.agg(F.avg("label").alias("__share")))  # one row
    return df.join(share, F.lit(True)).withColumn("weight", F.when(F.col("label") == 1, 0.5 / F.col("__share")).otherwise(0.5 / (1 - F.col("__share")))).drop("__share")


def out_of_fold(df: DataFrame, pipeline, fold: str, folds: int, keep: list[str]) -> DataFrame:
    """The columns `keep`, the fold and p: each row's probability by a model that was fitted on the other folds alone."""
    from pyspark.ml.functions import vector_to_array

    parts = []
    for i in range(folds):
        rest, own = df.where(F.col(fold) != i), df.where(F.col(fold) == i)
        seen = {r["label"] for r in rest.select("label").distinct().limit(3).collect()}
        if len(seen) < 2:  # nothing to tell apart
            parts.append(own.select(*keep, fold, F.lit(float(*seen) if seen else None).cast("double").alias("p")))
        else:
            parts.append(pipeline.fit(balanced(rest)).transform(own).select(*keep, fold, vector_to_array("probability")[1].alias("p")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def best_rule(df: DataFrame, value: str, gold: Column, side: Column, most: int = 101) -> DataFrame:
    """The rule `value >= cut` (ge) or `value <= cut` (le) with the best balanced accuracy on the train side, and how it does on the test
    side: direction, cut, train, test (balanced accuracies) and tp, fp, fn, tn of the test side. Cuts are the distinct values, or `most`
    quantiles of them, linear between neighbours, if there are as many; of equal rules ge and the lesser cut win. No row with fewer
    than ten rows to train on or five to test. Rows without a value take no part.

    Rows are counted by how many cuts they reach, so what meets all cuts is a few rows.
    """
    from . import ranks

    d = written(df.select(F.col(value).cast("double").alias("v"), gold.alias("y"), side.alias("s")).where("v IS NOT NULL AND y IS NOT NULL"), "values")
    each = d.where("s = 'train'").select("v").distinct()
    if each.limit(most).count() < most:
        cuts = each.agg(F.array_sort(F.collect_list("v")).alias("q"))  # fewer than `most` values
    else:
        cuts = ranks.quantiles(each, "v", [i / (most - 1) for i in range(most)]).select(F.array_sort(F.array_distinct("q")).alias("q"))
    placed = d.join(F.broadcast(cuts), F.lit(True)).select("s", "y", F.size(F.filter("q", lambda c: c <= F.col("v"))).alias("upto"), F.size(F.filter("q", lambda c: c < F.col("v"))).alias("below"))
    n = placed.groupBy("s", "y", "upto", "below").agg(F.count(F.lit(1)).alias("n"))
    x = n.join(F.broadcast(cuts), F.lit(True)).select("s", "y", "upto", "below", "n", F.posexplode("q").alias("i", "cut")).withColumn("direction", F.explode(F.array(F.lit("ge"), F.lit("le"))))
    hit = F.when(F.col("direction") == "ge", F.col("i") < F.col("upto")).otherwise(F.col("i") >= F.col("below"))
    part = lambda s, c: F.coalesce(F.sum(F.when((F.col("s") == s) & c, F.col("n"))), F.lit(0))
    y = F.col("y")
    kinds = {"tp": y & hit, "fp": ~y & hit, "fn": y & ~hit, "tn": ~y & ~hit}
    g = x.groupBy("direction", "cut").agg(*[part(s, c).alias(f"{s}_{k}") for s in ("train", "test") for k, c in kinds.items()])
    c = F.col
    rate = lambda s: F.round((c(f"{s}_tp") / F.greatest(c(f"{s}_tp") + c(f"{s}_fn"), F.lit(1)) + c(f"{s}_tn") / F.greatest(c(f"{s}_tn") + c(f"{s}_fp"), F.lit(1))) / 2, 9)
    rows = lambda s: sum((c(f"{s}_{k}") for k in ("fp", "fn", "tn")), c(f"{s}_tp"))
    g = g.where((rows("train") >= 10) & (rows("test") >= 5)).select("direction", "cut", rate("train").alias("train"), rate("test").alias("test"), *[c(f"test_{k}").alias(k) for k in kinds])
    return g.orderBy(F.desc("train"), "direction", "cut").limit(1)


def rule_errors(df: DataFrame, value: str, gold: Column, side: Column, rule: DataFrame) -> DataFrame:
    """The rows of the test side that a rule, one row of best_rule, gets wrong, with what it says (predicted)."""
    d = df.withColumns({"__y": gold, "__s": side}).where(F.col("__s") == "test").where(F.col(value).isNotNull() & F.col("__y").isNotNull())
    r = rule.select(F.col("direction").alias("__d"), F.col("cut").alias("__c"))  # one row
    d = d.join(F.broadcast(r), F.lit(True)).withColumn("predicted", F.when(F.col("__d") == "ge", F.col(value) >= F.col("__c")).otherwise(F.col(value) <= F.col("__c")))
    return d.where(F.col("predicted") != F.col("__y")).drop("__y", "__s", "__d", "__c")
