"""Statistics of evaluation as Column expressions and small aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of Wilson's interval; null where total is 0."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    denom = 1 + z * z / n
    centre = p + z * z / (2 * n)
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    low, high = F.greatest(F.lit(0.0), (centre - margin) / denom), F.least(F.lit(1.0), (centre + margin) / denom)
    return F.when(total > 0, low), F.when(total > 0, high)


def confusion(predicted: Column, actual: Column) -> dict[str, Column]:
    """tp, fp, fn and tn of two booleans, as aggregates."""
    return {"tp": F.count_if(predicted & actual), "fp": F.count_if(predicted & ~actual), "fn": F.count_if(~predicted & actual), "tn": F.count_if(~predicted & ~actual)}


def rates(df: DataFrame, empty: float | None = None) -> DataFrame:
    """Adds precision, recall, specificity, balanced_accuracy and f1 to tp, fp, fn, tn. empty: the value over an empty
    denominator, null or 0 (both conventions are in use)."""
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty).cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    d = df.withColumns({"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "specificity": div(tn, tn + fp)})
    return d.withColumns({"balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2, "f1": div(2 * tp, 2 * tp + fp + fn)})


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Reliability bins of probabilities (the last is closed): count, mean, positive rate, Wilson's lower bound, and the bin's part of the ECE."""
    b = df.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long"))
    g = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.sum(F.col(y).cast("long")).alias("positives"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # over bins, of which there are few
    rate = F.col("positives") / F.col("n")
    return g.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), "positives", F.round(rate, 6).alias("rate"), F.round(wilson(F.col("positives"), F.col("n"))[0], 6).alias("wilson_lower"), F.round(F.col("n") / total * F.abs(F.col("mean_p") - rate), 6).alias("ece_part"))


def auroc(df: DataFrame, score: str, y: str, by: list[str] | None = None, least: int = 0) -> DataFrame:
    """Area under the ROC curve by ranks, ties one half; null with a single class; groups of under `least` rows are left out.

    Rows are first counted by score, so what is sorted are distinct scores, not rows; over a whole table, in ranges of them.
    """
    from ..operators.ranks import running

    by = by or []
    s = df.groupBy(*by, score).agg(F.count_if(F.col(y)).alias("__pos"), F.count_if(~F.col(y)).alias("__neg"))
    if by:
        w = W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, 0)
        s = s.withColumn("__neg_upto", F.sum("__neg").over(w))
    else:
        s = running(s.where(F.col(score).isNotNull()), score, ["__neg"])
    u = s.withColumn("__u", F.col("__pos") * (F.col("__neg_upto") - F.col("__neg") + F.col("__neg") / 2))
    g = (u.groupBy(*by) if by else u.groupBy()).agg(F.sum("__pos").alias("positives"), F.sum("__neg").alias("negatives"), F.sum("__u").alias("__u"))
    return g.where(F.col("positives") + F.col("negatives") >= least).select(*by, "positives", "negatives", F.round(F.try_divide(F.col("__u"), F.col("positives") * F.col("negatives")), 6).alias("auroc"))


def best_threshold(df: DataFrame, score: str, y: str, floor: float) -> DataFrame:
    """The threshold of highest recall whose precision reaches the floor; ties: the higher threshold."""
    from ..operators.ranks import running

    s = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(y)).alias("pos"), F.count(F.lit(1)).alias("n"))
    all_ = s.groupBy().agg(F.sum("pos").alias("positives"), F.sum("n").alias("total"))
    c = running(s, score, ["pos", "n"]).join(F.broadcast(all_), F.lit(True))
    c = c.select(F.col(score).alias("threshold"), (F.col("positives") - F.col("pos_upto") + F.col("pos")).alias("tp"), (F.col("total") - F.col("n_upto") + F.col("n")).alias("selected"), "positives")
    ok = c.withColumn("precision", F.col("tp") / F.col("selected")).withColumn("recall", F.col("tp") / F.col("positives")).where(F.col("precision") >= floor)
    best = ok.groupBy().agg(F.max_by(F.struct("threshold", "tp", "selected", "precision", "recall"), F.struct("recall", "threshold")).alias("b")).where("b IS NOT NULL").select("b.*")
    return best.select("threshold", "tp", "selected", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
