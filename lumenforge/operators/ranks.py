"""Running totals, ranks and quantiles over a whole table without a task that holds all of it.

Values are dealt to about PIECES ranges by approximate quantiles; totals of the ranges, which are few, give each its offset. The
approximation only decides how even the ranges are: the results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIECES = 256
#: Rows that one window sums as well as ranges would, and sooner.
FEW = 10_000


def running(df: DataFrame, at: str, sums: list[str], pieces: int = PIECES) -> DataFrame:
    """Adds `<c>_upto`, for each c of sums, the sum over all rows whose `at` is not greater. `at` must be distinct and not null."""
    from .shared import written

    df = written(df, "running")
    if df.limit(FEW + 1).count() <= FEW:
        whole = W.orderBy(at).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({f"{c}_upto": F.sum(c).over(whole) for c in sums})
    cuts = df.agg(F.percentile_approx(at, [i / pieces for i in range(1, pieces)], 10 * pieces).alias("__cuts"))  # one row
    d = df.join(F.broadcast(cuts), F.lit(True)).withColumn("__piece", F.size(F.filter(F.coalesce("__cuts", F.array()), lambda c: c < F.col(at)))).drop("__cuts")
    before = W.orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    total = d.groupBy("__piece").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    offset = total.select("__piece", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__from_{c}") for c in sums])  # a row for each piece
    w = W.partitionBy("__piece").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    own = d.withColumns({f"{c}_upto": F.sum(c).over(w) for c in sums})
    return own.join(F.broadcast(offset), "__piece").withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"__from_{c}") for c in sums}).drop("__piece", *[f"__from_{c}" for c in sums])


def counted(df: DataFrame, at: str) -> DataFrame:
    """Each distinct value as v, with n, n_upto and the total: one combined count before anything is sorted."""
    g = df.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))  # one row
    return running(g, "v", ["n"]).join(F.broadcast(total), F.lit(True))


def percentile_of(df: DataFrame, at: str, out: str) -> DataFrame:
    """Adds the share of values that are not greater."""
    share = counted(df, at).select(F.col("v").alias(at), (F.col("n_upto") / F.col("total")).alias(out))
    return df.join(share, at, "left")


def quantiles(df: DataFrame, at: str, shares: list[float]) -> DataFrame:
    """One row with the array `q` of exact quantiles, linear between neighbours. Only the rows at the wanted ranks leave the ranges."""
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)]))
    x = counted(df, at).withColumn("p", wanted).withColumn("r", F.col("p.s") * (F.col("total") - 1))
    holds = lambda r: (F.col("n_upto") > r) & (F.col("n_upto") - F.col("n") <= r)
    low, high = F.floor("r"), F.ceil("r")
    x = x.where(holds(low) | holds(high))
    two = x.groupBy("p.i", "r").agg(F.max(F.when(holds(low), F.col("v"))).alias("lo"), F.max(F.when(holds(high), F.col("v"))).alias("hi"))
    each = two.select("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("r") - F.floor("r"))).alias("v"))
    return each.agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select(F.col("s.v").alias("q"))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Adds `out`: places 0, 1, 2 .. of the rows of each group in the given order (ascending, nulls first), also where one group holds most
    rows. Rows are dealt in ranges of group and order and written once; a range numbers its own, and counts of ranges, which are
    few, give each its offset. Rows that are equal in all of these are numbered in any order."""
    from .shared import written

    keys = [*group, *order]
    dealt = df.repartitionByRange(*keys) if keys else df
    held = written(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    n = held.groupBy("__range", *group).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range that the group reaches
    offset = n.select(F.col("__range").alias("__r"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    own = held.withColumn("__nth", F.row_number().over(W.partitionBy("__range", *group).orderBy(*order)) - 1)
    same = F.col("__range") == F.col("__r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return own.join(offset, same).select(*df.columns, (F.col("__nth") + F.col("__from")).cast("long").alias(out))


def spread_out(n: Column, ordinal: Column) -> Column:
    """Sorting ordinals 0 .. n - 1 by this takes the first, the last and the middle one, and then always the one that is farthest from all
    that are taken, the least of equal ones.

    Which one is taken halves a gap, so its distance is found by going down the halves that it lies in (64 steps at most), and a larger
    distance always comes first.
    """
    middle = F.floor(n / 2)
    start = F.struct(F.when(ordinal < middle, 0).otherwise(middle).cast("long").alias("a"), F.when(ordinal < middle, middle).otherwise(n - 1).cast("long").alias("b"), F.lit(-1).cast("long").alias("d"))

    def halve(s: Column, _: Column) -> Column:
        half = F.floor((s["b"] - s["a"]) / 2)
        at = s["a"] + half
        done = (s["d"] >= 0) | (half < 1)
        left = ordinal < at
        a = F.when(done | (ordinal == at) | left, s["a"]).otherwise(at)
        b = F.when(done | (ordinal == at) | ~left, s["b"]).otherwise(at)
        return F.struct(a.alias("a"), b.alias("b"), F.when(~done & (ordinal == at), half).otherwise(s["d"]).alias("d"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, halve)["d"]
    fixed = F.when(n <= 2, ordinal).when(ordinal == 0, 0).when(ordinal == n - 1, 1).when(ordinal == middle, 2)
    return F.when(fixed.isNotNull(), F.struct(F.lit(-(2**62)).cast("long").alias("d"), fixed.cast("long").alias("i"))).otherwise(F.struct((-found).alias("d"), (ordinal + 3).cast("long").alias("i")))
