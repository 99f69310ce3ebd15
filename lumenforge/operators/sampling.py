"""Deterministic samples: seeded digests take the place of random numbers, so a sample is the same on any cluster."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import order
from . import ranks


def round_robin(df: DataFrame, key: str, stratum: Column, seed: str, n: int, by_name: bool = False) -> DataFrame:
    """n rows, one from each stratum in turn; strata come in seeded order, or by name. Only the first n of a stratum can be taken, so no
    more are ever ranked together."""
    d = df.withColumns({"stratum": stratum, "__h": order(seed, F.col(key))})
    turn = d.withColumn("turn", F.row_number().over(W.partitionBy("stratum").orderBy("__h", key)).cast("long")).where(F.col("turn") <= n)
    return turn.orderBy("turn", *([] if by_name else [order(seed, F.col("stratum"))]), "stratum").limit(n).drop("__h")


def representative(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    return df.groupBy(group).agg(F.min_by(key, F.struct(order(seed, F.col(key)), F.col(key))).alias(key))


def capped_cohort(df: DataFrame, key: str, stratum: str, unique: str, seed: str, per_stratum: int, cap: int) -> DataFrame:
    """per_stratum rows of each stratum in seeded order, `cap` rows of a `unique` value at most. Strata are filled one
    by one, so the last step is sequential; it sees a bounded number of rows: those that can be taken at all. Of a stratum
    and value these are the first `cap`. In a stratum no more of them are passed over than rows were taken before it, so
    the first per_stratum for each stratum are enough."""
    strata = df.select(stratum).distinct().count()
    d = df.select(key, stratum, unique).withColumn("h", order(seed, F.col(key)))
    d = d.withColumn("__u", F.row_number().over(W.partitionBy(stratum, unique).orderBy("h", key))).where(F.col("__u") <= cap)
    d = d.withColumn("__s", F.row_number().over(W.partitionBy(stratum).orderBy("h", key))).where(F.col("__s") <= per_stratum * strata)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        out = []
        for _, part in rows.sort_values([stratum, "h", key]).groupby(stratum, sort=True):
            n = 0
            for r in part.itertuples(index=False):
                u = getattr(r, unique)
                if n < per_stratum and used.get(u, 0) < cap:
                    used[u] = used.get(u, 0) + 1
                    n += 1
                    out.append((getattr(r, key), getattr(r, stratum), u))
        return pd.DataFrame(out, columns=[key, stratum, unique])

    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return d.withColumn("__g", F.lit(1)).groupBy("__g").applyInPandas(fill, f"{key} {kind[key]}, {stratum} {kind[stratum]}, {unique} {kind[unique]}")


def bands(df: DataFrame, c: str, cuts: list[float]) -> DataFrame:
    """Adds the number of the band between exact quantiles (linear interpolation)."""
    q = ranks.quantiles(df, c, cuts)  # one row
    return df.join(F.broadcast(q), F.lit(True)).withColumn("band", F.size(F.filter("q", lambda x: x < F.col(c))).cast("long")).drop("q")


def vocabulary_rotation(terms: list[list[str]], n: int) -> list[str]:
    """n combinations of one term of each list, turning all lists at once."""
    return [" ".join(t[i % len(t)] for t in terms) for i in range(n)]


class Shortfall(ValueError):
    """Fewer rows can be taken than are wanted."""


def strata_rounds(df: DataFrame, key: str, unique: str, stratum: str, seed: str, count: int) -> DataFrame:
    """`count` rows with place, key, unique and stratum: strata, by name, take turns, each giving its next row in seeded order whose `unique`
    value wasn't taken yet. Rows without a unique value take no part. Raises Shortfall if there are too few.

    The turns are sequential, over rows that can be taken at all: of a stratum and value the first, and of a stratum the first
    `count` of these, since no more values than that are ever taken. So a task sees `count` rows of each stratum; strata are few by
    definition (combinations of cues).
    """
    d = df.where(F.col(unique).isNotNull()).select(key, unique, stratum).withColumn("h", order(seed, F.col(key)))
    one = d.groupBy(stratum, unique).agg(F.min_by(F.struct(key, "h"), F.struct("h", key)).alias("x")).select(F.col(f"x.{key}").alias(key), unique, stratum, "x.h")
    # the first `count` of each stratum: within salts, then among these
    salted = one.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(64)))
    near = salted.withColumn("__k", F.row_number().over(W.partitionBy(stratum, "__salt").orderBy("h", key))).where(F.col("__k") <= count)
    few = near.withColumn("__k", F.row_number().over(W.partitionBy(stratum).orderBy("h", key))).where(F.col("__k") <= count).drop("__salt", "__k")

    def turns(rows: pd.DataFrame) -> pd.DataFrame:
        queues = [list(part.itertuples(index=False)) for _, part in rows.sort_values([stratum, "h", key]).groupby(stratum, sort=True, dropna=False)]
        queues, used, out = [q[::-1] for q in queues], set(), []
        while queues and len(out) < count:
            for q in queues:
                while q and getattr(q[-1], unique) in used:
                    q.pop()
                if q and len(out) < count:
                    r = q.pop()
                    used.add(getattr(r, unique))
                    out.append((len(out), getattr(r, key), getattr(r, unique), getattr(r, stratum)))
            queues = [q for q in queues if q]
        if len(out) < count:
            raise Shortfall(f"wanted {count} rows, found {len(out)}")
        return pd.DataFrame(out, columns=["place", key, unique, stratum])

    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    # a row of nulls, so that the check runs for an empty table as well
    none = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema.fields])
    return few.unionByName(none).withColumn("__g", F.lit(1)).groupBy("__g").applyInPandas(lambda rows: turns(rows[rows["h"].notna()]), f"place long, {key} {kind[key]}, {unique} {kind[unique]}, {stratum} {kind[stratum]}")
