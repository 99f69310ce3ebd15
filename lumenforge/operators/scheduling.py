"""The work queue: cooldowns, staleness, pruning, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import fraction


def cooldown_replay(runs: DataFrame, keys: list[str], order: list[str], found: Column, failed: Column, base: float, failure: float, most: float) -> DataFrame:
    """The streak of runs without anything new after each run, and the seconds to wait.

    A find resets the streak; a failure leaves it and waits `failure`; else it grows, and the wait doubles from `base` up to `most`.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    d = runs.withColumns({"__f": found, "__x": failed & ~found})
    d = d.withColumn("__g", F.sum(F.col("__f").cast("int")).over(w))
    streak = F.sum((~F.col("__f") & ~F.col("__x")).cast("int")).over(W.partitionBy(*keys, "__g").orderBy(*order))
    d = d.withColumn("streak", streak.cast("long"))
    wait = F.when(F.col("__f"), None).when(F.col("__x"), F.lit(float(failure))).otherwise(F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("streak") - 1))))
    return d.withColumn("cooldown", wait).drop("__f", "__x", "__g")


def staleness_pick(df: DataFrame, key: str, recent: Column, now: Column, weight: Column, seed: str | None = None) -> DataFrame:
    """The key with the largest weight * (age + 1); ties: the smaller key. With a seed, up to one is added by its digest with the key,
    so that keys of nearly the same age don't always come in one order."""
    g = df.groupBy(key).agg(F.max(recent).alias("recent"), F.max(weight).alias("weight")).where("weight > 0")
    jitter = F.lit(0.0) if seed is None else fraction(seed, F.col(key))
    return g.withColumn("score", F.col("weight") * (F.greatest(F.lit(0.0), now - F.coalesce("recent", F.lit(0.0))) + 1) + jitter).orderBy(F.desc("score"), key).limit(1)


def prune(df: DataFrame, processed: Column, hits: Column, least: int, rate: float) -> DataFrame:
    """Rows that stay active: too few runs to tell, or a rate of hits that isn't below the floor."""
    return df.withColumn("active", (~((processed >= least) & (F.coalesce(F.try_divide(hits, processed), F.lit(0.0)) < rate))).cast("int"))


def batch_due(backlog: Column, oldest_age: Column, most: int = 150, hours: float = 4) -> Column:
    return (backlog >= most) | ((backlog > 0) & (oldest_age >= hours * 3600))
