"""Structured Streaming: ingest with dedup, sessions, stateful cooldowns, windows, routes, and alerts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import folder
from .crawl import Batches

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 1000) -> DataFrame:
    """The event table as a file stream; maxFilesPerTrigger holds the intake back."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", per_trigger).parquet(sf_dir).withColumn("at", F.to_timestamp(F.col("ts").cast("string")))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Events once each within the watermark, counted by user and session. An event just `gap` after the one before starts a session: Spark
    merges windows that touch, so they are a microsecond shorter until they are counted."""
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    g = once.groupBy("user_id", F.session_window("at", f"{gap} -1 microseconds")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), (F.col("session_window.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end"), "n")


COOLDOWN = "user_id long, streak long, cooldown double"


def cooldown_batch(table: Batches, rows: DataFrame, number: int) -> None:
    """For foreachBatch: a find resets a user's streak, an error leaves it, anything else lengthens it. A batch is summed by user before
    it meets the streaks so far, so no task holds the rows of a user, however many."""
    d = rows.select("user_id", "event_type", F.struct("at", "event_id").alias("k"))
    last = d.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("k").alias("last"))
    own = F.col("user_id").eqNullSafe(F.col("u"))
    counted = ~F.col("event_type").isin("purchase", "error") & (F.col("last").isNull() | (F.col("k") > F.col("last")))
    now = d.join(last.withColumnRenamed("user_id", "u"), own, "left").groupBy("user_id").agg(F.count_if(counted).alias("more"), F.max(F.col("last").isNotNull()).alias("found"))
    both = now.select("user_id", "more", "found", F.lit(0).cast("long").alias("streak")).unionByName(table.last(number).select("user_id", F.lit(0).cast("long").alias("more"), F.lit(False).alias("found"), "streak"))
    streak = F.when(F.max("found"), F.lit(0)).otherwise(F.sum("streak")) + F.sum("more")
    sums = both.groupBy("user_id").agg(streak.cast("long").alias("streak"))
    table.put(number, sums.withColumn("cooldown", F.when(F.col("streak") == 0, 0.0).otherwise(F.least(F.lit(7200.0), 600.0 * F.pow(F.lit(2.0), F.least(F.col("streak") - 1, F.lit(20)))))))
    table.forget()


def cooldowns(events: DataFrame, base: str | None = None) -> DataFrame:
    """Runs the stream of events over all that is there and returns user_id, streak and cooldown; a later run with the same base goes on."""
    spark = events.sparkSession
    base = base or f"{folder(spark)}/stream-cooldowns-{uuid.uuid4().hex}"
    table = Batches(spark, f"{base}/streaks", COOLDOWN)
    query = events.writeStream.foreachBatch(lambda rows, number: cooldown_batch(table, rows, number)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.last()


def tumbling(events: DataFrame, size: str = "6 hours", step: str | None = None, late: str = "1 day") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", size, step), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).select("window.start", "window.end", "event_type", "n", "peak")


def route(batch: DataFrame, routes: dict[str, Column], sink: Callable[[str, DataFrame], None]) -> None:
    """Of a micro-batch, writes each row to the first route whose condition holds, for foreachBatch."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(list(routes.items())):
        out = F.when(cond, name).otherwise(out)
    kept = batch.withColumn("route", F.coalesce(out, F.lit("drop"))).persist()
    try:
        for name in routes:
            sink(name, kept.where(F.col("route") == name))
    finally:
        kept.unpersist()


def alerts(batch: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows of a snapshot that meet a rule, with the names of all rules they meet, for foreachBatch."""
    met = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return batch.withColumn("alerts", met).where(F.size("alerts") > 0)


def run_to_table(df: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote; state and output lie in the shared folder. With keys, as
    "update" needs, the last batch's row of each key."""
    spark = df.sparkSession
    base = f"{folder(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # a replayed batch overwrites its own folder, so each counts once
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")
    if not keys:
        return out.select(*df.columns)
    rest = [c for c in df.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])
