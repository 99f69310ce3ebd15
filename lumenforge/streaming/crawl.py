"""The crawl loop as a stream of candidates: each micro-batch is deduplicated against all that was seen, routed, counted by
query, and held back while too many items are pending. Every table is written by batch number, so a replayed batch changes nothing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Batches:
    """A table of rows by batch number under a folder. A batch overwrites its own rows only."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path
        self.schema = T._parse_datatype_string(schema)

    def put(self, number: int, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def numbers(self) -> list[int]:
        sc = self.spark.sparkContext
        root = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
        found = fs.listStatus(root) if fs.exists(root) else []
        names = [x.getPath().getName() for x in found]
        done = [n for n in names if fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in done if n.startswith("batch="))

    def before(self, number: int | None = None) -> DataFrame:
        """All rows of the batches before this one (all: None), with their batch."""
        use = [n for n in self.numbers() if number is None or n < number]
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        if not use:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/batch={n}" for n in use])

    def last(self, number: int | None = None) -> DataFrame:
        """The rows of the last batch before this one: a table that each batch writes whole."""
        use = [n for n in self.numbers() if number is None or n < number]
        if not use:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={use[-1]}")

    def forget(self, keep: int = 2) -> None:
        """Deletes all but the last batches of a table that each batch writes whole."""
        sc = self.spark.sparkContext
        for n in self.numbers()[:-keep]:
            where = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={n}")
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


SEEN = "uid string, platform string, query string, status string, rank long"
STATS = "platform string, query string, returned long, new long, enqueued long, skipped long, streak long"
PENDING = ("pending_transcribe", "pending_detect")


class Crawl:
    """seen: every item once, in the batch that first brought it. stats: of each query, after each batch."""

    def __init__(self, spark: SparkSession, folder: str, max_pending: int = 3000, wait: float = 600.0, routes: dict[str, Column] | None = None, pause: Callable[[float], None] = time.sleep):
        self.spark, self.max_pending, self.wait, self.pause = spark, max_pending, wait, pause
        self.seen, self.stats = Batches(spark, f"{folder}/seen", SEEN), Batches(spark, f"{folder}/stats", STATS)
        self.finished = Batches(spark, f"{folder}/finished", "uid string")
        self.routes = routes or {"skipped": F.col("duration") > 1200}
        self.pauses = 0

    def pending(self) -> int:
        """Items that a later stage hasn't finished; skipped ones need none."""
        waiting = self.seen.before().where(F.col("status").isin(*PENDING))
        return waiting.join(self.finished.before(), "uid", "left_anti").count()

    def finish(self, number: int, uids: DataFrame) -> None:
        """What a later stage tells it has done; runs beside the stream."""
        self.finished.put(number, uids)

    def batch(self, rows: DataFrame, number: int) -> None:
        """For foreachBatch. The stream takes in nothing while this waits."""
        while self.pending() >= self.max_pending:
            self.pauses += 1
            self.pause(self.wait)
        status = F.lit("pending_transcribe")
        for name, held in reversed(list(self.routes.items())):
            status = F.when(held, name).otherwise(status)
        keys = ["platform", "query"]
        # one row of each item, the first by rank; then those that no earlier batch has
        own = rows.withColumn("status", status)
        first = own.groupBy("uid").agg(F.min_by(F.struct("platform", "query", "status", "rank"), F.struct("rank", "platform", "query")).alias("x")).select("uid", "x.*")
        new = first.join(self.seen.before(number).select("uid"), "uid", "left_anti")
        self.seen.put(number, new)
        new = self.spark.read.schema(self.seen.schema).parquet(f"{self.seen.path}/batch={number}")
        returned = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("returned"))
        skipped = F.count_if(~F.col("status").isin(*PENDING))
        found = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("new"), skipped.alias("skipped"))
        now = returned.join(found, keys, "left").fillna(0, ["new", "skipped"]).withColumn("enqueued", F.col("new") - F.col("skipped"))
        # a query without anything new lengthens its streak, one with something new ends it, one that didn't run keeps it
        old = self.stats.last(number).withColumn("ran", F.lit(0))
        both = now.withColumns({"streak": F.lit(0).cast("long"), "ran": F.lit(1)}).select(*self.stats.schema.names, "ran").unionByName(old)
        sums = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("returned", "new", "enqueued", "skipped")], F.sum("streak").alias("before"), F.max("ran").alias("ran"), F.sum(F.when(F.col("ran") == 1, F.col("new"))).alias("fresh"))
        streak = F.when(F.col("ran") == 0, F.col("before")).when(F.col("fresh") > 0, 0).otherwise(F.col("before") + 1)
        self.stats.put(number, sums.withColumn("streak", streak))
        self.stats.forget()

    def run(self, candidates: DataFrame, checkpoint: str) -> None:
        """Takes in all that is there, batch by batch. candidates: uid, platform, query, duration, rank."""
        query = candidates.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


SNAPSHOT = "name string, value long"
CHANGE = "name string, value long, change long, alerts array<string>"


class Monitor:
    """Snapshots of counts, one for each batch, and what changed since the one before."""

    def __init__(self, spark: SparkSession, folder: str, backlog: dict[str, int] | None = None, fall: float = 0.2):
        self.snapshots, self.backlog, self.fall = Batches(spark, f"{folder}/snapshots", SNAPSHOT), backlog or {}, fall

    def take(self, counts: DataFrame, number: int) -> DataFrame:
        """Appends counts (name, value) as this batch's snapshot (again: the same) and returns the changes with their alerts."""
        self.snapshots.put(number, counts.select("name", F.col("value").cast("long").alias("value")))
        now = self.snapshots.last(number + 1)
        before = self.snapshots.last(number).select("name", F.col("value").alias("old"))
        return compared(now.join(before, "name", "full"), self.backlog, self.fall)


def compared(rows: DataFrame, backlog: dict[str, int], fall: float) -> DataFrame:
    """name, value, change and alerts of rows with value and old. A count that is gone is one of 0."""
    value, old = F.coalesce("value", F.lit(0)), F.col("old")
    limit = F.lit(None).cast("long")
    for name, most in backlog.items():
        limit = F.when(F.col("name") == name, most).otherwise(limit)
    alerts = F.array_compact(F.array(F.when(value >= limit, F.concat("name", F.lit("_backlog_at_least_"), limit.cast("string"))), F.when(value < old * (1 - fall), F.concat("name", F.lit("_fell")))))
    keys = [c for c in rows.columns if c not in ("name", "value", "old")]
    return rows.select(*keys, "name", value.alias("value"), (value - old).alias("change"), alerts.alias("alerts"))
