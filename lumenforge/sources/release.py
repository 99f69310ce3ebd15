"""The release of a table by pillar: a contract for its columns, one folder for each pillar, and a manifest of rows and digests. And
re-processing of a table in place, with quarantine and a journal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PILLARS = ("witnessed", "instructional", "commentary")


class ContractError(ValueError):
    """A table isn't what its contract says."""


def checked(df: DataFrame, contract: T.StructType, key: Sequence[str]) -> DataFrame:
    """df with exactly the columns of the contract, in its order. Raises if a column is missing or of another type, a required one is null,
    or a key stands twice."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in contract.fields:
        if f.name not in have:
            raise ContractError(f"{f.name} is missing")
        if have[f.name] != f.dataType:
            raise ContractError(f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    out = df.select(*contract.names)
    required = [f.name for f in contract.fields if not f.nullable]
    if required:
        gone = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first()
        if bad := [c for c in required if gone[c]]:
            raise ContractError(f"null in {', '.join(bad)}")
    twice = out.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ContractError(f"key stands {twice[0]['n']} times: {', '.join(str(twice[0][k]) for k in key)}")
    return out


def row_digest(columns: Sequence[str]) -> Column:
    """A number of a row's values, for sums that don't depend on the order of rows."""
    shown = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *shown), 256), 1, 12), 16, 10).cast("decimal(38,0)")


def manifest(df: DataFrame, part: str) -> DataFrame:
    """part, n and digest of each part: the sum of its rows' digests."""
    rest = [c for c in df.columns if c != part]
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.sum(row_digest(rest)).cast("string").alias("digest"))


def release(df: DataFrame, path: str, contract: T.StructType, key: Sequence[str], part: str = "pillar", per_file: int = 1_000_000) -> DataFrame:
    """Writes df below path, by part, in files of `per_file` rows at most, and its manifest; a folder that is there is an error. Returns the
    manifest, made from what was written. A large part is dealt to as many tasks as it has rows for."""
    spark = df.sparkSession
    out = checked(df, contract, key)
    out.repartition(part, F.pmod(F.xxhash64(*key), F.lit(64))).write.option("maxRecordsPerFile", per_file).partitionBy(part).parquet(f"{path}/data")
    found = manifest(read(spark, path, contract, part), part)
    found.coalesce(1).write.json(f"{path}/manifest")  # a row for each part
    return spark.read.schema(found.schema).json(f"{path}/manifest")


def read(spark: SparkSession, path: str, contract: T.StructType, part: str = "pillar") -> DataFrame:
    """The released table; a filter on the part reads its folders only."""
    return spark.read.schema(contract).parquet(f"{path}/data").select(*contract.names)


def verified(spark: SparkSession, path: str, contract: T.StructType, part: str = "pillar") -> DataFrame:
    """part, n, digest and whether the released part still is what the manifest says; also parts that one side lacks."""
    now = manifest(read(spark, path, contract, part), part)
    said = spark.read.schema(now.schema).json(f"{path}/manifest").select(part, F.col("n").alias("n_said"), F.col("digest").alias("digest_said"))
    same = F.col("n").eqNullSafe(F.col("n_said")) & F.col("digest").eqNullSafe(F.col("digest_said"))
    return now.join(said, part, "full").select(part, "n", "digest", same.alias("intact"))


# --- re-processing in place -----------------------------------------------------------------------------------


class Reprocessing:
    """A table below `path` in folders by bucket, rows that were taken out (quarantine), and a journal of finished buckets.

    A run decides on each row once. Of a bucket it first writes what goes, then what stays, then the journal's entry, each by
    replacing a folder of its own; what goes is read again with what is there when a bucket was begun and not finished. So a run
    that was killed anywhere and is repeated ends as if it had never been. Nothing is deleted: quarantine keeps the rows, with the reason.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets

    def start(self, rows: DataFrame, key: str) -> None:
        """Lays the table down."""
        self.schema = rows.schema
        rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows")

    def _there(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _folder(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/rows").select(*self.schema.names)

    def quarantine(self) -> DataFrame:
        """Rows that were taken out, with run and reason."""
        schema = T.StructType([*self.schema.fields, T.StructField("reason", T.StringType()), T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not self._folder(f"{self.path}/quarantine"):
            return self.spark.createDataFrame([], schema).drop("bucket")
        return self.spark.read.schema(schema).parquet(f"{self.path}/quarantine").drop("bucket")

    def journal(self) -> DataFrame:
        schema = "run string, bucket int, kept long, taken long"
        return self.spark.read.schema(schema).json(f"{self.path}/journal/*/*") if self._folder(f"{self.path}/journal") else self.spark.createDataFrame([], schema)

    def run(self, name: str, reason: Column, stop_after: int | None = None) -> int:
        """Takes out the rows for which `reason` (an expression over the row alone) isn't null. Returns how many steps were taken; with
        stop_after the run breaks off after so many, as if killed: each bucket has three."""
        steps = 0

        def step(write) -> None:
            nonlocal steps
            if stop_after is not None and steps >= stop_after:
                raise InterruptedError
            write()
            steps += 1

        for bucket in range(self.buckets):  # folders, each of which is a job over its own rows
            entry, out, table = (f"{self.path}/{x}" for x in (f"journal/{name}/{bucket}", f"quarantine/run={name}/bucket={bucket}", f"rows/bucket={bucket}"))
            if self._there(entry):
                continue
            own = self.spark.read.schema(self.schema).parquet(table) if self._folder(table) else self.spark.createDataFrame([], self.schema)
            judged = own.withColumn("reason", reason)
            held = f"{self.path}/work/{name}/{bucket}"
            step(lambda judged=judged, out=out: None if self._there(out) else judged.where("reason IS NOT NULL").write.mode("overwrite").parquet(out))
            # beside the table first, and whole: a folder isn't read and replaced at once, and one that was half replaced isn't read again
            if not self._there(held):
                judged.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(held)
            kept = self.spark.read.schema(self.schema).parquet(held)
            step(lambda kept=kept, table=table: kept.write.mode("overwrite").parquet(table))
            taken = self.spark.read.parquet(out).count()
            line = self.spark.createDataFrame([(name, bucket, kept.count(), taken)], "run string, bucket int, kept long, taken long")
            step(lambda line=line, entry=entry: line.coalesce(1).write.mode("overwrite").json(entry))
        return steps
