"""Ledgers: strict and tolerant scans, sealed and append-only sinks, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import overlay


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, bad: str = "fail") -> DataFrame:
    """JSON lines, gzip or not; blank lines are skipped. bad: fail, drop, or keep (in _corrupt_record)."""
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad]
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())]) if bad == "keep" else schema
    return spark.read.schema(full).option("mode", mode).json(path)


def check_lines(df: DataFrame) -> DataFrame:
    """Of a scan with bad="keep": raises on the first bad line when an action reads it."""
    bad = F.col("_corrupt_record")
    return df.where(F.when(bad.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad line: "), bad)).cast("boolean"))).drop("_corrupt_record")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def manifest_items(df: DataFrame, text: str, item: str) -> DataFrame:
    """Items of a manifest that is a list, or an object with items or records."""
    as_list = F.from_json(text, f"array<{item}>")
    as_object = F.from_json(text, f"struct<items: array<{item}>, records: array<{item}>>")
    found = F.when(F.ltrim(F.col(text)).startswith("["), as_list).otherwise(F.coalesce(as_object["items"], as_object["records"]))
    return df.select(F.explode(found).alias("item"))


def append(df: DataFrame, path: str) -> None:
    """An append is all or nothing by the commit protocol."""
    df.write.mode("append").json(path)


def seal(df: DataFrame, path: str) -> None:
    """Writes once; an output that is there already is an error."""
    df.write.mode("errorifexists").json(path)


def digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the number of rows, and a digest of all of them that doesn't depend on their order. Each row gives a
    64-bit number; sums over disjoint parts add up, so nothing is gathered or sorted."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in (*keys, *(c for c in df.columns if c not in keys))])))
    return df.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string")), 256).alias("digest"))


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], out: str) -> None:
    """A new snapshot beside the old one: plain files have no merge."""
    overlay(spark.read.parquet(path), new, keys).write.mode("errorifexists").parquet(out)


def add_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Idempotent migration: columns that are missing come in as nulls, types are cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def shards_override(shards: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Union of shards in which later shards replace earlier ones, and within one the last row."""
    both = None
    for i, s in enumerate(shards):
        s = s.withColumn("__shard", F.lit(i))
        both = s if both is None else both.unionByName(s, allowMissingColumns=True)
    row = F.struct(*[F.col(c) for c in both.columns if c not in (*keys, "__shard")])
    return both.groupBy(*keys).agg(F.max_by(row, F.struct("__shard", order)).alias("r")).select(*keys, "r.*")


def uid(source: str, native_id: str) -> Column:
    return F.concat_ws("__", F.col(source), F.regexp_replace(F.col(native_id), "[^A-Za-z0-9_.-]", "_"))
