"""Operator 10, sharding: rendezvous hashing of stable record keys over weighted shards.

Each shard draws a score for a record, -weight / ln(u) with u in (0, 1) hashed from the record's key and the shard's
number; the highest score takes the record. A new shard therefore takes rows only into itself, and a change of one
weight moves rows only to or from that shard.

Defined cases: a null key is a key like any other and falls in one shard; equal keys share a shard; ties of scores
go to the lower shard; a null text has size 1 and the checksum of no bytes; an empty table gives an empty result.
Only the key, the text and the columns made here are returned, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense_rank_by, table, whole_text, with_schema

SHARDS = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, as a native expression; one hash for each shard and row."""
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be positive, at least one of them")
    name = F.coalesce(key.cast("string"), F.lit("\x00null"))
    # 52 bits of the hash, moved off 0 and 1; the least -ln(u) / weight wins
    draw = lambda i, w: -F.log((F.shiftrightunsigned(F.xxhash64(name, F.lit(i)), 12).cast("double") + 0.5) / F.lit(2.0**52)) / F.lit(float(w))
    scores = [F.struct(draw(i, w).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["i"]


def shard(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, grown: float | None = 1.0) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and the shard after one of weight `grown` has joined (null: not asked)."""
    wanted = with_schema(df, (key, df.schema[key].dataType.simpleString()), ("text", "string"))
    after = rendezvous(F.col(key), [*weights, grown]) if grown else F.lit(None).cast("int")
    rows = wanted.select(
        key,
        (F.octet_length(whole_text()) + 1).cast("long").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        after.alias("grown_shard"),
    )
    return dense_rank_by(rows, "shard", [key, "text_crc32", "size"], "slot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
