"""Image hashes and the prompts of the source-context step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from .registry import Tables, query

_TERM = "CAST(embedding[i + 1] AS DOUBLE) * cos(pi() * (2 * (i // 8) + 1) * (k // 8) / 16) * cos(pi() * (2 * (i % 8) + 1) * (k % 8) / 16) * sqrt(CASE WHEN k // 8 = 0 THEN 0.125 ELSE 0.25 END) * sqrt(CASE WHEN k % 8 = 0 THEN 0.125 ELSE 0.25 END)"
_HASHES = f"""c AS (SELECT vec_id, list_transform(range(64), lambda k: list_sum(list_transform(range(64), lambda i: {_TERM}))) AS co FROM embeddings),
m AS (SELECT vec_id, co, list_sort(co[2:64])[32] AS mid FROM c),
h AS (SELECT vec_id, array_to_string(list_transform(co, lambda x: CASE WHEN x > mid THEN '1' ELSE '0' END), '') AS phash FROM m)"""


def _hashes(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", vectors.perceptual_hash(F.col("embedding")).alias("phash"))


@query(f"WITH {_HASHES} SELECT vec_id, phash FROM h")
def perceptual_hash(t: Tables) -> DataFrame:
    return _hashes(t)


@query(f"WITH {_HASHES} SELECT a.vec_id, CAST(hamming(a.phash, b.phash) AS INTEGER) AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id + 1")
def phash_adjacent_hamming(t: Tables) -> DataFrame:
    after = _hashes(t).select((F.col("vec_id") - 1).alias("vec_id"), F.col("phash").alias("next"))
    return _hashes(t).join(after, "vec_id").select("vec_id", vectors.hamming(F.col("phash"), F.col("next")).alias("distance"))


@query("""SELECT conv_id, 'platform: forum' || coalesce(chr(10) || 'title: ' || nullif(to_json(nullif(max(text) FILTER (turn = 0), ''))::VARCHAR, 'null'), '')
|| coalesce(chr(10) || string_agg('comment (score ' || turn || '): ' || to_json(coalesce(text, ''))::VARCHAR, chr(10) ORDER BY turn) FILTER (turn > 0), '') AS prompt FROM conversations GROUP BY conv_id""")
def packet_prompt(t: Tables) -> DataFrame:
    said = F.sort_array(F.collect_list(F.when(F.col("turn") > 0, F.struct(F.col("turn").alias("score"), F.col("text").alias("body")))))
    packets = t.conversations.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("title"), said.alias("comments"))
    return packets.select("conv_id", text.context_prompt(F.lit("forum"), {"title": F.col("title")}, F.col("comments")).alias("prompt"))
