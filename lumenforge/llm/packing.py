"""Operator 9, best-fit packing by large-item matching.

A document is its token ids and an end token. Longer documents than the capacity are cut into full pieces, which are
sequences of their own, and one shorter piece. The rest is packed by size alone, so the plan needs only the count of
each size (at most `capacity` numbers): items above a third of the capacity pair at most twice per sequence, the
largest with the largest partner that still fits; smaller items, in descending size, go to the tightest gap that
holds them. Equal steps are taken at once, so the plan has as many runs for a hundred documents as for a billion
times more. Runs are then joined to the items by size and place within the size; the places come from a salted
two-step count, so a size that holds a third of all items is no hot group.

Defined cases: a null or empty text is the end token alone; equal rows are packed as separate items; a very long
text is cut into pieces; an empty table gives an empty result; only the columns made here are returned, so no
column can clash.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import CUT, matched
from .common import checkpoint, dense_rank_by, small_batches, spans, table, whole_text, with_schema

CAPACITY, END = 1024, 2
_loaded: dict = {}


def _byte_of() -> dict[str, int]:
    """How the file shows a byte: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(other)}


def encoding(path: str):
    """The vocabulary of a tokenizers file, with its added tokens, in tiktoken's encoder, which is faster and gives the ids that
    the tokenizers library gives (add_special_tokens=False): merges of byte-level vocabularies are in the order of ids."""
    import tiktoken

    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in k): i for k, i in held["model"]["vocab"].items()}
        added = {x["content"]: x["id"] for x in held["added_tokens"]}
        _loaded[path] = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _loaded[path]


def encode_all(texts: list[str], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text."""
    enc, out = encoding(path), []
    for t in texts:
        if len(t) <= CUT:
            out.append(enc.encode_to_numpy(t, allowed_special="all").tobytes())
        else:
            out.append(b"".join(np.array(enc._encode_single_piece(p), np.uint32).tobytes() if one else enc.encode_to_numpy(p, allowed_special="all").tobytes() for p, one in matched(t)))
    return out


def cut(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32. The first piece takes the remainder."""
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in spans(b.column(1), 1 << 20):
                ids, cols = b.column(0)[i:j].to_pylist(), ([], [], [], [], [])
                for d, raw in zip(ids, encode_all(b.column(1)[i:j].to_pylist(), path), strict=True):
                    raw += tail
                    n = len(raw) // 4
                    at, k = 0, 0
                    while at < n:
                        m = n % capacity if k == 0 and n % capacity else capacity
                        for c, v in zip(cols, (d, k, at, m, zlib.crc32(raw[4 * at : 4 * (at + m)])), strict=True):
                            c.append(v)
                        at, k = at + m, k + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(with_schema(df, ("doc_id", "long"), ("text", "string"))).select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, first place, how many, first sequence, offset): the item of this size at place p goes to sequence
    first + p - first place, at this offset.

    counts: items by size. Large items are matched from the largest down, each with the largest partner that fits;
    the others go in descending order to the smallest gap that holds them.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many) of the sequences that have it
    made = 0

    def put(size: int, n: int, first: int, offset: int) -> None:
        runs.append((size, used[size], n, first, offset))
        used[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        b = large[i] if i >= 0 else 0
        if b == a and left[a] == 1:
            b = large[i - 1] if i else 0
        n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        put(a, n, made, 0)
        if b:
            put(b, n, made, a)
        if capacity > a + b:
            gaps.setdefault(capacity - a - b, []).append((made, n))
        made += n
        large = [s for s in large if left[s]]
    order = sorted(gaps)
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            i = bisect.bisect_left(order, s)
            if i == len(order):
                each = capacity // s
                n = -(-left[s] // each)  # new sequences, filled with this size
                full = left[s] // each
                if full:
                    for k in range(each):
                        put(s, full, made, k * s)
                    if capacity > each * s:
                        gap = capacity - each * s
                        if gap not in gaps:
                            bisect.insort(order, gap)
                        gaps.setdefault(gap, []).append((made, full))
                if n > full:
                    rest = left[s]
                    for k in range(rest):
                        put(s, 1, made + full, k * s)
                    gap = capacity - rest * s
                    if gap not in gaps:
                        bisect.insort(order, gap)
                    gaps.setdefault(gap, []).append((made + full, 1))
                made += n
                continue
            g = order[i]
            first, n = gaps[g].pop()
            take = min(n, left[s])
            if n > take:
                gaps[g].append((first + take, n - take))
            if not gaps[g]:
                del gaps[g]
                del order[i]
            put(s, take, first, capacity - g)
            if g > s:
                if g - s not in gaps:
                    bisect.insort(order, g - s)
                gaps.setdefault(g - s, []).append((first, take))
    return runs


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length of 1 to `capacity`."""
    spark = items.sparkSession
    held = checkpoint(items)
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    runs = plan(counts, capacity)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("__size", "__place", "__n", "__first", "__offset")])
    by_run = spark.createDataFrame(runs, schema)
    placed = dense_rank_by(held, "length", ["doc_id", "piece", "ids_crc32"], "__at")
    # the runs number a few thousand, however many items there are: see the module's text
    joined = placed.join(F.broadcast(by_run), (F.col("length") == F.col("__size")) & (F.col("__at") >= F.col("__place")) & (F.col("__at") < F.col("__place") + F.col("__n")))
    return joined.select(*items.columns, (F.col("__first") + F.col("__at") - F.col("__place")).alias("sequence_id"), F.col("__offset").alias("offset"))


def pack_documents(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    return pack(cut(df, path or public_tokenizers.path("byte_bpe_50k.json"), capacity, end), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
