"""Pairs of similar token sets, exactly, without a row for each candidate: sets are packed into blocks of sketches, and a task finds in how
many bits the sketches of two blocks differ."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Bytes of sketches in a block, and pairs that a task compares at once, of so many sets with others.
BLOCK, ROWS, SETS = 2_000_000, 2**18, 64
#: Not used any more: tokens need no order now.
FREQUENT = 0
_BLOCK = "keys binary, sizes binary, sketches binary, bits int, least_size int, most_size int"


def _folded(sketches: np.ndarray, bits: int) -> np.ndarray:
    """The sketches that so many bits would have made."""
    while sketches.shape[1] * 64 > bits:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _near(a: dict, b: dict, same: bool, least: float, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of the sets that may be similar: their sketches differ in no more bits than similar sets do in tokens."""
    share = (1 - least) / (1 + least)  # of the tokens of both, so many are in one alone, at most
    bits = max(a["bits"], b["bits"])
    at, bt = (np.ascontiguousarray(_folded(x["sketches"], bits).T) for x in (a, b))
    wide = min(a["sketches"].shape[1], b["sketches"].shape[1]) * 64
    wa, wb = _folded(a["sketches"], wide), _folded(b["sketches"], wide)
    na, nb = a["sizes"].astype(np.int64), b["sizes"].astype(np.int64)
    kind = np.int16 if 2 * bits < 2**15 else np.int32
    la, lb = (np.ceil(n * share).astype(kind) for n in (na, nb))
    most = max(1, rows // SETS)
    differ, ones, left = np.empty((SETS, most), np.uint64), np.empty((SETS, most), np.uint8), np.empty((SETS, most), kind)
    for i in range(0, len(na), SETS):
        n = min(SETS, len(na) - i)
        lo, hi = np.searchsorted(nb, na[i] * least - 1e-9, "left"), np.searchsorted(nb, na[i + n - 1] / least + 1e-9, "right")
        for j in range(max(lo, i + 1) if same else lo, hi, most):
            m = min(most, hi - j)
            d, o, rest = differ[:n, :m], ones[:n, :m], left[:n, :m]
            np.add(la[i : i + n, None], lb[None, j : j + m], out=rest)
            for w in range(len(at)):
                np.bitwise_xor(at[w, i : i + n, None], bt[w, None, j : j + m], out=d)
                np.bitwise_count(d, out=o)
                np.subtract(rest, o, out=rest)
            x, y = np.nonzero(rest >= 0)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            total = na[x] + nb[y]
            fit = (np.minimum(na[x], nb[y]) >= np.maximum(na[x], nb[y]) * least - 1e-9) & (np.bitwise_count(wa[x] ^ wb[y]).sum(1, dtype=np.int64) <= total * share + 1e-9)
            if fit.any():
                yield x[fit], y[fit]


def similar_pairs(df: DataFrame, key: str, toks: str, least: float) -> DataFrame:
    """ka, kb and jaccard of all pairs ka < kb of token sets (by a long key, each once) whose Jaccard similarity is `least` or more.

    A set's sketch has the parities of how many of its tokens fall on each of its bits, 8 to 16 times as many bits as tokens, which are
    folded to a quarter first. Two
    sketches differ in no more bits than the sets do in tokens, and similar sets differ in few, so no pair is lost; that others pass is
    rare. Sets, sorted by size, are packed into blocks of a bounded size; each two blocks whose sizes are near enough meet in a task. Only
    pairs whose sketches are near leave it; these are compared in full. So what is written grows with the sets and the pairs found;
    the time of the sketches grows with the square of the sets.
    """
    d = df.select(F.col(key).cast("long").alias("k"), F.array_distinct(toks).alias("ts")).where(F.size("ts") > 0)
    hashed = d.select("k", F.transform("ts", lambda t: F.xxhash64(t)).alias("hs"))
    wider = 2 ** (math.ceil(-math.log2(least) - 1e-9) + 1)  # for sets as much larger as similar ones can be, and twice that to check

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            key, kinds = b.column(0).to_numpy(), np.frexp(sizes)[1]  # sizes below 2 ** kind
            for kind in np.unique(kinds).tolist():
                own = kinds == kind
                n, bits = int(own.sum()), max(64, 2 * 2**kind)
                hs, row = flat[np.repeat(own, sizes)] & np.uint64(bits * wider - 1), np.repeat(np.arange(n), sizes[own])
                out = np.zeros((n, bits * wider // 64), np.uint64)
                np.bitwise_xor.at(out, (row, (hs >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (hs & np.uint64(63)))
                columns = [pa.array(key[own]), pa.array(sizes[own], pa.int32()), pa.array(np.full(n, bits), pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "n", "bits", "sketch"])

    def packed(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            k, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
            values = [k.astype(np.int64).tobytes(), n.astype(np.int32).tobytes(), b"".join(x for b in held for x in b.column(3).to_pylist())]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values] + [pa.array([int(m)], pa.int32()) for m in (held[0].column(2)[0].as_py(), n.min(), n.max())], ["keys", "sizes", "sketches", "bits", "least_size", "most_size"])

        kind, room = None, 0
        for b in batches:
            bits, i = b.column(2).to_numpy(), 0
            ends = [*(np.flatnonzero(np.diff(bits)) + 1).tolist(), b.num_rows]
            while i < b.num_rows:
                if held and (bits[i] != kind or not room):
                    yield block()
                    held = []
                if not held:
                    kind, room = bits[i], max(1, size // (int(bits[i]) * wider // 8))
                n = min(room, next(e for e in ends if e > i) - i)
                held.append(b.slice(i, n))
                i, room = i + n, room - n
        if held:
            yield block()

    n = max(16, df.sparkSession.sparkContext.defaultParallelism)
    sets = written(hashed.mapInArrow(sketched, "k long, n int, bits int, sketch binary"), "sketches")
    blocks = written(sets.repartitionByRange(n, "n", "k").sortWithinPartitions("n", "k").mapInArrow(packed, _BLOCK).withColumn("id", F.monotonically_increasing_id()), "blocks")

    def met(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                value = lambda c: b.column(b.schema.get_field_index(c))[r]  # noqa: B023, E731
                one = lambda p: {"keys": np.frombuffer(value(p + "keys").as_buffer(), np.int64), "sizes": np.frombuffer(value(p + "sizes").as_buffer(), np.int32), "bits": value(p + "bits").as_py()}  # noqa: B023, E731
                x, y = ((e := one(p)) | {"sketches": np.frombuffer(value(p + "sketches").as_buffer(), np.uint64).reshape(len(e["keys"]), -1)} for p in "xy")
                for i, j in _near(x, y, value("same").as_py(), least, rows):
                    k, m = x["keys"][i], y["keys"][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k, m)), pa.array(np.maximum(k, m))], ["ka", "kb"])

    side = lambda d, p: d.select(*[F.col(c).alias(p + c) for c in d.columns])
    near = (F.col("xid") <= F.col("yid")) & ((F.col("yleast_size") * least <= F.col("xmost_size")) & (F.col("xleast_size") * least <= F.col("ymost_size")))
    both = side(blocks.repartition(n), "x").join(side(blocks, "y"), near).select(*[F.col(p + c) for p in "xy" for c in ("keys", "sizes", "sketches", "bits")], (F.col("xid") == F.col("yid")).alias("same"))
    cand = written(both.mapInArrow(met, "ka long, kb long"), "near-pairs")
    full = cand.join(d.select(F.col("k").alias("ka"), F.col("ts").alias("ta")), "ka").join(d.select(F.col("k").alias("kb"), F.col("ts").alias("tb")), "kb")
    k = F.size(F.array_intersect("ta", "tb"))
    return full.select("ka", "kb", (k / (F.size("ta") + F.size("tb") - k)).alias("jaccard")).where(F.col("jaccard") >= least)
