"""Operator 8, document fingerprints: Order MinHash.

A text's k-mers are numbered by occurrence, so a repeated k-mer counts as often as it stands there. For each of
SKETCHES hash functions the LEAST k-mers of smallest hash are selected among all of them, put back into text order, and
hashed as a tuple. The share of equal tuples falls with the edit distance: moving passages about changes the order and so the
tuples, which a plain MinHash would not see. K-mers are of K bytes of the UTF-8 text.

Defined cases: a null text is empty; an empty text has the fingerprint of no k-mers, and two empty texts have
likeness 1; a text shorter than K is one k-mer; a text with fewer k-mers than LEAST selects all; equal texts have
equal fingerprints; rows with equal doc_id follow each other by text; a null doc_id sorts first; a single document is
its own next one; an empty table gives an empty result; only the columns made here are returned, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, U64, mix, partitions, table, whole_text, with_schema

K, LEAST, SKETCHES = 12, 2, 32
_ODD = np.random.default_rng(88).integers(1, 2**63, (SKETCHES, 2), dtype=np.uint64) * U64(2) + U64(1)
#: K-mers of a batch at most; a longer text is a batch of its own.
BATCH = 1 << 19


def _kmers(raw: np.ndarray) -> np.ndarray:
    """A hash of the K bytes that begin at each place but the last K - 1: of the first eight and the last four."""
    n = len(raw) - K + 1
    eight = np.ndarray((n,), "<u8", raw, strides=(1,)).astype(U64)
    four = np.ndarray((n,), "<u4", raw, offset=8, strides=(1,)).astype(U64)
    return mix(eight * _ODD[0, 0] + four * _ODD[1, 0])


def sketches(texts: list[bytes]) -> np.ndarray:
    """The fingerprints, (texts, SKETCHES) numbers of 32 bits."""
    out = np.zeros((len(texts), SKETCHES), np.uint32)
    i = total = 0
    for j, t in enumerate([*texts, b""]):
        if j == len(texts) or total and total + len(t) > BATCH or j - i >= 2048:
            if j > i:
                out[i:j] = _sketch(texts[i:j])
            i, total = j, 0
        total += len(t)
    return out


def _sketch(texts: list[bytes]) -> np.ndarray:
    size = np.array([len(t) for t in texts])
    count = np.where(size == 0, 0, np.maximum(1, size - K + 1))
    raw = np.frombuffer(b"".join(t + bytes(max(0, K - len(t))) if t else b"" for t in texts) + bytes(K), np.uint8)
    begin = np.cumsum(np.where(size == 0, 0, np.maximum(size, K))) - np.where(size == 0, 0, np.maximum(size, K))
    first = np.cumsum(count) - count
    each = np.arange(len(texts))
    h = _kmers(raw)
    h = h[np.repeat(begin - first, count) + np.arange(int(count.sum()))] if (begin != first).any() else h[: int(count.sum())]
    if not len(h):
        return np.full((len(texts), SKETCHES), 0x5EED, np.uint32)
    # occurrence numbers: k-mers that agree in 32 bits of their hash are neighbours once sorted by text, these and place ..
    doc = np.repeat(each, count)
    if int(count.max()) < 1 << 20 and len(texts) <= 1 << 12:
        key = np.repeat((each.astype(U64) << U64(52)) - first.astype(U64), count) + np.arange(len(h), dtype=U64)
        key |= h & U64(0xFFFFFFFF00000)
        key.sort()
        group = key >> U64(20)
        same = group[1:] == group[:-1]
        held = np.flatnonzero(np.append(same, False) | np.append(False, same))
        at = first[(key[held] >> U64(52)).astype(np.int64)] + (key[held] & U64((1 << 20) - 1)).astype(np.int64)
    else:
        part = h & U64(0xFFFFFFFF00000)
        by = np.lexsort((part, doc))
        same = (doc[by][1:] == doc[by][:-1]) & (part[by][1:] == part[by][:-1])
        at = by[np.append(same, False) | np.append(False, same)]
    # .. and among these, which are few, the whole hash tells
    if len(at):
        at = at[np.lexsort((at, h[at], doc[at]))]
        begins = np.flatnonzero(np.concatenate(([True], (h[at][1:] != h[at][:-1]) | (doc[at][1:] != doc[at][:-1]))))
        nth = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        at, nth = at[nth > 0], nth[nth > 0]
        h[at] = mix(h[at] + nth.astype(U64) * _ODD[3, 0])
    small = (h >> U64(32)).astype(np.uint32)
    # a k-mer that is among the LEAST lies below this bound, but for one text in some ten thousand; those are done in full
    share = np.minimum(1.0, (LEAST + 14.0) / np.maximum(count, 1))
    limit = np.minimum(share * 2.0**32, 2.0**32 - 1).astype(np.uint32)[doc]
    out = np.full((len(texts), SKETCHES), 0x5EED, np.uint32)
    wanted = np.minimum(count, LEAST)
    g = np.empty_like(small)
    for s in range(SKETCHES):
        np.multiply(small, _ODD[s, 0].astype(np.uint32) | np.uint32(1), out=g)
        at = np.flatnonzero(g <= limit)
        short = np.flatnonzero(np.bincount(doc[at], minlength=len(texts)) < wanted)
        if len(short):
            at = np.union1d(at, np.concatenate([np.arange(first[d], first[d] + count[d]) for d in short]))
        at = at[np.argsort(doc[at].astype(U64) << U64(32) | g[at], kind="stable")]  # ties: the first in the text
        at = np.sort(at[_rank(doc[at]) < LEAST])  # text order
        d = doc[at]
        rank = _rank(d).astype(U64)
        begins = np.flatnonzero(rank == 0)
        out[d[begins], s] = (np.add.reduceat(mix(h[at] + (rank + U64(1)) * _ODD[s, 1]) * (rank * U64(2) + U64(1)), begins) >> U64(32)).astype(np.uint32)
    return out


def _rank(group: np.ndarray) -> np.ndarray:
    """The place of each element within its run of equal ones."""
    begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal tuples, an estimate from 0 to 1."""
    return (a == b).mean(axis=-1)


def fingerprint(df: DataFrame) -> DataFrame:
    """doc_id and fingerprint, the hex digits of the tuples' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = sketches(b.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.astype(">u4").tobytes().hex() for m in marks])], ["doc_id", "fingerprint"])

    return with_schema(df, ("doc_id", "long"), ("text", "string")).select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _ranges(ids: DataFrame, n: int) -> list[int]:
    """At most n - 1 ids that cut the table into about equal ranges."""
    cut = ids.select(F.percentile_approx("__id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    return sorted(set(cut or []))


def with_next(df: DataFrame) -> DataFrame:
    """doc_id, text, and the text of the next document by ascending doc_id (after the last: the first).

    Documents are dealt out by ranges of doc_id, one to a task. The first document of each range is sent to the range before as
    well, so every task has all it needs; what the driver learns is one id for each range. Rows of one doc_id are one range.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    rows = with_schema(df, ("doc_id", "long"), ("text", "string")).select("doc_id", whole_text().alias("text"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"))
    cuts = np.array(_ranges(rows.select("__id"), n), np.int64)

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

    heads = sorted((r["r"], r["m"]) for r in rows.select("__id").groupBy(of("__id").alias("r")).agg(F.min("__id").alias("m")).collect())
    before = {m: heads[i - 1][0] for i, (_, m) in enumerate(heads)}  # one for each range

    @F.pandas_udf("array<int>")
    def to(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, ids.to_numpy(), side="right")
        return pd.Series([[int(o)] if i not in before else [int(o), -1 - before[i]] for i, o in zip(ids.tolist(), own.tolist(), strict=True)])

    last = heads[-1][0] if heads else 0
    dealt = rows.withColumn("__to", F.explode(to("__id")))
    # a copy goes after all of its range; the first document's copy goes to the last range
    dealt = dealt.withColumn("__copy", F.col("__to") < 0).withColumn("__to", F.when(F.col("__copy"), -1 - F.col("__to")).otherwise(F.col("__to")))
    dealt = dealt.repartitionById(n, F.col("__to")).sortWithinPartitions("__to", "__copy", "__id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "next_text"]
        held = None  # the row that waits for its next one: range, doc_id, text
        for b in batches:
            ids, texts, ranges, copies = (b.column(c).to_pylist() for c in ("doc_id", "text", "__to", "__copy"))
            out: list[tuple] = []
            for row in zip(ids, texts, ranges, copies, strict=True):
                if held is not None and held[2] == row[2]:
                    out.append((held[0], held[1], row[1]))
                held = None if row[3] else row
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names)

    del spark, last
    return dealt.select("doc_id", "text", "__to", "__copy").mapInArrow(run, "doc_id long, text string, next_text string")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to as many from the beginning of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_with_edits(df: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness, and that to the next document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                ids, texts, following = (b.column(c)[i : i + 500].to_pylist() for c in range(3))
                edits = [edited(t, f).encode() for t, f in zip(texts, following, strict=True)]
                own = sketches([t.encode() for t in texts])
                # the next row's text mostly is this row's following one: only the others are sketched again
                odd = [k for k in range(len(texts)) if k + 1 == len(texts) or texts[k + 1] != following[k]]
                nxt = np.concatenate([own[1:], own[:1]])
                nxt[odd] = sketches([following[k].encode() for k in odd])
                new = sketches(edits)
                digits = lambda m: [x.astype(">u4").tobytes().hex() for x in m]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in edits]),
                        pa.array(digits(own)),
                        pa.array(digits(new)),
                        pa.array(likeness(own, new), pa.float64()),
                        pa.array(likeness(own, nxt), pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return with_next(df).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
