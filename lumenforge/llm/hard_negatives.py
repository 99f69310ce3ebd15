"""Operator 13, hard-negative mining by blocked dense products.

Anchors are taken in blocks of bounded bytes. A block is broadcast; every task multiplies it with its own candidates in
float64, block against block, and keeps the best few of each anchor. A first pass finds each anchor's positives. A second
pass, which carries their scores with the anchors, finds the negatives in each positive's window of scores. What the tasks
keep is merged by rank, so the shuffle holds a few rows for each anchor and task, never the pairs. With more anchors than
a block holds there are more passes, each over all candidates: a stated query set against all rows, in blocks.

Products are exact: components are whole numbers, and while the squared lengths of both rows stay under 2^53 so does every
partial sum. Rows beyond that are multiplied as Python's integers; a pair whose score itself reaches 2^53 takes no part.

Defined cases: a null id, label or vector, and a null or non-finite component, take no part; only vectors of equal length
are compared, and two empty ones score 0; equal scores go by smaller id; rows are rows, also repeated ones, but an anchor's
positives never have its id, and a repeated anchor row counts once; rows of one id that differ are anchors of their own and
share anchor_id; an empty table gives an empty result. Only the columns named here are read, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, table, with_schema

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
EVERY = 100
SCALE = 256.0
#: Bytes of a broadcast block of anchors, as float64.
BLOCK_BYTES = 32 << 20
#: Anchors and candidates multiplied at once.
ROWS, COLUMNS = 256, 4096
EXACT = 2.0**53


def taking_part(df: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part; every seventh id has the next label."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = with_schema(df, ("vec_id", "long"), ("label", "long"), ("embedding", "array<float>"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad)
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def quantised(column: pa.Array) -> list[np.ndarray]:
    """The vectors of an Arrow column, floor(256 x) of each component."""
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, exact; NaN where one reaches 2^53."""
    out = a @ b.T
    big_a, big_b = (a * a).sum(1) >= EXACT, (b * b).sum(1) >= EXACT
    for i, j in zip(*np.nonzero(big_a[:, None] | big_b[None, :]), strict=True):
        exact = sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True))
        out[i, j] = exact if abs(exact) < EXACT else math.nan
    return out


class Best:
    """The k best (score, id) of each window of scores; offers are merged as they come, in arrays."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.floor = np.full(len(low), -np.inf)
        self.at, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def offer(self, windows: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each of the windows, a column for each of the ids, which ascend."""
        hit = allowed & (scores >= np.maximum(self.low, self.floor)[windows, None]) & (scores <= self.high[windows, None])
        over = np.flatnonzero(hit.sum(1) > self.k)
        if len(over):  # the first k of a row by score, then by id
            own = np.where(hit[over], scores[over], -np.inf)
            last = -np.partition(-own, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            above, level = own > last, own == last
            hit[over] = above | level & (np.cumsum(level, axis=1) <= self.k - above.sum(1, keepdims=True))
        r, c = np.nonzero(hit)
        if not len(r):
            return
        at, score, found = np.concatenate((self.at, windows[r])), np.concatenate((self.score, scores[r, c])), np.concatenate((self.id, ids[c]))
        order = np.lexsort((found, -score, at))
        at, score, found = at[order], score[order], found[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        self.at, self.score, self.id = (x[nth < self.k] for x in (at, score, found))
        kth = nth[nth < self.k] == self.k - 1
        self.floor[self.at[kth]] = self.score[kth]


def _search(anchors: dict, k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over candidates (vec_id, label, embedding): the k best of each window of the anchors, of the anchor's label or of the others.

    anchors: broadcast; key, id and label of each, vectors by length, and the windows: anchor, slot, low, high.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = anchors.value
        owner, slot = held["owner"], held["slot"]
        best = Best(held["low"], held["high"], k)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            labels = b.column(1).to_numpy(zero_copy_only=False)
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            vectors = quantised(b.column(2))
            for size, (mine, block) in held["blocks"].items():
                rows = np.flatnonzero(sizes == size)
                rows = rows[np.argsort(ids[rows], kind="stable")]
                for label in np.unique(labels[rows]) if same else [None]:
                    of = rows if label is None else rows[labels[rows] == label]
                    take = np.arange(len(mine)) if label is None else np.flatnonzero(held["label"][mine] == label)
                    for j in range(0, len(of), COLUMNS):
                        part = of[j : j + COLUMNS]
                        candidates = np.stack([vectors[x] for x in part])
                        for i in range(0, len(take), ROWS):
                            own = mine[take[i : i + ROWS]]
                            scores = products(block[take[i : i + ROWS]], candidates)
                            if same:
                                allowed = held["id"][own][:, None] != ids[part][None, :]
                            else:
                                allowed = held["label"][own][:, None] != labels[part][None, :]
                            for s in range(held["slots"]):
                                w, r = held["window"][own, s], np.flatnonzero(held["window"][own, s] >= 0)
                                if len(r):
                                    best.offer(w[r], scores[r], allowed[r], ids[part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(held["key"][owner[best.at]]), pa.array(held["id"][owner[best.at]]), pa.array(slot[best.at]), pa.array(best.score.astype(np.int64)), pa.array(best.id)],
            ["anchor", "anchor_id", "slot", "score", "vec_id"],
        )

    return run


FOUND = "anchor long, anchor_id long, slot int, score long, vec_id long"


def _block(keys: list[int], ids: list[int], labels: list[int], vectors: list, windows: list[tuple[int, int, float, float]]) -> dict:
    """windows: anchor, slot, low, high."""
    sizes = np.array([len(v) for v in vectors])
    slots = 1 + max((w[1] for w in windows), default=-1)
    window = np.full((len(ids), max(1, slots)), -1)
    for n, (a, s, _, _) in enumerate(windows):
        window[a, s] = n
    blocks = {}
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        blocks[size] = mine, np.floor(SCALE * np.array([vectors[i] for i in mine], np.float64).reshape(len(mine), size))
    return {
        "key": np.array(keys, np.int64), "id": np.array(ids, np.int64), "label": np.array(labels, np.int64), "blocks": blocks, "window": window, "slots": slots,
        "owner": np.array([w[0] for w in windows], np.int64), "slot": np.array([w[1] for w in windows], np.int32), "low": np.array([w[2] for w in windows]), "high": np.array([w[3] for w in windows]),
    }


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and slot, with their rank."""
    w = W.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of which is_anchor holds."""
    spark = df.sparkSession
    sc, out = spark.sparkContext, Written(spark)
    rows = taking_part(df)
    anchors = rows.where(is_anchor).withColumn("anchor", F.xxhash64("vec_id", "label", "embedding")).dropDuplicates(["anchor"])
    n, widest = anchors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    passes = max(1, math.ceil(n * max(1, widest or 0) * 8 / block_bytes))
    results = []
    for p in range(passes):
        chosen = anchors if passes == 1 else anchors.where(F.pmod(F.xxhash64(F.lit(1), "anchor"), F.lit(passes)) == p)
        mine_ = chosen.toArrow()  # about block_bytes at most
        ids, labels, keys = (mine_.column(c).to_pylist() for c in ("vec_id", "label", "anchor"))
        vectors = mine_.column("embedding").to_pylist()
        first = sc.broadcast(_block(keys, ids, labels, vectors, [(a, 0, -np.inf, np.inf) for a in range(len(ids))]))
        likes = ranked(rows.mapInArrow(_search(first, positives, True), FOUND), positives).select("anchor", "rank", "vec_id", "score")
        known = out.keep(likes)
        number, windows = {k: i for i, k in enumerate(keys)}, []
        for r in known.toArrow().to_pylist():  # `positives` rows for each anchor of the block
            least, most = -(-low * r["score"] // 100), high * r["score"] // 100
            if least <= most:
                windows.append((number[r["anchor"]], r["rank"] - 1, float(least), float(most)))
        second = sc.broadcast(_block(keys, ids, labels, vectors, windows))
        far = ranked(rows.mapInArrow(_search(second, negatives, False), FOUND), negatives).withColumn("nth", F.col("slot") + 1)
        near = known.select("anchor", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        columns = ["anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
        results.append(out.keep(far.join(near, ["anchor", "nth"]).select(*columns)))
        first.destroy()
        second.destroy()
        out.drop(known)
    whole = results[0]
    for r in results[1:]:
        whole = whole.unionByName(r)
    return whole


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


def oracle() -> str:
    return f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives JOIN scored s USING (anchor_id)
WHERE NOT s.alike AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
