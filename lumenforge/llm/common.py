"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null doc_id inside joins and sorts.
NULL_ID = -(2**63)

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many tasks a shuffle is dealt to: the session's own setting, which the cluster sizes to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Rows of an Arrow batch handed to Python, where the session keeps Spark's own 10,000: whole texts are long rows.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session is set to BATCH_ROWS unless it names another number."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only in local mode, where all share one machine, is it made when unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or None
    if found is None:
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if found is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenforge-")
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by writing to the shared folder; lost executors reread it from there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


class Written:
    """Tables written as Parquet under the shared folder during one call of an operator; `drop` deletes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lumenforge/{uuid.uuid4().hex}"
        self.n, self.paths = 0, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.root}/{self.n}", self.n + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            if held := self.paths.pop(id(f), None):
                delete(self.spark, held[1])


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store through Spark's own file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores at its end as it takes to be no column of df."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def with_schema(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Selects the named columns with their types; a column that is missing comes back null. Other columns go, so none can clash."""
    have = {f.name for f in df.schema.fields}
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns])


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def dense_rank_by(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Adds `out`: places 0, 1, 2 .. without gaps among the rows with the same key, also where one key holds most rows.

    Rows are dealt by key and a salt from their order columns; places inside a salt come from a window, and the
    salts' offsets from the counts, which are few. So no task holds more than its share of a large key.
    """
    from pyspark.sql import Window as W

    n = partitions(df.sparkSession)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    placed = salted.withColumn("__nth", F.row_number().over(W.partitionBy(key, "__salt").orderBy(*order)) - 1)
    counts = salted.groupBy(key, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn("__from", F.coalesce(F.sum("__n").over(W.partitionBy(key).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(offsets.select(key, "__salt", "__from"), [key, "__salt"]).withColumn(out, (F.col("__nth") + F.col("__from")).cast("long")).drop("__salt", "__nth", "__from")


# --- hashing of words in numpy -------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: A-Z fold to a-z; the six ASCII white-space bytes end a word.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PIECE = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n + 1:
        size = max(n, _PIECE) + 2
        base, inverse = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 2**64), U64)
        base[0] = inverse[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.cumprod(base), np.cumprod(inverse)
        if n > 4 * _PIECE:  # not kept for one very long word
            out, _powers = _powers, None
            return out
    return _powers


def _words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a piece, and where each starts."""
    gap = np.ones(len(b) + 2, bool)
    gap[1:-1] = _SPACE[b]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    up, down = _power(len(b))
    total = np.zeros(len(b) + 1, U64)
    np.cumsum(_BYTE[_FOLD[b]] * up[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64)), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+`, A-Z folded, and the number of words of each text.

    Works through pieces of about a megabyte that end at white space, so a long text needs no more memory than its words.
    """
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    out, at, i = [], [], 0
    while i < len(joined):
        j = min(len(joined), i + _PIECE)
        while j < len(joined) and not _SPACE[joined[j]]:
            stop = np.flatnonzero(_SPACE[joined[j : j + _PIECE]])
            j = j + int(stop[0]) if len(stop) else min(len(joined), j + _PIECE)
        h, s = _words(joined[i:j])
        out.append(h)
        at.append(s + i)
        i = j
    h = np.concatenate(out) if out else np.zeros(0, U64)
    s = np.concatenate(at) if at else np.zeros(0, np.int64)
    return h, np.diff(np.searchsorted(s, bounds))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """For each text its set of hashed word shingles, sorted. Under `size` words: the whole sequence as one; no words: empty."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    k = max(0, len(words) - size + 1)
    odd = np.random.default_rng(7).integers(1, 2**63, size, dtype=np.uint64) * U64(2) + U64(1)
    h = np.zeros(k, U64)
    for i in range(size):
        h += words[i : i + k] * odd[i]
    h = mix(h)
    out = []
    for n, e in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= size:
            x = np.sort(h[e - n : e - size + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if n > size else x)
        elif n:
            short = words[e - n : e]
            out.append(mix(np.array([int((short * odd[:n]).sum(dtype=U64)) ^ (0xA5A5 + n)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def pieces(texts: list, most: int = 1 << 21):
    """Slices (from, to) of a list of texts that hold about `most` characters, one text at least."""
    i = total = 0
    for j, t in enumerate(texts):
        if total and total + len(t) > most:
            yield i, j
            i, total = j, 0
        total += len(t)
    if texts:
        yield i, len(texts)


def spans(column: pa.Array, most: int = 1 << 21):
    """Slices (from, to) of an Arrow column of texts that hold about `most` bytes, one text at least, without making its texts."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, i, n = np.cumsum(sizes), 0, len(sizes)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


SCHEMA = T
