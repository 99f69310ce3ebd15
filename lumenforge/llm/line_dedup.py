"""Operator 1, line dedup by winnowing over line hashes.

Lines are hashed (ends trimmed; lines without words don't count). From every line begins a window: as few lines as
hold MIN_WORDS words. Each window selects its smallest line hash (the last of equal ones) as a fingerprint, so two
texts that share a run of lines with MIN_WORDS words or more are guaranteed to share a fingerprint. Fingerprints that
occur at two places or more are joined to their positions (overlapping windows that select one line are one place; unique
ones, which most are, end here), and each position is extended both ways while the lines agree. To the left, the windows
that begin before are in the run themselves. To the right, a window comes with its longer versions,
line by line, until the lines after its first hold MIN_WORDS words, where the next window takes over. Of each
repeated window or longer version the earliest place in the corpus (by doc_id, then line) stays; the later ones go. So
what goes is every run of MIN_WORDS words or more, to its last line, that stands at an earlier place as well.

Nothing pairs up places: lines agree if the hash of all of them does, the first place of a hash is a minimum, taken before
the shuffle, and later places are joined to that one row, so a line that a third of all documents hold costs as much as
any other; what is joined is written next, so that Spark can split a partition that one line fills. The texts are read by
Python once for the positions, and those with repeats once more. With runs=False, matches aren't extended to the right:
whole windows go, shorter tails of a run stay.

Defined cases: a null text has no lines and comes back null; an empty text stays empty; rows with equal doc_id and
text are one document, none of whose lines repeat the other's; a null doc_id comes first; repeats inside a document go as well;
a run that is shorter than MIN_WORDS words stays; an empty table gives an empty result; a column whose name clashes
with an added one (lines_removed) is replaced, all others, whatever their names, come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Written, fresh, small_batches, spans, table, whole_text

MIN_WORDS = 10


def windows(text: str, least: int = MIN_WORDS, runs: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(fingerprint, its line, first line, last line, hash of the lines) of every window, and with `runs` of its longer versions after it."""
    import xxhash

    at, size, mark = [], [], []
    for i, line in enumerate(text.split("\n")):
        n = len(line.split())
        if n:
            at.append(i)
            size.append(n)
            mark.append(xxhash.xxh3_64_intdigest(line.strip().encode()))
    out, j, total = [], 0, 0
    for i in range(len(at)):
        while total < least and j < len(at):
            total += size[j]
            j += 1
        if total < least:
            break
        part = mark[i:j]
        whole = part[0] if len(part) == 1 else xxhash.xxh3_64_intdigest(b"".join(x.to_bytes(8, "little") for x in part))
        fp = min(part) - 2**63
        place = at[j - 1 - part[::-1].index(fp + 2**63)]
        out.append((fp, place, at[i], at[j - 1], whole - 2**63))
        total -= size[i]
        after, k = total, j
        while runs and k < len(at) and after + size[k] < least:
            after += size[k]
            k += 1
            out.append((fp, place, at[i], at[k - 1], xxhash.xxh3_64_intdigest(b"".join(x.to_bytes(8, "little") for x in mark[i:k])) - 2**63))
    return out


def fingerprints(docs: DataFrame, least: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """A row for each fingerprint of a document (id, h, text): id, h, fp, its first and last place, and the windows that selected it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("w", pa.int64())]))
        for b in batches:
            for i, j in spans(b.column(2)):
                cols: list[list] = [[] for _ in range(6)]
                for d, h, t in zip(*(b.column(c)[i:j].to_pylist() for c in range(3)), strict=True):
                    by: dict[int, tuple[list, list]] = {}
                    for fp, place, a, z, w in windows(t, least, runs):
                        places, wins = by.setdefault(fp, ([], []))
                        places.append(place)
                        wins.append({"a": a, "b": z, "w": w})
                    for fp, (places, wins) in by.items():
                        for c, v in zip(cols, (d, h, fp, min(places), max(places), wins), strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), kind)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "h", "fp", "low", "high", "wins"])

    return small_batches(docs).mapInArrow(run, "id long, h long, fp long, low int, high int, wins array<struct<a: int, b: int, w: long>>")


def key() -> list:
    """What tells documents apart, id and h, as expressions over the columns of a table of documents."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.xxhash64(whole_text())]


def repeated_lines(df: DataFrame, least: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """id, h and gone, the (first, last) lines of the later repeated runs, of each document that has any."""
    written = Written(df.sparkSession)
    i, h = key()
    marks = written.keep(fingerprints(df.select(i.alias("id"), h.alias("h"), whole_text().alias("text")), least, runs))
    at = lambda c: F.struct("id", "h", F.col(c).alias("at"))
    # written, so that the join has shuffles of its own, whose partitions Spark splits where one fingerprint fills them
    seen = written.keep(marks.groupBy("fp").agg(F.min(at("low")).alias("lo"), F.max(at("high")).alias("hi")).where("lo <> hi").select("fp"))
    live = written.keep(marks.join(seen, "fp").select("id", "h", F.explode("wins").alias("x")).select("id", "h", "x.*"))
    written.drop(marks, seen)
    first = written.keep(live.groupBy("w").agg(F.min(F.struct("id", "h", "a")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "first"))
    later = written.keep(live.join(first, "w").where(F.struct("id", "h", "a") > F.col("first")).select("id", "h", "a", "b"))
    written.drop(live, first)
    return later.groupBy("id", "h").agg(F.collect_list(F.struct("a", "b")).alias("gone"))


def dedup_lines(df: DataFrame, least: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """The rows of df, their texts without later repeated runs of lines, n_chars (where it is a column) to match, and lines_removed."""
    kept = [c for c in df.columns if c.lower() != "lines_removed"]
    base = df.select(*(F.col(f"`{c}`") for c in kept))
    i, h, gone, new = fresh(base, "id", "h", "gone", "new")
    spans_ = repeated_lines(base, least, runs).select(F.col("id").alias(i), F.col("h").alias(h), F.col("gone").alias(gone))
    joined = base.withColumns(dict(zip((i, h), key(), strict=True))).join(spans_, [i, h], "left")

    @F.pandas_udf("struct<text: string, n: long>")
    def without(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        texts, counts = [], []
        for t, g in zip(text.tolist(), gone.tolist(), strict=True):
            if g is None:
                texts.append(None)
                counts.append(0)
                continue
            lines = t.split("\n")
            out = bytearray(len(lines))
            for r in g:
                out[r["a"] : r["b"] + 1] = b"\x01" * (r["b"] + 1 - r["a"])
            texts.append("\n".join(x for x, y in zip(lines, out, strict=True) if not y))
            counts.append(sum(out))
        return pd.DataFrame({"text": texts, "n": counts})

    # texts without repeats don't pass through Python
    both = joined.withColumn(new, without(F.when(F.col(gone).isNotNull(), F.col("text")), F.col(gone)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.col(f"{new}.text"))
    cols = [text.alias(c) if c == "text" else F.length(text).cast(df.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in kept]
    return both.select(*cols, F.col(f"{new}.n").alias("lines_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines_removed, and the text that is left."""
    return dedup_lines(table(spark, sf_dir, "documents"), runs=True).select("doc_id", "lines_removed", "text")
