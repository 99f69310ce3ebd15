"""Batch stages over a queue of rows: a worker is tried on each pending row, what it settles is kept in a ledger, and the rest stays
pending for the next run. And the two halves of a detector around its model: prompts before, records and sinks after."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as words_
from . import detector
from .shared import finished, folders

OUTCOME = T.StructType([T.StructField(c, T.StringType()) for c in ("outcome", "result", "message")])
CHUNK = 64  # rows that a task holds as Python values at once


class Transient(Exception):
    """What a worker needs is taken or gone for now; later it may be there again."""


def attempts(rows: DataFrame, keys: Sequence[str], start: Callable[[], Callable[[dict], str | None]], threads: int = 1) -> DataFrame:
    """keys, outcome, result and message of a try on each row.

    `start` makes the worker, once in a task and only if the task has a row; the worker takes a row as a dict. It returns a string
    (outcome ok) or raises: Transient leaves this row and all that the task hasn't tried yet pending, anything else is an error of
    this row. With threads, so many rows are under way at once, as for calls of a service; rows that were under way beside a
    Transient keep what they gave.
    """
    schema = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in keys), *OUTCOME.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, gone = None, None

        def one(row: dict) -> tuple[str, str | None, str | None]:
            try:
                return "ok", worker(row), None
            except Transient as e:
                return "pending", None, str(e)
            except Exception as e:  # a row's own failure is its outcome
                return "error", None, f"{type(e).__name__}: {e}"[:500]

        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                for at in range(0, b.num_rows, CHUNK):
                    part = b.slice(at, CHUNK)
                    values, found = None if gone else part.to_pylist(), []
                    for first in range(0, part.num_rows, threads):
                        if gone is None and worker is None:
                            try:
                                worker = start()
                            except Transient as e:
                                gone = str(e)
                        if gone is not None:
                            found += [("pending", None, gone)] * (part.num_rows - first)
                            break
                        tried = list(pool.map(one, values[first : first + threads]))
                        gone = next((m for o, _, m in tried if o == "pending"), None)
                        found += tried
                    columns = [part.column(part.schema.get_field_index(k)) for k in keys]
                    columns += [pa.array([f[i] for f in found], pa.string()) for i in range(3)]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, *OUTCOME.names])

    return rows.mapInArrow(run, schema)


class Stage:
    """The ledger of a stage, in a folder that all executors share: for each run its queue, by part, and the outcomes of each part.

    A run first writes down what it will try: the rows that no earlier run has settled. Then each part is a job of its own. So a run
    that was killed and is repeated under its name goes on with the same queue, and calls the worker only for parts that weren't
    finished; one that is finished does nothing. Rows of one key are each tried, and an ok settles the key. A null in a key is a value. Names of runs sort
    as the runs came.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)

    def _same(self, left: DataFrame, right: DataFrame) -> Column:
        same = F.lit(True)
        for k in self.keys:
            same &= left[k].eqNullSafe(right[k])
        return same

    def outcomes(self, schema: T.StructType) -> DataFrame:
        """All outcomes of finished parts, with the name of their run."""
        kinds = T.StructType([*(schema[k] for k in self.keys), *OUTCOME.fields])
        # an empty relation that the optimizer sees as one, so nothing is moved to be compared with it
        out = self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields], F.lit("").alias("run"))
        for name in folders(self.spark, f"{self.path}/outcomes"):
            parts = [f"{self.path}/outcomes/{name}/{i}" for i in folders(self.spark, f"{self.path}/outcomes/{name}")]
            done = [p for p in parts if finished(self.spark, p)]
            if done:
                out = out.unionByName(self.spark.read.schema(kinds).parquet(*done).withColumn("run", F.lit(name)))
        return out

    def settled(self, schema: T.StructType, errors: bool = True) -> DataFrame:
        """keys, outcome, result, message and run of each key that is settled: its first ok, or, with errors, else its first error."""
        known = self.outcomes(schema).where(F.col("outcome").isin("ok", "error") if errors else F.col("outcome") == "ok")
        rest = [*OUTCOME.names, "run"]
        order = F.struct((F.col("outcome") != "ok").alias("bad"), "run", "result", "message")
        return known.groupBy(*self.keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*self.keys, "r.*")

    def pending(self, rows: DataFrame, errors: bool = True) -> DataFrame:
        """The rows whose key isn't settled; errors=False counts those with errors among them."""
        done = self.settled(rows.schema, errors)
        return rows.join(done, self._same(rows, done), "left_anti")

    def run(self, name: str, rows: DataFrame, start: Callable[[], Callable[[dict], str | None]], parts: int = 4, tasks: int | None = None, threads: int = 1, again: bool = False) -> None:
        """Tries all that is pending of `rows`; with `again` what had errors, too."""
        queue = f"{self.path}/queue/{name}"
        if not finished(self.spark, queue):
            h = F.pmod(F.xxhash64(*self.keys), F.lit(parts)).cast("int")
            self.pending(rows, errors=not again).withColumn("__part", h).write.mode("overwrite").partitionBy("__part").parquet(queue)
        whole = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("__part", T.IntegerType())])).parquet(queue)
        for i in range(parts):  # jobs, each over a folder of its own
            out = f"{self.path}/outcomes/{name}/{i}"
            if not finished(self.spark, out):
                # a call takes far longer than moving its row, so rows are dealt evenly
                own = whole.where(F.col("__part") == i).drop("__part").repartition(tasks or self.spark.sparkContext.defaultParallelism)
                attempts(own, self.keys, start, threads).write.mode("overwrite").parquet(out)


# --- before the model --------------------------------------------------------------------------------------------


def prompt(words: Column, title: Column, ask: str, least: int, hint: bool, most: int | None = None) -> Column:
    """The message for a transcript: title, how it is timed, what is said between triple quotes, and what is asked. Null where fewer
    than `least` words are said: no call is needed. `most` is the number of characters that a model takes; by default all."""
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit('Title: "'), title, F.lit('"\n\n'))).otherwise("")

    def timing(timed: Column) -> Column:
        rest = F.greatest(F.size(timed) - 1, F.lit(0))
        gaps = F.zip_with(F.slice(timed, 2, rest), F.slice(timed, 1, rest), lambda b, a: b["start"] - a["end"])
        breaks = F.size(F.filter(gaps, lambda g: g > 1.5))
        length = F.when(F.size(timed) > 0, F.element_at(timed, -1)["end"] - F.element_at(timed, 1)["start"]).otherwise(0.0)
        kind = lambda n: F.when(n >= 6, "many breaks, likely action").otherwise("few breaks, likely narration")
        return words_.let(breaks, lambda n: F.format_string("Timing: %d s, %d words, %d pauses (%s).\n\n", F.bround(length).cast("long"), F.size(words), n, kind(n)))

    def whole(said: Column) -> Column:
        n = F.size(F.filter(F.split(said, r"\s+"), lambda x: x != ""))
        timed = F.filter(words, lambda w: w["start"].isNotNull() & w["end"].isNotNull())
        body = said if most is None else F.substring(said, 1, most)
        return F.when(n >= least, F.concat(head, words_.let(timed, timing) if hint else F.lit(""), F.lit('Transcript:\n"""'), body, F.lit('"""\n\n' + ask)))

    # the words are joined, and their times looked at, once for each transcript
    return words_.let(F.trim(F.array_join(F.transform(words, lambda w: F.trim(F.coalesce(w["word"], F.lit("")))), " ")), whole)


# --- after the model ---------------------------------------------------------------------------------------------

LESSON = "struct<is_instructional: string, genre: string, norms: array<struct<statement: string, category: string>>, demos: array<struct<polarity: string, norm: string, start_quote: string, end_quote: string, explanation: string>>, expected_behavior: string>"


def demo_spans(df: DataFrame, keys: Sequence[str], words: str, answer: str, pad: float = 1.0) -> DataFrame:
    """keys, demo (from 0), polarity, norm, explanation, start, end, clip_start and clip_end of each enacted scene of an answer (JSON).

    A scene starts where the longest prefix of its start quote, three words or more, is said first, and ends with its end quote, or with
    the start quote if that isn't found; what isn't found is null. A clip is `pad` wider on both sides, where the span has a
    length. An answer that isn't JSON, or says no, has no scenes.
    """
    # words are taken apart only where an answer says yes
    a = df.select(*keys, F.col(words).alias("w"), F.from_json(answer, LESSON).alias("a")).where("a.is_instructional = 'yes'")
    a = a.select(*keys, detector.spanned(F.col("w")).alias("w"), "a")
    d = a.select(*keys, "w", F.col("w.token").alias("toks"), F.posexplode("a.demos").alias("demo", "d")).where("d IS NOT NULL")
    tokens = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+"), words_.normalise_token), lambda x: x != "")
    d = d.withColumns({"q1": tokens(F.col("d.start_quote")), "q2": tokens(F.col("d.end_quote"))})
    d = d.withColumns({"at1": detector.located(detector.prefix_at(F.col("toks"), F.col("q1")), 3), "at2": detector.located(detector.prefix_at(F.col("toks"), F.col("q2")), 3)})
    last = lambda at: F.get("w", F.get(at["places"], 0) + at["length"] - 1)["end"]
    lo, hi = F.get("w", F.get("at1.places", 0))["start"], F.coalesce(last(F.col("at2")), last(F.col("at1")))
    d = d.select(*keys, "demo", "d.polarity", "d.norm", "d.explanation", lo.alias("start"), hi.alias("end"))
    clip = F.col("end") > F.col("start")
    return d.withColumns({"clip_start": F.when(clip, F.greatest(F.col("start") - pad, F.lit(0.0))), "clip_end": F.when(clip, F.col("end") + pad)})


def routes(known: Column, kept: Column, modality: Column, verdict: Column, clips: Column) -> Column:
    """Where a settled row ends: null_verified (a planted negative that the detector clears), discussion, hit, truncated (found, but no
    clip could be kept), drop, or miss."""
    return (
        F.when((known == "null") & F.coalesce(verdict.startswith("drop:"), F.lit(False)), "null_verified")
        .when((kept > 0) & (modality == "commentary"), "discussion")
        .when((kept > 0) & (clips > 0), "hit")
        .when(kept > 0, "truncated")
        .when(F.coalesce(verdict.startswith("drop"), F.lit(False)), "drop")
        .otherwise("miss")
    )


def sink_routes(df: DataFrame, path: str, route: str = "route") -> DataFrame:
    """Writes each row below the folder of its route, as JSON lines, all in one pass; a path that is there is an error. Returns what was
    written. Nothing is moved first, so a route that takes most rows has as many tasks as they came in."""
    df.write.mode("errorifexists").partitionBy(route).json(path)
    return df.sparkSession.read.schema(T.StructType([f for f in df.schema.fields if f.name != route] + [T.StructField(route, T.StringType())])).json(path)
