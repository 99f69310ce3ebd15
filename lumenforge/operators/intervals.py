"""Joins and windows over intervals of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], bucket: float, closed: bool = True, pad: float = 0.0) -> DataFrame:  # noqa: E741
    """Inner join of rows with equal keys whose intervals overlap (closed, or half-open with closed=False), right ones padded.

    Both sides are cut at multiples of `bucket` and joined on key and bucket, so a key that holds a large share of the
    rows is spread; a pair counts in the bucket where its overlap begins, which keeps it single.
    """
    span = lambda a, b: F.sequence(F.floor(a / bucket).cast("long"), F.floor(b / bucket).cast("long"))
    rs, re = F.col(r[0]) - pad, F.col(r[1]) + pad
    a = left.withColumn("__b", F.explode(span(F.col(l[0]), F.col(l[1]))))
    b = right.withColumn("__b", F.explode(span(rs, re)))
    ls, le = F.col(l[0]), F.col(l[1])
    meet = (ls <= re) & (rs <= le) if closed else (ls < re) & (rs < le)
    home = F.floor(F.greatest(ls, rs) / bucket) == F.col("__b")
    return a.join(b, [*keys, "__b"]).where(meet & home).drop("__b")


def outside(df: DataFrame, zones: DataFrame, keys: list[str], d: tuple[str, str], z: tuple[str, str], pad: float, bucket: float) -> DataFrame:
    """Rows that touch no zone of the same key."""
    cols = df.columns
    mark = df.withColumn("__row", F.struct(*cols))
    hit = overlap_join(mark, zones.select(*keys, *z), keys, d, z, bucket, True, pad).select("__row").distinct()
    return mark.join(hit, "__row", "left_anti").select(*cols)


def as_of(events: DataFrame, states: DataFrame, keys: list[str], at: str, since: str, value: str, out: str) -> DataFrame:
    """The last value at or before each event, by one union and window: each row is sorted once, no range join."""
    e = events.withColumns({"__t": F.col(at), "__k": F.lit(1), "__v": F.lit(None).cast(states.schema[value].dataType)})
    s = states.select(*keys, F.col(since).alias("__t"), F.lit(0).alias("__k"), F.col(value).alias("__v"))
    w = W.partitionBy(*keys).orderBy("__t", "__k").rowsBetween(W.unboundedPreceding, 0)
    both = e.unionByName(s, allowMissingColumns=True)
    return both.withColumn(out, F.last("__v", ignorenulls=True).over(w)).where("__k = 1").drop("__t", "__k", "__v")


def gap_islands(df: DataFrame, keys: list[str], at: Column, gap: float, order: list[str], out: str = "island") -> DataFrame:
    """Numbers runs of rows whose neighbours are `gap` apart at most."""
    w = W.partitionBy(*keys).orderBy(at, *order)
    start = F.coalesce((at - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("__s", start).withColumn(out, F.sum("__s").over(w).cast("long")).drop("__s")


def merge_overlaps(df: DataFrame, keys: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """Numbers groups of overlapping intervals by the running maximum of their ends."""
    w = W.partitionBy(*keys).orderBy(start, *order)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("__s", F.coalesce((F.col(start) > before).cast("int"), F.lit(1))).withColumn("group", F.sum("__s").over(w).cast("long")).drop("__s")


def longest_run(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The length of the longest run of consecutive integers."""
    w = W.partitionBy(*keys).orderBy(at)
    g = df.select(*keys, at).distinct().withColumn("__g", F.col(at) - F.row_number().over(w))
    return g.groupBy(*keys, "__g").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("longest_run"))


def tiles(length: Column, size: float, step: float, tolerance: float = 1e-6) -> Column:
    """Starts of windows of `size` every `step`; the last one ends at the end of the medium."""
    last = F.greatest(F.lit(0.0), length - size)
    regular = F.filter(F.transform(F.sequence(F.lit(0), F.floor(last / step).cast("int")), lambda i: i * F.lit(float(step))), lambda s: s <= last + tolerance)
    return F.when(last - F.element_at(regular, -1) > tolerance, F.array_append(regular, last)).otherwise(regular)


def thinned(df: DataFrame, key: str, at: str, apart: float, order: list[str], strict: bool = False) -> DataFrame:
    """Greedy thinning: of each key the rows that come `apart` or more (strict: more) after the last one kept.

    Which rows stay depends on those kept before, so a key is one sorted stream; only its last kept time is held, in batches of
    rows, so a key with many rows needs no more memory than one with few.
    """
    import pyarrow as pa

    def run(batches):
        now = last = None
        for b in batches:
            keep = []
            for k, t in zip(b.column(b.schema.get_field_index(key)).to_pylist(), b.column(b.schema.get_field_index(at)).to_pylist(), strict=True):
                if k != now:
                    now, last = k, None
                stays = last is None or (t - last > apart if strict else t - last >= apart)
                keep.append(stays)
                last = t if stays else last
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.repartition(key).sortWithinPartitions(key, at, *order).mapInArrow(run, df.schema)


def beside(df: DataFrame, keys: list[str], at: str, conditional: Column, anchor: Column, within: float, bucket: float | None = None) -> DataFrame:
    """Unconditional rows, and conditional ones with an anchor of the same keys within a distance."""
    size = bucket or max(within, 1.0)
    marks = df.where(anchor & ~conditional).select(*keys, F.col(at).alias("__a")).withColumn("__b", F.explode(F.array(*[F.floor(F.col("__a") / size) + i for i in (-1, 0, 1)]))).distinct()
    wanted = df.where(conditional).withColumn("__b", F.floor(F.col(at) / size))
    kept = wanted.join(marks, (reduce_eq(wanted, marks, [*keys, "__b"])) & (F.abs(F.col(at) - F.col("__a")) <= within), "left_semi").drop("__b")
    return df.where(~conditional).unionByName(kept)


def reduce_eq(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = a[keys[0]] == b[keys[0]]
    for k in keys[1:]:
        out = out & (a[k] == b[k])
    return out


def with_tail(total: Column, size: float, stride: float, tolerance: float = 0.25) -> Column:
    """Windows (start, end) of `size` at every stride while they end before `total`, and one that ends there, unless the one before starts
    within the tolerance; a shorter total is one window."""
    n = F.ceil((total - size) / stride)
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(stride))
    last = total - size
    far = F.abs(F.element_at(starts, -1) - last) > tolerance
    whole = F.when(far, F.concat(starts, F.array(last))).otherwise(starts)
    each = F.transform(F.when(total > size, whole), lambda s: F.struct(s.alias("start"), F.least(total, s + size).alias("end")))
    one = F.array(F.struct(F.lit(0.0).alias("start"), total.cast("double").alias("end")))
    return F.when(total > size, each).when(total.isNotNull(), one)


def rebased(segments: Column, trims: Column) -> Column:
    """Segments (array of start, end, text) carried through a chain of trims (array of start, end), each in the time of the cut before: what
    doesn't touch a trim goes, the rest moves to its time, uncut. As long as a transcript times its repairs."""
    shape = "array<struct<start:double,end:double,text:string>>"

    def cut(held: Column, trim: Column) -> Column:
        kept = F.filter(held, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (s["end"] >= trim["start"]) & (s["start"] <= trim["end"]))
        return F.transform(kept, lambda s: F.struct(F.round(s["start"] - trim["start"], 3).alias("start"), F.round(s["end"] - trim["start"], 3).alias("end"), s["text"].alias("text"))).cast(shape)

    return F.aggregate(trims, segments.cast(shape), cut)
