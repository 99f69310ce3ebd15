"""The corpus on disk as tables: items in three layouts, transcripts, sidecars, feature ledgers; numbered errors of JSON lines; sealed outputs.

Files are listed and read by Spark; keys come from file names. Many small files are one scan, not one task each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ledgers import digest, read_jsonl, seal

#: Where each pillar's items lie below the root, and how the uid stands in the path.
LAYOUTS = {"witnessed": ("data/hits/*/metadata.json", r"/([^/]+)/metadata\.json$"), "instructional": ("data/instructional/*/metadata.json", r"/([^/]+)/metadata\.json$"), "commentary": ("data/discussion/*.json", r"/([^/]+)\.json$")}
#: Fields of a sidecar that are kept, texts cut at 4,000 characters as the sidecar format has it.
SIDECAR = ["title", "description", "channel", "uploader", "tags", "categories", "duration", "webpage_url", "language"]


def _path() -> Column:
    return F.col("_metadata.file_path")


def _exists(spark: SparkSession, pattern: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def documents_of(spark: SparkSession, root: str, pillar: str) -> DataFrame:
    """pillar, uid and body (JSON text) of every item of a pillar, in the order of file names when sorted by uid; empty if there is none."""
    pattern, key = LAYOUTS[pillar]
    if not _exists(spark, f"{root}/{pattern}"):
        return spark.createDataFrame([], "pillar string, uid string, body string")
    files = spark.read.text(f"{root}/{pattern}", wholetext=True)
    return files.select(F.lit(pillar).alias("pillar"), F.regexp_extract(_path(), key, 1).alias("uid"), F.col("value").alias("body"))


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """All items of the three layouts."""
    out = documents_of(spark, root, "witnessed")
    for pillar in ("instructional", "commentary"):
        out = out.unionByName(documents_of(spark, root, pillar))
    return out


SEGMENTS = "array<struct<start: double, end: double, text: string>>"


def with_segments(items: DataFrame, root: str, folder: str = "data/transcripts") -> DataFrame:
    """Items with the segments of their transcript; a missing or unreadable transcript is an empty array, not an error."""
    spark = items.sparkSession
    empty = F.array().cast(SEGMENTS)
    if not _exists(spark, f"{root}/{folder}/*.json"):
        return items.withColumn("segments", empty)
    t = spark.read.text(f"{root}/{folder}/*.json", wholetext=True).select(F.regexp_extract(_path(), r"/([^/]+)\.json$", 1).alias("uid"), F.from_json("value", f"segments {SEGMENTS}").getField("segments").alias("segments"))
    return items.join(t, "uid", "left").withColumn("segments", F.coalesce("segments", empty))


def sidecars(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """One row for each uid of the sidecars in some folders: the first folder wins; empty values come back null; names without a platform are left out."""
    schema = ", ".join(f"{f} {'array<string>' if f in ('tags', 'categories') else 'double' if f == 'duration' else 'string'}" for f in SIDECAR)
    out = None
    for i, folder in enumerate(folders):
        if not _exists(spark, f"{root}/{folder}/*.info.json"):
            continue
        d = spark.read.text(f"{root}/{folder}/*.info.json", wholetext=True).select(F.regexp_extract(_path(), r"/([^/]+)\.info\.json$", 1).alias("uid"), F.lit(i).alias("folder"), F.from_json("value", schema).alias("s"))
        out = d if out is None else out.unionByName(d)
    if out is None:
        return spark.createDataFrame([], f"uid string, source string, {schema}")
    kept = out.where(F.contains("uid", F.lit("__"))).groupBy("uid").agg(F.min_by("s", "folder").alias("s"))

    def shown(f: str) -> Column:
        c = F.col(f"s.{f}")
        return F.when(F.size(c) > 0, c).alias(f) if f in ("tags", "categories") else c.alias(f) if f == "duration" else F.nullif(F.substring(c, 1, 4000), F.lit("")).alias(f)

    return kept.select("uid", F.substring_index("uid", "__", 1).alias("source"), *[shown(f) for f in SIDECAR])


FEATURES = "uid string, pillar string, clip string, error string, low_level map<string, double>, keypoints map<string, double>, clip_scores struct<mean_probabilities: array<double>>"


def feature_index(spark: SparkSession, ledgers: list[str]) -> DataFrame:
    """Features by pillar, uid and the index in the medium's file name (0 without one). Failed rows are left out; later ledgers, and
    within one later rows, override. Rows of a ledger of several files go by file, block and place in the block: numbers of rows are only
    compared within a block, which one task reads in order, however files are packed into tasks."""
    out = None
    for i, path in enumerate(ledgers):
        d = spark.read.schema(FEATURES).json(path).select("*", F.lit(i).alias("ledger"), _path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        out = d if out is None else out.unionByName(d)
    if out is None:
        return spark.createDataFrame([], "pillar string, uid string, idx int, low_level map<string, double>, keypoints map<string, double>, clip_scores struct<mean_probabilities: array<double>>")
    named = F.regexp_extract(F.coalesce("clip", F.lit("")), r"(?:clip|demo)_(\d+)\.mp4$", 1)
    ok = out.where((F.coalesce("error", F.lit("")) == "") & (F.coalesce("uid", F.lit("")) != "") & (F.coalesce("pillar", F.lit("")) != "")).withColumn("idx", F.when(named == "", 0).otherwise(named.cast("int")))
    last = F.max_by(F.struct("low_level", "keypoints", "clip_scores"), F.struct("ledger", "path", "block", "row"))
    return ok.groupBy("pillar", "uid", "idx").agg(last.alias("f")).select("pillar", "uid", "idx", "f.*")


def trajectory(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Query rows of a trajectory ledger, gzip or not; the kind is tested where lines are read."""
    return read_jsonl(spark, path, schema, "drop").where("kind = 'query'")


def numbered_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of which every one must be an object of the schema: raises with the file and the number of its first bad line.
    Blank lines are skipped, and counted."""
    held = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).select("value", _path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    parsed = lines.withColumn("x", F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    full = F.trim("value") != ""
    bad = parsed.where(full & F.col("x._corrupt_record").isNotNull()).agg(F.min(F.struct("path", "block", "row")).alias("first")).first()["first"]
    if bad is not None:
        number = lines.where((F.col("path") == bad["path"]) & ((F.col("block") < bad["block"]) | (F.col("block") == bad["block"]) & (F.col("row") <= bad["row"]))).count()
        raise ValueError(f"{re.sub(r'^file:', '', bad['path'])}:{number}: not a JSON object of the schema")
    return parsed.where(full).select(*[F.col(f"x.{f.name}").alias(f.name) for f in schema.fields])


def seal_all(outputs: dict[str, tuple[DataFrame, list[str]]], path: str) -> DataFrame:
    """Writes several outputs once, each below the path, and a summary that names the rows and the digest of each, with a digest of
    all of these: whoever holds the summary can tell whether anything was changed."""
    rows = []
    for name, (df, keys) in sorted(outputs.items()):
        seal(df, f"{path}/{name}")
        d = digest(df.sparkSession.read.schema(df.schema).json(f"{path}/{name}"), keys).first()
        rows.append((name, d["n"], d["digest"]))
    spark = next(iter(outputs.values()))[0].sparkSession
    found = spark.createDataFrame(rows, "output string, n long, digest string")  # a row for each output
    manifest = found.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "output", "digest")))), 256).alias("manifest_sha256"))
    out = found.join(F.broadcast(manifest), F.lit(True))
    seal(out, f"{path}/summary")
    return out
