"""The release of a table by pillar, re-processing with quarantine, and tracks of boxes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import tracks
from ..operators.shared import folder
from ..sources import release
from .registry import Tables, query

CONTRACT = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("pillar", T.StringType(), False)])
_PILLAR = "CASE (doc_id % 3) " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(release.PILLARS)) + " END"
_DIGEST = "sum(('0x' || substr(sha256(concat_ws('|', " + ", ".join(f"coalesce('=' || {c}, '-')" for c in ("doc_id", "text", "source")) + ")), 1, 12))::BIGINT)::VARCHAR"


@query(f"SELECT {_PILLAR} AS pillar, count(*) AS n, {_DIGEST} AS digest, true AS intact FROM documents GROUP BY 1")
def release_manifest(t: Tables) -> DataFrame:
    """Documents released by pillar, with the rows and digest of each part as they are read back."""
    d = t.documents.select("doc_id", "text", "source", F.expr(_PILLAR).alias("pillar"))
    path = f"{folder(t.spark)}/release-{uuid.uuid4().hex}"
    release.release(d, path, CONTRACT, ["doc_id"])
    return release.verified(t.spark, path, CONTRACT)


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) > 1 AS again FROM documents) SELECT doc_id, CASE WHEN n_chars < 200 THEN 'too_short' WHEN again THEN 'duplicate' END AS reason FROM f""")
def reprocessed_documents(t: Tables) -> DataFrame:
    """Documents gone through again: short ones and later copies are taken out, with the reason; nothing is deleted. The run is broken off and
    repeated on the way."""
    d = t.documents.select("doc_id", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("name"))
    first = d.groupBy("name").agg(F.min("doc_id").alias("first"))
    table = release.Reprocessing(t.spark, f"{folder(t.spark)}/again-{uuid.uuid4().hex}", buckets=2)
    table.start(d.join(first, "name"), "doc_id")
    reason = F.when(F.col("n_chars") < 200, "too_short").when(F.col("doc_id") > F.col("first"), "duplicate")
    try:
        table.run("one", reason, stop_after=4)
    except InterruptedError:
        table.run("one", reason)
    return table.rows().select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(table.quarantine().select("doc_id", "reason"))


@query()
def box_tracks(t: Tables) -> DataFrame:
    """Boxes of embeddings as faces, by label as clip and eight to a frame, linked one to one from frame to frame."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    x, y = F.col("vec_id") % 8 * 1.0 + e(1), e(2)
    b = t.embeddings.select(F.col("label").cast("long").alias("clip"), F.expr("vec_id div 80").alias("frame"), F.col("vec_id").alias("box"), x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"))
    return tracks.link(b)
