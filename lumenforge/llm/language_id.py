"""Operator 5, language identification by Bayesian evidence fusion.

Text gives a likelihood of each language: hashed byte trigrams under a naive Bayes model, fitted on about FIT_ROWS
labelled rows (sampled by a hash of key and text, so that a text which many rows share counts by its share), tempered to the weight of WORTH trigrams because
neighbours aren't independent. Beside the languages stands a background class for all other text, junk included: every
bucket is equally likely under it. Three more pieces of evidence come from grouped aggregation over all rows, in which each
row counts by its text's posterior: how often rows of a language declare which markup language, and what share each
language has overall, in an address suffix, and on a host. The host's share is smoothed towards its suffix's, and that
towards the overall one. The posterior is the product, normalised over the languages and the background. lang
is the best of the languages; a row is accepted if it holds letters and that one reaches ACCEPT, so text that is likelier
under the background is not. A language without labelled rows stays below the background, so it is never accepted.

Defined cases: null and empty texts and texts without letters are undetermined (lang null, accepted false); a null
host or suffix is one group; a null or unknown declared language counts as "other"; ties go to the first language by
name; equal rows get equal results; a text of any length is read whole; an empty table gives an empty result; only
the key and the columns made here are returned, so no column can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fresh, table, whole_text

FIT_ROWS = 8000
BUCKETS = 1 << 15
WORTH = 40
SMOOTH = 20.0
#: Log probability of any bucket under the background class.
BACKGROUND = -float(np.log(BUCKETS))
ACCEPT = 0.5
#: Hosts and suffixes up to this number of rows are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 20_000
_LETTER = re.compile(r"[^\W\d_]")


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each text between blanks, A-Z folded, and how many each has."""
    flat = np.frombuffer(b"".join(b" " + t + b" \x00" for t in texts) + b"\x00\x00", np.uint8)
    low = np.where((flat >= 65) & (flat <= 90), flat + 32, flat)
    low = np.where((low < 65) & (low > 0), 32, low).astype(np.uint32)  # digits, marks and white space
    g = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)
    g ^= g >> np.uint32(15)
    bucket = (g * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    size = np.array([len(t) + 3 for t in texts])
    live = (low[:-2] > 0) & (low[1:-1] > 32) & (low[2:] > 0)
    return np.where(live, bucket, BUCKETS), size


def fit(rows: DataFrame, languages: list[str], most: int = FIT_ROWS) -> np.ndarray:
    """Log probabilities (language, bucket); a last column of zeros. rows: text, declared, and a key."""
    n = rows.where(F.col("declared").isin(languages)).count()
    bound = int(min(1.0, most / max(n, 1)) * 2**32)
    sample = rows.where(F.col("declared").isin(languages) & (F.pmod(F.xxhash64(*rows.columns), F.lit(2**32)) < bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS + 1), np.int64)
        for b in batches:
            lang = b.column(1).to_pylist()
            for t, x in zip(b.column(0).to_pylist(), lang, strict=True):
                g, _ = _grams([t.encode()])
                total[languages.index(x)] += np.bincount(g, minlength=BUCKETS + 1)
        for i, row in enumerate(total[:, :BUCKETS]):
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])

    counts = sample.select(whole_text().alias("text"), "declared").mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    c = np.zeros((len(languages), BUCKETS))
    found = counts.toPandas()  # languages times buckets at most
    c[found["lang"], found["bucket"]] = found["n"]
    total = c.sum(1, keepdims=True)
    p = (c + 0.05) / (np.where(total > 0, total, total.max()) + 0.05 * BUCKETS)  # without labelled rows, all is unseen
    return np.concatenate([np.log(p), np.zeros((len(languages), 1))], 1).astype(np.float32)


def text_likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """key columns, host, suffix and declared, and ll, the tempered log likelihoods, the background's last (null: no letters)."""
    keys = [c for c in rows.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            out: list = []
            i = 0
            while i < len(texts):
                j, total = i, 0
                while j < len(texts) and (j == i or total + len(texts[j]) < 1 << 20):
                    total += len(texts[j])
                    j += 1
                g, size = _grams([t.encode() for t in texts[i:j]])
                begin = np.cumsum(size) - size
                n = np.add.reduceat(np.append(g < BUCKETS, False), begin)
                sums = np.stack([np.add.reduceat(np.append(m[g], np.float32(0)), begin) for m in model], 1)
                mean = sums / np.maximum(n, 1)[:, None]
                mean = np.append(mean, np.full((len(mean), 1), BACKGROUND), 1)
                for t, k, row in zip(texts[i:j], n.tolist(), (mean * np.minimum(n, WORTH)[:, None]).astype(float).round(6).tolist(), strict=True):
                    out.append(row if k and _LETTER.search(t) else None)
                i = j
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), pa.array(out, pa.list_(pa.float64()))], [*keys, "ll"])

    return rows.mapInArrow(run, f"{fields}, ll array<double>")


def _softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def fuse(scored: DataFrame, languages: list[str]) -> DataFrame:
    """Adds lang, posterior, text_lang and accepted to rows with ll, declared, suffix and host."""
    n = len(languages)
    d = scored.withColumn("__said", F.when(F.col("declared").isin(languages), F.col("declared")).otherwise("other"))
    d = d.withColumns({"__host": F.coalesce("host", F.lit("")), "__suffix": F.coalesce("suffix", F.lit(""))})
    soft = d.where("ll IS NOT NULL").withColumn("__p", _softmax(F.col("ll")))
    sums = [F.sum(F.col("__p")[i]).alias(f"s{i}") for i in range(n)]
    hosts = checkpoint(soft.groupBy("__suffix", "__host", "__said").agg(*sums))  # a row for each host, not for each document
    add = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    total = hosts.agg(*add).first()
    whole = sum(x or 0.0 for x in total)
    overall = [((x or 0.0) + 1.0) / (whole + n) for x in total]
    said = {r["__said"]: [r[f"s{i}"] for i in range(n)] for r in hosts.groupBy("__said").agg(*add).collect()}  # languages and "other"
    kinds = [*languages, "other"]
    table_ = {k: [float(np.log((said.get(k, [0.0] * n)[i] + 1.0) / ((total[i] or 0.0) + len(kinds)))) for i in range(n)] + [-float(np.log(len(kinds)))] for k in kinds}
    declared = F.create_map(*[x for k in kinds for x in (F.lit(k), F.array(*[F.lit(v) for v in table_[k]]))])[F.col("__said")]

    even = -float(np.log(n + 1))  # the background's prior on any host
    up = hosts.groupBy("__suffix").agg(*add)
    mass = sum((F.col(f"s{i}") for i in range(1, n)), F.col("s0"))
    up = up.select("__suffix", F.array(*[(F.col(f"s{i}") + SMOOTH * overall[i]) / (mass + SMOOTH) for i in range(n)]).alias("__up"))
    own = hosts.groupBy("__suffix", "__host").agg(*add).join(up, "__suffix")
    prior = own.select("__suffix", "__host", F.array(*[F.log((F.col(f"s{i}") + SMOOTH * F.col("__up")[i]) / (mass + SMOOTH)) for i in range(n)], F.lit(even)).alias("__prior"))
    if hosts.count() <= BROADCAST_ROWS:
        prior = F.broadcast(prior)
    d = d.join(prior, ["__suffix", "__host"], "left")
    fallback = F.array(*[F.lit(float(np.log(x))) for x in overall], F.lit(even))
    joint = F.when(F.col("ll").isNotNull(), F.zip_with(F.zip_with("ll", declared, lambda a, b: a + b), F.coalesce("__prior", fallback), lambda a, b: a + b))
    names = F.array(*[F.lit(x) for x in languages])
    first = lambda c: F.get(names, -F.array_max(F.transform(c, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))["i"])
    d = d.withColumn("__joint", joint)
    own_ = lambda c: F.slice(c, 1, n)
    best = F.array_max(own_("__joint"))
    d = d.withColumns(
        {
            "lang": first(own_("__joint")),
            "posterior": F.round(1.0 / F.aggregate("__joint", F.lit(0.0), lambda s, x: s + F.exp(x - best)), 4),
            "text_lang": first(own_("ll")),
        }
    )
    return d.withColumn("accepted", F.coalesce(F.col("posterior") >= ACCEPT, F.lit(False))).drop("__said", "__host", "__suffix", "__prior", "__joint", "ll")


LANGUAGES = ["de", "en", "es", "fr"]


def identify(rows: DataFrame, languages: list[str] | None = None, model: np.ndarray | None = None) -> DataFrame:
    """rows: key columns, text, declared, suffix and host. Returns the key columns with the fused result."""
    languages = sorted(languages or LANGUAGES)
    rows = rows.withColumn("text", whole_text())
    model = fit(rows, languages) if model is None else model
    return fuse(checkpoint(text_likelihoods(rows, model)), languages)


def document_rows(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return df.select("doc_id", "text", col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), col("source").alias("host"))


def page_rows(df: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    said = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html[^>]*\slang\s*=\s*["']?([a-z]+)""", 1))
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&\w+;", " ")
    return df.select("page_id", text.alias("text"), F.nullif(said, F.lit("")).alias("declared"), F.nullif(F.regexp_extract(host, r"\.([a-z0-9\-]+)$", 1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"))


def accepted_documents(df: DataFrame) -> DataFrame:
    """The rows of df, all columns, without those whose language is not accepted."""
    from .line_dedup import key

    have = set(df.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    i, h = fresh(df, "id", "h")
    ids = dict(zip((i, h), key(), strict=True))
    rows = df.select(*(v.alias(k) for k, v in ids.items()), "text", col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), col("source").alias("host"))
    gone = checkpoint(identify(rows).where(~F.col("accepted")).select(i, h).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return df.withColumns(ids).join(gone, [i, h], "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(document_rows(table(spark, sf_dir, "documents"))).select("doc_id", "lang", "posterior", "text_lang", "declared", "accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(page_rows(table(spark, sf_dir, "pages"))).select("page_id", "host", "suffix", "lang", "posterior", "text_lang", "declared", "accepted")


__all__ = ["accepted_documents", "identify", "language_id_pages", "op5_language_id", "page_rows"]
