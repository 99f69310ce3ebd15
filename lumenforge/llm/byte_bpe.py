"""Operator 4, byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding at safe boundaries: a blank or line feed whose preceding character is not white
space. No match of the pattern spans such a place and no look-ahead reaches across it, so the pieces' ids put
together are those of the whole text. A long run of white space has no such place, and is too deep for the look-ahead's
backtracking; it's encoded as the pattern would match it: all of it at the end of a text, else all but its last character
as one match. Decoding goes through raw bytes; a token may end inside a character.

Defined cases: a null or empty text has no tokens; equal texts have equal ids; a text of any length is encoded whole;
an empty table gives an empty result; only doc_id and the columns made here are returned, so no column can clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text, with_schema

RANKS = "byte_bpe_50k.tiktoken"
#: Characters after which a text is cut at the next safe boundary.
CUT = 1 << 16
#: White space by the pattern's definition, in runs that are matched here.
_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")
_loaded: dict = {}


def encoding(path: str | None = None, pattern: str | None = None):
    """The tiktoken encoding over a rank file, loaded once in each Python worker. No special tokens."""
    import tiktoken

    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
        _loaded[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def cuts(text: str, most: int = CUT) -> Iterator[str]:
    """The text in pieces of about `most` characters that end at safe boundaries; a piece is longer where there is none."""
    i = 0
    while len(text) - i > most:
        j = i + most
        while j < len(text) and not (text[j] in " \n" and not text[j - 1].isspace()):
            j += 1
        yield text[i:j]
        i = j
    if i < len(text):
        yield text[i:]


def matched(text: str, most: int = CUT) -> Iterator[tuple[str, bool]]:
    """A long text in pieces, and whether a piece is one match of the pattern, a run of white space."""
    at = 0
    for m in _RUN.finditer(text):
        yield from ((p, False) for p in cuts(text[at : m.start()], most))
        at = m.end() - (m.end() < len(text))
        yield text[m.start() : at], True
    yield from ((p, False) for p in cuts(text[at:], most))


def encode(text: str, enc) -> list[int]:
    if len(text) <= CUT:
        return enc.encode_ordinary(text)
    return [x for piece, one in matched(text) for x in (enc._encode_single_piece(piece) if one else enc.encode_ordinary(piece))]


def encode_documents(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), and decoded (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                ids = [encode(t, enc) for t in b.column(1)[i : i + 256].to_pylist()]
                raw = [enc.decode_bytes(x) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 256], pa.array(ids, pa.list_(pa.int32())), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return with_schema(df, ("doc_id", "long"), ("text", "string")).select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and the decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def digest_documents(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As digest(encode_documents(df)), with the digests taken where the ids are, so that no ids go back to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        decimal = [str(i) for i in range(enc.n_vocab)].__getitem__
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1):
                ids = encode(t.as_py(), enc)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return with_schema(df, ("doc_id", "long"), ("text", "string")).select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
