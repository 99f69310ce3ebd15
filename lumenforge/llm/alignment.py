"""Operator 11, alignment of the tokens of two tokenizers by packed bitsets over the bytes of texts.

For a span of texts, one bit of a bitset marks the end of each token, for each tokenizer. The AND of both has the bytes
where both end; its set bits cut the texts into groups, and the rank of a cut (bits set up to it: prefix sums of word
popcounts) is the token that ends there. A link is a pair of tokens whose byte ranges end together, so each cut links its
last A token with its last B token.

How often an id pair is linked is counted over the whole corpus: each task counts its own pairs, Spark sums them. The pairs
of most links, HOT at most, are broadcast and looked up where the documents are; the links of all other pairs, of which
none is frequent, meet their counts in a shuffle join. So what is broadcast is bounded whatever the corpus, and no
link is left out.

Defined cases: a null or empty text, and one whose tokens' bytes aren't the space and the text (such as a text with
U+2581), has no tokens: zeros and an empty string; rows are aligned and counted one by one, also repeated ones and those
with a null doc_id; a text of any length is aligned whole, encoded in pieces that end where no token can cross; an
empty table gives an empty result. Only doc_id and text are read, so no other column can clash.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing
from .byte_bpe import CUT, matched
from .common import Written, small_batches, spans, table, whole_text, with_schema

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of ids whose counts are broadcast, at most.
HOT = 1 << 20
#: Distinct pairs that a task counts before it hands them on.
COUNTED = 1 << 20
#: Bytes of text aligned at once.
SPAN = 1 << 20
_MARK = "▁"
#: Where a text may be cut for B: before a space after a character that isn't one; no piece goes on across it.
_CUT = re.compile(f"(?<=[^ {_MARK}]) ")
#: Where A may match across the space between two words.
_RUN = re.compile(r"\s \s")
#: Characters of words whose ids a worker keeps.
KEPT = 4 << 20
_loaded: dict = {}


class Tokenizers:
    """Both encoders with the bytes of their tokens, and the texts of ids with the marks that stand before them."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a, self.b = packing.encoding(a), sentencepiece.SentencePieceProcessor(model_file=b)
        held = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        pieces = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(_MARK, " ").encode() for i, x in enumerate(held)]
        size = self.a.n_vocab
        self.bytes_a = pa.array([self.a.decode_single_token_bytes(i) for i in range(size)], pa.large_binary())
        self.bytes_b = pa.array(pieces, pa.large_binary())
        self.n_a, self.n_b = size, len(pieces)
        self.words: dict[str, int] = {}
        self.kept, self.ids = 0, [_Ids(), _Ids()]
        marks = [(",", size), (";", size), (",", len(pieces)), ("|", len(pieces))]
        self.shown = pa.array([f"{m}{i}" for m, n in marks for i in range(n)], pa.large_binary())

    def encode_a(self, text: str) -> list[int]:
        if len(text) <= CUT:
            return self.a.encode_ordinary(text)
        return [x for piece, one in matched(text) for x in (self.a._encode_single_piece(piece) if one else self.a.encode_ordinary(piece))]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """A text is cut into pieces of about CUT characters; the space at a cut is the one that B puts before each piece."""
        if max(map(len, texts), default=0) <= CUT:
            return self.b.encode(texts, num_threads=1)
        parts, of = [], []
        for t in texts:
            at, before = 0, len(parts)
            while len(t) - at > CUT and (m := _CUT.search(t, at + CUT)):
                parts.append(t[at : m.start()])
                at = m.end()
            parts.append(t[at:])
            of.append((before, len(parts)))
        ids = self.b.encode(parts, num_threads=1)
        return [ids[i] if j == i + 1 else [x for p in ids[i:j] for x in p] for i, j in of]


    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B the ids of all texts, and how many up to each text (from 0).

        Words repeat, and no token goes across a single space: each new word is encoded once and its ids are kept. Texts with
        runs of white space that hold a space are encoded whole.
        """
        split = [t.split(" ") if t else [] for t in texts]
        whole = [i for i, (t, w) in enumerate(zip(texts, split, strict=True)) if t and ("" in w or _RUN.search(t))]
        for i in whole:
            split[i] = []
        if self.kept > KEPT:
            self.words, self.kept, self.ids = {}, 0, [_Ids(), _Ids()]
        new = list(set().union(*split) - self.words.keys())
        if new:
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
            self.kept += sum(map(len, new))
            self.ids[0].add([self.encode_a(" " + w) for w in new])
            self.ids[1].add(self.encode_b(new))
        items = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(split)), np.int64, sum(map(len, split)))
        ends = np.cumsum([0, *map(len, split)])
        if whole:
            items = np.insert(items, ends[whole], len(self.words) + np.arange(len(whole)))
            ends[1:] += np.cumsum(np.isin(np.arange(len(texts)), whole))
            long = [texts[i] for i in whole]
            return [ids.plus(x).take(items, ends) for ids, x in zip(self.ids, ([self.encode_a(" " + t) for t in long], self.encode_b(long)), strict=True)]
        return [ids.take(items, ends) for ids in self.ids]


class _Ids:
    """Lists of ids by number."""

    def __init__(self, flat: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.flat, self.ends = (np.zeros(0, np.int64), np.zeros(1, np.int64)) if flat is None else (flat, ends)

    def plus(self, more: list[list[int]]) -> _Ids:
        ends = np.cumsum([0, *map(len, more)])
        flat = np.fromiter(itertools.chain.from_iterable(more), np.int64, ends[-1])
        return _Ids(np.concatenate((self.flat, flat)), np.concatenate((self.ends, self.ends[-1] + ends[1:])))

    def add(self, more: list[list[int]]) -> None:
        held = self.plus(more)
        self.flat, self.ends = held.flat, held.ends

    def take(self, items: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.ends[items + 1] - self.ends[items]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        return self.flat[np.arange(upto[-1]) + np.repeat(self.ends[items] - upto[:-1], sizes)], upto[ends]


def tokenizers(a: str, b: str) -> Tokenizers:
    """Loaded once in each Python worker."""
    if (a, b) not in _loaded:
        _loaded[a, b] = Tokenizers(a, b)
    return _loaded[a, b]


def _taken(values: pa.Array, at: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """Where each of the values ends (from 0), and all of them as one run of bytes."""
    got = values.take(pa.array(at))
    ends = np.frombuffer(got.buffers()[1], np.int64)[: len(at) + 1]
    return ends, memoryview(got.buffers()[2] or b"").cast("B")


class Bits:
    """A packed bitset with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, at: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[at] = 1
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def select(self) -> np.ndarray:
        """The set bits, ascending."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each of the places."""
        inside = self.words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at >> 6] + np.bitwise_count(inside)


class Aligned:
    """The tokens of some texts, without those of texts that the tokenizers don't give back, and the cuts that they share.

    a, b: ids; ends_a, ends_b: how many of them up to each text (from 0); cut_a, cut_b: the tokens that end at each cut;
    cuts: the last bytes, counted through all texts; ends: how many cuts up to each text.
    """

    def __init__(self, texts: list[str], tok: Tokenizers):
        spaced = [" " + t if t else "" for t in texts]
        bounds = np.cumsum([0, *(len(t.encode()) for t in spaced)])
        whole = memoryview("".join(spaced).encode())
        held = tok.encode(texts)
        bad = self._differ(*held[0], tok.bytes_a, whole, bounds) | self._differ(*held[1], tok.bytes_b, whole, bounds)
        if bad.any():
            held = [(ids[np.repeat(~bad, np.diff(ends))], np.concatenate(([0], np.cumsum(np.diff(ends) * ~bad)))) for ids, ends in held]
            bounds = np.concatenate(([0], np.cumsum(np.diff(bounds) * ~bad)))
        (self.a, self.ends_a), (self.b, self.ends_b) = held
        size = int(bounds[-1])
        last_a, last_b = np.cumsum(_lengths(tok.bytes_a)[self.a]) - 1, np.cumsum(_lengths(tok.bytes_b)[self.b]) - 1
        in_a, in_b = Bits.of(last_a, size), Bits.of(last_b, size)
        shared = in_a & in_b
        self.cuts = shared.select()
        self.cut_a, self.cut_b = in_a.rank(self.cuts), in_b.rank(self.cuts)
        self.ends = np.searchsorted(self.cuts, bounds)

    @staticmethod
    def _differ(ids: np.ndarray, ends: np.ndarray, of: pa.Array, whole: memoryview, bounds: np.ndarray) -> np.ndarray:
        """Which texts the tokens' bytes don't give back."""
        at, held = _taken(of, ids)
        at = at[ends] if len(ids) else np.zeros(len(ends), np.int64)
        if np.array_equal(at, bounds) and held[: at[-1]] == whole:
            return np.zeros(len(ends) - 1, bool)
        return np.array([held[i:j] != whole[p:q] for i, j, p, q in zip(at[:-1], at[1:], bounds[:-1], bounds[1:], strict=True)])

    def digests(self, tok: Tokenizers) -> list[str]:
        """SHA-256 of each text's groups, `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        end_a, end_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        end_a[self.cut_a] = end_b[self.cut_b] = True
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        first_a, first_b = np.concatenate(([True], end_a[:-1])), np.concatenate(([True], end_b[:-1]))
        order = np.empty(len(self.a) + len(self.b), np.int64)
        if len(order):
            order[np.arange(len(self.a)) + np.concatenate(([0], self.cut_b + 1))[group_a]] = self.a + tok.n_a * first_a
            order[np.arange(len(self.b)) + (self.cut_a + 1)[group_b]] = self.b + 2 * tok.n_a + tok.n_b * first_b
        at, shown = _taken(tok.shown, order)
        ends = self.ends_a + self.ends_b
        return [hashlib.sha256(shown[at[i] + 1 : at[j]]).hexdigest() if j > i else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_sizes: dict[int, np.ndarray] = {}


def _lengths(of: pa.Array) -> np.ndarray:
    if id(of) not in _sizes:
        _sizes[id(of)] = np.diff(np.frombuffer(of.buffers()[1], np.int64)[: len(of) + 1])
    return _sizes[id(of)]


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or public_tokenizers.path(A_FILE), b or public_tokenizers.path(B_FILE)


def _texts(df: DataFrame) -> DataFrame:
    return small_batches(with_schema(df, ("doc_id", "long"), ("text", "string"))).select("doc_id", whole_text().alias("text"))


def align_documents(df: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, the ids a and b, and for each group how many of them lie up to its end: a_to, b_to."""
    a, b = _paths(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(a, b)
        for batch in batches:
            for i, j in spans(batch.column(1), SPAN):
                x = Aligned(batch.column(1)[i:j].to_pylist(), tok)
                n = np.diff(x.ends)
                to_a, to_b = x.cut_a + 1 - np.repeat(x.ends_a[:-1], n), x.cut_b + 1 - np.repeat(x.ends_b[:-1], n)
                columns = [_lists(x.a, x.ends_a), _lists(x.b, x.ends_b), _lists(to_a, x.ends), _lists(to_b, x.ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *columns], ["doc_id", "a", "b", "a_to", "b_to"])

    return _texts(df).mapInArrow(run, "doc_id long, a array<int>, b array<int>, a_to array<int>, b_to array<int>")


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>"


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _measure(df: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each document, with its distinct pairs and how many links each has; rows without a number (`row`) hold sums of a task's pairs."""

    def pairs(keys: np.ndarray, n: np.ndarray, ends: np.ndarray, vocabulary: int) -> list[pa.Array]:
        return [_lists(keys // vocabulary, ends), _lists(keys % vocabulary, ends), _lists(n, ends)]

    def totals(parts: list, vocabulary: int) -> Iterator[pa.RecordBatch]:
        keys, n = _summed(parts)
        for i in range(0, len(keys), 1 << 16):
            k = len(keys[i : i + (1 << 16)])
            nothing = [pa.nulls(1, t) for t in (*[pa.int64()] * 6, pa.string())]
            yield pa.RecordBatch.from_arrays([*nothing, *pairs(keys[i : i + k], n[i : i + k], np.array([0, k]), vocabulary)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen, held, row = tokenizers(a, b), [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j in spans(batch.column(1), SPAN):
                x = Aligned(batch.column(1)[i:j].to_pylist(), tok)
                keys = x.a[x.cut_a] * tok.n_b + x.b[x.cut_b]
                every = tok.n_a * tok.n_b
                n = np.diff(x.ends)
                own, many = np.unique(keys + np.repeat(np.arange(j - i), n) * every, return_counts=True)
                ends = np.searchsorted(own, np.arange(j - i + 1) * every)
                own %= every
                if len(own):
                    seen.append((own, many))
                    held += len(own)
                counts = [np.diff(x.ends_a), np.diff(x.ends_b), n, n]
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(j - i)), batch.column(0)[i:j], *map(pa.array, counts), pa.array(x.digests(tok), pa.string()), *pairs(own, many, ends, tok.n_b)], NAMES)
                row += j - i
                if held > 2 * COUNTED:
                    seen = [_summed(seen)]
                    held = len(seen[0][0])
                    if held > COUNTED:
                        yield from totals(seen, tok.n_b)
                        seen, held = [], 0
        if seen:
            yield from totals(seen, tok.n_b)

    return _texts(df).mapInArrow(run, ALIGNED)


NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


def pair_counts(measured: DataFrame, out: Written) -> DataFrame:
    """a, b, n and whether n is the highest of all pairs with this b."""
    each = measured.where("row IS NULL").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    counts = out.keep(each.groupBy("a", "b").agg(F.sum("n").alias("n")))
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    whole = out.keep(counts.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))
    out.drop(counts)
    return whole


def floor_of(counts: DataFrame, most: int) -> int:
    """A number of links that `most` pairs at most reach."""
    bits = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()  # 64 rows at most
    total, least = 0, 1 << 62
    for r in sorted(bits, key=lambda r: -r["bits"]):
        total += r["n"]
        if total > most:
            break
        least = 1 << r["bits"]
    return least


def measure_documents(df: DataFrame, a: str | None = None, b: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    spark, (a, b) = df.sparkSession, _paths(a, b)
    out = Written(spark)
    measured = out.keep(_measure(df, a, b))
    counts = pair_counts(measured, out)
    least = floor_of(counts, hot)
    known = counts.where(F.col("n") >= least).toArrow()  # `hot` rows at most
    vocabulary = 1 + max(known.column("b").to_pylist(), default=0)
    keys = known.column("a").to_numpy().astype(np.int64) * vocabulary + known.column("b").to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((vocabulary, keys[order], known.column("n").to_numpy()[order], known.column("best").to_numpy()[order]))

    def looked_up(batch: pa.RecordBatch) -> tuple:
        """The flat pairs of a batch: a, b, links, ends of documents, places among the broadcast ones, and whether they are there."""
        vocabulary, keys, _, _ = shared.value
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "n")]
        x, y, n = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        ends = np.cumsum(np.concatenate(([0], columns[0].value_lengths().to_numpy(zero_copy_only=False))))
        wanted = x * vocabulary + y
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        there = (keys[at] == wanted) & (y < vocabulary) if len(keys) else np.zeros(len(wanted), bool)
        return x, y, n, ends, at, there

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, count, best = shared.value
        for batch in batches:
            _, _, n, ends, at, there = looked_up(batch)
            n = n * there
            total = (lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[ends])) if len(count) else (lambda v: np.zeros(len(ends) - 1, np.int64))
            sums = [pa.array(total(n * best[at]) if len(count) else total(n)), pa.array(total(n * count[at]) if len(count) else total(n))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - 3], *sums], [*batch.schema.names[:-3], "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, ends, _, there = looked_up(batch)
            row = np.repeat(batch.column(0).to_numpy(), np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(v[~there], t) for v, t in ((row, pa.int64()), (x, pa.int32()), (y, pa.int32()), (n, pa.int64()))], ["row", "a", "b", "links"])

    docs = measured.where("row IS NOT NULL")
    scored = docs.mapInArrow(score, ALIGNED.split(", a array")[0] + ", n_best long, count_sum long")
    rare = counts.where(F.col("n") < least)
    if not rare.isEmpty():
        met = docs.select("row", "a", "b", "n").mapInArrow(others, "row long, a int, b int, links long").join(rare, ["a", "b"])
        more = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
        whole = scored.join(more, "row", "left").fillna(0, ["more_best", "more_sum"])
        scored = whole.withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})
    return scored.select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_documents(table(spark, sf_dir, "documents"))
