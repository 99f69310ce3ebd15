"""Operator 3, N-gram Jaccard join by partition of the token universe and the pigeonhole principle.

A document is its set of word 5-grams. Two sets of sizes a and b link when their Jaccard similarity is 0.75 or more,
so when they differ in H(a, b) = floor((a + b) / 7) tokens at most. Sets are grouped by size band; for each band the
universe of tokens (their 64-bit hashes) is cut into segments, more than H. The hash of the tokens that a set has in a
segment is a signature. A set is entered under its own band and, where larger partners can lie there, the next.

What two linked sets share. A segment that isn't empty is worth one unit (level 0), or, with the one-deletion
neighbourhoods (level 1: each segment also without one of its tokens), two units where it holds two tokens or more. A
differing token takes one unit at most, so linked sets share more units than a set's budget, its units less H + 1.

Costs are allotted by how many sets have a signature. One that LIMIT sets or fewer have makes pairs. A frequent one
makes none; its units are taken off the budgets of its sets. So a pair must share more rare units than what is left of
either budget, which refuses almost all chance pairs by counting, and it is missed only if both sets have overdrawn their
budgets. Exactly these go to the next level: 0 (segments), 1 (with deletions), 2 (each token a segment of its own).

Cells. Sets that are overdrawn at level 2 share a frequent signature with each linked set that is, too. The first set
of a frequent signature leads it; a set belongs to the cells of the leaders of its signatures, but for the leaders with so
few of them that half of its budget pays for those (two linked sets can't both be spared all that they share). The
pairs of all levels make cells as well: the connected parts of their graph. In a cell, sets are compared as parity sketches
(a bit for each residue, flipped by each token: two sketches differ in no more bits than the sets in tokens) and,
where these allow it, token by token, but only while they aren't in one component yet. A task returns only links that join
two components: fewer than it has sets. A cell above BLOCK is cut into blocks. First each block is compared in itself, then one set for each
block, of its largest component, with those of the other blocks. A group of near copies is one component by then, and each of its texts has
been read once. Only sets that are still outside their cell's largest component go to its other blocks, and, cut into
blocks of their own, to each other: what moves grows with these sets, not with the square of the group, and nothing is left uncompared.

Sets are compared through 64-bit hashes of their tokens, and equal sets, which are one vertex throughout, are recognised
by a 64-bit hash. The result holds the components, not the pairs.

Defined cases: a null or empty text, or one without words, has an empty set and links to nothing; fewer than five
words make one token; equal rows are one vertex; a null doc_id stands before all others and comes back null;
two rows with the same doc_id and different texts each have their own text's links; very long texts are taken whole; an
empty table gives an empty result; only doc_id and the columns made here are returned, so no column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import NULL_ID, U64, Written, fresh, mix, partitions, shingle_sets, small_batches, spans, table, whole_text, with_schema

NUM, DEN, SIZE = 75, 100, 5
#: Sets that share a signature up to which it makes pairs.
LIMIT = 16
#: The last level, at which no budget can be negative from the start.
LAST = 2
#: Tokens, with EXTRA for each set, that a block of a cell holds about.
BLOCK, EXTRA = 1 << 21, 128
#: Signatures that a bucket holds about, and buckets at least, so that small tables are spread as well.
BUCKET, BUCKETS = 1 << 21, 16
#: Sets that are put into signatures at a time; their places take 14 bits.
AT_ONCE = 1 << 14
_K = np.random.default_rng(3).integers(1, 2**63, 4, dtype=np.uint64) * U64(2) + U64(1)


def _bands() -> np.ndarray:
    """First sizes of the bands, each 16/9 of the one before: partners lie in the same or the next band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * DEN * DEN // (NUM * NUM) + 1))
    return np.array(out)


BANDS = _bands()


def most_differing(a, b):
    """Tokens that two linked sets of these sizes differ in at most."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def partner(n):
    """The largest size that a partner can have."""
    return n * DEN // NUM


def _segments(band: np.ndarray) -> np.ndarray:
    top = BANDS[band + 1] - 1
    need = most_differing(top, top) + 1
    return (need * 115 + 99) // 100 + 4


def signatures(sets: list[np.ndarray], level: int) -> tuple[np.ndarray, ...]:
    """(signature, set, in the next band, deletion) of all entries, and (set, in the next band, budget) of each set and band."""
    n = np.array([len(s) for s in sets], np.int64)
    own = np.searchsorted(BANDS, n, side="right") - 1
    out, budgets = [], []
    for ahead in (0, 1):
        use = np.flatnonzero((n > 0) if not ahead else (n > 0) & (partner(n) >= BANDS[np.maximum(own, 0) + 1]))
        if not len(use):
            continue
        size, band = n[use], own[use] + ahead
        tok = np.concatenate([sets[i] for i in use])
        at = np.repeat(np.arange(len(use)), size)
        if level == LAST:
            first, units = np.arange(len(tok)), size
            place = mix(band.astype(U64)[at] * _K[1] + np.full(len(tok), level, U64) * _K[2])
            out.append((mix(mix(tok ^ _K[3]) + place), use[at], np.full(len(tok), ahead, np.uint8), np.zeros(len(tok), np.uint8)))
        else:
            seg = ((tok >> U64(32)) * _segments(band).astype(U64)[at]) >> U64(32)
            first = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (at[1:] != at[:-1]))))
            held = np.diff(np.append(first, len(tok)))
            value = mix(tok ^ _K[3])
            total = np.add.reduceat(value, first)
            place = mix(seg[first] * _K[0] + band.astype(U64)[at[first]] * _K[1] + np.full(len(first), level, U64) * _K[2])
            units = np.bincount(at[first], minlength=len(use))
            out.append((mix(total + place), use[at[first]], np.full(len(first), ahead, np.uint8), np.zeros(len(first), np.uint8)))
            if level == 1:
                units = units + np.bincount(at[first[held > 1]], minlength=len(use))
                where = np.repeat(np.arange(len(first)), held)
                cut = np.flatnonzero(held[where] > 1)
                out.append((mix(total[where[cut]] - value[cut] + place[where[cut]]), use[at[cut]], np.full(len(cut), ahead, np.uint8), np.ones(len(cut), np.uint8)))
        other = partner(size)
        need = most_differing(size, other if ahead else np.minimum(other, BANDS[band + 1] - 1)) + 1
        budgets.append((use, np.full(len(use), ahead, np.uint8), units - need))
    join = lambda parts, k: [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(k)]
    return *join(out, 4), *join(budgets, 3)


def name_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def text_key(text: str) -> list[Column]:
    """The text of a row, for equality: two hashes of 64 bits."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hashes, n (tokens of its set), and name of the set, null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for i, j in spans(texts):
                sets = shingle_sets(texts[i:j].to_pylist(), SIZE)
                names = pa.array([name_of(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(2)[i:j], b.column(3)[i:j], pa.array([len(s) for s in sets], pa.int64()), names], ["doc_id", "h1", "h2", "n", "name"])

    return small_batches(docs).select("doc_id", "text", *(h.alias(n) for h, n in zip(text_key("text"), ("h1", "h2"), strict=True))).mapInArrow(run, "doc_id long, h1 long, h2 long, n long, name long")


_PACKED = ["lo", "hi", "who", "names", "budgets"]
_ENTRIES = "bucket int, " + ", ".join(f"{c} binary" for c in _PACKED)


def entries(docs: DataFrame, level: int, buckets: int) -> DataFrame:
    """The signatures of texts, packed by bucket: five bytes each besides the bucket, and two for the set's place in
    the list of names and budgets that comes with them (with a bit each for next band and deletion).

    docs: text, and where it is known the name of the set; a row whose text has another set is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = b.column(0).cast(pa.binary())
            meant = b.column(1).to_pylist() if b.num_columns > 1 else None
            for i, j in spans(texts, 1 << 21 if level == 0 else 1 << 20):
                kept: list[np.ndarray] = []
                names: list[int] = []
                for k, s in enumerate(shingle_sets(texts[i:j].to_pylist(), SIZE)):
                    # an equal set of this task has entered the same signatures
                    if len(s) and (name := name_of(s)) not in seen and (meant is None or meant[i + k] == name):
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(name)
                        kept.append(s)
                        names.append(name)
                for p in range(0, len(kept), AT_ONCE):
                    yield _packed(kept[p : p + AT_ONCE], np.array(names[p : p + AT_ONCE], np.int64), level, buckets)

    return small_batches(docs).mapInArrow(run, _ENTRIES)


def _packed(sets: list[np.ndarray], names: np.ndarray, level: int, buckets: int) -> pa.RecordBatch:
    sig, which, ahead, cut, who, next_, budget = signatures(sets, level)
    left = np.zeros((len(sets), 2), np.int64)
    left[who, next_] = budget
    bucket = ((sig >> U64(40)) * U64(buckets) >> U64(24)).astype(np.uint16 if buckets <= 65535 else np.int64)
    by = np.argsort(bucket, kind="stable")
    slot = (which * 4 + cut * 2 + ahead).astype(np.uint16)[by]
    sig, bucket = sig[by], bucket[by]
    lo, hi = sig.astype(np.uint32), (sig >> U64(32)).astype(np.uint8)
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    ids, rows = [], []

    def listed(at: np.ndarray) -> list[bytes]:
        return [names[at].tobytes(), np.clip(left[at], 0, 255).astype(np.uint8).tobytes()]

    for x, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if e > s:
            here = np.zeros(len(sets), bool)
            here[slot[s:e] >> 2] = True
            place = (np.cumsum(here) - 1).astype(np.uint16)
            ids.append(x)
            rows.append([lo[s:e].tobytes(), hi[s:e].tobytes(), (place[slot[s:e] >> 2] << 2 | slot[s:e] & 3).tobytes(), *listed(np.flatnonzero(here))])
    if (poor := budget < 0).any():  # overdrawn from the start: told in a row without signatures
        ids.append(-1 - int(names[who[poor][0]] % buckets))
        rows.append([None, None, (np.arange(poor.sum()) << 2 | next_[poor]).astype(np.uint16).tobytes(), *listed(who[poor])])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(5))], ["bucket", *_PACKED])


def _first_of(*cols: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


_MET = ["a", "aa", "b", "bb", "k", "left_a", "left_b"]
_MET_SCHEMA = "a long, aa int, b long, bb int, k int, left_a int, left_b int"


def _meet(level: int):
    """Of a bucket's signatures: pairs of sets with the bands they met in (aa, bb: in the next), shared units and budgets;
    and, with bb = -1, the units k of a set whose frequent signatures the set b leads."""

    def run(t: pa.Table) -> pa.Table:
        def col(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(x for x in t.column(name).to_pylist() if x), kind)

        names, budgets = col("names", np.int64), col("budgets", np.uint8).astype(np.int64)
        per = [len(x) // 8 for x in t.column("names").to_pylist()]
        counts = [len(x) // 2 for x in t.column("who").to_pylist()]
        slot = col("who", np.uint16)
        who = (slot >> 2).astype(np.int64) + np.repeat(np.cumsum([0, *per[:-1]]), counts)
        ahead, cut = (slot & 1).astype(np.int64), (slot >> 1 & 1).astype(np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        if t.column("bucket")[0].as_py() < 0:
            none = np.zeros(len(who), np.int64)
            out.append((names[who], ahead, none, none - 1, none + (1 << 20), none, none))
        else:
            sig = col("lo", np.uint32).astype(U64) | col("hi", np.uint8).astype(U64) << U64(32)
            by = np.argsort(sig)
            sig = sig[by]
            same = np.concatenate(([False], sig[1:] == sig[:-1], [False]))
            live = np.flatnonzero(same[1:] | same[:-1])
            by, sig = by[live], sig[live]
            name, ahead, cut, budget = names[who[by]], ahead[by], cut[by], budgets[2 * who[by] + ahead[by]]
            order = np.lexsort((cut, ahead, name, sig))
            order = order[_first_of(sig[order], name[order], ahead[order], cut[order])]
            sig, name, ahead, cut, budget = sig[order], name[order], ahead[order], cut[order], budget[order]
            if len(sig):
                first = _first_of(sig)
                size = np.diff(np.append(first, len(sig)))
                group = np.repeat(np.arange(len(first)), size)
                apart = name[first] != name[first + size - 1]
                out += [_frequent(level, np.flatnonzero((apart & (size > LIMIT))[group]), name, ahead, cut, budget, name[first][group])]
                out += [_pairs(level, np.flatnonzero((apart & (size <= LIMIT))[group]), group, name, ahead, cut, budget)]
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(7)]
        return pa.table([pa.array(c.astype(np.int64 if m in "ab" else np.int32)) for c, m in zip(cols, _MET, strict=True)], _MET)

    return run


def _frequent(level: int, hot: np.ndarray, name, ahead, cut, budget, leader) -> tuple[np.ndarray, ...]:
    if level < LAST:  # only the last level's leaders are asked for
        leader = np.zeros(len(leader), np.int64)
    by = hot[np.lexsort((leader[hot], ahead[hot], name[hot]))]
    cost = 2 - cut[by] if level == 1 else np.ones(len(by), np.int64)
    new = _first_of(name[by], ahead[by], leader[by])
    at = by[new]
    k = np.add.reduceat(cost, new) if len(new) else cost
    return name[at], ahead[at], leader[at], np.full(len(at), -1), k, budget[at], np.zeros(len(at), np.int64)


def _pairs(level: int, few: np.ndarray, group, name, ahead, cut, budget) -> tuple[np.ndarray, ...]:
    g, found = group[few], []
    for d in range(1, 2 * LIMIT):
        i = np.flatnonzero(g[d:] == g[:-d])
        if not len(i):
            break
        x, y = few[i], few[i + d]
        ok = ((ahead[x] & ahead[y]) == 0) & ((cut[x] & cut[y]) == 0) & (name[x] != name[y])
        found.append((x[ok], y[ok]))
    x, y = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    by = np.lexsort((ahead[y], ahead[x], name[y], name[x]))
    x, y = x[by], y[by]
    k = np.where(cut[x] | cut[y], 1, 2) if level == 1 else np.ones(len(x), np.int64)
    new = _first_of(name[x], name[y], ahead[x], ahead[y])
    k = np.add.reduceat(k, new) if len(new) else k
    x, y = x[new], y[new]
    return name[x], ahead[x], name[y], ahead[y], k, budget[x], budget[y]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parities of the tokens' residues, two bits or more for each token of the largest set: a row of 64-bit words for each set."""
    words = 4
    while words * 32 < max(map(len, sets)):
        words *= 2
    out = np.zeros((len(sets), words), U64)
    for i in range(0, len(sets), step := max(1, (1 << 22) // (64 * words))):
        part = sets[i : i + step]
        at = np.repeat(np.arange(len(part)), [len(s) for s in part])
        tok = (np.concatenate(part) & U64(64 * words - 1)).astype(np.int64)
        bits = (np.bincount(at * (64 * words) + tok, minlength=len(part) * 64 * words) & 1).astype(np.uint8)
        out[i : i + step] = np.packbits(bits).view(U64).reshape(len(part), words)
    return out


def _linked(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    size = np.array([len(x) for x in others])
    tok = np.concatenate(others)
    at = np.minimum(np.searchsorted(a, tok), len(a) - 1)
    common = np.add.reduceat((a[at] == tok).astype(np.int64), np.cumsum([0, *size[:-1]]))
    return (common > 0) & (DEN * common >= NUM * (len(a) + size - common))


def joining(names: list[int], sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """Links of a cell that join two components, until all linked sets are joined. With both sides 0 and 1 given, only
    pairs across are compared. Every pair is either in one component already or compared, by sketch and then by token."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, names, sides = [sets[i] for i in order], [names[i] for i in order], sides[order]
    n = np.array([len(s) for s in sets])
    across = bool((sides != sides[0]).any()) or sides[0] >= STAYS
    bits, part, out = sketches(sets), np.arange(len(sets)), []
    for p in range(len(sets) - 1):
        stop = np.searchsorted(n, partner(n[p]), side="right")
        rest = slice(p + 1, stop)
        ok = part[rest] != part[p]
        if across:
            ok &= sides[rest] != sides[p]
        at = p + 1 + np.flatnonzero(ok)
        if not len(at):
            continue
        apart = np.bitwise_count(bits[at] ^ bits[p]).sum(1, dtype=np.int64)
        near = apart <= most_differing(n[at], n[p])
        at = at[near][np.argsort(apart[near], kind="stable")]
        while len(at):  # a few at a time: most of a component's other members need not be compared once it is joined
            some, at = at[:32], at[32:]
            for q in some[_linked(sets[p], [sets[i] for i in some])]:
                if part[q] != part[p]:
                    out.append((names[p], names[q]))
                    part[part == part[q]] = part[p]
            at = at[part[at] != part[p]]
    return out


_CELL = ["kind", "cell", "i", "j"]


def _in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, cell, i, j, side, name, text), sorted by cell and blocks, to links (a, b)."""
    key, names, sets, sides = None, [], [], []
    found: list[tuple[int, int]] = []

    def close() -> None:
        if len(names) > 1:
            found.extend(joining(names, sets, np.array(sides)))
        names.clear(), sets.clear(), sides.clear()

    def links() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        found.clear()
        return out

    for b in batches:
        texts = b.column(6).cast(pa.binary())
        rows = list(zip(*(b.column(c).to_pylist() for c in range(6)), strict=True))
        for i, j in spans(texts):
            for r, s in zip(rows[i:j], shingle_sets(texts[i:j].to_pylist(), SIZE), strict=True):
                if r[:4] != key:
                    close()
                    key = r[:4]
                # a doc_id may have two texts: it must be the set that was meant; rows may be repeated
                if len(s) and name_of(s) == r[5] and not (names and names[-1] == r[5]):
                    names.append(r[5])
                    sets.append(s)
                    sides.append(r[4])
        yield links()
    close()
    yield links()


def components(edges: DataFrame, written: Written) -> DataFrame:
    """node and label, the smallest node of its component, of all nodes in the edges (a, b). Distributed: each round
    hooks every node to its smallest neighbour, shortens the paths, and contracts the edges."""
    e = written.keep(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = None
    while not e.isEmpty():
        up = written.keep(e.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")))
        while True:
            roots = up.where("a <> p").select(F.col("a").alias("q"), F.col("p").alias("pp"))
            step = written.keep(up.join(roots, up["p"] == roots["q"], "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            up = step.select("a", "p")
            if step.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            labels = written.keep(labels.join(up, labels["label"] == up["a"], "left").select("node", F.coalesce("p", "label").alias("label")))
        x, y = up.select(F.col("a").alias("xa"), F.col("p").alias("xp")), up.select(F.col("a").alias("ya"), F.col("p").alias("yp"))
        e = written.keep(e.join(x, e["a"] == x["xa"]).join(y, F.col("b") == y["ya"]).where("xp <> yp").select(F.col("xp").alias("a"), F.col("yp").alias("b")).distinct())
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("label"))


def meetings(docs: DataFrame, sets: DataFrame, level: int, written: Written) -> DataFrame:
    """What meets in the buckets of one level, over all of them: see _meet. sets: n of the sets that docs hold, for the number of buckets."""
    n = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(BUCKETS, -(-n * (1, 3, 2)[level] // BUCKET))
    met = entries(docs, level, buckets).groupBy("bucket").applyInArrow(_meet(level), _MET_SCHEMA)
    return written.keep(met.groupBy("a", "aa", "b", "bb").agg(F.sum("k").alias("k"), F.min("left_a").alias("left_a"), F.min("left_b").alias("left_b")))


def costs(met: DataFrame) -> DataFrame:
    """name, ahead, cost, budget: what the frequent signatures of a set and band cost."""
    return met.where("bb < 0").groupBy(F.col("a").alias("name"), F.col("aa").alias("ahead")).agg(F.sum("k").alias("cost"), F.min("left_a").alias("budget"))


def likely(met: DataFrame, cost: DataFrame) -> DataFrame:
    """Pairs that share more units than either set has budget left; those that are both overdrawn are left to the next level."""
    pairs = met.where("bb >= 0")
    for x, f in (("a", "aa"), ("b", "bb")):
        pairs = pairs.join(cost.select(F.col("name").alias(x), F.col("ahead").alias(f), F.col("cost").alias(f"cost_{x}")), [x, f], "left")
    most = F.greatest(*(F.col(f"left_{x}") - F.coalesce(f"cost_{x}", F.lit(0)) for x in "ab"))
    return pairs.where((most >= 0) & (F.col("k") > most)).select("a", "b")


def cells_of(met: DataFrame, over: DataFrame) -> DataFrame:
    """name and cell, of overdrawn sets: the leaders of their frequent signatures, without those that half the budget pays for."""
    led = met.where("bb < 0").select(F.col("a").alias("name"), F.col("aa").alias("ahead"), F.col("b").alias("cell"), F.col("k").alias("cost"), F.col("left_a").alias("budget")).join(over, "name")
    paid = F.sum("cost").over(W.partitionBy("name", "ahead").orderBy("cost", "cell").rowsBetween(W.unboundedPreceding, 0))
    return led.withColumn("paid", paid).where("paid > floor(budget / 2)").select("name", "cell").distinct()


def cut(members: DataFrame) -> DataFrame:
    """Members of cells (kind, cell, name, rep, n) of two or more with how many blocks their cell has, and their own: a cell above BLOCK is cut
    by a hash of the name."""
    total = members.groupBy("kind", "cell").agg(F.sum(F.col("n") + EXTRA).alias("w"), F.count(F.lit(1)).alias("size")).where("size > 1")
    d = members.join(total, ["kind", "cell"]).withColumn("blocks", F.ceil(F.col("w") / BLOCK).cast("int"))
    return d.select("kind", "cell", "name", "rep", "n", "blocks", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("own"))


#: Sides of tasks in which only pairs across are compared, also where one side is empty.
STAYS, MOVES = 2, 3


def leaders(known: DataFrame) -> DataFrame:
    """One set for each block of a cell, of the largest component in it, to be compared with those of the cell's other blocks."""
    each = known.groupBy("kind", "cell", "own", "label").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("name", "rep")).alias("x"))
    top = each.groupBy("kind", "cell", "own").agg(F.max_by("x", F.struct("m", "label")).alias("x"))
    return top.select("kind", "cell", F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), "x.name", "x.rep")


def rest(known: DataFrame) -> DataFrame:
    """The tasks that compare what is left of cut cells: sets outside the largest component of their cell move, to each block of those inside
    and to each other; those inside stay where they are. Without any that move there is nothing left to do."""
    size = known.groupBy("kind", "cell", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = size.groupBy("kind", "cell").agg(F.max_by("label", F.struct("m", "label")).alias("most"))
    d = known.join(largest, ["kind", "cell"])
    moving = d.where("label <> most")
    weight = moving.groupBy("kind", "cell").agg(F.ceil(F.sum(F.col("n") + EXTRA) / BLOCK).cast("int").alias("parts"))
    moving = moving.join(weight, ["kind", "cell"]).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "name"), F.col("parts")).cast("int"))
    staying = d.where("label = most").join(weight, ["kind", "cell"])
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = moving.withColumn("o", upto("blocks")).select("kind", "cell", F.col("o").alias("i"), F.col("part").alias("j"), F.lit(MOVES).alias("side"), "name", "rep")
    b = staying.withColumn("o", upto("parts")).select("kind", "cell", F.col("own").alias("i"), F.col("o").alias("j"), F.lit(STAYS).alias("side"), "name", "rep")
    c = moving.withColumn("o", upto("parts"))
    c = c.select((F.col("kind") + 2).alias("kind"), "cell", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), (F.col("part") > F.col("o")).cast("int").alias("side"), "name", "rep")
    return a.unionByName(b).unionByName(c)


class _Join:
    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.written = Written(self.spark)
        self.docs = with_schema(df, ("doc_id", "long"), ("text", "string")).select("doc_id", whole_text().alias("text"))
        self.rows = self.written.keep(described(self.docs))
        # one row for each distinct set
        self.sets = self.written.keep(self.rows.where("name IS NOT NULL").groupBy("name").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("rep"), F.min("n").alias("n")))

    def texts(self, names: DataFrame, source: DataFrame) -> DataFrame:
        """text and name of the sets in `names` (name, rep); a doc_id with two texts gives both, the readers compare the name."""
        return names.join(source, names["rep"] == source["__rep"]).select("text", "name")

    def links(self) -> DataFrame:
        keep, drop = self.written.keep, self.written.drop
        met = meetings(self.docs.select("text"), self.sets, 0, self.written)
        cost = keep(costs(met))
        pairs = keep(likely(met, cost))
        over = keep(cost.where("cost > budget").select("name").distinct())
        drop(met, cost)
        # the texts of all sets that may still have a link: a part of the input, read from here on
        active = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).unionByName(over).distinct()
        reps = active.join(self.sets, "name").select("name", "rep")
        source = self.docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__rep"), "text")
        live = keep(source.join(reps.select("rep").distinct(), source["__rep"] == F.col("rep"), "left_semi"))
        found, level = [pairs], 0
        while not over.isEmpty() and level < LAST:
            level += 1
            known = over.join(self.sets, "name").select("name", "rep", "n")
            met = meetings(self.texts(known, live), known, level, self.written)
            cost = keep(costs(met))
            found.append(keep(likely(met, cost)))
            over = keep(cost.where("cost > budget").select("name").distinct())
            if level < LAST:
                drop(met, cost)
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.unionByName(more)
        groups = components(pairs, self.written)
        members = groups.select(F.lit(0).alias("kind"), F.col("label").alias("cell"), F.col("node").alias("name"))
        if level == LAST:
            members = members.unionByName(cells_of(met, over).select(F.lit(1).alias("kind"), "cell", "name"))
        cells = keep(cut(members.join(self.sets, "name")))
        first = self.compared(cells.select("kind", "cell", F.col("own").alias("i"), F.col("own").alias("j"), F.lit(0).alias("side"), "name", "rep"), live)
        large = cells.where("blocks > 1")
        if large.isEmpty():
            return first
        # a text of a cut cell has been read once so far; what its block has joined decides whether it goes anywhere else
        second = self.compared(leaders(self.known(large, first)), live)
        both = first.unionByName(second)
        return both.unionByName(self.compared(rest(self.known(large, both)), live))

    def known(self, members: DataFrame, links: DataFrame) -> DataFrame:
        labels = components(links, self.written)
        return self.written.keep(members.join(labels, members["name"] == labels["node"], "left").select(*members.columns, F.coalesce("label", "name").alias("label")))

    def compared(self, tasks: DataFrame, live: DataFrame) -> DataFrame:
        """Links (a, b) of tasks (kind, cell, i, j, side, name, rep) that join components of the sets in each."""
        rows = tasks.join(live, tasks["rep"] == live["__rep"]).select(*_CELL, "side", "name", "text")
        # sorted streams: a task holds one cell, or two blocks of one, at a time
        spread = rows.repartition(partitions(self.spark), *_CELL).sortWithinPartitions(*_CELL, "name")
        return self.written.keep(small_batches(spread).mapInArrow(_in_cells, "a long, b long"))

    def result(self) -> DataFrame:
        labels = components(self.links(), self.written)
        least = self.sets.join(labels, F.col("name") == F.col("node"), "left").select("name", "rep", F.coalesce("label", "name").alias("label"))
        first = least.groupBy("label").agg(F.min("rep").alias("component"))
        of = self.written.keep(least.join(first, "label").select("name", "component"))
        self.written.drop(*(f for f, _ in list(self.written.paths.values()) if f is not of and f is not self.rows))
        own = F.coalesce("component", "doc_id")
        out = self.rows.join(of, "name", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(own != NULL_ID, own).alias("component_id"), own.alias("first"), "h1", "h2")


def link_documents(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _Join(df).result().drop("first", "h1", "h2")


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of df, all columns, of which one document of each component stays: the rows with the smallest doc_id.
    A row goes by its doc_id and its text, so another text under the same doc_id stays unless it is linked itself.
    Documents with an empty set, and rows without a doc_id, all stay; where one of these is in a component, it's the one."""
    key, h1, h2 = fresh(df, "gone", "h1", "h2")
    gone = _Join(df).result().where("doc_id <> first").select(F.col("doc_id").alias(key), F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct()
    # the text as the join reads it, in names that df doesn't have
    one, two, text = fresh(df, "__h1", "__h2", "__text")
    whole = df.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    whole = whole.withColumns(dict(zip((one, two), text_key(text), strict=True))).drop(text)
    same = (F.col("doc_id").cast("long") == F.col(key)) & (F.col(one) == F.col(h1)) & (F.col(two) == F.col(h2))
    return whole.join(gone, same, "left_anti").select(*[f"`{c}`" for c in df.columns])


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))
