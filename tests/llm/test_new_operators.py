"""Alignment, url filters and hard negatives against brute force, with nulls, ties, repeats, long texts, empty tables and clashing columns."""

import hashlib
import json
import os
import random
import re
import struct
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenforge.llm import alignment, hard_negatives, html_extract, jaccard_join, language_id, sharding, url_filter


# --- alignment -----------------------------------------------------------------------------------


def aligned(rows):
    """The contract, by the two libraries themselves and dictionaries of ends."""
    a_path, b_path = alignment._paths(None, None)
    one, two = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    one.encode_special_tokens = True
    with open(a_path, encoding="utf-8") as f:
        vocabulary = {i: k for k, i in json.load(f)["model"]["vocab"].items()}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}

    def bytes_a(i):
        return bytes(byte[c] for c in vocabulary[i])

    def bytes_b(i):
        return bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("\u2581", " ").encode()

    out, links = [], []
    for d, text in rows:
        whole = (" " + text).encode() if text else b""
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        if b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
            a, b = [], []
        at = [dict(zip(np.cumsum([len(f(i)) for i in ids]).tolist(), range(1, len(ids) + 1), strict=True)) for ids, f in ((a, bytes_a), (b, bytes_b))]
        groups, x, y = [], 0, 0
        for cut in sorted(at[0].keys() & at[1].keys()):
            groups.append((a[x : at[0][cut]], b[y : at[1][cut]]))
            x, y = at[0][cut], at[1][cut]
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        links.append([(p[-1], q[-1]) for p, q in groups])
        out.append((d, len(a), len(b), len(groups), len(groups), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    n, most = Counter(p for of in links for p in of), defaultdict(int)
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    return sorted([(*o[:5], sum(n[p] == most[p[1]] for p in of), sum(n[p] for p in of), o[5]) for o, of in zip(out, links, strict=True)], key=repr)


def texts():
    r = random.Random(5)
    odd = [None, "", " ", "  two  spaces  ", "\n\t x", "x\n \ny", "a\u2581b", "<s> <0x41> </s> <|endoftext|> x", "é日本語   𝄞 ｆｕｌｌ", "\0 nul", "x" * 5000, " " * 9000 + "x" + " " * 9000, "same text", "same text"]
    odd.append(" ".join(r.choice(["ab", "été", "  ", "日本", "\n\n"]) for _ in range(60_000)))
    odd += ["".join(r.choice(["a", "B", " ", " ", "\n", "\t", "é", "12", "'s", ".", "\r\n", "日", "\u2581"]) for _ in range(r.randint(1, 14))) for _ in range(300)]
    odd += [" ".join(r.choice(["the", "thing", "entre", "and", "over,", "1234", "naïve"]) for _ in range(40)) for _ in range(40)]
    return [(None if i % 50 == 0 else i, t, "clash", i) for i, t in enumerate(odd)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string, n_a string, row long").repartition(3)


@pytest.mark.parametrize("hot", [alignment.HOT, 40, 0])
def test_alignment(odd, hot):
    """With all pairs broadcast, with some, and with none: the others meet their counts in a join."""
    want = aligned([r[:2] for r in texts()])
    assert sorted(map(tuple, alignment.measure_documents(odd, hot=hot).collect()), key=repr) == want
    assert sum(r[1] == 0 for r in want) > 5 and sum(r[4] for r in want) > 50_000


def test_alignment_counts_in_parts(odd, monkeypatch):
    monkeypatch.setattr(alignment, "COUNTED", 10)
    monkeypatch.setattr(alignment, "KEPT", 100)
    test_alignment(odd, 40)


def test_alignment_gives_token_ranges(odd, spark):
    for r in alignment.align_documents(odd).collect():
        assert len(r.a_to) == len(r.b_to) and (not r.a or (r.a_to[-1], r.b_to[-1]) == (len(r.a), len(r.b)))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.measure_documents(none).count() == 0 and alignment.align_documents(none).count() == 0


def test_bitsets():
    r = random.Random(1)
    for size in (1, 63, 64, 65, 400):
        at = sorted(r.sample(range(size), r.randint(0, size)))
        bits = alignment.Bits.of(np.array(at, np.int64), size)
        assert bits.select().tolist() == at
        assert bits.rank(np.arange(size)).tolist() == [sum(x < i for x in at) for i in range(size)]


# --- url filters ---------------------------------------------------------------------------------


def pages():
    r = random.Random(3)
    hosts = [f"h{i}.{d}" for i in range(8) for d in ("com", "org", "net", "example.org")] + ["org", "com", "xorg"]
    rows = []
    for i in range(300):
        links = "".join(f'<A class=x HREF = "{r.choice(["http://", "https://", "//"])}{r.choice(hosts).upper()}/a?b">x</a>' for _ in range(r.randint(0, 5)))
        url = r.choice(["http", "HTTPS", "x://y"]) + "://" + r.choice(hosts) + r.choice(["/fr/1", "/de/", "/es/2", "/en/1", "/en/17?x", "/en/2", "", "?q=/fr/", "#/de/"])
        rows.append((i, url, links + '<a href="/local"><a href=x://h0.com/ >'))
    return [*rows, (None, None, None), (5, "no url", rows[0][2]), (6, "http://", None), (None, "http://h1.net/", "<a <a <a href='//h0.com"), rows[0], rows[0]]


def by_hand(rows, rules, steps, damping):
    """The verdicts in plain Python, with dictionaries of whole numbers."""

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c)[0] if c in rest else rest
        host, _, path = rest.partition("/")
        return host.lower(), ("/" + path if "/" in rest else "")

    def rule_of(host, path):
        fit = [(len(x), v, x) for v, x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        return max(fit)[1:] if fit else (None, None)

    seeds, edges = {"allow": Counter(), "block": Counter()}, Counter()
    for _, url, html in rows:
        host, path = parts(url)
        verdict, _ = rule_of(host, path)
        if host and verdict:
            seeds[verdict][host] += 1
        for tag in (html or "").lower().split("<a ")[1:]:
            link = tag.split("href", 1)[-1].lstrip(" =\"'").split('"')[0].split(" ")[0]
            if "//" in link:
                to = link.split("//")[1].split("/")[0]
                if host and to and to != host and "<" not in tag.split("href")[0]:
                    edges[host, to] += 1
    share = {}
    for verdict, ahead in (("allow", True), ("block", False)):
        total = sum(seeds[verdict].values())
        start = {h: url_filter.TOTAL // total * n for h, n in seeds[verdict].items()}
        ways = edges if ahead else Counter({(b, a): n for (a, b), n in edges.items()})
        degree = Counter()
        for (a, _), n in ways.items():
            degree[a] += n
        now = dict(start)
        for _ in range(steps):
            then = Counter({h: x * (100 - damping) // 100 for h, x in start.items()})
            for (a, b), n in ways.items():
                then[b] += now.get(a, 0) * damping // 100 // degree[a] * n
            now = then
        share[verdict] = now
    out = []
    for page, url, _ in rows:
        host, path = parts(url)
        verdict, rule = rule_of(host, path)
        trust, distrust = share["allow"].get(host, 0), share["block"].get(host, 0)
        out.append((page, host, path, rule, verdict or ("block" if distrust > trust else "allow"), trust, distrust))
    return sorted(out, key=repr)


def test_url_filter_by_link_graph(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = sorted(map(tuple, url_filter.judge(df, steps=3).collect()), key=repr)
    want = by_hand(rows, url_filter.RULES, 3, url_filter.DAMPING)
    assert got == want
    assert {(r[3] is None, r[4]) for r in got} == {(True, "allow"), (True, "block"), (False, "allow"), (False, "block")}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_filter_against_sql(spark, tmp_path):
    rows = pages()
    pq.write_table(pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": [r[1] for r in rows], "html": [r[2] for r in rows]}), tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet')")
    want = con.execute(url_filter.oracle()).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in url_filter.op12_url_filter(spark, str(tmp_path)).collect())


def test_url_rules(spark):
    urls = ["https://A.org/x", "http://b.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://xorg/", "http://org", "http://c.com/fr/?x", "http://c.com/fr", "a://b.com/de/://", "://com/de/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert [got[i] for i in range(10)] == [
        ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), (None, "allow"), (None, "allow"), ("com/fr/", "allow"), (None, "allow"), ("com/de/", "block"), ("com/de/", "block"),
    ]
    with pytest.raises(ValueError, match="rules"):
        url_filter.judge(df, [("allow", f"x{i}/") for i in range(url_filter.MOST_RULES + 1)])


# --- hard negatives ------------------------------------------------------------------------------


def mined(rows, every):
    held = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        held.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(v)))) for v in x]))
    out = []
    for i, label, x in {(i, b, tuple(x)) for i, b, x in held if i % every == 0}:
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), j, b == label) for j, b, y in held if len(y) == len(x) and j != i or len(y) == len(x) and b != label]
        for s, j, _ in sorted(r for r in scored if r[2])[:5]:
            fit = sorted((t, k) for t, k, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s)[:10]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit)]
    return sorted(out)


def vectors():
    r = random.Random(9)
    rows = [(i, r.randrange(3), [r.choice([-0.5, 0.1, 0.25, 0.9]) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, 1, [0.25, 0.25, 0.25, 0.25]) for i in range(40)]  # ties
    rows += [(None, 1, [1.0] * 4), (2000, None, [1.0] * 4), (2001, 1, None), (2002, 1, [None, 1.0, 1.0, 1.0]), (2003, 1, [float("nan")] * 4), (2004, 1, [float("inf")] * 4)]
    rows += [(2100, 2, [0.5, 0.5]), (2105, 2, [0.75, 0.5]), (2106, 1, [0.25, 0.25]), (2110, 1, []), (2111, 1, []), (2112, 2, [])]
    return [*rows, (3, 1, [0.5] * 4), (20, 2, [0.5] * 4), (9, 2, [0.9] * 4), (9, 2, [0.9] * 4)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 160])
def test_hard_negatives(spark, block_bytes):
    """In one pass and in several; with small tiles; repeated ids, ties, vectors of several lengths."""
    df = spark.createDataFrame([(*r, 0) for r in vectors()], "vec_id long, label int, embedding array<float>, score int").repartition(3)
    some = 10 if block_bytes > 1000 else 100
    got = hard_negatives.mine(df, F.col("vec_id") % some == 0, block_bytes=block_bytes)
    want = mined(vectors(), some)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_hard_negatives_tiles(spark, monkeypatch):
    best = hard_negatives.Best(np.array([-np.inf]), np.array([np.inf]), 3)
    r = np.random.default_rng(2)
    scores, ids = r.integers(0, 4, (1, 400)).astype(float), np.sort(r.permutation(1000)[:400])
    for i in range(0, 400, 37):
        best.offer(np.array([0]), scores[:, i : i + 37], np.ones((1, len(ids[i : i + 37])), bool), ids[i : i + 37])
    assert sorted(zip(-best.score, best.id, strict=True)) == sorted(zip(-scores[0], ids, strict=True))[:3]


def test_products_are_exact():
    a, b = np.array([[2.0**40, 1.0], [3.0, 1.0]]), np.array([[1.0, 2.0**40 + 1], [2.0**20, 5.0], [2.0**39, 7.0]])
    got = hard_negatives.products(a, b)
    assert got[0, 0] == 2**41 + 1 and got[1].tolist() == [2**40 + 4, 3 * 2**20 + 5, 3 * 2**39 + 7] and np.isnan(got[0, 1:]).all()


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df, F.col("vec_id") % 100 == 0).count() == 0
    assert os.path.exists(public_tokenizers.path(alignment.A_FILE))


# --- earlier operators, outside Spark ------------------------------------------------------------


def test_rendezvous_outside_spark(spark):
    """Hashes and draws in Python: the shard of each key before and after one more shard."""
    keys = [None, -5, *range(300)]

    def best(key, weights):
        name = "\x00null" if key is None else str(key)
        first = xxhash.xxh64_intdigest(name.encode(), seed=42)
        draws = []
        for i, w in enumerate(weights):
            h = xxhash.xxh64_intdigest(struct.pack("<i", i), seed=first)
            draws.append((-np.log(((h >> 12) + 0.5) / 2.0**52) / w, i))
        return min(draws)[1]

    df = spark.createDataFrame([(k, f"text {k}") for k in keys], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(df).collect()}
    assert got == {k: (best(k, [1.0] * 16), best(k, [1.0] * 17)) for k in keys}


def test_text_likelihoods_outside_spark(spark):
    """The trigram model in plain Python: counts, smoothing, and each text's tempered log likelihoods."""
    r = random.Random(3)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 6)))
    rows = [(i, " ".join(word("abcdx" if i % 2 else "abyz") for _ in range(12)) + (" 12 É!" if i % 5 == 0 else ""), "en" if i % 2 else "fr") for i in range(60)] + [(99, "", "en"), (98, "12 34", "fr")]

    def grams(text):
        b = [32, *text.encode(), 32]
        low = [x + 32 if 65 <= x <= 90 else x for x in b]
        low = [32 if x < 65 else x for x in low]
        out = []
        for x, y, z in zip(low, low[1:], low[2:], strict=False):
            if y > 32:
                g = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) % 2**32
                g ^= g >> 15
                out.append((g * 0x2C1B3C6D % 2**32) >> 17)
        return out

    n = language_id.BUCKETS
    counts = {x: Counter(g for _, t, y in rows if y == x for g in grams(t)) for x in ("en", "fr")}
    total = {x: sum(c.values()) for x, c in counts.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d = language_id.document_rows(df)
    model = language_id.fit(d, ["en", "fr"])
    for x, row in zip(("en", "fr"), model, strict=True):
        for g in list(counts["en"])[:50] + [0, 7]:
            assert abs(row[g] - np.log((counts[x][g] + 0.05) / (total[x] + 0.05 * n))) < 1e-4
    got = {r.doc_id: r.ll for r in language_id.text_likelihoods(d, model).collect()}
    for i, t, _ in rows:
        g = grams(t)
        if not re.search(r"[^\W\d_]", t):
            assert got[i] is None
            continue
        for k in range(3):
            mean = -np.log(n) if k == 2 else np.mean([model[k][x] for x in g])
            assert abs(got[i][k] - mean * min(len(g), language_id.WORTH)) < 2e-3


def test_null_ids_and_repeated_pages(spark):
    page = "<article><p>one two three</p></article>"
    pages = spark.createDataFrame([(None, "u", page), (1, None, page), (1, None, page), (2, "v", None)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text) for r in html_extract.extract_pages(pages, {}).collect()), key=repr)
    assert got == [(1, "one two three"), (1, "one two three"), (2, ""), (None, "one two three")]
    assert language_id.identify(language_id.page_rows(pages.limit(0))).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs).collect()} == {1: (59_996, 1), 2: (59_997, 1), 3: (jaccard_words(long[: len(long) // 2]) - 4, 3)}


def jaccard_words(text):
    return len(text.split())
