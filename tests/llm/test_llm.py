"""The ten operators and the pipeline against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenforge.llm import byte_bpe, flac, html_extract, jaccard_join, language_id, licenses, line_dedup, order_minhash, packing, sharding

RND = random.Random(11)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 7))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece int, length long, sequence_id long, name string, shard int, lines_removed long"


def words(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def corpus():
    shared = [words(14), words(20)]
    texts = [None, "", "   \n\t ", "one", "Two Words", "é日本語 text", "x" * 3000, "\n".join(words(12) for _ in range(400))]
    for i in range(24):
        base = [words(RND.randint(3, 25)) for _ in range(RND.randint(2, 8))]
        texts.append("\n".join([base[0], shared[i % 2], *base[1:]]))
        near = " ".join(base).split()
        for _ in range(i % 4):
            near[RND.randrange(len(near))] = RND.choice(WORDS)
            texts.append("\n".join(base) if RND.random() < 0.3 else " ".join(near))
    texts += texts[-6:] + ["Released under the MIT License.\n" + words(30), words(50) + "\nLicensed under CC BY-NC 4.0."]
    rows = [(i * 3, t, "en", f"s{i % 3}", len(t or ""), 1, 2, 3, "n", 4, 5) for i, t in enumerate(texts)]
    return rows + rows[-1:]  # a repeated row


CORPUS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {r[0]: r[1] or "" for r in CORPUS}
ROWS = len(CORPUS)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_empty_tables(empty, spark):
    for f in (line_dedup.dedup_lines, lambda d: flac.read(flac.store(d)), jaccard_join.link_documents, byte_bpe.digest_documents, licenses.scan, order_minhash.compare_with_edits, packing.pack_documents, sharding.shard, lambda d: language_id.identify(language_id.document_rows(d))):
        assert f(empty).count() == 0
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_line_dedup(docs):
    first, spans = {}, []
    for d in sorted(TEXTS):
        lines = TEXTS[d].split("\n")
        at = [i for i, x in enumerate(lines) if x.split()]
        for p in range(len(at)):
            q = total = 0
            for q in range(p, len(at)):
                total += len(lines[at[q]].split())
                if total >= line_dedup.MIN_WORDS:
                    break
            if total >= line_dedup.MIN_WORDS:
                key = tuple(lines[i].strip() for i in at[p : q + 1])
                spans.append((d, at[p], at[q], key))
                first.setdefault(key, (d, at[p]))
    gone = defaultdict(set)
    for d, a, b, key in spans:
        if first[key] != (d, a):
            gone[d].update(range(a, b + 1))
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == ROWS and sum(map(len, gone.values())) > 20
    for r in out:
        assert (r.text or "") == "\n".join(x for i, x in enumerate(TEXTS[r.doc_id].split("\n")) if i not in gone[r.doc_id])
        assert r.lines_removed == len(gone[r.doc_id]) and (r.text is None or r.n_chars == len(r.text))


def repeated_runs(texts):
    """Lines of each text that go: all runs of MIN_WORDS words or more that an earlier place holds as well, whatever their length."""
    first, spans = {}, []
    for d in sorted(texts):
        lines = texts[d].split("\n")
        at = [i for i, x in enumerate(lines) if x.split()]
        for p in range(len(at)):
            for q in range(p, min(len(at), p + 40)):
                if sum(len(lines[i].split()) for i in at[p : q + 1]) >= line_dedup.MIN_WORDS:
                    key = tuple(lines[i].strip() for i in at[p : q + 1])
                    spans.append((d, at[p], at[q], key))
                    first.setdefault(key, (d, at[p]))
    gone = defaultdict(set)
    for d, a, b, key in spans:
        if first[key] != (d, a):
            gone[d].update(range(a, b + 1))
    return gone


def without_lines(text, gone):
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def test_line_dedup_deletes_whole_runs(docs, spark):
    long = [" ".join(WORDS[i : i + n]) for i, n in ((5, 12), (40, 11), (90, 3))]
    texts = {**TEXTS, 1000: f"{long[0]}\na b\nc\n{long[1]}\nd e f\n\ng", 1003: f"own\n{long[2]}"}
    texts |= {1001: texts[1000], 1002: texts[1000] + "\nown line", 1004: texts[1003] + "\n" + texts[1000]}
    gone = repeated_runs(texts)
    more = spark.createDataFrame([(d, texts[d]) for d in range(1000, 1005)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs.select("doc_id", "text").unionByName(more), runs=True).collect()}
    assert got[1001].text == "" and got[1002].text == "own line" and len(gone[1004]) == 7
    for d, t in texts.items():
        assert (got[d].text or "") == without_lines(t, gone[d]) and got[d].lines_removed == len(gone[d])


def test_clashing_names_come_back(spark):
    """Columns named as the operators' own inner columns are kept, and null ids and texts are rows like others."""
    line = words(14)
    rows = [(1, f"{line}\nxx", 1, 2, 3, "a", 5), (2, line, 2, 3, 4, "b", 6), (None, None, 3, 4, 5, "c", 7), (None, line, 4, 5, 6, "d", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, id int, h int, new string, __new int")
    out = {r.new: r for r in line_dedup.dedup_lines(df, runs=True).collect()}
    assert [(out[x].text, out[x].gone, out[x].id, out[x].h, out[x]["__new"]) for x in "abcd"] == [("xx", 1, 2, 3, 5), ("", 2, 3, 4, 6), (None, 3, 4, 5, 7), (line, 4, 5, 6, 8)]
    kept = language_id.accepted_documents(df)
    assert kept.columns == df.columns and kept.count() <= 4
    assert jaccard_join.keep_one(df).columns == df.columns


def test_flac_round_trip_and_damage(docs):
    for r in flac.read(flac.store(docs)).collect():
        b = TEXTS[r.doc_id].encode()
        p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    payloads = [bytes([7]) * 192, bytes(range(192)) * 30, np.random.default_rng(1).integers(0, 256, 5000, np.uint8).tobytes(), bytes([0, 255] * 2000), b"a"]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    assert flac.decode(streams[1:2], [(1500, 3000)])[0] == payloads[1][1500:3000]
    bad = bytearray(streams[2])
    bad[-40] ^= 4
    with pytest.raises(ValueError, match="CRC-16"):
        flac.decode([bytes(bad)])


def roots(sets):
    """The smallest key of each key's component, all pairs compared."""
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def test_jaccard_components(docs):
    sets = {d: shingles(t) for d, t in TEXTS.items()}
    root = roots(sets)
    got = jaccard_join.link_documents(docs).collect()
    assert len(got) == ROWS
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), root[d]) for d, s in sets.items()}
    assert {r.doc_id for r in jaccard_join.keep_one(docs).collect()} == {d for d in sets if root[d] == d}


def test_jaccard_with_repeated_and_null_ids(spark):
    """Rows with one doc_id and different texts have their own links; a null doc_id stands first and comes back null."""
    a, b, c = (words(60).split() for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, near(a)), (9, near(b)), (None, " ".join(c)), (7, near(c)), (None, None), (8, "")]
    got = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(5, 3), (5, 5), (3, 3), (9, 5), (None, None), (7, None), (None, None), (8, 8)])


def test_one_document_of_each_group_stays_by_text(spark):
    """A near copy goes, but not an unrelated text that stands under the same doc_id; columns may clash."""
    a, b, c = (words(60) for _ in range(3))
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a, 0), (5, near, 1), (5, b, 2), (7, c, 3), (None, near, 4), (8, None, 5), (8, "", 6), (5, near, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 int")
    assert sorted(r.h1 for r in jaccard_join.keep_one(df).collect()) == [2, 3, 4, 5, 6]
    assert sorted(r.h1 for r in jaccard_join.keep_one(df.where("doc_id IS NOT NULL")).collect()) == [0, 2, 3, 5, 6]
    assert jaccard_join.keep_one(df).columns == df.columns and jaccard_join.keep_one(df.limit(0)).count() == 0


def test_jaccard_blocks(spark, monkeypatch):
    """Cells above the block size are compared block by block, and lose no link."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2000)
    test_jaccard_with_frequent_signatures(spark)


def test_jaccard_with_frequent_signatures(spark):
    """A passage that all documents share, and a large group of near copies around the threshold."""
    r = random.Random(2)
    passage = [r.choice(WORDS) for _ in range(40)]
    base = [r.choice(WORDS) for _ in range(80)]
    rows = []
    for i in range(160):
        if i % 2:
            w = passage + [r.choice(WORDS) + str(i) for _ in range(25)]
        else:
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(80)] = f"e{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    sets = {d: shingles(t) for d, t in rows}
    up = dict(zip(sets, sets, strict=True))
    root = lambda x: x if up[x] == x else root(up[x])
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root(a) != root(b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: x.component_id for x in got.collect()} == {d: root(d) for d in sets}


def test_bpe(docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.digest_documents(docs).collect():
        ids = enc.encode_ordinary(TEXTS[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TEXTS[r.doc_id].encode()).hexdigest())
    blank = {1: "a" + " " * 90_000 + "b", 2: " " * 70_000, 3: "\n" * 66_001 + "x  y", 4: "q" * 70_000 + "\r\n" * 5000 + "\u3000" + " " * 5000}
    assert all(byte_bpe.encode(t, enc) == enc.encode_ordinary(t) for t in blank.values())
    for t in (" " * 1_000_000, "\n" * 1_000_000, "a" + " " * 999_999 + "b"):
        assert enc.decode_bytes(byte_bpe.encode(t, enc)).decode() == t
    long = "".join(RND.choice(["a", " b", "  ", "\n", "\r\n ", "é", "'s", " 12", "!"]) for _ in range(5000))
    assert [x for p in byte_bpe.cuts(long, 50) for x in enc.encode_ordinary(p)] == enc.encode_ordinary(long)
    assert byte_bpe.digest(byte_bpe.encode_documents(docs)).exceptAll(byte_bpe.digest_documents(docs)).isEmpty()


def test_language(spark):
    stems = {"en": ["the", "thing", "of", "and", "ation"], "de": ["der", "ung", "und", "schen", "nicht"], "es": ["los", "cion", "que", "ando", "para"], "fr": ["les", "eaux", "vous", "ment", "pour"]}
    rows = [(i, " ".join(RND.choice(stems[lang]) for _ in range(30)), lang, f"h{i % 7}") for i, lang in enumerate(["en", "de", "es", "fr"] * 40)]
    rows += [(900, None, "en", None), (901, "12 34 %%", "fr", "h1"), (902, " ".join(stems["de"] * 6), None, "new"), (903, "und und", "xx", "h2")]
    out = {r.doc_id: r for r in language_id.identify(language_id.document_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert sum(out[i].lang == lang and out[i].accepted for i, _, lang, _ in rows[:160]) == 160
    assert [out[i].lang for i in (900, 901)] == [None, None] and not out[900].accepted and out[902].lang == "de"
    kept = language_id.accepted_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {900, 901}


def test_language_fusion_against_numpy(spark):
    """Priors of declared language, suffix and host and their fusion, written again without Spark, on the rows' own likelihoods."""
    r = random.Random(6)
    langs = ["de", "en"]
    ll = [[-r.random() * 9, -r.random() * 9, -9.0] if i % 9 else None for i in range(80)]
    rows = [(i, x, r.choice(["de", "en", "xx", None]), r.choice(["com", "org", None]), f"h{r.randrange(6)}") for i, x in enumerate(ll)]
    got = {x.k: x for x in language_id.fuse(spark.createDataFrame(rows, "k int, ll array<double>, declared string, suffix string, host string"), langs).collect()}
    soft = {k: np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum() for k, x, *_ in rows if x}
    said = lambda d: d if d in langs else "other"
    part = lambda f: sum((soft[k][:2] for k, x, d, s, h in rows if x and f(d, s, h)), np.zeros(2))
    total = part(lambda *_: True)
    overall = (total + 1) / (total.sum() + 2)
    for k, x, d, s, h in rows:
        if not x:
            assert got[k].lang is None and not got[k].accepted
            continue
        like = np.append(np.log((part(lambda e, *_: said(e) == said(d)) + 1) / (total + 3)), -np.log(3))
        up = part(lambda e, t, _: t == s)
        up = (up + language_id.SMOOTH * overall) / (up.sum() + language_id.SMOOTH)
        own = part(lambda e, t, g: (t, g) == (s, h))
        prior = np.append(np.log((own + language_id.SMOOTH * up) / (own.sum() + language_id.SMOOTH)), -np.log(3))
        joint = np.array(x) + like + prior
        post = np.exp(joint - joint.max()) / np.exp(joint - joint.max()).sum()
        best = int(post[:2].argmax())
        assert got[k].lang == langs[best] and abs(got[k].posterior - post[best]) < 2e-4 and got[k].accepted == (got[k].posterior >= 0.5)


def test_language_of_pages(spark):
    stems = {"en": ["the", "thing", "of", "and", "ation"], "de": ["der", "ung", "und", "schen", "nicht"]}
    text = lambda x: " ".join(RND.choice(stems[x]) for _ in range(40))
    rows = [(i, f"https://www.s{i % 4}.{'de' if x == 'de' else 'com'}/p?{i}", f"<html lang='{x}'><script>var q</script><body><p>{text(x)}</p></body></html>") for i, x in enumerate(["en", "de"] * 30)]
    rows += [(900, None, None), (901, "not a url", "<p>12</p>")]
    got = {r.page_id: r for r in language_id.identify(language_id.page_rows(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert all(got[i].lang == x and got[i].accepted and got[i].suffix == ("de" if x == "de" else "com") and got[i].host == f"www.s{i % 4}.{got[i].suffix}" for i, x in enumerate(["en", "de"] * 30))
    assert got[900].lang is None and got[901].host is None and not got[901].accepted


def test_language_rejects_other_text(spark):
    """Unlisted languages and random letters go, also where a listed language is declared or has no labelled rows; clean texts stay."""
    r = random.Random(4)
    stems = {"en": ["the", "thing", "of", "and", "ation"], "de": ["der", "ung", "und", "schen", "nicht"], "es": ["los", "cion", "que", "ando", "para"], "fr": ["les", "eaux", "vous", "ment", "pour"]}
    other = ["Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由在尊严和权利上一律平等", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(40))]
    for names in (["en", "de", "es", "fr"], ["en", "de", "fr"]):
        clean = [(i, " ".join(r.choice(stems[x]) for _ in range(r.choice((2, 30, 300)))), x, f"h{i % 7}") for i, x in enumerate(names * 40)]
        odd = [(1000 + i, t, declared, "h1") for i, (t, declared) in enumerate((t, x) for t in other for x in (None, "xx"))]
        out = {x.doc_id: x for x in language_id.identify(language_id.document_rows(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string"))).collect()}
        assert all(out[i].accepted and out[i].lang == x for i, _, x, _ in clean)
        assert not any(out[i].accepted for i, *_ in odd)


def test_html(spark):
    body = "<p>" + words(40) + " a &amp; b</p><p>" + words(30) + "</p>"
    plain = "\n".join([re.sub(r"\s+", " ", re.sub("<[^>]*>", "", p)).replace("&amp;", "&").strip() for p in body.split("</p>") if p])
    frame = "<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=/a>menu</a></li></ul></nav>{}<div class='comments'><p>first!</p></div><footer>f</footer></body></html>"
    pages = {1: frame.format(f"<article><h1>Head</h1>{body}</article>"), 2: frame.format(f"<div>{body}</div>"), 3: None, 4: "", 5: "<p>", 6: "only text", 7: frame.format(f"<article>{body}<aside>ad</aside><form>q</form></article>")}
    got = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame([(k, "u", v, 9) for k, v in pages.items()], "page_id long, url string, html string, text int")).collect()}
    assert got[1].text == "Head\n" + plain and got[2].text == plain and got[7].text == plain
    assert [got[k].text for k in (3, 4, 5, 6)] == ["", "", "", "only text"] and got[1].n_chars == len(got[1].text)
    assert html_extract.region([-1, 2, -1, 3, -9, 4]) == (1, 4) and html_extract.region([-1, -2]) == (0, 0)


def test_html_keeps_wrapped_content_and_all_main_elements():
    text = lambda i, n: " ".join(WORDS[i : i + n])
    body, score = f"<p>{text(0, 40)}</p><p>{text(50, 30)}</p>", {"word any text": 1.0}
    want = f"{text(0, 40)}\n{text(50, 30)}"
    rest = f"<div class='comments'><p>{text(100, 9)}</p></div><div id=sidebar><p>{text(120, 6)}</p></div>"
    for name in ("class=has-sidebar", "class='page with-header'", "id=search-results", "class='no-comments'", "class=commentsWrapper", "id=header-wrap"):
        assert html_extract.extract(f"<body><div {name}><div>{body}</div>{rest}</div></body>", score) == want
        assert html_extract.extract(f"<body><div {name}><article>{body}</article>{rest}</div></body>", score) == want
    between = f"<p>{text(150, 100)}</p>"
    assert html_extract.extract(f"<body><article><p>{text(0, 40)}</p></article>{between}<article><p>{text(50, 30)}</p></article></body>", score) == want


def test_html_malformed_and_nested():
    text = lambda i, n: " ".join(WORDS[i : i + n])
    get = lambda page: html_extract.extract(page, {})
    assert get("<body><p title=it's>first words</p><p>it's fine</p></body>") == "first words\nit's fine"
    assert get(f"<main><p>{text(0, 40)}</p><article class='comment'><p>{text(50, 9)}</p></article></main>") == text(0, 40)
    assert get(f"<article><p>{text(0, 9)}</p><p class='legal-history'>{text(20, 9)}</p><p class=ad>buy</p></article>") == f"{text(0, 9)}\n{text(20, 9)}"
    assert get("<p a='<b>x</b> y") == "" or get("<p a='<b>x</b> y")
    for part in ("<a '", "<a x='>' ", "<b><i>", "<div class=ad>", "<!-- ", "<![CDATA[", "<x", "<p><b>", "</i><b>"):
        small, large = (timed(get, part * n) for n in (10_000, 80_000))
        assert large < 24 * max(small, 0.05), part


def timed(f, x):
    import time

    began = time.process_time()
    f(x)
    return time.process_time() - began


def test_html_comments_and_notices_go_however_long():
    text = lambda i, n: " ".join(WORDS[i : i + n])
    story, want = f"<p>{text(0, 40)}</p><p>{text(50, 30)}</p>", f"{text(0, 40)}\n{text(50, 30)}"
    said = "".join(f"<p>{text(100 + 20 * i, 20)}</p>" for i in range(8))
    several = "".join(f"<article class=comment><p>{text(100 + 40 * i, 40)}</p></article>" for i in range(4))
    for score in ({}, {"word any text": 1.0}):
        for page in (
            f"<div>{story}</div><div class='comments'>{said}</div>",
            f"<main>{story}<div class='comments'>{said}</div></main>",
            f"<article>{story}</article><section id=comments>{several}</section>",
            f"<article>{story}</article><section id=comments>{several.replace(' class=comment', '')}</section>",
            f"<article>{story}</article><aside>{several.replace(' class=comment', '')}</aside>",
            f"<form><div class=site-header>{text(200, 9)}</div><article>{story}</article></form>",
            f"<div class=commentsWrapper>{story}<div class=cookie-notice>{said}</div></div>",
        ):
            assert html_extract.extract(f"<body>{page}</body>", score) == want
    assert html_extract.extract(f"<body><p>{text(0, 20)}</p><div class=cookie-notice>{text(100, 60)}</div></body>", {}) == text(0, 20)
    kept = f"<main><p>{text(0, 20)}</p><section class='social-history'>{text(100, 60)}</section><section id='related-work'>{text(200, 9)}</section></main>"
    assert html_extract.extract(kept, {}) == "\n".join([text(0, 20), text(100, 60), text(200, 9)])


def test_html_region_is_the_best_of_all():
    r = random.Random(8)
    for _ in range(300):
        v = [r.choice([-2, -1, 0, 1, 3]) for _ in range(r.randint(0, 14))]
        a, b = html_extract.region(v)
        assert sum(v[a:b]) == max([0] + [sum(v[i:j]) for i in range(len(v)) for j in range(i, len(v) + 1)])


def test_html_weights_are_learned(spark):
    """Text without a main element is cut by weights that pages with one have taught: here, that words in <dd> lists are furniture."""
    page = "<body><dl>" + "<dd>{}</dd>" * 5 + "</dl><{}><p>{}</p><p>{}</p></{}></body>"
    pages = [(i, "u", page.format(*(words(2) for _ in range(5)), "article", words(30), words(20), "article")) for i in range(50)]
    score = html_extract.weights(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert score["tag dd"] < 2 * score["tag p"] < 0 < score["word any text"]
    a, b = words(30), words(20)
    assert html_extract.extract(page.format(*(words(2) for _ in range(5)), "div", a, b, "div"), score) == f"{a}\n{b}"
    assert html_extract.weights(spark.createDataFrame([], "page_id long, url string, html string")) == {}


def test_licenses(docs, spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "mit" and len(t) > 300)
    wrap = lambda n: "\n".join(textwrap.wrap(mit, n))
    more = {9001: wrap(34), 9002: wrap(34) * 25, 9003: mit + " " + "x" * 8000, 9004: words(200) + "\n" + wrap(78), 9005: words(90) + " Released under the MIT License. " + words(90), 9006: "license " * 20_000, 9007: None}
    texts = {**TEXTS, **{k: v or "" for k, v in more.items()}}
    got = {r.doc_id: r for r in licenses.scan(docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))).collect()}
    hits = {d: r.license for d, r in got.items() if r.license}
    assert set(hits.values()) == {"mit", "cc-by-nc-4.0"} and len(got) == len(texts) and all(got[d].license == "mit" for d in range(9001, 9006))
    chosen = licenses.anchors(licenses.TEMPLATES, licenses.THRESHOLD)
    for d, r in got.items():
        best = None
        units = [*enumerate(re.sub(r"[^\w\n]+|_", " ", texts[d].lower()).split("\n")), (-1, texts[d])]
        for line, unit in units:
            g = set(licenses.bigrams(unit))
            for name, t in licenses.TEMPLATES:
                k = set(licenses.bigrams(t))
                x = 2 * len(g & k) / (len(g) + len(k)) if g else 0
                if x >= 0.75:
                    best = min(best or (0,), (-x, name, line))
        whole = licenses.sequence(texts[d])
        for name, t in licenses.TEMPLATES:
            f, k = licenses.anchored(t, chosen), set(licenses.bigrams(t))
            for p in {max(0, p - f.index(x)) for p, x in enumerate(whole) if x in f}:
                g = set(whole[p : p + len(f)])
                x = 2 * len(g & k) / (len(g) + len(k))
                if x >= 0.75:
                    best = min(best or (0,), (-x, name, licenses.LAST))
        assert (r.license, r.line) == ((best[1], -2 if best[2] == licenses.LAST else best[2]) if best else (None, None))


def test_order_minhash(docs):
    ids = sorted([r[0] for r in CORPUS])
    got = defaultdict(list)
    for r in order_minhash.compare_with_edits(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == ROWS
    for i, d in enumerate(ids):
        t, following = TEXTS[d], TEXTS[ids[(i + 1) % len(ids)]]
        e = order_minhash.edited(t, following)
        a, b, c = (order_minhash.sketches([x.encode()])[0] for x in (t, e, following))
        assert any((r.edited_sha256, r.near_edited, r.near_next, r.fingerprint) == (hashlib.sha256(e.encode()).hexdigest(), (a == b).mean(), (a == c).mean(), a.astype(">u4").tobytes().hex()) for r in got[d])
    long = words(3000).encode()
    same, moved = order_minhash.sketches([long])[0], order_minhash.sketches([long[9000:] + long[:9000]])[0]
    assert 0.2 < order_minhash.likeness(same, moved) < 1


def plain_order_minhash(text):
    """Order MinHash with whole numbers, k-mer by k-mer, without numpy."""
    m64, odd = 2**64 - 1, [[int(x) for x in row] for row in order_minhash._ODD]

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m64
        return x ^ (x >> 31)

    k, seen, h = order_minhash.K, Counter(), []
    padded = text + bytes(max(0, k - len(text))) if text else b""
    for i in range(len(padded) - k + 1):
        x = padded[i : i + k]
        v = mix((int.from_bytes(x[:8], "little") * odd[0][0] + int.from_bytes(x[8:], "little") * odd[1][0]) & m64)
        n, seen[x] = seen[x], seen[x] + 1
        h.append(mix((v + n * odd[3][0]) & m64) if n else v)
    out = []
    for a, b in odd:
        low = sorted(range(len(h)), key=lambda i: (((h[i] >> 32) * (a % 2**32 | 1)) % 2**32, i))[: order_minhash.LEAST]
        total = sum(mix((h[i] + (r + 1) * b) & m64) * (2 * r + 1) for r, i in enumerate(sorted(low))) & m64
        out.append(total >> 32 if h else 0x5EED)
    return out


def test_order_minhash_against_plain_python():
    r = random.Random(12)
    texts = [b"", b"a", b"ab" * 3, b"x" * 40, b"abcabcabcabcabcabcabcabc" * 4, "日本語テキスト".encode() * 5]
    texts += ["".join(r.choice("ab c") for _ in range(r.randint(1, 300))).encode() for _ in range(60)]
    assert order_minhash.sketches(texts).tolist() == [plain_order_minhash(t) for t in texts]


def test_pcm_blocks(docs):
    rows = flac.pcm_blocks(flac.store(docs)).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.doc_id][r.sample_offset] = bytes(r.pcm)
    for d, t in TEXTS.items():
        b = t.encode()
        assert b"".join(by[d][k] for k in sorted(by[d])) == b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))


def test_order_minhash_reads_every_kmer():
    """A last byte that changes is one k-mer of n: a tuple stays if, of the n + 1 k-mers of both texts, neither that one nor its successor is among the two least."""
    r = random.Random(3)
    for n, most in ((8, 1), (19, 5)):
        texts = ["".join(r.choice("abcdefghij ") for _ in range(order_minhash.K + n - 1)).encode() for _ in range(300)]
        a, b = order_minhash.sketches(texts), order_minhash.sketches([t[:-1] + b"x" for t in texts])
        assert (a == b).all(1).sum() <= most
        assert abs(order_minhash.likeness(a, b).mean() - (n - 1) * (n - 2) / ((n + 1) * n)) < 0.03


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, t in TEXTS.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want = Counter()
        at = 0
        for k, n in enumerate(([len(ids) % 1024] if len(ids) % 1024 else []) + [1024] * (len(ids) // 1024)):
            want[k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += [r[0] for r in CORPUS].count(d)
            at += n
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d]) == want
    for part in by_seq.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_plan_is_tight():
    counts = Counter(RND.randint(1, 1024) for _ in range(5000))
    runs = packing.plan(counts)
    load = defaultdict(int)
    for size, _, n, first, _ in runs:
        for k in range(n):
            load[first + k] += size
    total = sum(s * n for s, n in counts.items())
    assert max(load.values()) <= 1024 and sum(load.values()) == total and len(load) <= -(-total // 1024) * 1.03 + 1
    assert len(packing.plan({s: n * 10**9 for s, n in counts.items()})) < 20_000


def test_sharding(docs, spark):
    rows = sharding.shard(docs).collect()
    by = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(TEXTS[r.doc_id].encode()) + 1, zlib.crc32(TEXTS[r.doc_id].encode()), "key")
        assert r.grown_shard in (r.shard, 16)
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    d = spark.range(20000).select(F.col("id").alias("doc_id"), sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s"))
    assert 0.73 < d.agg(F.avg("s")).first()[0] < 0.77


def test_pipeline(spark, tmp_path):
    """All rows of run() against lines, links and tokens found without Spark, on what the language stage accepts."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    d = tmp_path / "documents.parquet"
    spark.createDataFrame([r[:5] for r in CORPUS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kept = language_id.accepted_documents(spark.read.parquet(str(d))).select("doc_id", "text").collect()
    assert {r.doc_id for r in kept} <= {k for k, t in TEXTS.items() if re.search(r"[^\W\d_]", t)} and len(kept) > 40
    texts = {r.doc_id: r.text for r in kept}
    gone = repeated_runs(texts)
    left = {k: without_lines(t, gone[k]) for k, t in texts.items()}
    left = {k: t for k, t in left.items() if not gone[k] or t.strip(" \n\t\r")}
    root = roots({k: shingles(t) for k, t in left.items()})
    tok, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for k, t in left.items():
        if root[k] == k:
            ids, at = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
            for i, n in enumerate(([len(ids) % 1024] if len(ids) % 1024 else []) + [1024] * (len(ids) // 1024)):
                want[k, i, at, n, zlib.crc32(ids[at : at + n].tobytes())] += sum(r.doc_id == k for r in kept)
                at += n
    rows = out.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want and len(root) > len(set(root.values()))
    load = defaultdict(list)
    for r in rows:
        load[r.sequence_id].append((r.offset, r.length))
    for part in load.values():
        assert sum(n for _, n in part) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(sorted(part), sorted(part)[1:], strict=False))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encode_all_is_the_library():
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(5)
    bits = ["a", "été", "ж", "中", "word", "'s", "don't", "  ", "\n", "\n\n", "\t", ".", "!?", "&&&", "12", "<|endoftext|>", "́", "🙂", "end.\nNext", "x--y", '"', " "]
    texts = ["", "\n a\nb c\nd", "hello <|endoftext|> world", "a" + " " * 80_000 + "<|endoftext|>  x", "\n" * 70_000, "w " * 50_000] + ["".join(r.choice(bits) + (" " if r.random() < 0.5 else "") for _ in range(r.randint(0, 30))) for _ in range(2000)]
    assert packing.encode_all(texts, path) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_jaccard_moves_texts_of_a_group_once(spark, monkeypatch):
    """Rows written for one group of near copies grow with the group, not with its square; and no link is lost."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4000)
    moved = []
    kept = jaccard_join._Join.compared

    def counted(self, tasks, live):
        moved[-1] += tasks.count()
        return kept(self, tasks, live)

    monkeypatch.setattr(jaccard_join._Join, "compared", counted)
    r = random.Random(4)
    base = [r.choice(WORDS) for _ in range(90)]
    for n in (150, 600):
        moved.append(0)
        rows = []
        for i in range(n):
            w = list(base)
            w[r.randrange(90)] = f"e{i}"
            rows.append((i, " ".join(w)))
        rows += [(n + i, " ".join(base[:45] + [f"o{i}x{k}" for k in range(40)])) for i in range(5)]  # outside
        got = {x.doc_id: x.component_id for x in jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {d: 0 if d < n else d for d, _ in rows}
    assert moved[0] < 3 * 155 + 60 and moved[1] < 5 * moved[0]
