"""Operator 6, HTML extraction by the maximum-scoring subsequence.

A page is a sequence of tokens: tags, and words. Each has a class: a tag its name, a word where it stands (its kind: in
a nav, a form, a block that is named like page furniture, or none of these; in a link or not; in one of the main elements that the
page names, beside these, or on a page that names none). Words in text score positive and tags negative; the weights are
add-one smoothed log odds of a class inside against outside the content, from labelled pages, and one linear scan
finds the contiguous region with the largest sum on every page. Blocks that overlap it are kept whole, but for words of
kinds that are likelier outside (menus, forms, adverts, comments, what stands beside the main elements): these count
nothing and are left out. A block is named as furniture by a class, id or role all of whose parts say so (comment-list, but not
social-history). Such a block, or a form or the like, that holds all main elements of the page is a wrapper around the content;
any other is furniture, however many words it holds. Only on a page on which the scan finds nothing without them is the one
with the most words opened, until a region is found. Between the main elements of one page tags cost nothing, so that all of
them are reached.

Pages are labelled where their own markup names one main element (`article`, `main`): FIT_PAGES of them, or a few more or
less, are sampled by a hash of the whole row. They are counted where they lie; only the counts of classes, of which
there are some hundreds, come to the driver.

Defined cases: null or empty html gives an empty text; html without words as well; a page of text without any tag is
content as a whole; unclosed tags end with their parent or at the end of the page; tags of upper case, quotes of
either kind around values only, stray `<` and unknown references are read as browsers do; a quote that is never closed is a
character; the time is linear in the page, however malformed; equal pages have equal texts; an empty table gives an
empty result; only page_id, url and the columns made here are returned, so no column can clash.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_schema

#: About so many pages are sampled for the weights.
FIT_PAGES = 2000
# fixed values: HTML elements by what they do
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
FURNITURE = frozenset("nav header footer aside form dialog menu button select fieldset object svg canvas audio video head iframe noscript template".split())
MAIN = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that hold one paragraph.
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: Other elements whose tags have a weight of their own; all else shares one.
KNOWN = INLINE | FURNITURE | MAIN | CLOSES_P | VOID | frozenset("html body dt dd li thead tbody tfoot tr td th caption colgroup center font option optgroup legend".split())
#: First parts of a class that tell a state of the page, not what the block is: has-sidebar, no-comments.
STATES = frozenset("has have with without no not is".split())
#: Words of class, id and role that name furniture.
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted breadcrumb breadcrumbs comment comments respond reply replies disqus cookie cookies consent gdpr notice notices notification popup modal overlay footer foot header masthead menu nav navbar navigation navi sidebar aside related recommended share sharing social newsletter subscribe subscription signup login search widget toolbar pagination pager skip copyright legal disclaimer tags contentinfo complementary".split())
#: Words that stand beside one of NAMES and say nothing else.
COMPANIONS = frozenset("area article author bar block body bottom box button buttons container content entry fixed form global group inner item items left line link links list main meta outer page panel policy post posts primary right row secondary section site slot sticky story text thread title top unit user wrap wrapper".split())
_START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][^\s/>]*))", re.S)
_STOP = re.compile(r">|=\s*([\"'])")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def named_like_furniture(attributes: str) -> bool:
    """Whether a class, id or role consists of NAMES and COMPANIONS, with one of NAMES at least; numbers, and a prefix of up to three letters, don't count."""
    for m in _NAMED.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in _PART.split(word) if p and not p.isdigit()]
            if len(parts) > 1 and len(parts[0]) <= 3 and parts[0] not in NAMES and parts[0] not in STATES:
                parts = parts[1:]
            if not NAMES.isdisjoint(parts) and (NAMES | COMPANIONS).issuperset(parts):
                return True
    return False


def marks(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(from, to, "/" or "", name, attributes) of each tag, and of comments, declarations and CDATA with "!" or "[" as name.

    Linear: a quote that isn't closed later never is, and once a tag has run to the end of the page in its quotes, quotes no
    longer hide the end of a tag."""
    at, last = 0, page.rfind(">")
    closed, quotes = {'"': True, "'": True}, True
    while m := _START.search(page, at):
        lo, at = m.start(), m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            yield lo, at, "", "!", ""
        elif lo > last:
            return
        elif m[2] is None:
            end = page.find("]]>", at) if m[0] == "<![CDATA[" else -1
            if end >= 0:
                yield lo, end + 3, "", "[", page[at:end]
                at = end + 3
            else:
                at = page.find(">", lo) + 1
                yield lo, at, "", "!", ""
        else:
            pos, end = at, -1
            while quotes and (x := _STOP.search(page, pos)):
                if not x[1]:
                    end = x.start()
                    break
                pos = x.end()
                if closed[x[1]]:
                    q = page.find(x[1], pos)
                    closed[x[1]] = q >= 0
                    pos = max(pos, q + 1)
            if end < 0:
                quotes, end = False, page.find(">", at)
            yield lo, end + 1, m[1], m[2].lower(), page[at:end]
            at = end + 1


class Token(NamedTuple):
    tag: str  # "#text", a name, or a name after a slash
    text: str
    main: bool  # in a main element
    block: int  # the innermost block around that may be furniture, -1 without one


class Block:
    """A block that may be furniture: of what kind, in which other, and how many main elements it holds."""

    __slots__ = ("around", "kind", "mains")

    def __init__(self, around: int, kind: str):
        self.around, self.kind, self.mains = around, kind, 0


def tokens(page: str) -> tuple[list[Token], list[Block], int]:
    """The tokens of a page, its blocks (each after the one around it), and how many main elements it has that lie in no other."""
    out: list[Token] = []
    blocks: list[Block] = []
    open_: list[tuple[str, int, int]] = []  # name, and what was around: main elements, block
    where: dict[str, list[int]] = defaultdict(list)  # places in open_ by name
    total, mains, block, at, last_main = 0, 0, -1, 0, [-1]

    def close(to: int) -> None:
        nonlocal mains, block
        while len(open_) > to:
            name, mains, block = open_.pop()
            where[name].pop()
            if name in MAIN:
                last_main.pop()

    def put(tag: str, text: str = "") -> None:
        out.append(Token(tag, text, mains > 0, block))

    for lo, hi, slash, name, attributes in marks(page):
        if lo < at:  # in a script or the like
            continue
        if lo > at:
            put("#text", page[at:lo])
        at = hi
        if name in "![":
            if name == "[":
                put("#text", html.escape(attributes))
        elif slash:
            if where[name] and not (name in INLINE and last_main[-1] > where[name][-1]):
                close(where[name][-1])
            put("/" + name)
        elif name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            put(name)
            at = end.end() if end else len(page)
        else:
            if name in CLOSES_P:
                for i in range(len(open_) - 1, max(-1, len(open_) - 7), -1):
                    if open_[i][0] == "p":
                        close(i)
                        break
                    if open_[i][0] not in INLINE:
                        break
            elif name in ("li", "option", "tr", "td", "th", "dt", "dd") and open_ and open_[-1][0] == name:
                close(len(open_) - 1)
            alone = name in VOID or attributes.rstrip().endswith("/")
            before, kind = (mains, block), ""
            if name in FURNITURE and not (name == "header" and mains):
                kind = name
            elif name not in ("html", "body") and attributes and _HIDDEN.search(attributes):
                kind = "hidden"
            elif name not in ("html", "body", "main") and attributes and named_like_furniture(attributes):
                kind = "named"
            if kind:
                blocks.append(Block(block, kind))
                block = len(blocks) - 1
            elif name in MAIN:
                if not mains:
                    total += 1
                    if block >= 0:
                        blocks[block].mains += 1
                mains += 1
            if not alone:
                where[name].append(len(open_))
                open_.append((name, *before))
                if name in MAIN:
                    last_main.append(len(open_) - 1)
            put(name)
            if alone:
                mains, block = before
    if at < len(page):
        put("#text", page[at:])
    for b in reversed(blocks):
        if b.around >= 0:
            blocks[b.around].mains += b.mains
    return out, blocks, total


class Page:
    """A page's tokens with their words, and the kinds of its blocks: "" for wrappers around the content."""

    def __init__(self, page: str):
        self.tokens, self.blocks, self.mains = tokens(page)
        self.opened: set[int] = set()
        link, self.words, self.links = 0, [], []
        for t in self.tokens:
            link = link + 1 if t.tag == "a" else max(0, link - 1) if t.tag == "/a" else link
            self.words.append(len(t.text.split()) if t.tag == "#text" else 1)
            self.links.append(link > 0)

    def kinds(self) -> list[str]:
        out: list[str] = []
        for i, b in enumerate(self.blocks):
            wrapper = i in self.opened or self.mains and b.mains == self.mains
            out.append(b.around >= 0 and out[b.around] or ("" if wrapper else b.kind))
        return out

    def open(self, every: bool = False) -> bool:
        """Takes the named block or form with the most words (outside links) for a wrapper, down to one that has words of its own."""
        kinds, own = self.kinds(), [0] * len(self.blocks)
        for t, n, a in zip(self.tokens, self.words, self.links, strict=True):
            if t.tag == "#text" and t.block >= 0 and not a:
                own[t.block] += n
        held = own.copy()
        inner: dict[int, list[int]] = defaultdict(list)
        usable = [b.kind in ("named", "form") for b in self.blocks]
        for i in range(len(self.blocks) - 1, -1, -1):
            around = self.blocks[i].around
            if usable[i]:
                inner[around if around >= 0 and kinds[around] else -1].append(i)
                if around >= 0:
                    held[around] += held[i]
        if every:
            self.opened.update(i for i, u in enumerate(usable) if u)
            return bool(self.opened)
        at = -1
        while choice := [i for i in inner[at] if held[i]]:
            at = min(choice, key=lambda i: (-held[i], i))
            self.opened.add(at)
            if own[at]:
                return True
        return False

    def classes(self) -> list[tuple[str, int]]:
        """Class and words (1 for a tag) of each token."""
        kinds = [*self.kinds(), ""]  # the last for tokens in no block
        named_main = any(t.main and t.tag == "#text" and not kinds[t.block] and n for t, n in zip(self.tokens, self.words, strict=True))
        out = []
        for t, n, a in zip(self.tokens, self.words, self.links, strict=True):
            kind = kinds[t.block] or "text"
            if t.tag == "#text":
                place = "in" if named_main and t.main else "beside" if named_main else "any"
                out.append((f"word {place} {kind}" + " link" * a, n))
            else:
                tag = t.tag if t.tag.lstrip("/") in KNOWN else "other"
                out.append(("tag beside" if named_main and not t.main else f"tag {tag}" + " furniture" * (kind != "text"), n))
        return out


def counts(page: str) -> Counter:
    """How often each class stands inside and outside the main element; empty if the page names none or several. A word is
    counted by its place, and as on a page that names no main element."""
    read = Page(page)
    found, kinds = read.tokens, [*read.kinds(), ""]
    starts = sum(1 for a, b in zip([False, *(t.main for t in found)], (t.main for t in found), strict=False) if b and not a)
    out: Counter = Counter()
    if starts == 1:
        for (kind, n), t in zip(read.classes(), found, strict=True):
            out[kind, t.main] += n
            if kind.startswith("word"):
                out[re.sub("^word (in|beside)", "word any", kind), t.main] += n
            elif kind == "tag beside":
                out["tag " + (t.tag if t.tag.lstrip("/") in KNOWN else "other") + " furniture" * bool(kinds[t.block]), False] += n
    return out


def weights(df: DataFrame, most: int = FIT_PAGES) -> dict[str, float]:
    """Scores of the classes of tokens from about `most` labelled pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                total.update(counts(x.as_py()))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["kind", "inside", "n"])

    labelled = df.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    share = most / max(most, labelled.count())
    sample = labelled.where(F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = sample.select("html").mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return scores({(r["kind"], r["inside"]): r["n"] for r in found})


def default(kind: str) -> float:
    """The score of a class that no labelled page has."""
    if kind.startswith("tag"):
        tag = kind.split()[1].lstrip("/")
        return 0.0 if tag == "beside" else -0.25 if tag in SINGLE | INLINE | {"br"} and not kind.endswith("furniture") else -1.0
    place, where = kind.split()[1:3]
    return -2.0 if where != "text" or place == "beside" else 3.0 if place == "in" else -0.5 if kind.endswith("link") else 1.0


def scores(found: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of the classes, kept to the side that the method gives them: words in text positive, tags negative."""
    total = {i: sum(n for (_, side), n in found.items() if side == i) + 1 for i in (True, False)}
    out = {}
    for kind in {k for k, _ in found}:
        odds = math.log((found.get((kind, True), 0) + 1) / total[True]) - math.log((found.get((kind, False), 0) + 1) / total[False])
        if kind.startswith("tag"):
            out[kind] = 0.0 if kind == "tag beside" else max(-6.0, min(-0.25, odds - 1.0))
        elif kind in ("word any text", "word in text", "word in text link"):
            out[kind] = min(3.0, max(0.5, odds))
        else:
            out[kind] = max(-3.0, min(3.0, odds))
    return out


def region(values: list[float]) -> tuple[int, int]:
    """The first of the contiguous ranges (from, to) with the largest sum; (0, 0) if none is positive."""
    best = total = 0.0
    start, found = 0, (0, 0)
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, found = total, (start, i + 1)
    return found


def left_out(kind: str, score: float) -> bool:
    """Words that are likelier outside the content, for more than being in a link."""
    return score <= 0 and kind.removesuffix(" link") not in ("word any text", "word in text")


def extract(page: str | None, score: dict[str, float]) -> str:
    if not page:
        return ""
    read = Page(page)

    def scan() -> tuple[list[bool], int, int]:
        values, gone = [], []
        for kind, n in read.classes():
            v = score.get(kind)
            v = default(kind) if v is None else v
            gone.append(kind.startswith("word") and left_out(kind, v))
            values.append(0.0 if gone[-1] else v * n)
        return gone, *region(values)

    out_of, lo, hi = scan()
    for every in (False, True):
        if lo == hi and read.open(every):
            out_of, lo, hi = scan()
    out, block, reached = [], [], False

    def close() -> None:
        nonlocal block, reached
        text = _SPACE.sub(" ", html.unescape("".join(block))).strip() if reached else ""
        if text:
            out.append(text)
        block, reached = [], False

    for i, t in enumerate(read.tokens):
        if t.tag == "#text":
            if not out_of[i]:
                block.append(t.text)
                reached |= lo <= i < hi
        elif t.tag.lstrip("/") not in INLINE and block:
            close()
    close()
    return "\n".join(out)


def extract_pages(df: DataFrame, score: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = with_schema(df, ("page_id", "long"), ("url", "string"), ("html", "string"))
    score = weights(pages) if score is None else score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                texts = [extract(x.as_py(), score) for x in b.column(2)[i : i + 500]]
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 500], b.column(1)[i : i + 500], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
