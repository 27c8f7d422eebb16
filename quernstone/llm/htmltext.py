"""Main text of web pages, with site templates removed.

A page is read into a tree of block elements.  Subtrees are hashed, and Spark counts on how many pages of a host each
hash occurs, copies of a page counted once; subtrees on a share of their host's pages are template and go, unless they
hold an article or main element.  Where a page has such elements, only they are printed; subtrees inside them are
counted by the host's different articles, so what sites repost stays and notices that recur in their articles go.
What an element is by its name, role or class (menus, footers, forms, adverts, comments, ...) goes too, counted or not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import narrow, read
from .storage import kept

# Element names of the HTML standard by what they do to text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
CLOSES_P = BLOCKS - frozenset("caption tbody td tfoot th thead tr body html".split())
SAME_CLOSES = {"li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "thead": frozenset(["tr", "td", "th", "tbody"]), "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]), "tfoot": frozenset(["tr", "td", "th", "tbody"])}
SAME_STOPS = frozenset("ul ol dl table select article div section".split())
GONE = frozenset("head script style title noscript noembed noframes iframe template svg object embed applet canvas audio video map nav footer aside form button select option textarea input label fieldset dialog menu search".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
GONE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget footer masthead header topbar toolbar share sharing social related recommended pagination pager comment comments commentlist disqus respond reply replies skip".split())
PROTECTED = ("article", "main")
NEVER = frozenset(["html", "body", *PROTECTED])
CELLS = frozenset("td th caption".split())
WITHIN = 0x9E3779B97F4A7C15  # sets hashes inside article and main apart
#: Of GONE_WORDS, those that other names often have as a part (side-effects): there they say nothing by themselves.
VAGUE = frozenset(["side", "widget"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
USED = frozenset("class id role hidden aria-hidden".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+|\d+")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}


class Element:
    """An element; parts: elements, and texts with their references decoded; guessed: unwanted by a part of a name only."""

    __slots__ = ("tag", "marks", "parts", "unwanted", "guessed")

    def __init__(self, tag: str, attributes: str = "", inside: bool = False):
        self.tag, self.parts, self.marks = tag, [], ""
        self.unwanted, self.guessed = tag in GONE, False
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                name = m[1].lower()
                if name not in USED:
                    continue
                value = (m[2] or m[3] or m[4] or "").lower()
                self.marks += f" {name}={value}"
                if name in ("class", "id"):
                    if tag not in ("html", "body", *PROTECTED) and not (tag in HEADINGS or (tag == "p" and name == "id")):
                        self._judge(value, inside)
                elif name == "role":
                    self.unwanted |= value in GONE_ROLES
                elif name == "hidden" or value == "true":
                    self.unwanted = True
        self.guessed &= not self.unwanted
        self.unwanted |= self.guessed

    def _judge(self, value: str, inside: bool) -> None:
        """By class or id: inside an article only whole names count, and a header is the article's own."""
        whole = GONE_WORDS.intersection(value.split())
        if inside:
            self.unwanted |= bool(whole - {"header"})
        elif whole:
            self.unwanted = True
        else:
            self.guessed |= not (GONE_WORDS - VAGUE).isdisjoint(_NAME.findall(value))


class _Open:
    """The open elements; the nearest one of a name is found without going through them, however deep they are."""

    def __init__(self, root: Element):
        self.stack, self.blocks = [root], [0]
        self.guesses: list[int] = []
        self.places: dict[str, list[int]] = {}

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        if e.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        if e.guessed:
            self.guesses.append(len(self.stack))
        elif e.tag in PROTECTED and not e.unwanted:  # what holds an article goes by a whole name only, not as "has-sidebar"
            for place in self.guesses:
                self.stack[place].unwanted = False
            self.guesses.clear()
        self.stack.append(e)

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these names; 0 if none is open."""
        found = 0
        for t in tags:
            places = self.places.get(t)
            if places and places[-1] > found:
                found = places[-1]
        return found

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()
        while self.guesses and self.guesses[-1] >= place:
            self.guesses.pop()


def parse(source: str) -> Element:
    """The tree of a page; tags that are missing or left open are filled in as browsers do for common cases."""
    root = Element("html")
    opened = _Open(root)
    stack = opened.stack
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            stack[-1].parts.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].parts.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            place = opened.last(tag)
            if place and (tag in ("article", "main", "body") or place > opened.last("article", "main", "body")):
                opened.close(place)
            continue
        if tag in ("html", "body") and (tag == "html" or opened.last("body")):
            continue
        if tag == "body":
            opened.close(1)
        closes = SAME_CLOSES.get(tag)
        if closes:
            limit = opened.last(*(SAME_STOPS - closes))
            while (place := opened.last(*closes)) > limit:
                opened.close(place)
        if tag in CLOSES_P and stack[opened.blocks[-1]].tag == "p":
            opened.close(opened.blocks[-1])
        e = Element(tag, m[3], opened.last(*PROTECTED) > 0)
        stack[-1].parts.append(e)
        if tag in VOID:
            continue
        if tag in RAW:
            end = _ENDS[tag].search(source, at)
            at = end.start() if end else n
            if end:
                close = source.find(">", at)
                at = n if close < 0 else close + 1
            continue
        opened.push(e)
    return root


def _elements(root: Element) -> list[Element]:
    """All elements, each one before those in it."""
    found = [root]
    for e in found:
        found.extend(p for p in e.parts if not isinstance(p, str))
    return found


def host(url: str | None) -> str:
    """Host name in lower case; empty if there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def subtree_hashes(root: Element, site: str) -> tuple[dict[int, int], list[int], int | None]:
    """Hash by id() of each block element that has a text and neither is nor holds a protected one; equal subtrees of a
    host are equal.  Then which of these hashes lie in protected elements (there they differ from those outside), and a
    hash of the elements that hold the text, None if there are none.  Cells of tables in protected elements have no hash,
    since a row without one of its cells says something else."""
    found: dict[int, int] = {}
    within: list[int] = []
    seed = xxhash.xxh64_intdigest(site)
    elements = _elements(root)
    protected: set[int] = set()
    for e in elements:
        if e.tag in PROTECTED or id(e) in protected:
            protected.update(id(p) for p in (e, *e.parts) if not isinstance(p, str))
    holds: set[int] = set()
    done: dict[int, tuple[bytes, bool]] = {}
    for e in reversed(elements):
        h, full = xxhash.xxh64(f"{e.tag}{e.marks}", seed=seed), False
        for part in e.parts:
            if isinstance(part, str):
                text = " ".join(part.split())
                if text:
                    h.update(f"\0{text}")
                    full = True
            else:
                inner, has = done[id(part)]
                h.update(inner)
                full |= has
                if part.tag in PROTECTED or id(part) in holds:
                    holds.add(id(e))
        value = h.intdigest()
        done[id(e)] = value.to_bytes(8, "little"), full
        if full and e.tag in BLOCKS and e.tag not in NEVER and id(e) not in holds:
            if id(e) not in protected:
                found[id(e)] = value
            elif e.tag not in CELLS:
                found[id(e)] = value ^ WITHIN
                within.append(value ^ WITHIN)
    tops = [done[id(e)][0] for e in _tops(root, elements)]
    return found, within, xxhash.xxh64_intdigest(b"".join(tops), seed=seed) if tops else None


def _tops(root: Element, elements: list[Element]) -> list[Element]:
    """The elements that hold the text: articles, or main elements without one.  No template holds any of them."""
    articles: set[int] = set()  # elements that hold a wanted article
    for e in reversed(elements):
        if any(not isinstance(p, str) and not p.unwanted and (p.tag == "article" or id(p) in articles) for p in e.parts):
            articles.add(id(e))
    tops: list[Element] = []
    todo = [root]
    while todo:
        e = todo.pop()
        if e is not root and e.tag in PROTECTED and (e.tag == "article" or id(e) not in articles):
            tops.append(e)
        else:
            todo.extend(p for p in reversed(e.parts) if not isinstance(p, str) and not p.unwanted)
    return tops


def printed(root: Element) -> tuple[list[str], dict[int, tuple[int, int]]]:
    """The blocks of the main text in page order, and by id() of each printed block element which of them are in it."""
    tops = _tops(root, _elements(root))
    lines: list[str] = []
    line: list[str] = []
    spans: dict[int, tuple[int, int]] = {}

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            lines.append(text)
        line.clear()

    inside = bool(tops)
    for top in tops or [root]:
        walk: list[Element | str | tuple[int, int]] = [top]  # a pair: the end of a block, and its first line
        while walk:
            part = walk.pop()
            if isinstance(part, str):
                line.append(part)
            elif isinstance(part, tuple):
                flush()
                spans[part[0]] = part[1], len(lines)
            elif part.tag == "br":
                line.append(" ")
            else:
                if part.tag in BLOCKS:  # what goes parts its neighbours as well
                    flush()
                if part is top or not (part.unwanted or (part.tag == "header" and not inside)):
                    if part.tag in BLOCKS:
                        walk.append((id(part), len(lines)))
                    walk.extend(reversed(part.parts))
        flush()
    return lines, spans


def without(lines: list[str], spans: list[tuple[int, int]]) -> str:
    """The lines outside these spans."""
    stay = np.ones(len(lines), bool)
    for i, j in spans:
        stay[i:j] = False
    return "\n".join(x for x, s in zip(lines, stay, strict=True) if s)


def main_text(root: Element, template: set[int] | None = None) -> str:
    """Blocks of the main text, one a line; template: id() of block elements that go."""
    lines, spans = printed(root)
    return without(lines, [spans[e] for e in template or () if e in spans])


def _signed(values: list[int]) -> list[int]:
    """Hashes as 64-bit numbers with a sign."""
    return np.array(values, np.uint64).view(np.int64).tolist()


READ = "url string, site long, copy long, own_site long, own long, outside int, lines array<string>, keys array<long>, first array<int>, last array<int>"
FLUSH_CHARS = 4 << 20


def read_pages(pages: DataFrame) -> DataFrame:
    """A row a page, read once: page_id, url, lines, and the hashes of its block elements (keys), those outside of articles
    first and `outside` many, with their lines from `first` to before `last`, none where they aren't printed.  For the
    counts: site and own_site, keys of the host for pages and for articles; copy and own, hashes of the page and of its
    articles (null: none)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    names = [c.split()[0] for c in READ.split(", ")]
    ints, texts = pa.list_(pa.int64()), pa.list_(pa.string())
    kinds = [pa.string(), *[pa.int64()] * 4, pa.int32(), texts, ints, pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begin, held = [], 0, 0
            for i, (url, source) in enumerate(zip(batch.column("url"), batch.column("html"), strict=True)):
                rows.append(_read_page(url.as_py(), source.as_py() or ""))
                held += len(source.as_buffer()) if source.is_valid else 0
                if held > FLUSH_CHARS or i + 1 == batch.num_rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(begin, len(rows)), *columns], names=["page_id", *names])
                    rows, begin, held = [], i + 1, 0

    return narrow(pages, page_id="page_id", url="url", html="html").mapInArrow(run, f"page_id {kind}, {READ}")


def _read_page(url: str | None, source: str) -> tuple:
    site, root = host(url), parse(source)
    found, within, own = subtree_hashes(root, site)
    lines, spans = printed(root)
    inside = set(within)
    elements = sorted(found.items(), key=lambda x: x[1] in inside)
    first, last = map(list, zip(*(spans.get(e, (0, 0)) for e, _ in elements), strict=True)) if elements else ([], [])
    site_key, own_key, copy = _signed([xxhash.xxh64_intdigest(f"\0page {site}"), xxhash.xxh64_intdigest(f"\0article {site}"), xxhash.xxh64_intdigest(source)])
    return url, site_key, copy, own_key, None if own is None else _signed([own])[0], len(found) - len(within), lines, _signed([h for _, h in elements]), first, last


def templates(found: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """key: hashes of subtrees, with their host, on at least min_pages different pages and this share of the host's different
    pages; for those inside article and main, as many different articles and this share of the host's different articles.
    found: rows of `read_pages`."""
    each = lambda site, copy, keys: found.where(F.col(copy).isNotNull()).select(F.col(site).alias("site"), F.col(copy).alias("copy"), F.explode(F.concat(F.array(site), keys)).alias("key"))
    outside = F.col("outside")
    rows = each("site", "copy", F.slice("keys", F.lit(1), outside)).unionByName(each("own_site", "own", F.slice("keys", outside + 1, F.size("keys"))))
    often = rows.groupBy("site", "key").agg(F.countDistinct("copy").alias("n")).where(F.col("n") >= min_pages)
    of_site = F.max(F.when(F.col("key") == F.col("site"), F.col("n"))).over(Window.partitionBy("site"))
    return often.withColumn("pages", of_site).where((F.col("key") != F.col("site")) & (F.col("n") >= min_share * F.col("pages"))).select("key")


def extract(pages: DataFrame, min_pages: int = 10, min_share: float = 0.1, broadcast_keys: int = 2_000_000) -> DataFrame:
    """page_id, url, text, n_chars of each page.

    pages: page_id, url, html; other columns are left out.  A null html is an empty page, a null url the empty host;
    text is "" where there is none.  Each row stays, equal rows too; pages of a host with equal html count once.
    Template: on at least min_pages pages of the host and min_share of them, inside article and main of its articles.
    Pages are read once, into a table of their blocks in the shared folder.  Template hashes are broadcast up to
    broadcast_keys of them; beyond that each page's own ones are joined to it.
    """
    rows = kept(read_pages(pages), "html-blocks", "zstd")
    found = templates(rows, min_pages, min_share)
    spark = rows.sparkSession
    known = [r[0] for r in found.limit(broadcast_keys + 1).toLocalIterator()]
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    shown = rows.select("page_id", "url", "lines", "keys", "first", "last")
    if len(known) <= broadcast_keys:
        sent = spark.sparkContext.broadcast(np.sort(np.array(known, np.int64)))
        return shown.mapInArrow(lambda batches: _texts(batches, sent), schema)

    rows = rows.withColumn("page", F.xxhash64("page_id", "url", "copy"))
    own = rows.dropDuplicates(["page"]).select("page", F.explode("keys").alias("key"))
    own = own.join(found, "key", "left_semi").groupBy("page").agg(F.collect_set("key").alias("gone"))  # one page's own subtrees
    return rows.join(own, "page", "left").select(*shown.columns, "gone").mapInArrow(lambda batches: _texts(batches, None), schema)


def _texts(batches: Iterator[pa.RecordBatch], sent: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Texts without the lines of template elements: those of the broadcast, or each page's own (gone)."""
    for batch in batches:
        texts = []
        for i in range(batch.num_rows):
            lines, keys, first, last = (batch.column(c)[i] for c in ("lines", "keys", "first", "last"))
            keys, template = keys.values.to_numpy(), sent.value if sent else np.sort(np.array(batch.column("gone")[i].as_py() or [], np.int64))
            at = np.searchsorted(template, keys)
            goes = np.append(template, 0)[at] == keys
            goes &= at < len(template)
            spans = zip(first.values.to_numpy()[goes].tolist(), last.values.to_numpy()[goes].tolist(), strict=True)
            texts.append(without(lines.as_py(), list(spans)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all `pages`; see `extract` for nulls, repeated rows and empty tables."""
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
