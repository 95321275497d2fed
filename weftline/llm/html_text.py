"""Main text of web pages: site template removal, then the article's blocks.

Pages are parsed to a tree; block subtrees are hashed and counted per host in Spark (distinct pages only).
Subtrees on MIN_PAGES pages of the host or more are deleted: containers everywhere, other blocks of TEXT_WORDS words or more where they stand
outside of an article. What is left is searched for the article. A page that would lose all its text is a copy of other pages and keeps it.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, key_hash, need, prepare, stored

# Element names of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset(
    "script style textarea title noscript iframe xmp noembed noframes head nav footer aside form template svg math canvas object audio video select option datalist dialog menu fieldset input img map".split()
)
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody thead tfoot tr caption ul".split()
)
CONTAINER = frozenset("div section nav aside header footer form ul ol dl table figure details blockquote".split())
TEXT = frozenset("p li h1 h2 h3 h4 h5 h6 dd dt td th pre address figcaption caption summary".split())
CLOSES_P = BLOCK - frozenset("html body tr tbody thead tfoot caption".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",)}
P_FENCE = ("table", "button", "td", "th", "article", "section", "div", "li")
# Words of class, id and role names that mark what is not the article, and words that say nothing beside them.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar widget widgets menu navbar nav navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments commentlist disqus reply replies respond login search toolbar skip hidden paywall contentinfo complementary dialog".split()
)
NEUTRAL = frozenset(
    "site page top bottom left right main global primary secondary box bar area section block wrapper wrap container inner outer list item items panel slot unit button buttons link links icons form post posts article articles story stories news content body text group region module header title".split()
)
HEADER = frozenset(("header", "banner"))
ROOTS = frozenset("content post entry article story main body text".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S
)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
#: Distinct pages of a host from which a subtree recurs; words from which a block that is no container can.
MIN_PAGES, TEXT_WORDS = 5, 5


class Node:
    """An element: names are the parts of its class, id and role names; mark its subtree's hash, where that is counted."""

    __slots__ = ("children", "mark", "names", "tag", "unseen")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.children, self.mark, self.unseen = tag, [], None, False
        self.names: tuple[frozenset[str], ...] = ()
        if attrs and ("=" in attrs or "hidden" in attrs.lower()):
            found = []
            for name, a, b, c in _ATTR.findall(attrs):
                value = (a or b or c).lower()
                if name.lower() in ("hidden", "aria-hidden"):
                    self.unseen = self.unseen or value not in ("false", "until-found")
                else:
                    found += [frozenset(_WORD.findall(x)) for x in value.split()]
            self.names = tuple(x for x in found if x)

    def named(self, words: frozenset[str], beside: frozenset[str] = frozenset()) -> bool:
        """Whether a whole name consists of these words, some beside others."""
        return any(x & words and x <= words | beside for x in self.names)


@contextmanager
def _deep(tree: Node | None, depth: int):
    """Room for walks as deep as the tree. They are plain Python calls, which don't use the C stack."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 2 * depth + 1000))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


class Page:
    """A tree of elements and decoded text, and its depth. Unclosed, misnested and stray tags are taken as browsers take them, roughly; nothing fails."""

    def __init__(self, html: str):
        self.root = Node("html", "")
        self.depth = 1
        stack, at, n = [self.root], 0, len(html)
        is_open: Counter[str] = Counter()

        def close(k: int) -> None:
            for x in stack[k:]:
                is_open[x.tag] -= 1
            del stack[k:]

        def close_before(tags: tuple[str, ...], fence: tuple[str, ...]) -> None:
            if any(is_open[t] for t in tags):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in tags:
                        return close(k)
                    if stack[k].tag in fence:
                        return None
            return None

        search = _TAG.search
        while at < n:
            m = search(html, at)
            if m is None:
                stack[-1].children.append(unescape(html[at:]))
                break
            if m.start() > at:
                stack[-1].children.append(unescape(html[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing, attrs = name.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
            if closing:
                if is_open[tag]:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
                continue
            if tag in CLOSES_P:
                close_before(("p",), P_FENCE)
            if tag in SIBLINGS:
                close_before(SIBLINGS[tag], FENCE[tag])
            node = Node(tag, attrs)
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
            elif tag not in VOID and not attrs.endswith("/"):
                stack.append(node)
                is_open[tag] += 1
                self.depth = max(self.depth, len(stack))

    def marks(self) -> set[int]:
        """Hash all subtrees; the hashes (signed 64-bit) that are counted go to their nodes and are returned."""
        found: set[int] = set()
        with _deep(self.root, self.depth):
            _hash(self.root, False, found)
        return found

    def text(self, recurring: frozenset[int] = frozenset()) -> str:
        """The article's blocks, one a line: all <article> that aren't teasers, else <main>, else containers so named, else the page."""
        with _deep(self.root, self.depth):
            left = _pruned(self.root, recurring, False)
            out: list[str] = []
            line: list[str] = []
            for root in _article(left, recurring):
                _blocks(root, out, line)
                _flush(out, line)
        return "\n".join(out)


def _hash(node: Node, inside: bool, found: set[int]) -> tuple[bytes, int]:
    """A digest of tag, names and normalised content, and the number of words."""
    parts, n = [node.tag.encode(), b" ".join(w.encode() for x in node.names for w in sorted(x))], 0
    within = inside or node.tag in ("article", "main")
    for x in node.children:
        if isinstance(x, str):
            words = x.split()
            parts.append(" ".join(words).encode("utf-8", "replace"))
            n += len(words)
        else:
            digest, k = _hash(x, within, found)
            parts.append(digest)
            n += k
    digest = hashlib.blake2b(b"\x00".join(parts), digest_size=8).digest()
    if n and (node.tag in CONTAINER or node.tag == "article" or not inside and n >= TEXT_WORDS and node.tag in TEXT):
        node.mark = int.from_bytes(digest, "little", signed=True)
        found.add(node.mark)
    return digest, n


def subtree_hashes(html: str | None) -> list[int]:
    return sorted(Page(html).marks()) if html else []


def _noise(node: Node, parent: Node, inside: bool) -> bool:
    if node.unseen or node.tag in DROPPED or node.tag == "button" and parent.tag in CONTAINER | {"html", "body", "main", "article"}:
        return True
    if node.tag == "header" or node.tag in CONTAINER and node.named(HEADER, NEUTRAL):
        return not (inside and _has_heading(node))
    if node.tag in CONTAINER or node.tag == "article":
        return node.named(NOISE, NEUTRAL)
    return node.tag in TEXT and node.tag[0] != "h" and node.named(NOISE)


def _has_heading(node: Node) -> bool:
    for x in node.children:
        if not isinstance(x, str) and (x.tag in ("h1", "h2") or _has_heading(x)):
            return True
    return False


def _pruned(node: Node, recurring: frozenset[int], inside: bool) -> Node:
    """A copy of the tree less recurring subtrees and what is not the article by role. Articles that recur are left to _article."""
    out = Node(node.tag, "")
    out.names, out.mark = node.names, node.mark
    inside = inside or node.tag in ("article", "main")
    for x in node.children:
        if isinstance(x, str):
            out.children.append(x)
        elif x.mark in recurring and x.tag != "article" or _noise(x, node, inside):
            out.children.append(" ")
        else:
            out.children.append(_pruned(x, recurring, inside))
    return out


def _length(node: Node, linked: bool = False) -> tuple[int, int]:
    """Characters of a subtree, and how many of them are links' text."""
    n = links = 0
    for x in node.children:
        if isinstance(x, str):
            k = len(x.strip())
            n += k
            links += k if linked else 0
        else:
            a, b = _length(x, linked or x.tag == "a")
            n += a
            links += b
    return n, links


def _roots(node: Node, test, out: list[Node]) -> None:
    for x in node.children:
        if not isinstance(x, str):
            if test(x):
                out.append(x)
            else:
                _roots(x, test, out)


def _article(tree: Node, recurring: frozenset[int]) -> list[Node]:
    """The subtrees that are the article. Teasers, which are mostly links, and articles of many pages give way to others."""
    tests = (
        lambda x: x.tag == "article",
        lambda x: x.tag == "main" or x.tag in ("div", "section") and x.named(frozenset(("main",))),
        lambda x: x.tag in ("div", "section") and x.named(ROOTS),
    )
    for test in tests:
        found: list[Node] = []
        _roots(tree, test, found)
        size = [(x, *_length(x)) for x in found]
        size = [x for x in size if x[1]]
        if size:
            own = [x for x in size if x[0].mark not in recurring] or size
            return [x for x, n, links in own if 2 * links < n] or [x for x, _, _ in own]
    return [tree]


def _blocks(node: Node, out: list[str], line: list[str]) -> None:
    for x in node.children:
        if isinstance(x, str):
            line.append(x)
        elif x.tag in BLOCK:
            _flush(out, line)
            _blocks(x, out, line)
            _flush(out, line)
        elif x.tag in ("br", "td", "th", "wbr"):
            line.append(" " if x.tag != "wbr" else "")
            _blocks(x, out, line)
            line.append(" " if x.tag in ("td", "th") else "")
        else:
            _blocks(x, out, line)


def _flush(out: list[str], line: list[str]) -> None:
    if text := " ".join("".join(line).split()):
        out.append(text)
    line.clear()


def main_text(html: str | None, recurring: frozenset[int] = frozenset()) -> str:
    """The article's text less recurring subtrees; all of it if nothing would be left."""
    if not html:
        return ""
    page = Page(html)
    if recurring:
        page.marks()
        if text := page.text(recurring):
            return text
    return page.text()


def host(url: str = "url"):
    """The host of a URL, lower-case, without user and port; empty for none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _source(pages: DataFrame) -> DataFrame:
    prepare(pages.sparkSession)
    rows = need(pages, {"page_id": "long", "url": "string", "html": "string"})
    return rows.withColumn("page_key", key_hash("page_id", "url", "html"))


def recurring_subtrees(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_key, marks: the subtrees of each page that recur on its host. Equal pages count once; pages without any are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([subtree_hashes(x) for x in batch.column(3).to_pylist()], pa.list_(pa.int64()))],
                ["page_key", "host", "page", "marks"]
            )

    seen = stored(
        _source(pages).select(
            "page_key", F.xxhash64(host()).alias("host"), F.xxhash64("html").alias("page"), "html"
        ).mapInArrow(read, "page_key long, host long, page long, marks array<long>"),
        "marks"
    )
    # A subtree of a host is one number; distinct pages are found before their subtrees are dealt out, so that a count is a plain sum.
    each = seen.select("page_key", "host", "page", F.expr("transform(marks, m -> xxhash64(host, m))").alias("keys"), "marks")
    once = each.groupBy("host", "page").agg(F.first("keys").alias("keys"))
    long = each.select("page_key", F.explode(F.arrays_zip("keys", "marks")).alias("x")).select(
        "page_key", F.col("x.keys").alias("key"), F.col("x.marks").alias("mark")
    )
    counts = once.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    often = stored(counts.where(F.col("n") >= min_pages), "often", few=8)
    return join_counted(long, often, "key").select("page_key", "mark").groupBy("page_key").agg(F.collect_set("mark").alias("marks"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, one row per row of pages. Null html or html without an article's text: empty text. Null page_ids and urls stay.

    Very long and very deep pages are read whole. Repeated rows get equal results; an empty table gives no rows; other columns are left out.
    """
    marks = recurring_subtrees(pages, min_pages)
    rows = _source(pages).join(marks, "page_key", "left").select("page_id", "url", "html", "marks")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h, frozenset(m or ())) for h, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(read, "page_id long, url string, text string")
