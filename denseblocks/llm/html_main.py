"""Main text of web pages, with site template removal.

Pass one hashes the element subtrees of every page and Spark counts, for each host, with
how many different main texts a subtree recurs. Pass two deletes subtrees that recur with
many main texts of their host (SHARE of them, LEAST at least), as well as those that are no main
text by their tag, role or class (menus, headers, footers, sidebars, notices, adverts, forms,
comments), and writes the text blocks of the article that are left, in page order.

Text blocks of an article (paragraphs, headings, items, cells) and parts that make up
much of it are never counted as template by themselves. All else, lists, tables and
sections of an article and the paragraphs of pages without one included, counts once for
all pages of equal main text: copies of a page on one host stay whole.

A class condemns an element only by a whole name that is a listed word (outside articles also
by a compound of listed and neutral words, as in ``cookie-bar``); and whatever its tag, role or class,
an element stays that holds all articles of the page and most of its text. Pages may be
nested to any depth: trees are walked with stacks of their own, in time linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from hashlib import blake2b
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, python_tasks, small

SHARE, LEAST = 0.05, 3  # a subtree with this share of a host's main texts, and so many, is template
MOST_SHARE = 0.3  # a part with more of the article's text than this is no template

# Fixed values of HTML: elements without an end, those that hold raw text, those that
# start a new block, and those whose start ends an open paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table
tbody td tfoot th thead tr ul""".split())
TEXT = set("p h1 h2 h3 h4 h5 h6 li dd dt td th tr pre blockquote figcaption caption summary b i em strong a span code br hr tbody thead tfoot".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# What is never text, and what is no main text unless it holds the page's articles.
NO_TEXT = set("""script style noscript template head title svg math iframe object embed canvas audio video button input
select textarea datalist map xmp noembed noframes""".split())
NO_TAG = set("form nav footer aside menu dialog".split())
NO_ROLE = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NO_CLASS = set("""ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr
notice notices alert popup modal newsletter subscribe subscription sidebar menu navbar nav navigation breadcrumb breadcrumbs pagination
pager header footer masthead comment comments disqus replies share sharing social related recommended widget toolbar""".split())
COMMENTS = set("comment comments disqus replies reply".split())
NEUTRAL = set("""site page global top bottom left right upper lower box bar area list lists wrap wrapper container section block inner
outer group item items link links row col column panel strip unit slot holder message text form""".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z)|[^<]+|<""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_PART = re.compile(r"[-_]+")
_MAINS = ("article", "main")
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_UNBASE = pow(_BASE, -1, 1 << 64)


class Node:
    """An element. ``gone``: never text; ``doubt``: no main text by tag, role or class
    (COMMENT if as a reader's comment), unless it turns out to hold the articles."""

    __slots__ = ("tag", "labels", "gone", "doubt", "kids")

    def __init__(self, tag: str, labels: str = "", gone: bool = False, doubt: str = ""):
        self.tag, self.labels, self.gone, self.doubt, self.kids = tag, labels, gone, doubt, []


def _listed(names: list[str], inside: bool) -> bool:
    """Does one of the class names say that this is no main text?"""
    for name in names:
        if name in NO_CLASS:
            return True
        parts = set(filter(None, _PART.split(name)))
        if not inside and parts <= NO_CLASS | NEUTRAL and parts & NO_CLASS:
            return True
    return False


def _open(token: str, tag: str, inside: bool) -> Node:
    attrs = {}
    for m in _ATTR.finditer(token, len(tag) + 1):
        attrs.setdefault(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), ""))
    labels = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip().lower()
    names = labels.split()
    gone = (
        tag in NO_TEXT
        or "hidden" in attrs
        or attrs.get("aria-hidden", "").lower() == "true"
        or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "").lower()))
    )
    comment = not COMMENTS.isdisjoint(names)
    doubt = ""
    if tag in ("html", "body", "main"):
        pass
    elif tag == "article":
        doubt = "comment" if comment else ""
    elif tag in NO_TAG and tag != "form" or attrs.get("role", "").lower() in NO_ROLE:
        doubt = "tag"
    elif tag == "form" or _listed(names, inside):
        doubt = "comment" if comment else "class"
    return Node(tag, labels, gone, doubt)


def parse(html: str) -> Node:
    """A tree of nodes and strings. Ends that are missing or that nothing opened do no
    harm; a tag that the page breaks off in is dropped."""
    root = Node("")
    stack = [root]
    open_tags: Counter = Counter()
    at, n = 0, len(html)

    def close(i: int) -> None:
        for x in stack[i:]:
            open_tags[x.tag] -= 1
        del stack[i:]

    while at < n:
        m = _TOKEN.match(html, at)
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<":
            stack[-1].kids.append(unescape(token))
            continue
        name = _NAME.match(token)
        if not name or not token.endswith(">"):
            continue
        tag = name[1].lower()
        if token[1] == "/":
            if open_tags[tag] > 0:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            continue
        if tag in BLOCK and open_tags["p"] > 0:  # a block ends an open paragraph, also around inline elements
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in SAME and any(open_tags[x] > 0 for x in SAME[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SAME[tag]:
                    close(i)
                    break
                if stack[i].tag in SCOPE[tag]:
                    break
        node = _open(token, tag, open_tags["article"] + open_tags["main"] > 0)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            stop = end.start() if end else n
            node.kids.append(html[at:stop])
            at = n if end is None else html.find(">", stop) + 1 or n
        elif tag not in VOID and not token.endswith("/>"):
            stack.append(node)
            open_tags[tag] += 1
    _settle(root)
    return root


def _events(root: Node):
    """(kid, True) on the way down and (node, False) on the way up, texts included, in
    page order; nothing below ``gone`` elements."""
    stack: list = [(root, iter(root.kids))]
    while stack:
        node, kids = stack[-1]
        for k in kids:
            yield k, True
            if isinstance(k, Node) and not k.gone:
                stack.append((k, iter(k.kids)))
                break
        else:
            stack.pop()
            if node is not root:
                yield node, False


def _settle(root: Node) -> None:
    """Decide the doubtful elements: they go, unless they hold all articles and main
    elements of the page and more than half of its text. Without any of these on the page, only a
    class or a form can be outweighed by the text."""
    letters = mains = 0
    before: dict[int, tuple[int, int]] = {}
    doubtful = []
    for k, down in _events(root):
        if isinstance(k, str):
            letters += len(k) - k.count(" ") - k.count("\n") - k.count("\t")
        elif down:
            mains += k.tag in _MAINS and not k.gone and not k.doubt
            if k.doubt:
                before[id(k)] = letters, mains
        elif k.doubt:
            l0, m0 = before[id(k)]
            doubtful.append((k, letters - l0, mains - m0))
    for k, n, m in doubtful:
        most = 2 * n > letters and m == mains
        k.gone = not (most and (mains > 0 or k.doubt == "class"))


def _mains(root: Node) -> list[Node]:
    """The outermost articles, else the outermost main elements, else the whole page."""
    for tag in _MAINS:
        found, depth = [], 0
        for k, down in _events(root):
            if isinstance(k, Node) and k.tag == tag and not k.gone:
                if down and depth == 0:
                    found.append(k)
                depth += 1 if down and tag not in VOID else -1
        if found:
            return found
    return [root]


class Page:
    """The words of a page without its ``gone`` elements, in order, and the elements by
    the range of words that they hold."""

    def __init__(self, root: Node, start: Node, inside: bool, drop: set[int] = frozenset()):
        self.elements: list[tuple[Node, bool, int, int]] = []  # element, in an article, first word, end
        pieces: list[str] = []
        self.words: list[str] = []
        within, skip = int(inside), 0
        marks: list[tuple[int, Node, bool]] = []
        for k, down in _events(start):
            if isinstance(k, str):
                if not skip:
                    pieces.append(k)
                continue
            if k.tag in VOID:
                pieces.append(" ")
                continue
            if k.gone:
                continue
            if down:
                if skip or id(k) in drop or k.tag == "header" and within == 0:
                    skip += 1
                    continue
                within += k.tag in _MAINS
                if k.tag in BLOCK:
                    self._flush(pieces)
                    marks.append((len(self.words), k, within > 0))
            elif skip:
                skip -= 1
            else:
                if k.tag in BLOCK:
                    self._flush(pieces)
                    at, node, was = marks.pop()
                    self.elements.append((node, was, at, len(self.words)))
                within -= k.tag in _MAINS
        self._flush(pieces)

    def _flush(self, pieces: list[str]) -> None:
        """A block ends the words of what is open."""
        if pieces:
            self.words += "".join(pieces).split()
            pieces.clear()


def _plain(node: Node, drop: set[int] = frozenset(), inside: bool = True) -> str:
    return " ".join(Page(node, node, inside, drop).words)


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_word_hash = lru_cache(1 << 16)(_hash)


class _Powers:
    """Powers of _BASE and its inverse modulo 2^64, as far as a page has needed them."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            steps = np.ones(max(n, 2 * len(cls.up), 4096), np.uint64)
            for name, base in (("up", _BASE), ("down", _UNBASE)):
                steps[1:] = base
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def _candidates(root: Node, mains: list[Node] | None = None, page: Page | None = None) -> list[tuple[Node, int]]:
    """Subtrees that may be template, with their hashes: elements other than page and
    article; in an article no text blocks and nothing that makes up much of it."""
    mains, page = mains or _mains(root), page or Page(root, root, False)
    whole, n = mains[0] is root, len(page.words)
    letters = [0, *accumulate(map(len, page.words))]
    size = lambda a, b: letters[b] - letters[a] + max(b - a - 1, 0)
    ranges = {id(node): (a, b) for node, _, a, b in page.elements}
    total = size(0, n) if whole else sum(size(*ranges.get(id(m), (0, 0))) for m in mains)
    some = [
        (node, a, b) for node, inside, a, b in page.elements
        if a < b and node.tag not in ("html", "body", *_MAINS) and not (inside and node.tag in TEXT) and (size(a, b) <= MOST_SHARE * total or not (inside or whole))
    ]
    if not some:
        return []
    # a hash of the words from a to b, whatever stands before them: the sum of word hashes times powers
    up, down = _Powers.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.fromiter(map(_word_hash, page.words), np.int64, n).view(np.uint64) * up, out=sums[1:])
    a, b = np.array([x[1] for x in some]), np.array([x[2] for x in some])
    texts = ((sums[b] - sums[a]) * down[a]).tolist()
    return [(node, _hash(f"{node.tag}\0{node.labels}\0{z - y}\0{t}")) for (node, y, z), t in zip(some, texts)]


def main_text(html: str | None, template: set[int] = frozenset()) -> str:
    root = parse(html or "")
    mains = _mains(root)
    drop = {id(n) for n, h in _candidates(root, mains) if h in template} if template else set()
    return " ".join(filter(None, (_plain(m, drop, m is not root) for m in mains)))


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _subtrees(batches):
    for b in batches:
        urls, hashes, texts = b.column("url").to_pylist(), [], []
        for html in b.column("html"):
            root = parse(html.as_py() or "")
            mains, page = _mains(root), Page(root, root, False)
            hashes.append(sorted({h for _, h in _candidates(root, mains, page)}))
            ranges = {id(node): (x, y) for node, _, x, y in page.elements} | {id(root): (0, len(page.words))}
            parts = (" ".join(page.words[slice(*ranges[id(m)])]) if id(m) in ranges else _plain(m) for m in mains)
            texts.append(_hash(" ".join(parts)))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("th"), pa.array(map(host, urls), pa.string()), pa.array(texts, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                                         names=["page_id", "th", "host", "main", "subtrees"])


def _extract(batches):
    for b in batches:
        text = [main_text(h, set(t or ())) for h, t in zip(b.column("html").to_pylist(), b.column("template").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array([len(t or ()) for t in b.column("template").to_pylist()], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars", "n_template"])


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html; other columns are ignored):
    ``page_id, url, text, n_chars, n_template`` (subtrees of the page that are template).

    A null or empty page has an empty text. Pages without a host in their url are one
    site. Repeated rows come back repeated; pages of a host with equal main texts (before
    templates go) count once. Very long pages are read whole, and pages nested to any depth. An
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    python_tasks(spark)
    stage = Stage(spark, "html")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    keyed = pages.withColumn("th", F.xxhash64("html", "url"))
    nodes = keyed.select("page_id", "th", "url", "html").mapInArrow(_subtrees, "page_id long, th long, host string, main long, subtrees array<long>")
    rows = stage.put(nodes.withColumn("host", F.xxhash64("host")), "subtrees")
    nodes = rows.select("page_id", "th", "host", "main", F.explode("subtrees").alias("subtree"))
    often = stage.put(nodes.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n"), "often")
    mains = nodes.select("host", "subtree", "main").join(small(often), ["host", "subtree"]).distinct()
    found = mains.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # only hosts of many main texts ask for more than the least count
    hosts = rows.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("m")).where(F.col("m") * share > least)
    hosts = stage.put(hosts, "hosts")
    found = found.join(small(hosts), "host", "left").where(F.col("n") >= F.coalesce("m", F.lit(0)) * share)
    template = stage.put(found.select("host", "subtree"), "template")
    hits = nodes.join(template, ["host", "subtree"]).groupBy("page_id", "th").agg(F.collect_set("subtree").alias("template"))
    hits = hits.withColumnRenamed("page_id", "p").withColumnRenamed("th", "t")
    both = keyed.join(hits, keyed.page_id.eqNullSafe(hits.p) & (keyed.th == hits.t), "left")
    return both.select("page_id", "url", "html", "template").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_template long")
