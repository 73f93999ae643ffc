"""Main text of web pages by wrapper induction.

1. Each host has a reference page (least id hash). Every page's tree of block elements is aligned with it by
   simple tree matching; a page's matched nodes report the reference's node and a hash of their own text.
2. The reports are counted over all pages of the host (partial sums before the shuffle). A node's text that at
   least SUPPORT pages and half of the host's pages show is constant: template. All other text varies.
3. The page is aligned once more: constant nodes drop out, varying slots are content. The content root is
   found from the body down: into the child that holds most varying text outside links, as long as no heading, no bare text
   and no other such text lie beside it; an <article> or <main> element is reason to descend, and a second one not to. Menus,
   footers, adverts, forms, reader comments and blocks that are mostly links go wherever they are; class names count as whole
   names. Headings inside an article stay, constant or not. Where nearly all text of a page is constant (copies of one page), its text
   counts as varying.

Text: character references decoded, white space inside a block one space, blocks in page order one per
line; <br> is white space. Elements nested deeper than DEPTH lie flat in their ancestor, so no text is lost.
Child lists are matched in a band of BAND places around the diagonal, after their equal ends; shorter lists than that
are matched in full. Parsing is linear in the page.

Defined results: null or empty html gives an empty text; a null url is a host of its own; broken nesting
is closed at the next matching end tag; repeated rows are extracted one by one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "template", "svg")}
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOISE = frozenset("head nav footer aside form dialog menu button select option textarea script style noscript template iframe svg title object canvas audio video".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol dl table div section p".split())
_HOLDERS = frozenset("html body div section article main td tr tbody table center".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts of class names and ids that mark what is no content, and parts that say nothing; a name counts if it has no other part.
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsored sponsor sponsors promo promos banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer "
    "cookie cookies consent notice notices alert alerts popup popups modal newsletter subscribe signup comment comments commentlist replies respond disqus share sharing social related recommended widget "
    "widgets pagination pager toolbar masthead".split()
)
_NEUTRAL_WORDS = frozenset(
    "list lists box boxes link links button buttons btn bar bars block blocks section sections container wrapper wrap inner outer area form forms item items post posts article articles story stories page pages "
    "site main global primary secondary top bottom left right header head title thread feed slot unit group row col column content text icon icons media js the for this your our user reader more".split()
)
_PARTS = re.compile(r"[a-z]+", re.I)


def _noisy(name: str) -> bool:
    """Whether one of the names is made of noise words, with neutral ones and digits at most beside them."""
    for token in name.split():
        parts = [x.lower() for x in _PARTS.findall(token)]
        if any(x in _NOISE_WORDS for x in parts) and all(x in _NOISE_WORDS or x in _NEUTRAL_WORDS for x in parts):
            return True
    return False



DEPTH = 200
#: Children of two nodes are matched where their places differ by so many at most, after scaling to the lists' lengths.
BAND = 128
SUPPORT = 3
#: Pages of a host that a task takes: larger hosts are dealt out.
SPLIT = 500


class Link(str):
    """Text inside a link."""


class Node:
    __slots__ = ("tag", "name", "children", "noise")

    def __init__(self, tag: str, name: str, noise: bool):
        self.tag, self.name, self.children, self.noise = tag, name, [], noise  # children: Nodes and strings; None is a line break


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Place behind the > that ends a tag, quotes respected; -1 if none does. dead: places from which none was found."""
    seen = []
    while at not in dead:
        seen.append(at)
        m = _STOP.search(page, at)
        if m is None:
            break
        if m[0] == ">":
            return m.end()
        close = page.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
    dead.update(seen)
    return -1


def _tokens(page: str) -> Iterator[tuple]:
    """(start, end, text of CDATA or None, whether an end tag, name or None, attributes) of comments, CDATA, declarations and tags.

    Each search that fails is not made again, so the whole is linear in the page.
    """
    at, dead, missing = 0, set(), {}

    def find(what: str, start: int) -> int:
        if missing.get(what, len(page) + 1) <= start:
            return -1
        found = page.find(what, start)
        if found < 0:
            missing[what] = start
        return found

    while (i := page.find("<", at)) >= 0:
        end, cdata, closing, name, attrs = -1, None, False, None, ""
        if page.startswith("<!--", i):
            found = find("-->", i + 4)
            end = found + 3 if found >= 0 else len(page)
        elif page.startswith("<![CDATA[", i) and (found := find("]]>", i + 9)) >= 0:
            end, cdata = found + 3, page[i + 9 : found]
        elif page[i + 1 : i + 2] in ("!", "?"):
            end = find(">", i + 2) + 1 or -1
        elif m := _NAME.match(page, i):
            end = _tag_end(page, m.end(), dead)
            closing, name, attrs = bool(m[1]), m[2].lower(), page[m.end() : end - 1]
        if end < 0:
            at = i + 1
            continue
        skip = yield i, end, cdata, closing, name, attrs
        at = skip or end


def parse(page: str) -> Node:
    """Tree of block elements; inline elements leave only their text unless they are noise."""
    root = Node("#root", "", False)
    stack, at, links = [("#root", root)], 0, 0
    count: Counter = Counter()  # open elements by tag
    endless: dict[str, int] = {}

    def say(text: str) -> None:
        stack[-1][1].children.append(Link(text) if links else text)

    def close(tags: set[str] | frozenset[str], stop: tuple[str, ...] = ("table", "ul", "ol", "dl", "article", "div", "section", "body", "select")) -> None:
        if not any(count[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                leave(k)
                return
            if stack[k][0] in stop:
                return

    def leave(k: int) -> None:
        if stack[k][1] is stack[k - 1][1]:
            stack[k][1].children.append(None)
        for t, _ in stack[k:]:
            count[t] -= 1
        del stack[k:]

    tokens, skip = _tokens(page), None
    while True:
        try:
            start, end, cdata, closing, tag, attrs = tokens.send(skip)
        except StopIteration:
            break
        skip = None
        if start > at:
            say(page[at:start])
        at = end
        if cdata is not None:
            say(entities.escape(cdata, False))
            continue
        if tag is None:
            continue
        if tag == "a":
            links = 0 if closing else 1
        if closing:
            if not count[tag]:  # nothing to close
                if tag in ("br", "p"):
                    stack[-1][1].children.append(" " if tag == "br" else None)
                continue
            k = len(stack) - 1
            while stack[k][0] != tag:
                k -= 1
            leave(k)
            continue
        if tag in _VOID:
            stack[-1][1].children.append(None if tag == "hr" else " " if tag == "br" else "")
            continue
        if tag in _RAW and not attrs.rstrip().endswith("/"):
            last = _RAW[tag].search(page, at) if endless.get(tag, len(page)) >= at else None
            if last is None:
                endless[tag] = min(at, endless.get(tag, at))
            at = last.end() if last else len(page) if tag in ("script", "style") else at
            skip = at
            continue
        found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
        name = " ".join(v for k, v in found.items() if k != "itemprop")
        noise = tag in _NOISE or _noisy(name) and tag not in ("html", "body", "article", "main")
        if tag in _INLINE and not noise:
            continue
        if tag in _CLOSES_P:
            close({"p"})
        if tag in _SELF_CLOSING:
            close(_SELF_CLOSING[tag], ("table", "ul", "ol", "dl", "select"))
        if attrs.rstrip().endswith("/") and tag not in ("p", "div"):
            continue
        if len(stack) > DEPTH and (not noise or stack[-1][1].noise):
            stack[-1][1].children.append(None)
            stack.append((tag, stack[-1][1]))
            count[tag] += 1
            continue
        node = Node(tag, " ".join(v for k, v in sorted(found.items())), noise)
        stack[-1][1].children.append(node)
        stack.append((tag, node))
        count[tag] += 1
    if at < len(page):
        say(page[at:])
    return root


def blocks(node: Node, skip: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks below node; skip: nodes (by identity) whose own text is left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    def walk(x: Node) -> None:
        on = id(x) not in skip
        for c in x.children:
            if c is None:
                flush()
            elif isinstance(c, str):
                if on:
                    run.append(c)
            elif not c.noise:
                inline = c.tag in _INLINE
                if not inline:
                    flush()
                walk(c)
                if not inline:
                    flush()

    walk(node)
    flush()
    return out


def _kids(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and not c.noise]


def _tree(node: Node) -> tuple[tuple, list[Node]]:
    """Signature (label, size, children...) of the element tree and its nodes in preorder; noise is left out."""
    nodes = [node]
    kids = []
    for c in _kids(node):
        sig, own = _tree(c)
        kids.append(sig)
        nodes += own
    return ((node.tag, node.name), len(nodes), tuple(kids)), nodes


def tree_match(a: tuple, b: tuple, memo: dict | None = None) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of preorder numbers of a largest order-keeping, parent-keeping match of two signatures."""
    memo = {} if memo is None else memo
    if a[0] != b[0]:
        return []
    if a == b:
        return [(i, i) for i in range(a[1])]
    key = (id(a), id(b))
    if key in memo:
        return memo[key]
    x, y = a[2], b[2]
    at_x, at_y = [1], [1]
    for k in x:
        at_x.append(at_x[-1] + k[1])
    for k in y:
        at_y.append(at_y[-1] + k[1])
    low, m, n = 0, len(x), len(y)
    while low < min(m, n) and x[low] == y[low]:
        low += 1
    while m > low and n > low and x[m - 1] == y[n - 1]:
        m, n = m - 1, n - 1
    joined = [(i, i) for i in range(low)] + [(m + i, n + i) for i in range(len(x) - m)]
    h, w = m - low, n - low
    if h and w:
        lows = [max(0, i * w // h - BAND) for i in range(h + 1)]
        best = [[0] * (min(w, i * w // h + BAND) - lows[i] + 1) for i in range(h + 1)]
        at = lambda i, j: best[i][min(j - lows[i], len(best[i]) - 1)] if j >= lows[i] else 0
        for i in range(h):
            row, start = best[i + 1], lows[i + 1]
            for j in range(max(0, start - 1), start + len(row) - 1):
                match = at(i, j) + len(tree_match(x[low + i], y[low + j], memo)) if x[low + i][0] == y[low + j][0] else 0
                row[j + 1 - start] = max(at(i, j + 1), row[j - start] if j >= start else 0, match)
        i, j = h, w
        while i and j:
            if at(i, j) == at(i - 1, j):
                i -= 1
            elif at(i, j) == at(i, j - 1):
                j -= 1
            else:
                i, j = i - 1, j - 1
                joined.append((low + i, low + j))
    pairs = [(0, 0)]
    for i, j in joined:
        pairs += [(at_x[i] + p, at_y[j] + q) for p, q in tree_match(x[i], y[j], memo)]
    memo[key] = pairs
    return pairs


def _own_text(node: Node) -> str:
    return " ".join("".join(c for c in node.children if isinstance(c, str)).split())


@lru_cache(maxsize=64)
def _reference(page: str) -> tuple:
    return _tree(parse(page))[0]


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def slots(page: str | None, reference: str | None) -> list[tuple[int, int]]:
    """(reference's node, hash of the page's own text there) of matched nodes that hold text."""
    sig, nodes = _tree(parse(page or ""))
    texts = [_own_text(n) for n in nodes]
    return [(j, _hash(texts[i])) for i, j in tree_match(sig, _reference(reference or "")) if texts[i]]


def main_text(page: str | None, reference: str | None = None, template: set[tuple[int, int]] = frozenset()) -> str:
    """The text of a page; template: slots of the reference that are constant over the host."""
    root = parse(page or "")
    sig, nodes = _tree(root)
    texts = [_own_text(n) for n in nodes]
    constant = {i for i, j in tree_match(sig, _reference(reference)) if (j, _hash(texts[i])) in template} if template else set()
    if sum(len(texts[i]) for i in constant) >= 0.9 * sum(map(len, texts)):
        constant = set()
    plain: dict[int, int] = {}  # varying text outside links, of whole subtrees
    bare: dict[int, int] = {}  # the same of nodes themselves
    linked: dict[int, int] = {}
    heads: dict[int, bool] = {}
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        own = 0 if i in constant else sum(len(c.strip()) for c in n.children if isinstance(c, str) and not isinstance(c, Link))
        bare[id(n)] = own
        plain[id(n)] = own + sum(plain[id(c)] for c in _kids(n))
        linked[id(n)] = sum(len(c.strip()) for c in n.children if isinstance(c, Link)) + sum(linked[id(c)] for c in _kids(n))
        heads[id(n)] = n.tag in _HEADS and bool(texts[i]) and i not in constant or any(heads[id(c)] for c in _kids(n))
    inside = {"article", "main"}
    within: set[int] = set()
    for n in nodes:  # outside an article, headers and what is mostly links go
        for c in _kids(n):
            if id(n) in within or n.tag in inside:
                within.add(id(c))
            c.noise = id(c) not in within and (c.tag == "header" or c.tag in _LISTS and linked[id(c)] > plain[id(c)])
    holds: dict[int, bool] = {}  # an article or main element that has text of its own
    for n in reversed(nodes):
        holds[id(n)] = n.tag in inside and plain[id(n)] > 0 or any(holds[id(c)] for c in _kids(n))
    kept = {i for i in constant if nodes[i].tag in _HEADS and id(nodes[i]) in within}  # headings of an article are its own on any number of pages
    constant -= kept
    top = root
    while top.tag not in inside:
        kids = _kids(top)
        heavy = max(kids, key=lambda c: plain[id(c)], default=None)
        if heavy is None or bare[id(top)] or heavy.tag not in _HOLDERS or not plain[id(heavy)]:
            break
        beside = [c for c in kids if c is not heavy]
        if any(holds[id(c)] for c in beside) or not holds[id(heavy)] and any(plain[id(c)] or heads[id(c)] for c in beside):
            break  # an article, or text that varies, would stay outside
        top = heavy
    return "\n".join(blocks(top, {id(nodes[i]) for i in constant}))


def _host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", _host("url"))
    hosts = cut(p.where("html IS NOT NULL").groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("page_id"), F.xxhash64("html"))).alias("reference"), F.count("*").alias("pages")))
    many = hosts.where(F.col("pages") > SPLIT).select("host", F.expr(f"pages div {SPLIT} + 1").alias("parts"))
    p = p.join(many, "host", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "html"), "parts"))).drop("parts")
    spread = lambda df: df.withColumn("part", F.explode(F.expr(f"sequence(0L, IF(pages > {SPLIT}, pages div {SPLIT}, 0))")))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                got = [(h, j, t) for h, html, ref in zip(*(c.to_pylist() for c in part.columns)) for j, t in slots(html, ref)]
                c = list(zip(*got)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64())], ["host", "node", "own"])

    several = spread(hosts.where(F.col("pages") >= SUPPORT)).select("host", "part", "reference")
    seen = p.where("html IS NOT NULL").join(several, ["host", "part"]).select("host", "html", "reference").mapInArrow(report, "host string, node int, own long")
    shown = seen.groupBy("host", "node", "own").agg(F.count("*").alias("n")).join(hosts.select("host", "pages"), "host").where(f"n >= {SUPPORT} AND 2 * n >= pages")
    wrappers = cut(shown.groupBy("host").agg(F.collect_list(F.struct("node", "own")).alias("template")))  # two texts of a node at most
    both = p.join(spread(hosts.join(wrappers, "host")).select("host", "part", "reference", "template"), ["host", "part"], "left").select("page_id", "url", "html", "reference", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(h.as_py(), r.as_py(), {(x["node"], x["own"]) for x in t.as_py() or ()}) for h, r, t in zip(part.column(2), part.column(3), part.column(4))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


SQL = None
