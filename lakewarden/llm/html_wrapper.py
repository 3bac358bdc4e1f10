"""Main text of web pages by union-free wrapper inference.

A page's tokens become a tree of blocks. Within a page, neighbouring blocks of one label align and fold into a repeated
group; across the pages of a host, token streams align child by child (longest common subsequence of
labels): what one side lacks becomes optional, what either repeats stays repeated, texts that differ become slots. The
outcome per host is one wrapper, a regular expression without unions. Wrappers merge first inside each task, then,
distinct ones only, in salted groups and at last per host, so no task sees all pages of a host. Labels are made of the
marks (class, id, role) that pages of a host share, counted in Spark, and wide blocks fold by label: a wrapper is as
large as its template, not as its host.

The wrapper tells where a host keeps its articles: every ``article`` or ``main`` element with more text of the pages' own
than links, else the whole page without blocks of links. Lines that are the same on half of the host's pages, three at least,
are template text, counted in Spark: they have no weight in the wrapper and are not part of the article, unless
less than a quarter of what a page keeps there is its own. Menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments are dropped below it: elements by their names, others by whole words
of class, id or role that links or little text confirm; never ``html``, ``body``, articles, what holds one, headings or paragraphs. Pages that lack the
place their host's wrapper names use the wrapper of the page itself.

A null or empty page has an empty text; pages without a host form one group. Repeated rows get equal results.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices, staged, text_of

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^<>=]|=(?!\s*[\"']))*+|[^<>]*)>", re.S | re.I)
MARK = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
DROPPED_TAGS = {"head", "nav", "header", "footer", "aside", "form", "menu", "select", "button", "dialog", "title"}
DROPPED_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "cookie", "cookies",
    "consent", "notice", "popup", "modal", "newsletter", "subscribe", "share", "social", "related", "comment", "comments", "disqus", "footer", "complementary", "contentinfo", "search",
}
#: Words that in an article are proof enough; the others need links beside them.
ADVERTS = {"ad", "ads", "advert", "advertisement", "sponsored", "disqus", "navbar", "breadcrumb", "breadcrumbs", "complementary", "contentinfo"}
ARTICLES = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements to which the words never apply.
PROTECTED = {"html", "body", "p", "pre", "blockquote"} | ARTICLES | HEADINGS
#: An element that ends when one of these begins beside it.
CLOSED_BY = {"p": BLOCKS - {"option", "legend"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = {"ul", "ol", "table", "dl", "article", "main", "section", "div", "body", "select"}
SLOT = "#"
SALTS = 16
#: Blocks side by side in a wrapper before those of one label become one repeated group.
MOST_CHILDREN = 64
#: What is counted over the pages of a host: pages, marks, lines.
PAGE, MARKED, LINE = range(3)
#: A mark belongs to the template from one page in so many on.
MARK_SHARE = 10
#: A line is template text from one page in so many on, and from so many pages.
LINE_SHARE, LINE_PAGES = 2, 3
BROADCAST_HOSTS = 200_000
#: Blocks nested deeper become blocks side by side in the one at this level; their texts keep their order, marks of theirs say nothing.
MOST_LEVELS = 200


class Node:
    """A block of a page: its label, the words that speak against it, texts and blocks in page order."""

    __slots__ = ("label", "tag", "dropped", "words", "items", "chars", "linked")

    def __init__(self, label: str, tag: str, dropped: bool, words: set[str] = frozenset()):
        self.label, self.tag, self.dropped, self.words, self.items, self.chars, self.linked = label, tag, dropped, words, [], 0, 0


@functools.lru_cache(1 << 16)
def number(text: str) -> int:
    """64 bits that stand for a mark or a line."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def tree(page: str, known: frozenset[int] | None = None, seen: set[str] | None = None) -> Node:
    """The blocks of a page; missing and stray end tags are put up with.

    ``known`` has the numbers of the marks that belong to the host's template (none given: all); marks with a digit are
    never part of a label. ``seen`` takes the marks of the page.
    """
    root = Node("#page", "#page", False)
    stack: list[Node] = [root]
    inline: list[str] = []  # open inline elements, to find links
    at = 0

    def text(piece: str) -> None:
        if piece and (len(stack) <= MOST_LEVELS or not stack[-1].chars):
            stack[min(len(stack), MOST_LEVELS) - 1].items.append((piece, "a" in inline))

    def edge() -> None:
        """Ends the line where a block too deep for the tree begins or ends."""
        if len(stack) > MOST_LEVELS:
            stack[MOST_LEVELS - 1].items.append(Node("#deep", "#deep", False))

    for m in TOKEN.finditer(page):
        text(page[at: m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                text(" ")
            continue
        if tag not in BLOCKS and tag != "button":
            if not m[2]:
                inline.append(tag)
            elif tag in inline:
                inline.reverse()
                inline.remove(tag)
                inline.reverse()
            continue
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    edge()
                    del stack[i:]
                    inline.clear()
                    break
                if tag in CLOSED_BY and stack[i].tag in SCOPES:
                    break
            continue
        for i in range(len(stack) - 1, max(0, len(stack) - 1 - MOST_LEVELS), -1):
            if tag in CLOSED_BY.get(stack[i].tag, ()):
                edge()
                del stack[i:]
                inline.clear()
                break
            if stack[i].tag in SCOPES:
                break
        found = [(name.lower(), (a or b or c).lower()) for name, a, b, c in MARK.findall(m[4])]
        marks = " ".join(value for _, value in found)
        own = sorted({("#" if name == "id" else ".") + word for name, value in found for word in value.split() if not re.search("[0-9]", word)})
        if seen is not None:
            seen.update(own)
        label = tag + "".join(mark for mark in own if known is None or number(mark) in known)
        if tag in ARTICLES:
            for holder in stack[:MOST_LEVELS]:
                holder.words = frozenset()
                holder.dropped = holder.dropped and holder.tag != "form"
        node = Node(label, tag, tag in DROPPED_TAGS, frozenset() if tag in PROTECTED else DROPPED_WORDS.intersection(marks.split()))
        if len(stack) < MOST_LEVELS:
            stack[-1].items.append(node)
        else:  # not in the tree; chars counts the dropped blocks it lies in or is
            node.chars = node.dropped + (stack[-1].chars if len(stack) > MOST_LEVELS else 0)
        stack.append(node)
        edge()
    text(page[at:])
    settle(root, known or frozenset())
    return root


def settle(root: Node, known: frozenset[int]) -> None:
    """Blocks whose class, id or role has a word of the list are dropped if something confirms it.

    Links that are most of a block's text, or template text alone, confirm it anywhere. Elsewhere than in an article or a section so does less than
    half of the page's text; in these only with a word that means nothing else.
    """
    def measure(node: Node) -> None:
        for item in node.items:
            if isinstance(item, tuple):
                n = len(" ".join(item[0].split()))
                node.chars, node.linked = node.chars + n, node.linked + n * item[1]
            elif not item.dropped:
                measure(item)
                node.chars, node.linked = node.chars + item.chars, node.linked + item.linked

    def walk(node: Node, inside: bool) -> None:
        for item in node.items:
            if isinstance(item, Node) and not item.dropped:
                within = inside or item.tag in ARTICLES or item.tag == "section"
                if item.words:
                    item.dropped = 2 * item.linked > item.chars or all(_line(line) in known for line, _ in lines(item)) or (2 * item.chars < root.chars and (not within or bool(item.words & ADVERTS)))
                if not item.dropped:
                    walk(item, within)

    measure(root)
    walk(root, False)


# A wrapper is [label, tag, dropped, optional, repeated, text, chars, linked chars, [children]]
LABEL, TAG, DROPPED, OPTIONAL, REPEATED, TEXT, CHARS, LINKED, CHILDREN = range(9)


def infer(node: Node, known: frozenset[int] = frozenset()) -> list:
    """The wrapper of one page: neighbouring blocks of one label fold into a repeated group; template text has no weight."""
    own = [(line, link) for line, link in _runs(node) if _line(line) not in known]
    text = " ".join(line for line, _ in _runs(node))
    folded: list[list] = []
    for child in (i for i in node.items if isinstance(i, Node)):
        made = infer(child, known)
        if folded and folded[-1][LABEL] == made[LABEL]:
            folded[-1] = align(folded[-1], made)
            folded[-1][REPEATED] = True
        else:
            folded.append(made)
    folded = bounded(folded)
    return [node.label, node.tag, node.dropped, False, False, SLOT if own and len(text) > 40 else text, sum(len(line) for line, _ in own), sum(link for _, link in own), folded]


def align(a: list, b: list) -> list:
    """The wrapper that matches whatever either of two wrappers of one label matches."""
    out = a[:]
    out[OPTIONAL], out[REPEATED] = a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED]
    out[DROPPED] = a[DROPPED] and b[DROPPED]
    out[TEXT] = a[TEXT] if a[TEXT] == b[TEXT] else SLOT
    out[CHARS], out[LINKED] = a[CHARS] + b[CHARS], a[LINKED] + b[LINKED]
    x, y = a[CHILDREN], b[CHILDREN]
    if [c[LABEL] for c in x] == [c[LABEL] for c in y]:
        out[CHILDREN] = [align(c, d) for c, d in zip(x, y)]
        return out
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][LABEL] == y[j][LABEL] else max(best[i + 1][j], best[i][j + 1])
    merged, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][LABEL] == y[j][LABEL]:
            merged.append(align(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            merged.append(_optional(x[i]))
            i += 1
        else:
            merged.append(_optional(y[j]))
            j += 1
    folded: list[list] = []
    for child in merged:  # an optional part beside its like is a repetition
        if folded and folded[-1][LABEL] == child[LABEL]:
            folded[-1] = align(folded[-1], child)
            folded[-1][REPEATED] = True
        else:
            folded.append(child)
    out[CHILDREN] = bounded(folded)
    return out


def bounded(children: list[list]) -> list[list]:
    """More than ``MOST_CHILDREN`` neighbours become a sequence of optional repeated ones, one of each label."""
    if len(children) <= MOST_CHILDREN:
        return children
    groups: dict[str, list] = {}
    for child in children:
        groups[child[LABEL]] = align(groups[child[LABEL]], child) if child[LABEL] in groups else _optional(child)
        groups[child[LABEL]][REPEATED] = True
    return list(groups.values())


def _optional(wrapper: list) -> list:
    out = wrapper[:]
    out[OPTIONAL] = True
    return out


def expression(wrapper: list) -> str:
    """The wrapper written as a regular expression without unions."""
    inner = ("#TEXT" if wrapper[TEXT] == SLOT else wrapper[TEXT]) + "".join(expression(c) for c in wrapper[CHILDREN])
    return f"(<{wrapper[LABEL]}>{inner}</>)" + ("*" if wrapper[OPTIONAL] and wrapper[REPEATED] else "?" if wrapper[OPTIONAL] else "+" if wrapper[REPEATED] else "")


def place(wrapper: list) -> list[list[str]]:
    """Labels from the page to each ``article`` or ``main`` with text of its pages' own; none where a host has no such element."""
    named: list[tuple[int, list[str]]] = []

    def mass(w: list) -> int:
        return 0 if w[DROPPED] else w[CHARS] - 2 * w[LINKED] + sum(mass(c) for c in w[CHILDREN])

    def walk(w: list, path: list[str]) -> None:
        if w[DROPPED]:
            return
        path = [*path, w[LABEL]]
        if w[TAG] in ARTICLES:
            named.append((mass(w), path))
            return
        for c in w[CHILDREN]:
            walk(c, path)

    walk(wrapper, [])
    own = [path for n, path in named if n > 0]
    return sorted(own) or ([max(named)[1]] if named else [])


def _at(node: Node, paths: set[tuple[str, ...]], above: tuple[str, ...] = ()) -> Iterator[Node]:
    """The blocks at the places, in page order."""
    here = (*above, node.label)
    if here in paths:
        yield node
    else:
        for item in node.items:
            if isinstance(item, Node):
                yield from _at(item, paths, here)


def _without_links(node: Node) -> None:
    """Drops blocks that are mostly links, except beside running text."""
    if any(isinstance(i, Node) and i.tag in ("p", "pre", "blockquote") and 2 * i.linked < i.chars for i in node.items):
        return
    for item in node.items:
        if isinstance(item, Node) and not item.dropped:
            item.dropped = item.tag not in PROTECTED and 2 * item.linked > item.chars
            if not item.dropped:
                _without_links(item)


def main_text(page: str, paths: list[list[str]], known: frozenset[int] | None = None) -> str:
    """The blocks of the article, one to a line."""
    root = tree(page, known)
    found = [x for node in _at(root, {tuple(p) for p in paths}) for x in lines(node)]
    if not found:
        paths = place(infer(root, known or frozenset()))
        if not paths:
            _without_links(root)
        found = [x for node in (_at(root, {tuple(p) for p in paths}) if paths else [root]) for x in lines(node)]
    return "\n".join(_own(found, known or frozenset()))


def _own(found: list[tuple[str, bool]], known: frozenset[int]) -> list[str]:
    """The lines without template text. A heading of the template stays where a line of the page's own follows it.

    Where less than a quarter is the page's own, nothing tells a copied article from a template: all lines stay.
    """
    constant = [_line(line) in known for line, _ in found]
    if 4 * sum(len(line) for (line, _), c in zip(found, constant) if not c) < sum(len(line) for line, _ in found):
        return [line for line, _ in found]
    out: list[str] = []
    held: list[str] = []
    for (line, heading), c in zip(found, constant):
        if c and heading:
            held.append(line)
        elif c:
            held.clear()
        else:
            if not heading:
                out += held
            held.clear()
            out.append(line)
    return out


def _line(line: str) -> int:
    return number.__wrapped__(f" {line}")


def _runs(node: Node) -> Iterator[tuple[str, int]]:
    """The lines of a block itself and how many of their characters are links."""
    held: list[tuple[str, bool]] = []
    for item in [*node.items, None]:
        if isinstance(item, tuple):
            held.append(item)
            continue
        if line := " ".join(html.unescape("".join(t for t, _ in held)).split()):
            yield line, min(len(line), sum(len(" ".join(html.unescape(t).split())) for t, link in held if link))
        held.clear()


def lines(node: Node) -> Iterator[tuple[str, bool]]:
    """The lines of a block, without what is dropped, and whether they are headings."""
    heading = node.tag in HEADINGS
    held: list[str] = []
    for item in [*node.items, None]:
        if isinstance(item, tuple):
            held.append(item[0])
            continue
        if line := " ".join(html.unescape("".join(held)).split()):
            yield line, heading
        held.clear()
        if item is not None and not item.dropped:
            yield from lines(item)


def _host(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def template(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, known: the numbers of the marks and lines that pages of a host share; hosts of a single page are left out.

    Equal pages count as one. A mark is known on a tenth of the host's
    pages, two at least: so there are at most ten times as many as a page has on average, however many pages there are. A line is known on half
    of them, three at least.
    """
    rows = pages.select(_host(url).alias("host"), text_of(page).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            out: list[tuple] = []
            for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                marks: set[str] = set()
                found = {line for line, _ in lines(tree(source, None, marks))}
                copy = number.__wrapped__(source)
                out.append((host, PAGE, 0, copy))
                out += [(host, MARKED, number(mark), copy) for mark in marks]
                out += [(host, LINE, _line(line), copy) for line in found]
            columns = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["host", "kind", "value", "copy"])

    counted = rows.mapInArrow(run, "host string, kind int, value long, copy long").groupBy("host", "kind", "value").agg(F.count_distinct("copy").alias("n"))
    counted = staged(counted.filter(F.col("n") > 1))
    sizes = counted.filter(F.col("kind") == PAGE).select(F.col("host").alias("_host"), F.col("n").alias("_n"))
    few = F.broadcast(sizes) if sizes.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else sizes
    shared = (F.col("kind") == MARKED) & (F.col("n") * MARK_SHARE >= F.col("_n"))
    shared = shared | (F.col("kind") == LINE) & (F.col("n") * LINE_SHARE >= F.col("_n")) & (F.col("n") >= LINE_PAGES)
    facts = counted.join(few, F.col("host") == F.col("_host")).filter((F.col("kind") == PAGE) | shared)
    return facts.groupBy("host").agg(F.collect_list(F.when(F.col("kind") != PAGE, F.col("value"))).alias("known"))


def _with(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """``pages`` with the facts of their hosts."""
    few = F.broadcast(facts) if facts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else facts
    return pages.join(few, "host", "left")


def _known(numbers: pa.Array) -> list[frozenset[int] | None]:
    return [None if x is None else frozenset(x) for x in numbers.to_pylist()]


def wrappers(pages: DataFrame, facts: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, wrapper (JSON): one wrapper per host, aligned over all its pages."""
    rows = _with(pages.select(_host(url).alias("host"), text_of(page).alias("html")), facts).select("host", "html", "known")
    spec = "host string, wrapper string"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[str, list] = {}
        for part in slices(batches, "html"):
            for host, source, known in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _known(part.column(2))):
                made = infer(tree(source, known), known or frozenset())
                merged[host] = align(merged[host], made) if host in merged else made
            if len(merged) > 2000:  # many hosts in a task: hand on what there is, it is merged below
                yield pack(merged)
                merged = {}
        yield pack(merged)

    def pack(merged: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(merged), pa.string()), pa.array([json.dumps(w) for w in merged.values()], pa.string())], ["host", "wrapper"])

    def again(frame):
        whole = None
        for text in sorted(frame["wrapper"]):
            made = json.loads(text)
            whole = align(whole, made) if whole else made
        frame = frame.iloc[:1].copy()
        frame["wrapper"] = json.dumps(whole)
        return frame[["host", "wrapper"]]

    partial = rows.mapInArrow(first, spec).distinct()
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = salted.groupBy("host", "salt").applyInPandas(again, spec)
    return some.groupBy("host").applyInPandas(again, spec)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [json.dumps(place(json.loads(w))) for w in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], ["host", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(h, json.loads(p), k) for h, p, k in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), _known(part.column(4)))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    facts = staged(template(pages, url, page))
    found = wrappers(pages, facts, url, page).mapInArrow(paths, "host string, path string")
    both = staged(found.join(facts, "host", "left"))
    rows = only(pages, page_id=page_id, url=url, html=page).withColumn("html", text_of("html"))
    met = _with(rows.withColumn("host", _host("url")), both).select("page_id", "url", "html", F.coalesce("path", F.lit("[]")).alias("path"), "known")
    kinds = rows.schema
    return met.mapInArrow(run, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string, n_chars bigint")
