"""Operator 5: main text of web pages by composite text density.

A page becomes a small tree of elements. Elements that are never part of an article go first: by name (menus,
asides, forms, scripts, ...) or by a word of their class, id or role (sidebar, advert, comments, ...), unless
they hold a main element or, on a page without a main element or article elsewhere, an article or most of the page's text; page headers and
footers go unless an article holds them. Inside of a main element or article, only a container goes by its class, and only by a
class word that says nothing but that (``notice``, ``notice-box``, but not ``notice-board``); buttons, labels and formulas in
its prose stay. For every node left, with C characters, LC of them in links, T tags and LT link tags, the density is ``C / T *
log(C / LC * T / LT + 1) / log(log(C / (C - LC) * LC + LC_body / C_body * C + e) + 1)``, where a zero count becomes 1. A node's score is the sum of its children's
densities. The node of the largest score is the article, widened to the outermost ``article`` or ``main`` element
around it; the least density on its path to the body is the threshold for what stands beside that path: elements
of any name next to it whose density reaches the threshold are taken as well, and so is an ``h1`` right before it.

Texts of block elements are joined by one blank in page order; white space inside a block becomes one blank,
character references are decoded. Nothing else is dropped. Defined results: null, empty and textless pages give
an empty text; unclosed elements end with their parent; markup cut off at the end of the page is ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav aside form script style noscript template svg math iframe object embed canvas audio video button select option textarea input label fieldset dialog menu map noembed noframes xmp".split())
ENDS_P = BLOCK - {"br", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "body", "html"}
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tbody thead tr td th", ("table",)), "tfoot": ("tbody thead tr td th", ("table",))}
#: Words of a class, id or role that mark what is not the article.
MARKS = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail widget widgets footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus replies respond reply share sharing social related recommended recommendations outbrain taboola pagination pager copyright search complementary contentinfo dialog".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?:/?[a-zA-Z][^>]*)\Z", re.S)
MARKED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PIECES = re.compile(r"[a-z]+", re.I)
#: Class words that begin so say how a page is laid out, not what the element is.
LAYOUT = ("no-", "has-", "with-", "without-")
#: Beside a mark in a class word, these say no more than the mark alone.
WRAPPERS = frozenset("area bar block box btn button buttons col column container content group holder inner item items left links list main outer panel right section slot top bottom unit wrap wrapper post posts page".split())
#: Elements that a class alone does not take out of an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th span em strong b i a code figcaption".split())
#: Dropped elements whose words stay in the prose of an article.
IN_PROSE = frozenset("button label math fieldset".split())
#: A marked element with at least this share of a page's text is the page, not a part beside the article.
WHOLE_PAGE = 0.8


class Node:
    __slots__ = ("name", "parent", "children", "gone", "marked", "inside", "prose", "chars", "links", "tags", "link_tags", "density")

    def __init__(self, name: str, parent: Node | None, gone: bool, marked: bool = False) -> None:
        self.name, self.parent, self.gone, self.marked = name, parent, gone, marked
        #: Whether it is (in) a main element or an article, and (in) an element of prose.
        self.inside = name in ("article", "main") or parent is not None and parent.inside
        self.prose = name in PROSE or parent is not None and parent.prose
        self.children: list[Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = 0.0


def _marked(attributes: str, strict: bool) -> bool:
    """Whether a class word, id or role marks the element; strictly, only by words of marks and wrappers."""
    for m in MARKED.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        for word in value.split():
            if word.lower().startswith(LAYOUT):
                continue
            pieces = [p.lower() for p in PIECES.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word))]
            if any(p in MARKS for p in pieces) and (not strict or all(p in MARKS or p in WRAPPERS for p in pieces)):
                return True
    return False


def _unwanted(name: str, parent: Node) -> bool:
    if name in DROPPED:
        return not (name in IN_PROSE and parent.inside and (name == "fieldset" or parent.prose))
    if name in ("header", "footer"):
        return name == "footer" or not parent.inside
    return False


def parse(page: str) -> Node:
    """The tree of a page; start and end tags may be missing."""
    root = Node("html", None, False)
    at, here = 0, root

    def pop_to(names: tuple[str, ...] | list[str], stop: tuple[str, ...]) -> None:
        nonlocal here
        p = here
        while p is not root and p.name not in stop:
            if p.name in names:
                here = p.parent
                return
            p = p.parent

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, attributes = m[2].lower(), m[3]
        if m[1]:
            p = here
            while p is not root and p.name != name:
                p = p.parent
            if p is not root:
                here = p.parent
            continue
        if name in ("html", "body"):
            if name == "body":
                while here.name == "head" or here.gone and here is not root and here.name == "head":
                    here = here.parent
            continue
        if name in ENDS_P:
            pop_to(("p",), ("article", "section", "div", "td", "th", "li", "blockquote", "table", "button"))
        if name in CLOSED_BY:
            names, stop = CLOSED_BY[name]
            pop_to(names.split(), stop)
        marked = False
        if "=" in attributes and name != "main":
            marked = not (here.inside and name in PROSE) and _marked(attributes, here.inside)
        node = Node(name, here, here.gone or _unwanted(name, here), marked)
        here.children.append(node)
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        here = node
    return root


def _left(root: Node) -> list[Node]:
    """The nodes that are not gone, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.gone)
    return order


def drop_marked(root: Node) -> None:
    """Marked elements go, unless they hold a main element, or an article that is not marked where none is elsewhere.

    Where a page has neither, marked articles and elements with most of its text stay too.
    """
    chars: dict[int, int] = {}
    order = _left(root)
    under: set[int] = set()  # in a marked element
    for node in order:
        if node.marked or node.parent is not None and id(node.parent) in under:
            under.add(id(node))
    free = any(node.name in ("main", "article") and id(node) not in under for node in order)
    holds: set[int] = set()
    for node in reversed(order):
        inside = [c for c in node.children if isinstance(c, Node) and not c.gone]
        chars[id(node)] = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(chars[id(c)] for c in inside)
        if node.name == "main" or node.name == "article" and not node.marked and (not free or id(node) not in under) or any(id(c) in holds for c in inside):
            holds.add(id(node))
    for node in order:
        if node.marked and id(node) not in holds:
            node.gone = id(root) in holds or node.name != "article" and chars[id(node)] < WHOLE_PAGE * chars[id(root)]


def measure(root: Node) -> list[Node]:
    """Counts and densities of the nodes that are left, children first."""
    order = _left(root)[::-1]
    for node in order:
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip())
            elif not c.gone:
                node.chars += c.chars
                node.links += c.links
                node.tags += c.tags + 1
                node.link_tags += c.link_tags + (c.name == "a")
        if node.name == "a":
            node.links, node.link_tags = node.chars, node.tags
    share = root.links / max(1, root.chars)
    for node in order:
        c, t = node.chars, max(1, node.tags)
        if c:
            plain = max(1, c - node.links)
            base = log(c / plain * node.links + share * c + e)
            node.density = c / t * log(c / max(1, node.links) * t / max(1, node.link_tags) + 1) / log(base + 1)
    return order


def _texts(node: Node, out: list[str]) -> None:
    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append("\n")
        elif isinstance(x, str):
            out.append(html.unescape(x))
        elif not x.gone:
            block = x.name in BLOCK
            if block:
                out.append("\n")
                stack.append(None)
            stack.extend(reversed(x.children))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    drop_marked(root)
    order = measure(root)

    def total(node: Node) -> float:
        return sum(c.density for c in node.children if isinstance(c, Node) and not c.gone) or node.density * 0.5

    best = max(reversed(order), key=total, default=root)
    path, p = [], best
    while p is not None:
        path.append(p)
        p = p.parent
    path = path[max((i for i, p in enumerate(path) if p.name in ("article", "main")), default=0) :]
    threshold = min(p.density for p in path)
    taken, on_path = {id(path[0])}, {id(p) for p in path[1:]}
    for below, p in zip(path, path[1:], strict=False):
        beside = [c for c in p.children if isinstance(c, Node) and not c.gone and c.chars]
        for c, following in zip(beside, [*beside[1:], None], strict=True):
            if c is not below and (c.density >= threshold or c.name == "h1" and following is below):
                taken.add(id(c))
    out: list[str] = []

    def collect() -> None:
        stack = [root]
        while stack:
            node = stack.pop()
            if id(node) in taken:
                _texts(node, out)
                out.append("\n")
            elif id(node) in on_path:
                stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    collect()
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
