"""Main text of HTML pages by composite text density.

A page becomes a tree.  Each node has its characters and tags, and those of links among
them; its density is characters per tag, lessened by a logarithm that grows with the share
of links.  A node's density sum is that of its children.  The subtree with the greatest
sum is the content; the least density on the path from it to the body is the threshold that
a child of the path must reach, with as much plain text as the content's own blocks, to
be content as well; beside the content itself, unless that is an article, plain text of any length is
content, and a heading belongs to the block behind it.  Article and main parts are only weighed: their density counts WEIGHT times,
when the content lies inside one and may be widened to it, and when one beside the path, of
whatever length, is held against the threshold.

Menus, headers, footers, sidebars, forms, notices, adverts and reader comments are left out by
their elements and by the names in their class, id and role, before densities count, unless such a
form or named element (not readers' comments) holds most of the page's text outside links, or is a
paragraph of an article, without links, whose name is an ordinary word (share, related);
scripts, styles and other parts without text never enter the tree.

Defined cases: null, empty and textless pages have empty text; unclosed elements end where
the next block or the page ends; an unclosed tag, comment or script ends the page; a page
without body elements is its own body; stray end tags are ignored; equal sums go to the
first node; texts of any length are read whole, in time linear in their length and depth; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from auditflow.llm import text as T

# As in the HTML standard a quote opens a value only right behind "="; elsewhere it is a letter, and ">" ends the tag.
_VALUE = r"(?>\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)"
_TAG = re.compile(rf"</?([a-zA-Z][^\s/>]*+)((?>[\s/]++|=?+[^\s/>=]++(?>\s*+=\s*+{_VALUE}?+)?+|=)*+)>")
_ATTRIBUTE = re.compile(r"=?([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
#: Fixed element names of the HTML standard.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element on the left is closed by the start of one on the right.
_ENDS_P = BLOCKS - frozenset("br caption li dd dt tr td th tbody thead tfoot option body html".split())
CLOSED_BY = {
    "p": _ENDS_P | {"li", "dd", "dt", "td", "th", "tr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "head": {"body"},
}
ENDED_BY = {tag: [x for x, by in CLOSED_BY.items() if tag in by] for tag in BLOCKS | {"option", "optgroup"}}
_SCOPE = frozenset("table td th body html article section div ul ol dl".split())
DROPPED = frozenset("nav footer aside form button select input label fieldset svg canvas object audio video map dialog menu head".split())
#: Words of class, id and role that mark what is no content.
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead sidebar aside widget ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login search share sharing social comment comments commentlist disqus respond replies reply discussion related recommended "
    "recommendations pagination pager toolbar skip copyright contentinfo complementary "
    "cookie-notice cookie-banner cookie-consent site-header site-footer page-footer nav-bar menu-bar side-bar ad-banner social-share share-buttons "
    "comment-list post-comments related-posts related-articles skip-link newsletter-signup".split()
)
#: Marks that are also common headings: as an id they may be the anchor of a section.
HEADINGS = frozenset("discussion comment comments notice notices notification related recommended recommendations search share sharing social subscription promotion reply respond replies sponsor "
                     "copyright advertising".split()) - {"comments", "respond"}
#: Marks of what readers write, which may well be longer than the content.
READERS = frozenset("comment comments commentlist comment-list post-comments disqus respond replies reply discussion".split())

#: Marks that an article's own paragraphs may have as ordinary words.
WORDS = HEADINGS - READERS - frozenset("notice notices notification promotion sponsor copyright advertising".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Blocks that hold a part of a text; the content is what holds them.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt br hr".split())
#: What counts for an article or main part where its density is held against the densest subtree inside it, or the threshold.
WEIGHT = 2.0


class Node:
    __slots__ = ("tag", "parent", "first", "last", "marked", "chars", "tags", "link_chars", "link_tags", "density", "sum", "children", "plain", "links",
                 "article", "depth", "scope")

    def __init__(self, tag: str, parent: Node | None, first: int, marked: int):
        self.tag, self.parent, self.first, self.last, self.marked = tag, parent, first, first, marked
        self.plain = 0
        self.links = False
        self.article = tag in ("article", "main")
        self.depth = parent.depth + 1 if parent else 0
        self.scope: int = self.depth if parent is None or tag in _SCOPE else parent.scope  # depth of the nearest scope around
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.children: list[Node] = []


def _is_marked(tag: str, attributes: str) -> int:
    """Whether an element is left out by its name, or by the names in its attributes: 0 no, 1 unless it wraps the page,
    2 always, -1 unless it is an article's own and without links."""
    marked = 0
    if tag in DROPPED:
        if tag not in ("form", "fieldset"):
            return 2
        marked = 1
    if not attributes or tag in ("body", "html", "article", "main"):
        return marked
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            if name == "role" and value in ("main", "article"):
                return 0
            names = MARKS.intersection(value.split())
            if name == "id":
                names -= HEADINGS
            if names and tag == "p" and names <= WORDS and marked < 1:
                marked = -1
            elif names and tag not in HEADS:
                marked = max(marked, 1 if READERS.isdisjoint(names) else 2)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
    return marked


def parse(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of a page, and its stretches of text in page order; a block's edge is a stretch ' '."""
    root = Node("html", None, 0, 0)
    here, body, at, pieces = root, None, 0, []
    opened: defaultdict[str, list[Node]] = defaultdict(list)  # open elements by name, so that no end costs a search

    def close(node: Node) -> None:
        nonlocal here
        while here is not node.parent:
            here.last = len(pieces)
            if here is not root:
                opened[here.tag].pop()
            here = here.parent

    while at < len(html):
        sign = html.find("<", at)
        if sign < 0 or sign > at:
            end = len(html) if sign < 0 else sign
            pieces.append((here, html[at:end]))
            at = end
            continue
        after = html[at + 1 : at + 2]
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = len(html) if end < 0 else end + 3
        elif after in ("!", "?"):
            end = html.find(">", at)
            at = len(html) if end < 0 else end + 1
        elif not (after.isascii() and after.isalpha() or after == "/" and html[at + 2 : at + 3].isalpha()):
            pieces.append((here, "<"))
            at += 1
        else:
            found = _TAG.match(html, at)
            if found is None:
                break
            at, tag, rest = found.end(), found[1].lower(), found[2]
            if tag in BLOCKS:
                pieces.append((here, " "))
            if after == "/":
                if not opened[tag]:
                    continue
                node = opened[tag][-1]
                if tag in _SCOPE or tag not in BLOCKS or node.depth > here.scope:
                    close(node)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = len(html) if end is None else end.start()
                if end is not None:
                    at = html.find(">", at) + 1 or len(html)
                continue
            if tag in ("html", "body") or tag in VOID:
                if tag == "body" and body is None:
                    node = here
                    while node is not root and node.tag != "head":
                        node = node.parent
                    if node is not root:
                        close(node)
                    here.children.append(body := Node("body", here, len(pieces), 0))
                    opened["body"].append(body)
                    here = body
                elif tag in VOID:
                    here.tags += 1
                continue
            ending = max((opened[x][-1] for x in ENDED_BY.get(tag, ()) if opened[x]), key=lambda n: n.depth, default=None)
            if ending is not None and ending.depth >= here.scope:  # an open element may end where this one starts
                close(ending)
            node = Node(tag, here, len(pieces), _is_marked(tag, rest))
            here.children.append(node)
            opened[tag].append(node)
            here = node
    close(root) if here is not root else None
    root.last = len(pieces)
    return body or root, [(node, references.unescape(piece) if "&" in piece else piece) for node, piece in pieces]


def _measure(body: Node, pieces: list[tuple[Node, str]]) -> list[Node]:
    """All unmarked nodes in page order, with their densities; a marked node counts as nothing."""
    every, stack = [], [body]
    while stack:
        every.append(node := stack.pop())
        stack.extend(node.children)
    for node, piece in pieces:
        node.plain += len(piece.strip())
    for node in reversed(every):
        if node.tag == "a":
            node.links, node.plain = node.plain > 0 or node.links, 0
        if node is not body:
            node.parent.plain += node.plain
            node.parent.links |= node.links
            node.parent.article |= node.article
    order, stack = [], [(body, False)]
    while stack:
        node, inside = stack.pop()
        order.append(node)
        inside = inside or node.tag in ("article", "main")
        # What is no content unless it holds the page's article or most of its text; an article's own header is content.
        node.children = [c for c in node.children if not (c.marked or c.tag == "header" and not inside) or c.marked < 0 and inside and not c.links
                         or c.marked < 2 and 2 * c.plain > body.plain or c.article]
        stack.extend((c, inside) for c in reversed(node.children))
    for node, piece in pieces:
        if piece != " ":
            node.chars += len(piece.strip())
    for node in reversed(order):
        link = node.tag == "a"
        if link:
            node.link_chars, node.link_tags = node.chars, 1
        for c in node.children:
            node.chars += c.chars
            node.tags += c.tags + 1
            node.link_chars += c.chars if link else c.link_chars
            node.link_tags += c.link_tags
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        n, tags, links, link_tags = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if n:
            base = math.log(n / max(n - node.link_chars, 1) * node.link_chars + share * n + math.e)
            node.density = n / tags * max(math.log(n / links * tags / link_tags, max(base, 1.0 + 1e-9)), 0.0)
        node.sum = sum(c.density for c in node.children) if node.children else node.density
    return order


def _beside(path: list[Node], threshold: float, usual: float, headed: bool) -> list[Node]:
    """What is content beside the path: articles as dense as the threshold, and blocks as dense and as long.

    Beside content that is no article, paragraphs and what holds some stay however short; a heading goes with
    the block behind it, unless the content is an article with headings of its own.
    """
    inside, found = {id(n) for n in path}, []
    loose = path[0].tag not in ("article", "main")
    for level, node in enumerate(path[1:]):
        follows = False
        for c in reversed(node.children):
            if id(c) in inside:
                follows = True
            elif c.chars and c.tag in BLOCKS:
                heading = c.tag in HEADS
                block = c.tag == "p" or any(x.tag == "p" for x in c.children)
                dense = c.density * (WEIGHT if c.article else 1) >= threshold
                ok = 2 * c.link_chars < c.chars and (
                    dense and (c.article or c.chars >= usual and (heading or block)) or heading and follows and (loose or not headed) or block and loose and not level)
                if ok:
                    found.append(c)
                follows = ok
    return found


def _text(node: Node, pieces: list[tuple[Node, str]], kept: set[int]) -> str:
    return " ".join("".join([piece for owner, piece in pieces[node.first : node.last] if id(owner) in kept]).split())


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    body, pieces = parse(html)
    body.last = len(pieces)
    order = _measure(body, pieces)
    if not body.chars:
        return ""
    best = max((n for n in order if n.children or n is body or n.tag in BLOCKS), key=lambda n: n.sum, default=body)
    while best.parent is not None and best is not body and (best.tag not in BLOCKS or best.tag in LINES):
        best = best.parent
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    around = next((k for k, n in enumerate(path) if n.tag in ("article", "main")), 0)
    if WEIGHT * path[around].density >= best.density:
        path = path[around:]
        best = path[0]
    own = sorted(n.chars for n in order if n.tag == "p" and n.first >= best.first and n.last <= best.last)
    usual = own[len(own) // 2] if own else best.chars
    headed = any(n.tag in HEADS and n.first >= best.first and n.last <= best.last for n in order)
    parts = [best, *_beside(path, threshold, usual, headed)]
    kept = {id(n) for n in order}
    return " ".join(filter(None, (_text(n, pieces, kept) for n in sorted(parts, key=lambda n: n.first))))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
