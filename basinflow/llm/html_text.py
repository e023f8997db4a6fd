"""Main text of web pages by composite text density over the nodes of the page."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Tags without content, tags that break a line of text, tags whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
#: Tags whose content is never read; tags, roles and names that say that a part isn't the article.
UNREAD = frozenset("script style textarea title template iframe noembed noframes noscript xmp head svg canvas object select option button".split())
OTHER_TAGS = frozenset("nav footer aside form dialog menu".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OTHER_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?s?|comments?|commentlist|disqus|respond|replies|sidebar|side-?bar|widget|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|masthead|cookies?|consent|gdpr|newsletter|subscribe|signup|sign-up|login|popup|modal|overlay|social|share|sharing|related|recommended|toolbar|pagination|pager|skip-?link)(?:$|[-_\s\d])",
    re.I,
)
#: What names are read of; a paragraph or heading is judged by its place alone.
NAMED = frozenset("article div section ul ol dl table header details fieldset figure center".split())
#: Of the chosen subtree's text, how much a part has to hold to be the article by itself, how much lies
#: outside for its parent to be chosen instead, and how much a marked article has to hold.
WHOLE, OUTSIDE, MARKED = 0.5, 0.5, 0.5
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: An end tag that may be missing; the start tags that imply it, and where that stops.
IMPLIED = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())
#: Blocks that are text themselves rather than hold blocks of it.
PARAGRAPHS = frozenset("p h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figure figcaption".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parts", "parent", "anchor", "unread", "other", "sure", "article", "chars", "links", "tags", "link_tags", "density", "total", "rank", "holds")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.parts = tag, parent, []
        #: The nearest node, itself included, that isn't inline.
        self.anchor = parent.anchor if tag in INLINE and parent is not None else self
        values = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        role = values.get("role", "").lower()
        whole = tag in ("html", "body")
        self.unread = tag in UNREAD or not whole and ("hidden" in values or values.get("aria-hidden") == "true" or bool(HIDDEN.search(values.get("style", ""))))
        named = tag in NAMED and bool(OTHER_NAMES.search(f"{values.get('class', '')} {values.get('id', '')}"))
        self.article = (tag in ("article", "main") or role in ("main", "article") or values.get("itemprop", "").lower() == "articlebody") and not named
        # A header of the whole page, not of an article.
        banner = tag == "header" and (parent is None or parent.tag in ("body", "html", "#root"))
        self.sure = tag in OTHER_TAGS - {"form"} or banner
        self.other = not whole and (self.sure or tag in OTHER_TAGS or role in OTHER_ROLES or named)

    def inside(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node) and not p.unread]

    def own(self) -> int:
        return sum(len(_SPACE.sub(" ", p).strip()) for p in self.parts if isinstance(p, str))


class Open:
    """How often each tag stands open: in all, and inline ones since the last block, so that a stray end tag costs one look."""

    def __init__(self):
        self.all: dict[str, int] = {}
        self.inline: list[dict[str, int]] = [{}]

    def enter(self, tag: str) -> None:
        self.all[tag] = self.all.get(tag, 0) + 1
        if tag in BLOCK:
            self.inline.append({})
        elif tag in INLINE:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1

    def leave(self, tag: str) -> None:
        self.all[tag] -= 1
        if tag in BLOCK:
            self.inline.pop()
        elif tag in INLINE:
            self.inline[-1][tag] -= 1

    def has(self, tag: str) -> bool:
        return (self.inline[-1] if tag in INLINE else self.all).get(tag, 0) > 0


def parse(html: str) -> Node:
    """A tree of nodes and texts, in time linear in the page. Missing end tags are implied, stray ones
    ignored; an inline end tag doesn't close the blocks that stand open inside it. No recursion."""
    root = Node("#root", None)
    at, here, end, known = 0, root, len(html), Open()

    def up_to(node: Node) -> Node:
        """Closes the open nodes up to this one; its parent."""
        nonlocal here
        while True:
            known.leave(here.tag)
            done, here = here is node, here.parent
            if done:
                return here

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            here.parts.append(html[at:])
            break
        if lt > at:
            here.parts.append(html[at:lt])
        m = _TOKEN.match(html, lt)
        if m is None:
            here.parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                here.parts.append(m[0][9:-3])
            continue
        name = name.lower()
        if m[1]:
            if known.has(name):
                node = here
                while node.tag != name:
                    node = node.parent
                up_to(node)
            elif name in ("br", "p"):
                here.parts.append(Node(name, here))
            continue
        for tag, by in IMPLIED.items():
            if name in by and known.all.get(tag):
                node = here.anchor
                while tag != "p" and node.tag == "p":
                    node = node.parent.anchor
                if node.tag == tag:
                    up_to(node)
        node = Node(name, here, m[3])
        here.parts.append(node)
        if name in VOID or m[3].endswith("/") and name in ("svg", "path", "use"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            node.parts.append(html[at : close.start() if close else end])
            at = close.end() if close else end
            continue
        here = node
        known.enter(name)
    return root


def measure(root: Node) -> list[Node]:
    """Counts characters, tags and those in links upwards, and the densities and their sums; the
    nodes that are read, parents first. A line break is no tag.

    A node's own text, beside its children, counts in its sum as one child more.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.inside()
    owns = {}
    for node in reversed(order):
        inside, own = node.inside(), node.own()
        owns[id(node)] = own
        node.chars = own + sum(c.chars for c in inside)
        node.tags = sum(c.tags + (c.tag not in ("br", "wbr")) for c in inside)
        node.links = node.chars if node.tag == "a" else sum(c.links for c in inside)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in inside)
        node.holds = node.article or node.tag == "h1" or any(c.holds for c in inside)
    body = next((n for n in order if n.tag == "body"), root)
    share = body.links / max(body.chars, 1)
    for rank, node in enumerate(order):
        node.rank = rank
        node.density = density(node.chars, node.tags, node.links, node.link_tags, share)
    for node in order:
        inside, own = node.inside(), owns[id(node)]
        alone = 0.0 if node.tag == "a" else density(own, sum(c.tag not in ("br", "wbr") for c in inside), 0, 0, share)
        node.total = alone + sum(c.density for c in inside if not c.other)
    return order


def density(chars: int, tags: int, links: int, link_tags: int, share: float) -> float:
    """Composite text density: characters per tag, times the logarithm of
    (chars / links) (tags / link_tags), to the base ln(chars links / (chars - links) + share chars + e).

    share: that of characters in links in the whole body. A count of 0 under a fraction line is 1;
    the base is e at least, since without links it is 1, to which there is no logarithm.
    """
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - links, 1) * links + share * chars + math.e)
    adjust = math.log(max(chars / max(links, 1) * max(tags, 1) / max(link_tags, 1), 1.0)) / math.log(max(base, math.e))
    return chars / max(tags, 1) * adjust


def _text(node: Node) -> int:
    return node.chars - node.links


def main_node(order: list[Node], root: Node) -> Node:
    """The subtree of the greatest sum of child densities, then what marks and thresholds make of it.

    The threshold is the least density on the path from that node to the body. The parent is taken
    instead while parts beside the node that reach the threshold, links aside, hold half as much
    text again; then a part that holds most of the text, beside which nothing is dense. An article
    or main element around the node, or one inside with half of its text, is taken for it.
    """
    body = next((n for n in order if n.tag == "body"), root)
    # Parts that are marked as something else than the article aren't chosen.
    outside: set[int] = set()
    for node in order:
        if node.parent is not None and id(node.parent) in outside or _is_other(node, body):
            outside.add(id(node))
    inside = [n for n in order if n.chars and id(n) not in outside and n.tag not in INLINE]
    if not inside:
        return body
    best = max(inside, key=lambda n: (n.total, -n.rank))
    threshold, node = best.density, best
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
    while best is not body and best.parent is not None and best.tag != "body":
        up = best.parent
        beside = [c for c in up.inside() if c is not best and id(c) not in outside and c.density >= threshold and 2 * c.links <= c.chars]
        if sum(map(_text, beside)) + up.own() < OUTSIDE * _text(best):
            break
        best = up
    while (part := _lone_part(best, outside)) is not None and (part.article or not best.article):
        best = part
    around, outer = best, None
    while around is not None:
        outer = around if around.article else outer
        around = around.parent
    if outer is not None:
        return outer
    marked = max((n for n in inside if n.article and _below(n, best)), key=lambda n: n.chars, default=None)
    if marked is not None and _text(marked) >= MARKED * _text(best):
        return marked
    return _with_headline(best, outside)


def _lone_part(node: Node, outside: set[int]) -> Node | None:
    """The block inside a node that holds half of its text, where nothing beside it is as much as half as
    dense, a paragraph or loose text; headlines aside."""
    if node.own():
        return None
    parts = [c for c in node.inside() if c.chars and id(c) not in outside and 2 * c.links <= c.chars]
    part = max((c for c in parts if c.tag in BLOCK - PARAGRAPHS), key=_text, default=None)
    if part is None or _text(part) < WHOLE * _text(node) or any(c.tag in PARAGRAPHS or 2 * c.density >= part.density for c in parts if c is not part and c.tag != "h1"):
        return None
    return part


def _is_other(node: Node, whole: Node) -> bool:
    """Marked as something else than the article; a mark around the headline, or nearly all text, is of no account."""
    return node.other and (node.sure or not node.holds and 10 * _text(node) < 9 * _text(whole))


def _below(node: Node, top: Node) -> bool:
    while node is not None and node is not top:
        node = node.parent
    return node is top


def _with_headline(best: Node, outside: set[int]) -> Node:
    """A node of the headline that stands right before the subtree, and the subtree; or the subtree alone."""
    up = best.parent
    if up is None or up.tag == "#root" or any(n.tag == "h1" for n in _walk(best)):
        return best
    before = [c for c in up.inside()[: up.inside().index(best)] if id(c) not in outside]
    if not before or before[-1].tag not in ("h1", "header", "hgroup") or not any(n.tag == "h1" for n in _walk(before[-1])):
        return best
    both = Node("div", None)
    both.parts = [before[-1], best]
    return both


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += node.inside()


def main_text(html: str | None) -> str:
    """The article of a page as text: see extract()."""
    if not html:
        return ""
    root = parse(html.replace("\x00", ""))
    order = measure(root)
    node = main_node(order, root)
    blocks, line = [], []
    stack: list[object] = [node]
    while stack:
        part = stack.pop()
        if part is None:
            blocks.append("".join(line))
            line = []
        elif isinstance(part, str):
            line.append(unescape(part))
        elif part is node or not part.unread and not _is_other(part, order[0]):
            edge = [None] if part.tag in BLOCK else []
            stack += [*edge, *reversed(part.parts), *edge]
    blocks.append("".join(line))
    return " ".join(t for t in (_SPACE.sub(" ", b).strip() for b in blocks) if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    pages: page_id, url, html; more columns are ignored. The text is that of the page's main node
    (main_node: the greatest sum of composite text densities), its headline included, without menus,
    footers, sidebars, notices, adverts, forms, scripts, styles and comments that are marked as such
    by a tag, a role or a container's name: references decoded, white space inside a block one blank, blocks in page order joined by one
    blank. Null or empty pages, and pages without text, give the empty text; broken markup is read
    as far as it goes; repeated rows are treated each by itself; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
