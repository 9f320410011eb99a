"""Main text of web pages by composite text density.

A page is read into a tree (raw-text elements, implied end tags and cut-off markup as browsers read them); scripts, styles, form
controls, media and hidden elements hold no text.  For every other node, with C characters, T tags below it, LC link characters and
LT link tags, the composite density is C/T times the logarithm of C/LC * T/LT to a base that grows with the share of links
in the node and in the page.  The node whose children's densities have the largest sum is the core.

Elements that by name, class, id or role look like menus, headers and footers of the site, sidebars, forms, notices, adverts or
comments are suspects: what is in them counts ``WEAK``, ``FORM``, ``HEADER`` or ``STRONG`` as much, in sums and in the counts of the nodes above.
A suspect around the core is forgiven (a <form> around the page, say).  Any other is text only when few of its characters are links
and its density, less the same penalty, reaches ``FLOOR`` of the least density on the path from the body to the core (taken as a tenth of the core's
at least).  The page's only <h1> is kept in a suspect header, unless it is a link.

Beside the path all other text joins, whatever its density, when less than ``LINKS`` of its characters are links; loose text counts with the
inline elements beside it.  Headings beside the path join in any case; of a neighbour with more links, the parts with fewer join.  Lists of five
or more short links and little else go, beside the core and in it.

Blocks (paragraphs, headings, list items, cells, ...) are joined by one newline in page order; character references are
decoded, white space within a block becomes one space.  A <br> is white space.  Null and empty pages, and pages without text,
give an empty text.  Pages are read whole, in time proportional to their length; repeated rows get equal results; other columns aren't read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-modal)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - frozenset("caption dd dt li legend optgroup option tbody td tfoot th thead tr body html".split()) | {"li", "dd", "dt"}
_CLOSES = {"li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
_NEVER = frozenset("head button select input datalist option optgroup svg object canvas audio video map annotation annotation-xml".split())
_SUSPECT = {"form": "form", "header": "header"} | dict.fromkeys("nav footer aside dialog menu search".split(), "strong")
_ROLES = {"banner": "header", "search": "weak", "form": "form"} | dict.fromkeys("navigation contentinfo complementary dialog alertdialog alert menu menubar toolbar".split(), "strong")
_STRONG = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promotion promoted replies respond sidebar sidebars signup sponsor sponsored subscribe subscription".split())
_WEAK = frozenset("disclaimer discussion overlay related reply search share sharing social toolbar widget widgets".split())
#: Words beside those of ``_WEAK`` that say nothing else; with any other word, as in related-work, the name may be that of a section.
_BESIDE = frozenset("area article articles bar block bottom box btn button buttons container content element form icon icons inline inner item items left link links list main media more networks news outer panel post posts read right section side stories story this tool tools top wrap wrapper".split())
_OF_ARTICLE = frozenset("article blog body chapter content entry main news page post section story text title".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_KEEPS = frozenset(("html", "body", "article", "main"))
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_STATE = frozenset(("has", "with", "no", "without", "is"))
LINKS, FLOOR, WEAK, FORM, HEADER, STRONG = 0.3, 0.15, 0.5, 0.3, 0.05, 0.001
_PENALTY = {None: 1.0, "weak": WEAK, "header": HEADER, "form": FORM, "strong": STRONG, "never": 0.0}
#: A list of so many links, with texts of so many characters in the mean, is a menu.
MENU_LINKS, MENU_TEXT = 5, 40


class _Node:
    __slots__ = ("chars", "children", "density", "kind", "link_chars", "link_tags", "name", "parent", "sum", "tags", "weight")

    def __init__(self, name: str, parent: _Node | None, kind: str | None = None):
        self.name, self.parent, self.kind = name, parent, kind
        self.children: list[_Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0.0
        self.density = self.sum = 0.0
        self.weight = (parent.weight if parent else 1.0) * _PENALTY[kind]

    @property
    def out(self) -> bool:
        return self.kind == "never"


def _kind(name: str, attributes: str, in_article: bool) -> str | None:
    """What an element's name and attributes say against it: never, strong, form, header, weak or nothing."""
    if name in _NEVER:
        return "never"
    found = {_SUSPECT.get(name)}
    if name == "header" and in_article:
        found = set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        kind, value = m[1].lower(), (m[2] or "").strip("\"'")
        if kind == "hidden" and value.lower() != "until-found" or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "never"
        if name in _KEEPS:
            continue
        if kind == "aria-modal" and value.lower() != "false":
            found.add("strong")
        elif kind == "role":
            found.add(_ROLES.get(value.lower()))
        elif kind == "class" or kind == "id" and name not in _HEADINGS:
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                if not words or words[0] in _STATE:
                    continue
                if not _STRONG.isdisjoint(words):
                    found.add("strong")
                elif not _WEAK.isdisjoint(words):
                    found.add("weak" if "discussion" in words or set(words) - _WEAK - _BESIDE else "strong")
                elif "header" in words and _OF_ARTICLE.isdisjoint(words):
                    found.add("header")
    return next((k for k in ("strong", "form", "header", "weak") if k in found), None)


class _Open:
    """The open elements, with the places of each name, so that no tag searches the whole stack."""

    def __init__(self, root: _Node):
        self.stack, self.places, self.blocks = [root], defaultdict(list), [0]

    def push(self, node: _Node) -> None:
        self.places[node.name].append(len(self.stack))
        if node.name in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()
        while self.blocks[-1] >= at:
            self.blocks.pop()

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else 0

    def open_tag(self, name: str) -> None:
        """Closes what a start tag closes by itself: an open p, items, cells and rows of the same list or table."""
        if name in _ENDS_P and self.stack[self.blocks[-1]].name == "p":
            self.cut(self.blocks[-1])
        if name in _CLOSES:
            closed, limits = _CLOSES[name]
            limit = max(self.last(n) for n in limits)
            inner = [p[k] for n in closed if (p := self.places.get(n)) and (k := bisect_right(p, limit)) < len(p)]
            if inner:
                self.cut(min(inner))


def parse(page: str) -> _Node:
    """The tree of a page, from the root."""
    root = _Node("html", None)
    opened, at, end, body = _Open(root), 0, len(page), False
    while at < end:
        m = _MARKUP.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            opened.stack[-1].children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if m[1]:
            if k := opened.last(m[1].lower()):
                opened.cut(k)
            continue
        name = (m[2] or m[4] or "").lower()
        if not name or m[4] and page[m.end() - 1] != ">":
            continue  # a comment, a declaration, or a tag that the page's end cuts off
        attributes = m[3] or m[5] or ""
        if name == "html" or name == "body" and body:
            continue
        if name == "body":
            body = True
            if opened.stack[-1].name == "head":
                opened.cut(len(opened.stack) - 1)
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else end
            continue
        opened.open_tag(name)
        node = _Node(name, opened.stack[-1], _kind(name, attributes, bool(opened.last("article") or opened.last("main"))))
        opened.stack[-1].children.append(node)
        if name not in _VOID and not attributes.endswith("/"):
            opened.push(node)
    return root


def _in_order(root: _Node) -> list[_Node]:
    """The nodes that may hold text, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.out:
            out.append(node)
            todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def _measure(nodes: list[_Node]) -> None:
    """Counts, densities and sums of all nodes; a suspect counts for its penalty's share in the nodes above it."""
    for node in reversed(nodes):
        node.chars += sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        elif node.name == "math":
            node.tags = 0.0  # a formula is one element
        if (p := node.parent) is not None:
            w = _PENALTY[node.kind]
            p.chars, p.tags, p.link_chars, p.link_tags = p.chars + w * node.chars, p.tags + w * (node.tags + 1), p.link_chars + w * node.link_chars, p.link_tags + w * node.link_tags
    page = next((n for n in nodes if n.name == "body"), nodes[0])
    share = page.link_chars / max(page.chars, 1)
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        if node.parent is not None:
            node.parent.sum += node.weight * node.density


def density(chars: float, tags: float, link_chars: float, link_tags: float, share: float) -> float:
    """Composite text density of a node in a page with the given share of link characters; each count is 1 at least where it divides.

    The constant e**e keeps the base at e or more, so that nodes of few characters and pages without links have densities of the same scale.
    """
    if not chars:
        return 0.0
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e**math.e)
    return chars / t * math.log(max(chars / lc * t / lt, 1)) / math.log(base)


class _Choice:
    """Which nodes' subtrees are the text, and which nodes in them are not."""

    def __init__(self, nodes: list[_Node]):
        body = next((n for n in nodes if n.name == "body"), nodes[0])
        core = max(nodes, key=lambda n: n.sum)  # the first in page order among equals
        path = [core]
        while path[-1] is not body and path[-1].parent is not None:
            path.append(path[-1].parent)
        self.core, self.path = core, {id(n) for n in path}
        self.least = FLOOR * max(min(n.density for n in path), core.density / 10)
        heads = [n for n in nodes if n.name == "h1"]
        self.title = heads[0] if len(heads) == 1 and heads[0].link_chars < LINKS * heads[0].chars else None
        self.chosen = {id(core)}
        todo, broken = path[1:], set()
        for node in reversed(nodes):
            if node.parent is not None and (node.name in _BLOCK or id(node) in broken):
                broken.add(id(node))
                broken.add(id(node.parent))
        while todo:
            node = todo.pop()
            few, many = [], []
            for u in _units(node, broken):
                if id(u[0]) not in self.path:
                    fits = sum(c.link_chars for c in u) < LINKS * sum(c.chars for c in u) or id(node) in self.path and u[0].name in _HEADINGS
                    (few if fits else many).append(u)
            if id(node) not in self.path and all(u[0].name in _HEADINGS for u in few):
                few = []  # the caption of a menu
            self.chosen.update(id(c) for u in few for c in u)
            todo += [u[0] for u in many if id(u[0]) in broken and u[0].name != "a" and not self.drops(u[0])]
        title = self.title
        while title is not None and id(title) not in self.path and title.kind != "header":
            title = title.parent
        if title is not None and title.kind == "header" and id(title) not in self.path and self.drops(title):
            self.chosen.add(id(self.title))
        else:
            self.title = None

    def drops(self, node: _Node) -> bool:
        """Whether a node off the core's path is a suspect of too low density, or a menu."""
        if node.out:
            return True
        if id(node) in self.path:
            return False
        if node.kind and (node.link_chars >= LINKS * node.chars or node.density * _PENALTY[node.kind] < self.least):
            return True
        return node.name in _BLOCK and node.link_tags >= MENU_LINKS and node.link_chars >= 0.8 * node.chars and node.link_chars <= MENU_TEXT * node.link_tags and node.density < self.core.density


def _units(node: _Node, broken: set[int]) -> list[list[_Node]]:
    """Children of a node that may hold text: each block by itself, runs of text and inline elements together; texts become nodes."""
    out: list[list[_Node]] = [[]]
    for k, c in enumerate(node.children):
        if isinstance(c, str):
            text, c = c, _Node("", node)
            c.children, c.chars = [text], len("".join(text.split()))
            node.children[k] = c
        if c.name in _BLOCK or id(c) in broken:
            out += [[], []] if c.out else [[c], []]
        elif not c.out:
            out[-1].append(c)
    return [u for u in out if u]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    nodes = _in_order(parse(page))
    _measure(nodes)
    if not nodes[0].chars:
        return ""
    choice, blocks, piece = _Choice(nodes), [], []

    def close() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            blocks.append(text)

    todo: list[tuple[_Node | str | None, bool, bool]] = [(nodes[0], False, False)]
    while todo:
        item, inside, dropped = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            if inside and not dropped:
                piece.append(item)
        elif item.out:
            if item.name in _BLOCK:
                close()
        else:
            inside = inside or id(item) in choice.chosen
            dropped = item is not choice.title and (dropped or choice.drops(item))
            if item.name in _BLOCK:
                close()
                todo.append((None, False, False))
            elif item.name == "br" and inside:
                piece.append(" ")
            todo += [(c, inside, dropped) for c in reversed(item.children)]
    close()
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
