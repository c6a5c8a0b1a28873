"""Main text of web pages by composite text density.

A page becomes a DOM tree. For every node the density is its characters per tag, adjusted by its link characters and
link tags and by the body's link share; a part that names itself (by tag, whole class or id, or role) as a menu, header,
footer, sidebar, notice, advert, form or reader comments, and all in it, has ``NAMED`` of it. A node's density sum is that
of its children. The node with the largest sum is the main one; from it the search goes down as long as one child's own
sum is more than what all of the node but that child adds to the sum, so that a page's frame does not stand for its
article. The least density on the path from the body to the main node is the threshold. Another subtree that passes it is
kept, too, if its largest sum is at least ``SHARE`` of the main one's, so that text in several blocks is whole; text that
stands directly in a node that passes is kept with its inline elements. Paragraphs, headings and lists beside a chosen
one, under the same parent, are kept however short they are, unless all of their text is links.

What is left out is left out for its density: within what is kept, a part that names itself goes where its lowered density
does not reach the threshold. Where all of a page stands in such a part (an unclosed menu, a form around all), all
densities are lowered alike and the choice is the same.

Defined cases: null, empty or text-free pages give empty text; tags that are not closed end with their parent; a page
cut off in the middle gives what it has; an unfinished tag at the end is dropped; of equal density sums the outermost,
then the first node counts; repeated rows are kept; an empty table gives no rows; pages may be of any length and depth;
other columns are ignored, whatever their names (also ``text`` and ``n_chars``).
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden|aria-label|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe svg math object canvas".split())
#: Elements that name themselves as something outside the article.
OUTSIDE = frozenset("head nav footer aside form button select option menu dialog audio video".split())
#: Elements that do not separate words.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: Names of parts outside the article, and words that may stand beside one in a class or id: ``site-header``.
ROLES = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar aside rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar share sharing social related recommended "
    "recommendations comment comments disqus reply replies respond newsletter subscribe subscription signup login popup modal overlay pagination pager skip toolbar".split()
)
BESIDE = frozenset("main site page global top bottom left right primary secondary inner outer area bar box block list group container wrapper wrap slot section form items item links buttons post posts to".split())
ARIA = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Opening one of the keys ends an open element of the values, within the nearest of the borders.
_P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SCOPE = frozenset("body html table td th article section main div aside nav header footer form button object caption".split())
#: Blocks that belong together under one parent.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
#: What a part's name leaves of its density; the least part of the main sum that another block of text has.
NAMED, SHARE = 0.02, 0.2


class Node:
    __slots__ = ("best", "chars", "density", "kids", "link_chars", "link_tags", "named", "outside", "parent", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None, named: bool = False):
        self.tag, self.parent, self.named, self.kids = tag, parent, named, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.outside = False
        self.best = self

    def nodes(self) -> list[Node]:
        return [k for k in self.kids if k.__class__ is Node]


def _names_itself(tag: str, attributes: str, here: Node) -> bool:
    """Whether an element names itself as something other than the article."""
    if tag in OUTSIDE or (tag == "header" and not _in_article(here)):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name == "role" and value.lower() in ARIA:
            return True
        if name in ("class", "id") and any(_is_role(one) for one in value.split()):
            return True
    return False


def _is_role(name: str) -> bool:
    """Whether a whole class or id is a role, or roles with words that go with any."""
    words = {w.lower() for w in _WORDS.findall(name)}
    return bool(words & ROLES) and all(w in ROLES or w in BESIDE or w.isdigit() for w in words)


def _in_article(node: Node | None) -> bool:
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def parse(page: str) -> Node:
    """The tree of a page's text; text children are strings."""
    body = Node("body", None)
    here, at, size = body, 0, len(page)
    low = None
    while at < size:
        found = _TAG.search(page, at)
        if not found:
            here.kids.append(page[at:])
            break
        if found.start() > at:
            here.kids.append(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            node = here
            while node.tag != tag and node is not body and not (node.tag in _SCOPE and tag in INLINE | {"p"}):
                node = node.parent
            if node.tag == tag and node is not body:
                here = node.parent
            continue
        if tag in RAW:
            low = low or page.lower()
            end = low.find(f"</{tag}", at)
            if end < 0 and tag not in ("script", "style", "textarea", "title", "template"):
                end = at  # never closed: only the tag itself goes
            at = size if end < 0 else end
            if end >= 0 and low.startswith(f"</{tag}", at):
                at = page.find(">", at) + 1 or size
            continue
        if tag in ("html", "body"):
            here = body if here.tag == "head" else here
            continue
        if tag in _P_ENDERS:
            here = _closed(here, {"p"}, _SCOPE, body)
        elif tag in _ENDS:
            here = _closed(here, *_ENDS[tag], body)
        node = Node(tag, here, _names_itself(tag, found[3], here))
        here.kids.append(node)
        if tag not in VOID and not found[3].endswith("/"):
            here = node
    return body


def _closed(here: Node, tags: set[str], borders, body: Node) -> Node:
    node = here
    while node is not body and node.tag not in borders:
        if node.tag in tags:
            return _closed(node.parent, tags, borders, body)
        node = node.parent
    return here


def measure(body: Node) -> list[Node]:
    """Fills in counts, densities, density sums and largest-sum nodes below of all nodes; returns them, parents first."""
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.best = node
        order.append(node)
        stack.extend(node.nodes())
    for node in reversed(order):
        for kid in node.kids:
            if kid.__class__ is Node:
                node.chars += kid.chars
                node.tags += kid.tags + 1
                node.link_chars += kid.link_chars
                node.link_tags += kid.link_tags + (kid.tag == "a")
            else:
                node.chars += len(kid) - kid.count(" ") - kid.count("\n")
        if node.tag in ("a", "button"):
            node.link_chars = node.chars
    for node in order:
        node.outside = node.named or (node.parent is not None and node.parent.outside)
    share = body.link_chars / max(1, body.chars)
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share) * (NAMED if node.outside else 1.0)
    for node in reversed(order):
        kids = node.nodes()
        node.total = sum(k.density for k in kids)
        for k in kids:
            if k.best.total > node.best.total:
                node.best = k.best
        if node.total >= node.best.total:
            node.best = node
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density: characters per tag, times a logarithm that falls with the links' part of both."""
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    inner = chars / lc * t / lt
    base = chars / max(1, chars - link_chars) * link_chars + share * chars + math.e
    return chars / t * math.log(inner) / math.log(base) if inner > 1 else 0.0


def main_node(body: Node) -> Node:
    """The node with the largest density sum, or below it the one whose own sum outweighs all that stands beside it."""
    node = body.best
    while True:
        inside = [k for k in node.nodes() if k.tag not in _TEXT and k.tag not in INLINE]
        heavy = max(inside, key=lambda k: k.best.total, default=None)
        if heavy is None or heavy.best.total <= node.total - heavy.density:
            return node
        node = heavy.best


def main_parts(body: Node) -> tuple[set[Node], set[Node], set[Node]]:
    """The nodes whose subtrees are main text, those whose own text (with inline elements) is, and those that are left out of both."""
    order = measure(body)
    best = main_node(body)
    path = set(_path(best))
    threshold = min(n.density for n in path)
    cut = {n for n in order if n.named and n not in path and n.density < threshold}
    whole: set[Node] = set()
    own: set[Node] = set()
    stack = [body]
    while stack:
        node = stack.pop()
        if node in cut:
            continue
        if node is body and best is body:
            own.add(body)
            whole.update(k for k in body.nodes() if k.chars > k.link_chars)
            continue
        if node is best:
            whole.add(node)
            continue
        if node.density >= threshold and node.density > 0 and node not in path and max(node.best.total, node.density) >= SHARE * best.total:
            whole.add(node.best)
            if node.best is node:
                continue
            if any(k.__class__ is str and not k.isspace() for k in node.kids):
                own.add(node)
        if node in path and node is not body and any(k.__class__ is str and not k.isspace() for k in node.kids):
            own.add(node)
        stack.extend(node.nodes())
    for node in list(whole):
        if node.tag in _TEXT and node.parent is not None:
            whole.update(k for k in node.parent.nodes() if k.tag in _TEXT and k.chars > k.link_chars)
    return whole, own, cut


def _path(node: Node | None) -> Iterator[Node]:
    """A node and all above it."""
    while node is not None:
        yield node
        node = node.parent


def text_of(node: Node, whole: set[Node], own: set[Node], cut: set[Node]) -> str:
    """Main blocks in page order, white space as single spaces."""
    parts: list[str] = []
    stack: list = [(node, False)]
    while stack:
        one, kept = stack.pop()
        if one.__class__ is str:
            parts.append(one if kept else " ")
            continue
        kept = kept or one in whole
        if one.tag not in INLINE or not kept or one in cut:
            parts.append(" ")
            if one in cut:
                continue
            stack.append((" ", True))
        running = one in own
        stack.extend((k, kept or (running and (k.__class__ is str or k.tag in INLINE))) for k in reversed(one.kids))
    return _SPACE.sub(" ", html.unescape("".join(parts))).strip()


def extract(page: str | None) -> str:
    if not page:
        return ""
    body = parse(page)
    return text_of(body, *main_parts(body))


def main_text(df: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                texts = [extract(h) for h in piece.column(2).to_pylist()]
                yield pa.record_batch([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
