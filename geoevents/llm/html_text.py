"""Main text of web pages by tree scoring.

A tolerant reader builds the tree of a page. Subtrees that are no text of the page (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are cut off by element name or by the words of their class and id. Every
paragraph then earns points for its length and commas and passes them to its ancestors, less the farther up; a container's points are
discounted by the share of its text that is links. The container with most points is kept with the siblings that score well beside it;
inside an article element the whole article is kept.

Null and empty pages give an empty text. Rows are read on their own, so repeated rows repeat. Nothing is cut to a length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces

NAME = "op8_html_text"

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
DROPPED = frozenset(
    "head script style textarea title noscript iframe template xmp noembed noframes nav header footer aside form button select option input label fieldset "
    "dialog menu svg canvas object embed audio video map figcaption".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in a class or an id that tell a subtree of no interest.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert menu menus nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside rail widget widgets footer header masthead share sharing social related recommended newsletter subscribe subscription signup popup modal overlay "
    "login search comment comments commentlist respond reply replies disqus discussion pagination pager toolbar skip hidden".split()
)
LIKELY = frozenset("article body content entry main page post story text".split())
#: Start tags that end an open element of these names, up to the nearest of the limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAMES = re.compile(r"[A-Za-z0-9]+")


class Node:
    __slots__ = ("name", "parent", "children", "dropped", "likely", "points", "length", "linked")

    def __init__(self, name: str, parent: Node | None, dropped: bool = False, likely: bool = False) -> None:
        self.name, self.parent, self.dropped, self.likely = name, parent, dropped, likely
        self.children: list[Node | str] = []
        self.points, self.length, self.linked = 0.0, 0, 0


def judged(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is cut off, and whether its names speak for main text."""
    if name in DROPPED:
        return True, False
    if not attributes or name in ("html", "body"):
        return False, name in ("article", "main")
    words: set[str] = set()
    hidden = main = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            words |= {w.lower() for w in NAMES.findall(value)}
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            hidden = True
        elif key == "role":
            main |= value.lower() in ("main", "article")
            hidden |= value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar")
    if name in ("article", "main") or main:
        return hidden, True
    return hidden or bool(words & UNLIKELY), bool(words & LIKELY)


def parsed(page: str) -> Node:
    root = Node("#root", None)
    here, at, n = root, 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                here.children.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name = name.lower()
        if m[1] or m[4]:
            node = here
            while node is not None and node.name != name:
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        # A block ends an open paragraph; items and cells end their like.
        ends, limits = CLOSES.get(name, (None, None))
        if name in BLOCKS:
            node = here
            while node.parent is not None and node.name != "p" and (node.name not in BLOCKS):
                node = node.parent
            if node.name == "p":
                here = node.parent
        if ends:
            node, last = here, None
            while node.parent is not None and node.name not in limits:
                if node.name in ends:
                    last = node
                node = node.parent
            if last is not None:
                here = last.parent
        dropped, likely = judged(name, m[3] or m[6] or "")
        node = Node(name, here, dropped, likely)
        here.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            node.dropped = True
            at = end.end() if end else n
        elif name not in VOID and not (m[3] or m[6] or "").endswith("/"):
            here = node
    return root


def in_order(top: Node) -> Iterator[tuple[Node | str, bool]]:
    """Nodes on entering (True) and leaving (False), and texts; what is dropped is left out."""
    stack: list[tuple[Node | str, bool]] = [(top, True)]
    while stack:
        item, enter = stack.pop()
        yield item, enter
        if enter and isinstance(item, Node):
            stack.append((item, False))
            stack.extend((c, True) for c in reversed(item.children) if isinstance(c, str) or not c.dropped)


def blocks(top: Node) -> Iterator[tuple[Node, str, int]]:
    """(innermost block, text, characters in links) of each block of text, in page order."""
    parts, linked, in_link = [], 0, 0
    stack = [top]

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        out = (stack[-1], text, min(linked, len(text))) if text else None
        parts, linked = [], 0
        return out

    for item, enter in in_order(top):
        if isinstance(item, str):
            text = html.unescape(item)
            parts.append(text)
            linked += len(text) if in_link else 0
            continue
        if item.name == "a":
            in_link += 1 if enter else -1
        elif item.name == "br" and enter:
            parts.append(" ")
        if item.name in BLOCKS:
            if found := flush():
                yield found
            if enter:
                stack.append(item)
            elif len(stack) > 1 and stack[-1] is item:
                stack.pop()
    if found := flush():
        yield found


def score(root: Node) -> Node | None:
    """Pass points up and return the best container."""
    touched: dict[int, Node] = {}
    for block, text, linked in blocks(root):
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        node, level = block, 0
        while node is not None:
            node.length += len(text)
            node.linked += linked
            if level and level <= 6:
                node.points += points / (1, 2, 6, 9, 12, 15)[level - 1]
                touched[id(node)] = node
            elif block.name not in ("p", "pre", "blockquote", "li", "td") and block.name not in HEADINGS:
                # Bare text of a container counts for the container itself.
                node.points += points if not level else 0
                touched[id(node)] = node
            node, level = node.parent, level + 1
    best, most = None, -1.0
    for node in touched.values():
        value = rated(node)
        if value > most:
            best, most = node, value
    return best


def rated(node: Node) -> float:
    return (node.points + (25 if node.likely else 0)) * (1 - node.linked / max(1, node.length))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parsed(page)
    best = score(root)
    if best is None:
        return ""
    # All of an article belongs together.
    node = best
    while node is not None:
        if node.name in ("article", "main") and node.likely:
            best = node
            break
        node = node.parent
    kept = [best]
    if best.parent is not None:
        least = max(10.0, 0.2 * rated(best))
        kept = []
        for sibling in best.parent.children:
            if isinstance(sibling, str) or sibling.dropped:
                continue
            density = sibling.linked / max(1, sibling.length)
            plain = sibling.name == "p" and density < 0.25 and sibling.length > 80
            title = sibling.name in HEADINGS and best.name != "article" and density < 0.5
            if sibling is best or rated(sibling) >= least or plain or title:
                kept.append(sibling)
    lines = []
    for part in kept:
        for block, text, linked in blocks(part):
            # Lists of links inside the text are menus.
            if not menu(block, part):
                lines.append(text)
    return "\n".join(lines)


def menu(block: Node, top: Node) -> bool:
    node: Node | None = block
    while node is not None and node is not top:
        if node.name in ("ul", "ol", "table", "div", "section") and node.length and node.linked / node.length > 0.8 and sum(isinstance(c, Node) for c in node.children) > 2:
            return True
        node = node.parent
    return False


def extracted(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of ``column``."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts = []
        for piece, last in pieces(arrays):
            parts.append(pa.array([main_text(p) for p in piece.to_pylist()], pa.string()))
            if last:
                yield pa.concat_arrays(parts)
                parts = []

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return pages.withColumn(into, F.arrow_udf(run, "string")(F.col(column)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
