"""Main text of web pages, by scores that paragraphs pass up the tree."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.store import map_batches

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
BLANKS = re.compile(r"\s+")

RAW = frozenset("script style noscript template textarea title iframe noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
DROPPED = RAW | frozenset("head nav footer aside form button select input object svg canvas audio video map dialog menu".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CELLS = frozenset("td th table".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot body".split())
SHARE = 0.4
"""Part of a node's points that its parent gets."""
SCOPE = frozenset("ul ol dl table body html article section div td th".split())

# Names that mark what surrounds an article.  Whole words of class, id and role count.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side rail "
    "header masthead topbar footer foot bottombar copyright legal cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login register share sharing social follow related recommended recommendations popular trending comment comments commentlist respond reply replies disqus feedback discussion widget widgets "
    "pagination pager toolbar search searchform form complementary contentinfo tags taglist byline toc skip hidden".split()
)
# Words that say nothing about what they are joined to.
FILLER = frozenset("list box block wrap wrapper container section area item items inner outer site group bar panel link links button buttons row col column global primary secondary top bottom left right".split())
INSIDE = frozenset("article articlebody body content contents entry main maincontent page post postcontent story text".split())
NAME = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")
SHORT, LINKED = 140, 0.4
"""Something whose name has other words beside those of ``AROUND`` is dropped if it has less text, or a greater share of it in links."""
PROSE, MENU = 60, 0.6
"""Text, in characters, that makes a plain sibling a part of the article; share of links from which a list may be a menu."""


class Node:
    __slots__ = ("tag", "names", "marked", "hidden", "gone", "parent", "children", "score", "text_size", "link_size")

    def __init__(self, tag: str, attributes: str = "", parent: "Node | None" = None):
        self.tag, self.parent, self.children = tag, parent, []
        self.score, self.text_size, self.link_size = 0.0, 0, 0
        self.names, self.marked, self.hidden, self.gone = frozenset(), False, False, False
        if attributes:
            found = []
            for key, value in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id", "role", "itemprop"):
                    for name in value.split():
                        words = [w.lower() for w in NAME.findall(name)]
                        found += words
                        # A name of such words alone says what it is; one that has others may be a subject.
                        self.marked |= any(w in AROUND for w in words) and all(w in AROUND or w in FILLER for w in words)
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    self.hidden = True
            self.names = frozenset(found)

    def surrounding(self) -> bool:
        """Whether its tag, its attributes or a name of its own say that it stands around an article."""
        if self.hidden or self.tag in DROPPED:
            return True
        if self.tag == "header":
            # The title of an article may stand in a header of its own.
            return not any(p.tag in ("article", "main") for p in self.above())
        return self.nameable() and self.marked and not self.names & INSIDE

    def nameable(self) -> bool:
        return self.tag not in ("html", "body", "article", "main", "p", "a", "b", "i", "em", "strong", "span", "h1")

    def beside(self) -> bool:
        """Whether one word of a name, and little text or many links, say so; asked once texts are measured."""
        return self.nameable() and bool(self.names & AROUND) and not self.names & INSIDE and (self.text_size < SHORT or density(self) > LINKED)

    def above(self) -> Iterator["Node"]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class Path:
    """The open elements of a page, with counts of their tags, so that no end tag is looked for in vain."""

    def __init__(self):
        self.root = self.node = Node("html")
        self.counts: dict[str, int] = {}
        self.cells: list[dict[str, int]] = [{}]  # counts inside each open table or cell

    def push(self, child: Node) -> None:
        self.node = child
        self.counts[child.tag] = self.counts.get(child.tag, 0) + 1
        if child.tag in CELLS:
            self.cells.append({})
        self.cells[-1][child.tag] = self.cells[-1].get(child.tag, 0) + 1

    def pop_to(self, node: Node) -> None:
        while self.node is not node:
            tag = self.node.tag
            self.counts[tag] -= 1
            self.cells[-1][tag] -= 1
            if tag in CELLS:
                self.cells.pop()
            self.node = self.node.parent

    def close(self, tag: str) -> None:
        """An end tag; inside a table or cell only its own elements can be closed, or the table's."""
        if (self.counts if tag in TABLE_PARTS else self.cells[-1]).get(tag):
            up = self.node
            while up.tag != tag:
                up = up.parent
            self.pop_to(up.parent)

    def before_block(self, tag: str) -> None:
        """A block ends an open paragraph; an item ends the item before it in the same list."""
        ends = CLOSED_BY.get(tag, ())
        if not self.counts.get("p") and not any(self.counts.get(t) for t in ends):
            return
        up, left = self.node, self.node
        while up is not self.root and (up.tag == "p" or up.tag not in BLOCKS or up.tag in ends):
            if up.tag == "p" or up.tag in ends:
                left = up.parent
            if up.tag in SCOPE and up.tag not in ends:
                break
            up = up.parent
        self.pop_to(left)


def parse(page: str) -> Node:
    """A forgiving tree: unknown end tags are ignored, paragraphs and items end where the next begins."""
    path = Path()
    at = 0
    while True:
        m = MARKUP.search(page, at)
        if m is None:
            path.node.children.append(page[at:])
            return path.root
        if m.start() > at:
            path.node.children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            path.close(tag)
            continue
        if tag in BLOCKS:
            path.before_block(tag)
        if tag in ("html", "body"):
            continue
        child = Node(tag, m[3], path.node)
        path.node.children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            child.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3] or "").rstrip().endswith("/"):
            path.push(child)


def measure(root: Node) -> list[Node]:
    """Sizes of text and links of every node, dropping what surrounds the article; the nodes in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        kept = []
        for child in node.children:
            if isinstance(child, str):
                size = len(child.strip())
                node.text_size += size
                node.link_size += size if linked or node.tag == "a" else 0
                kept.append(child)
            elif not child.surrounding():
                kept.append(child)
        node.children = kept
        stack += [(c, linked or node.tag == "a") for c in reversed(kept) if not isinstance(c, str)]
    for node in reversed(order):
        # Parts of a node are complete before it is.
        kept = []
        for child in node.children:
            if not isinstance(child, str):
                child.gone = child.beside()
                if child.gone:
                    continue
                node.text_size += child.text_size
                node.link_size += child.link_size
            kept.append(child)
        node.children = kept
    out = []
    for node in order:
        node.gone |= node.parent is not None and node.parent.gone
        if not node.gone:
            out.append(node)
    return out


def density(node: Node) -> float:
    return node.link_size / node.text_size if node.text_size else 0.0


def own_text(node: Node) -> tuple[int, int]:
    """Length and commas of the text in a node that is in no block below it."""
    size = commas = 0
    stack = [node]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, str):
                size += len(child.strip())
                commas += sum(map(child.count, ",،、，"))
            elif child.tag not in BLOCKS:
                stack.append(child)
    return size, commas


def best_nodes(root: Node) -> list[Node]:
    """The container with the best score, and those of its siblings that go with it."""
    order = measure(root)
    for node in order:
        if node.tag not in BLOCKS:
            continue
        size, commas = own_text(node)
        if size < 25 or node.tag not in PARAGRAPHS and node.tag not in ("div", "section", "article", "main", "html"):
            continue
        points = 1 + commas + min(size / 100, 3.0)
        # Text right inside a container counts for the container itself.
        up = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
        up.score += points
    # Every ancestor gets a share, of each level the same.
    for node in reversed(order):
        if node.parent is not None:
            node.parent.score += SHARE * node.score
    scored = [n for n in order if n.score > 0]
    if not scored:
        return [root]

    def value(node: Node) -> float:
        bonus = 5.0 * (node.tag in ("article", "main")) + 3.0 * bool(node.names & INSIDE) - 3.0 * (node.tag in ("ul", "ol", "table", "tr", "tbody", "html"))
        return (node.score + bonus) * (1 - density(node))

    top = max(scored, key=value)
    # The article as a whole, if the best container is a part of one.
    for up in top.above():
        if up.tag in ("article", "main") and density(up) < 0.5:
            top = up
            break
    if top.parent is None or top.tag in ("article", "main"):
        return [top]
    # What goes with it stands beside it, or beside the containers around it.  A container of several
    # parts of an article is the article's, with all that is left in it; the page itself is not.
    chosen, at = [top], top
    while at.parent is not None:
        before, after, parts = [], [], False
        side = before
        for sibling in at.parent.children:
            if sibling is at:
                side = after
            elif not isinstance(sibling, str) and goes_with(sibling, at, value, at is top):
                side.append(sibling)
                parts |= sibling.tag not in ("h1", "h2") and sibling.text_size > PROSE
        at = at.parent
        chosen = [at] if parts and at.parent is not None else [*before, *chosen, *after]
    return chosen


def goes_with(node: Node, at: Node, value: Callable[[Node], float], first: bool) -> bool:
    """Whether a sibling of the best container, or of one around it, belongs to the article."""
    if node.tag == "h1" or first and node.tag == "h2":
        return True
    if node.tag == "p":
        return node.text_size > 80 and density(node) < 0.25 or first and 0 < node.text_size <= 80 and not node.link_size
    if node.score <= 0 or density(node) >= 0.3:
        return False
    return value(node) >= 0.2 * value(at) or bool(node.names) and node.names == at.names or node.text_size >= PROSE


def sentences(node: Node) -> bool:
    """Whether what a list links are sentences rather than the words of a menu."""
    items = whole = 0
    stack = [node]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, str):
                text = child.strip()
                items += len(text) > 1
                whole += len(text) >= 40 or len(text) > 15 and text[-1] in ".!?"
            else:
                stack.append(child)
    return 2 * whole >= items > 0


def block_texts(node: Node) -> list[str]:
    """Texts of the blocks of a node in page order."""
    out: list[list[str]] = [[]]
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif x.tag == "br":
            out[-1].append(" ")
        else:
            block = x.tag in BLOCKS
            if block:
                if x.tag in ("ul", "ol", "div", "section", "table") and x.text_size and density(x) > MENU and not sentences(x):
                    continue
                out.append([])
                stack.append(None)
            stack += reversed(x.children)
    texts = (BLANKS.sub(" ", html.unescape("".join(parts))).strip() for parts in out if parts)
    return [t for t in texts if t]


def main_text(page: str | None) -> str:
    """The article of a page, one line a block; empty if it has none."""
    if not page:
        return ""
    return "\n".join(text for node in best_nodes(parse(page)) for text in block_texts(node))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars.

    Null and empty pages have an empty text.  Each row is treated by itself:
    null ids stay, repeated rows get equal results, an empty table gives none;
    text outside any markup is one block; of containers of equal value the first
    in page order is the best; pages of any length and depth are read whole, in
    time in proportion; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
