"""HTML extraction by composite text density.

A page becomes a tree of its elements. Every node gets its composite text
density: characters for each tag, adjusted by what part of them is in links,
against the body's part (the logarithm's base is kept at e or more, where the
published formula has a pole for pages without links). A node's density sum is
that of its children. The node of the largest sum is the core of the article; the
least density on its path to the body is the threshold. The article is the core
and, beside its path to the body, the elements that reach the threshold and the
headings. So it is the same whatever elements are called. Names only do this:

* scripts, styles, menus, forms and the like are no text, by their tag or role;
* an element all of whose class or id is a word like ``ad`` or ``cookie-notice``
  is left out, and of the sums too, unless it holds an article, a heading with
  paragraphs or the core that there is with it, and nothing else has half as much;
* so is one whose class or id begins or ends with a word like ``comments``, unless
  it holds an article, a first heading, or all that is like an article;
* sparse elements beside the core stay if they are in an ``article`` with it.

Inside the article nothing more is dropped. Text is cut into blocks by block
elements; a line break is white space; character references are decoded; white
space in a block becomes one space.

Defined results: null, empty and tagless pages give their own text (nothing,
nothing, the text); pages are judged one by one, so repeated rows give equal
texts; an unclosed element ends where its parent does, an end tag that closes
nothing is none; a very long page takes time and memory in proportion. Columns
called text or n_chars are kept, and the new ones get underscores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestone.llm.arrowtext import pieces
from lodestone.llm.shared import unused

#: Comments, sections of characters, declarations, and what begins a tag.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?]|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)", re.S)
#: What stands before the next quote or end of a tag.
PLAIN = re.compile(r"[^>\"']*+")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: The words of a class or id: runs of letters, cut where a capital follows a small letter.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes noembed xmp svg math object audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article blockquote body center dd div dl details figure html main ol section table tbody td tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: A start tag ends open elements of these names, up to the element that holds them.
ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th", "table"),
    "tfoot": ("tbody thead tfoot tr td th", "table"),
    "option": ("option", "select"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: What marks an element as no part of an article.
OUT_TAGS = frozenset("nav aside footer form button select input label fieldset menu dialog head script style noscript template datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adbox adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidenav aside rail menu mainmenu navmenu submenu nav topnav subnav navbar navigation breadcrumb breadcrumbs footer cookie cookies cookiebar consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion widget widgets toolbar pagination pager login search searchbox masthead skip topbar hidden".split()
)
#: Names of reader comments, by their first or last word, and words that make it a name of something else.
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
OF_ANOTHER = frozenset("with has have no without hide show allow open opened closed enabled disabled allowed on off".split())
HEADER_WORDS = frozenset("header pageheader siteheader".split())
KEPT_TAGS = frozenset("html body main".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "out", "chars", "links", "tags", "link_tags", "density", "sum", "marked", "comment")

    def __init__(self, tag: str, parent: Node | None, out: bool = False):
        self.tag, self.parent, self.out = tag, parent, out
        self.marked = self.comment = False
        self.parts: list[Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0


def marks(tag: str, rest: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is no part of an article by its tag, role or being hidden, whether a class or id says so, and whether one names reader comments.

    A class or the id says so if all words of a whole name do: cookie-notice does,
    with-sidebar does not. Names of comments begin or end with that word:
    user-comments does, with-comments and comments-open do not.
    """
    if tag in OUT_TAGS or tag == "header" and not in_article:
        return True, False, False
    if tag in KEPT_TAGS or not rest:
        return False, False, False
    marked = comment = False
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in WORD.findall(token)]
                marked |= bool(words) and OUT_WORDS.union(() if in_article else HEADER_WORDS).issuperset(words)
                comment |= bool(words) and not COMMENT_WORDS.isdisjoint((words[0], words[-1])) and OF_ANOTHER.isdisjoint((words[0], words[-1]))
        elif name == "role" and value.lower() in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False, False
        elif name == "style" and HIDDEN.search(value):
            return True, False, False
    return False, marked, comment


class Path:
    """The open elements. Where the innermost of a kind stands is known, so no tag is looked for by climbing."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.containers: list[int] = []
        self.enter(root)

    @property
    def at(self) -> Node:
        return self.nodes[-1]

    def last(self, tag: str) -> int:
        """Where the innermost open element of a tag stands; 0 for none, or the root."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def enter(self, node: Node) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(place)
        if node.tag in BLOCK:
            self.blocks.append(place)
        if node.tag in CONTAINERS:
            self.containers.append(place)

    def leave(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.nodes) > place:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in CONTAINERS:
                self.containers.pop()

    def close(self, tag: str) -> None:
        """An end tag; an inline one doesn't end a block around it, and one that was not begun ends nothing."""
        place = self.last(tag)
        if place and (tag in BLOCK or place > self.blocks[-1]):
            self.leave(place)

    def make_room(self, tag: str) -> None:
        """A start tag ends an open paragraph if it is a block's, and elements like itself in a list or table."""
        if tag in BLOCK and (place := self.last("p")) > self.containers[-1]:
            self.leave(place)
        if tag in ENDS:
            names, until = ENDS[tag]
            edge, first = max(map(self.last, until)), len(self.nodes)
            for name in names:
                for place in reversed(self.places.get(name, ())):
                    if place <= edge:
                        break
                    first = min(first, place)
            self.leave(first)


class Ends:
    """Where the tags of a page end. Quotes that lead to no end are remembered, so none is followed twice."""

    def __init__(self, html: str):
        self.html = html
        self.last = {mark: html.rfind(mark) for mark in ">\"'"}
        self.astray: set[int] = set()

    def of(self, place: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``place``, or -1.

        A ``>`` in quotes is none, unless that leaves the tag without an end.
        """
        html, at, met = self.html, place, []
        if place > self.last[">"]:
            return -1
        while (at := PLAIN.match(html, at).end()) < len(html):
            mark = html[at]
            if mark == ">":
                return at
            met.append(at)
            if at in self.astray or at >= self.last[mark]:
                break
            at = html.index(mark, at + 1) + 1
        self.astray.update(met)
        return html.find(">", place)


def tree(html: str) -> Node:
    """The elements of a page below one root; text and elements in order. Linear in the page."""
    root = Node("html", None)
    path, place, ends = Path(root), 0, Ends(html)
    while (m := TOKEN.search(html, place)) is not None:
        tag, end = m["tag"], m.end()
        if tag is not None:
            end = ends.of(end)
        elif m[0] in ("<!", "<?"):
            end = html.find(">", end) if end <= ends.last[">"] else -1
        if end < 0:
            # no tag ends from here on: all is text, up to a comment or a section of characters
            end = min((k for k in (html.find(x, m.start()) for x in ("<!--", "<![CDATA[")) if k >= 0), default=len(html))
            path.at.parts.append(html[place:end])
            place = end
            continue
        if m.start() > place:
            path.at.parts.append(html[place : m.start()])
        rest = html[m.end() : end]
        place = end + (tag is not None or m[0] in ("<!", "<?"))
        if tag is None:
            if m[0].startswith("<![CDATA["):
                path.at.parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m["close"]:
            path.close(tag)
            continue
        if tag == "html" or tag == "body" and path.at.tag == "html":
            if tag == "body":
                body = Node("body", path.at)
                path.at.parts.append(body)
                path.enter(body)
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                end = RAW_ENDS[tag].search(html, place)
                place = end.end() if end else len(html)
            continue
        if tag in VOID:
            path.at.parts.append(Node(tag, path.at, tag in OUT_TAGS))
            continue
        path.make_room(tag)
        child = Node(tag, path.at)
        child.out, child.marked, child.comment = marks(tag, rest, path.last("article") > 0 or path.last("main") > 0)
        path.at.parts.append(child)
        path.enter(child)
    if place < len(html):
        path.at.parts.append(html[place:])
    return root


def in_order(root: Node) -> list[Node]:
    """All nodes that are not out, parents first."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.out]
    return found


def weigh(root: Node) -> list[Node]:
    """Count characters, links and tags of all nodes, and set densities and sums."""
    nodes = in_order(root)
    for node in reversed(nodes):
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            elif not x.out:
                node.chars += x.chars
                node.links += x.links
                node.tags += x.tags + 1
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.links = node.chars
    base = root.links / root.chars if root.chars else 0.0
    for node in reversed(nodes):
        c, lc = node.chars, node.links
        if c:
            inner = c / max(1, c - lc) * lc + base * c + math.e
            ratio = c / max(1, lc) * max(1, node.tags) / max(1, node.link_tags)
            node.density = c / max(1, node.tags) * math.log(max(ratio, 1.0)) / math.log(max(math.log(inner), 1.0) + math.e - 1)
        node.sum = sum(x.density for x in node.parts if isinstance(x, Node) and not x.out)
    return nodes


def densest(nodes: list[Node], root: Node) -> Node:
    """The container of the largest density sum, the inner one of equals."""
    return max((n for n in reversed(nodes) if n.tag in CONTAINERS), key=lambda n: n.sum, default=root)


def densest_child(node: Node) -> float:
    """The density of a node's densest element."""
    return max((x.density for x in node.parts if isinstance(x, Node) and not x.out), default=0.0)


def clear(nodes: list[Node]) -> None:
    """Forget what ``weigh`` found."""
    for node in nodes:
        node.chars = node.links = node.tags = node.link_tags = 0
        node.density = node.sum = 0.0


def spare(root: Node) -> None:
    """Take marked elements out, but for those that hold an article or main element or a heading with paragraphs, and reader comments, but for those that hold an article or a first heading.

    If the core of the page is in one that goes, and nothing else is like an
    article (half as dense as the comments, or half the core's sum), it stays.
    """
    nodes = in_order(root)
    if not any(n.marked or n.comment for n in nodes):
        return
    weigh(root)
    core = densest(nodes, root)
    dense, total = densest_child(core), core.sum
    # (an article or main element, a first heading, any heading, paragraphs)
    holds: dict[Node, tuple[bool, bool, bool, int]] = {}
    for node in reversed(nodes):
        own = [holds[x] for x in node.parts if isinstance(x, Node) and not x.out]
        named, first, heading, paragraphs = any(x[0] for x in own), any(x[1] for x in own), any(x[2] for x in own), sum(x[3] for x in own)
        if node.comment:
            node.out = not (named or first)
        elif node.marked:
            node.out = not (named or node.tag == "article" or heading and paragraphs > 1)
        filled = node.chars > 0
        holds[node] = (
            named or filled and node.tag in ("article", "main"),
            first or filled and node.tag == "h1",
            heading or filled and node.tag in HEADINGS,
            paragraphs + (filled and node.tag == "p"),
        )
    clear(nodes)
    plain = densest(weigh(root), root)
    like_article, as_much = 2 * densest_child(plain) >= dense, 2 * plain.sum >= total
    node: Node | None = core
    while node is not None:
        node.out = node.out and (like_article if node.comment else as_much)
        node = node.parent
    clear(nodes)


def article(root: Node) -> list[Node]:
    """The nodes whose text is the article, in page order."""
    spare(root)
    core = densest(weigh(root), root)
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    # in an article element that the core is in, what is sparse stays; elsewhere it goes
    inside = next((k for k, n in enumerate(path) if n.tag == "article"), 0)
    chosen = [core]
    for k, (node, parent) in enumerate(zip(path, path[1:])):
        good = lambda x: x.chars and (x.tag in HEADINGS or 2 * x.links <= x.chars and (x.density >= threshold or k < inside))
        siblings = [x for x in parent.parts if isinstance(x, Node) and not x.out]
        at = siblings.index(node)
        chosen = [*filter(good, siblings[:at]), *chosen, *filter(good, siblings[at + 1 :])]
    return chosen


def blocks(nodes: list[Node]) -> list[str]:
    """The text of each block, white space made one space; empty blocks are none."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    for top in nodes:
        close()
        stack: list[Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                run.append(unescape(x))
            elif not x.out:
                if x.tag == "br":
                    run.append(" ")
                elif x.tag in BLOCK:
                    close()
                    stack.append(None)
                    stack += reversed(x.parts)
                else:
                    stack += reversed(x.parts)
        close()
    return out


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by line feeds."""
    return "\n".join(blocks(article(tree(html)))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` but html, with text and n_chars (underscores in front where these names are taken)."""
    at = pages.columns.index("html")
    others = pages.drop("html")
    text, n_chars = unused(others, "text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            texts = [main_text(x) for x in batch.column(at).to_pylist()]
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            names = [c for k, c in enumerate(batch.schema.names) if k != at]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(lengths)], [*names, text, n_chars])

    return pages.mapInArrow(run, T.StructType([*others.schema.fields, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())]))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
