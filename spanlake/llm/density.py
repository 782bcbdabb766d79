"""Main text of web pages by composite text density.

The tree of a page is built without what can't be the article: elements for menus, headers, footers, asides, forms and scripts, hidden ones, and those
that a whole name of their class (or, of a mere container, their id) calls an advert, a notice, comments and the like. Headings, sections and paragraphs never go by their id, nor
anything by a word among others, nor what holds more than half of the text. For each node that is left, characters per tag, adjusted for the share of links, give a density, and its blocks'
densities a sum. The node with the largest sum is the article; the least density on its path to the body is the threshold
for further subtrees that belong to it, and headings beside that path belong to it whatever their density. Parsing and choosing take time in proportion to the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import small_batches

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr del img input math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded".split())
DROPPED = frozenset("head nav footer aside form menu dialog button select object canvas audio video map frameset".split()) | RAW
WHOLE = frozenset("html body main article".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Names that mark what isn't the article, and words that may stand beside one in a name. A name of class or id marks only if all its parts are of these.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist
consent cookie cookies disqus footer foot header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup
promo promoted related recommended search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets login signup gdpr
respond replies reply disclaimer alert skip""".split())
BESIDE = frozenset("""container wrapper wrap area list box block section site page left right top bottom inner outer primary secondary main mobile desktop bar item
items link links button buttons col row group panel slot unit holder content body inline global user form icon icons media this posts articles stories
text sub header google js the""".split())
#: Elements that a class may mark, and those that an id may mark, too: ids of headings, sections and paragraphs are made of their words.
BY_CLASS, BY_ID = frozenset("div ul ol dl li table section p span article".split()), frozenset("div ul ol dl table".split())
_WRAPPER = re.compile(r"(?i)(sub)*section|sect\d|level\d|chapter")

#: A tag whose quoted values hold no < or >; others are read by `_Tags`.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?>[^<>"']+|"[^"<>]*"|'[^'<>]*')*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_UNQUOTED = re.compile(r"""[^>"']*""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S)
_CUT = re.compile(r"[_\-:.]+|(?<=[a-z])(?=[A-Z])")
_SIZE = re.compile(r"\d+(x\d+)?")
#: Marks that are part of an article where they stand inside one, and endings that mark behind a word of BESIDE as whole words do.
TITLES, ENDINGS = frozenset(("header", "masthead", "banner")), ("nav", "menu", "sidebar", "footer", "advert", "cookies", "comments")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_ITEMS, _LISTS = frozenset("li dt dd tr td th option thead tbody".split()), frozenset("ul ol dl table select".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_SCOPE = frozenset("html body table td th ul ol dl article section div main aside blockquote form button nav header footer".split())


class Node:
    """drop: left out, marked: by a name of class or id. inside: in an article or main element. p, item: the nearest open paragraph, and the nearest open part of a list or table, in scope."""

    __slots__ = ("tag", "parent", "items", "drop", "marked", "inside", "p", "item", "chars", "tags", "link_chars", "link_tags", "density", "total", "block")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, marked: bool = False):
        self.tag, self.parent, self.items, self.drop, self.marked = tag, parent, [], drop, marked
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.p = self if tag == "p" else None if tag in _SCOPE or parent is None else parent.p
        self.item = self if tag in _ITEMS else None if tag in _LISTS or parent is None else parent.item
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.block = tag not in INLINE


def _marks(name: str, inside: bool) -> bool:
    """Whether one name of class or id says that its element isn't the article. inside: whether it stands in an article or main element."""
    mark = False
    for part in filter(None, _CUT.split(name)):
        part = part.lower()
        ending = next((e for e in ENDINGS if part.endswith(e) and part[: -len(e)] in BESIDE), None)
        if (part in MARKS or ending) and not (inside and part in TITLES):
            mark = True
        elif part not in BESIDE and not _SIZE.fullmatch(part):
            return False
    return mark


def _unwanted(tag: str, attributes: str, node: Node) -> tuple[bool, bool]:
    """Whether an element is left out, and whether that is by a name only."""
    if tag in WHOLE and tag != "article":
        return False, False
    if tag in DROPPED or tag == "header" and not node.inside:
        return True, False
    classes, ids, marked = [], [], False
    for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "class":
            classes = value.split()
        elif name == "id":
            ids = value.split()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value) or name == "role" and value.lower() in ROLES:
            return True, False
    if tag in BY_CLASS:
        marked = any(_marks(c, node.inside) for c in classes if tag != "article" or "comment" in c.lower())
    if tag in BY_ID and not any(map(_WRAPPER.fullmatch, classes)):
        marked = marked or any(_marks(i, node.inside) for i in ids)
    return marked, marked


class _Tags:
    """Finds tags and the ends of raw elements. What isn't found once isn't looked for again further on, so no part of a page is read more than twice."""

    def __init__(self, page: str):
        self.page, self.none, self.quotes = page, set(), True

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def tag(self, at: int):
        """(closing, tag, attributes, end) of what begins with the < at `at`; tag None for comments and declarations; None if it's text."""
        if m := _TAG.match(self.page, at):
            return m[1], m[2], m[3], m.end()
        if self.page.startswith("<!--", at):
            end = self.find("-->", at + 4)
            return "", None, "", end + 3 if end >= 0 else len(self.page)
        m = _NAME.match(self.page, at)
        if not m and self.page[at + 1 : at + 2] not in ("!", "?", "/"):
            return None
        end = self.find(">", at)
        if end < 0:
            return None
        if not m:
            return "", None, "", end + 1
        if self.quotes:
            place = m.end()
            while True:
                place = _UNQUOTED.match(self.page, place).end()
                if place >= len(self.page):  # quotes don't pair from here to the end: from now on they mean nothing
                    self.quotes = False
                    break
                if self.page[place] == ">":
                    end = place
                    break
                close = self.find(self.page[place], place + 1)
                place = close + 1 if close >= 0 else place + 1
        return m[1], m[2], self.page[m.end() : end], end + 1

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of a raw element, or -1."""
        if tag in self.none:
            return -1
        m = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(self.page, at)
        if m:
            return m.end()
        self.none.add(tag)
        return -1


def parse(page: str) -> Node:
    """A tree of nodes and decoded texts. Raw elements and comments are left out; unclosed elements end where HTML ends them."""
    root = node = Node("html", None)
    tags, opened = _Tags(page), Counter()
    at, end = 0, len(page)

    def close(up: Node) -> Node:
        """Leave the open elements up to and with `up`."""
        x = node
        while True:
            opened[x.tag] -= 1
            if x is up:
                return x.parent
            x = x.parent

    while at < end:
        stop = page.find("<", at)
        if stop < 0:
            stop = end
        if stop > at:
            node.items.append(entities.unescape(page[at:stop]))
        if stop == end:
            break
        found = tags.tag(stop)
        if found is None:
            node.items.append("<")
            at = stop + 1
            continue
        closing, tag, attributes, at = found
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = close(up)
            elif tag == "p":
                node.items.append(Node("p", node))
            continue
        if tag == "html":
            continue
        if tag in RAW:
            behind = tags.raw_end(tag, at)
            at = behind if behind >= 0 else at if attributes.endswith("/") else end
            continue
        if tag not in INLINE and node.p is not None:  # a block ends an open paragraph
            node = close(node.p)
        if tag in _CLOSED_BY:
            ends = _CLOSED_BY[tag]
            if any(opened[x] > 0 for x in ends):
                up = node.item
                while up is not None and up.tag not in ends:
                    up = up.parent.item
                while up is not None and up.tag in ends:
                    node = close(up)
                    up = node if node.parent is not None else None
        new = Node(tag, node, *_unwanted(tag, attributes, node))
        node.items.append(new)
        if tag not in VOID and not (attributes.endswith("/") and tag not in INLINE and tag not in _SCOPE and tag != "p"):
            opened[tag] += 1
            node = new
    return root


def _order(root: Node) -> list[Node]:
    """Nodes that aren't dropped, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.drop:
            out.append(n)
            todo += [x for x in reversed(n.items) if isinstance(x, Node)]
    return out


def _own_chars(node: Node) -> int:
    return sum(len(x.strip()) for n in _order(node) for x in n.items if isinstance(x, str))


def _open_containers(root: Node) -> None:
    """A form that holds more than half of the page's text is a container like any other; so is an element marked by its name that does, and has paragraphs, on a page without an article or
    main element outside."""
    nodes, some = _order(root), []
    total, whole = _own_chars(root), any(n.tag in ("article", "main") for n in nodes)
    for n in nodes:
        some += [x for x in n.items if isinstance(x, Node) and x.drop and (x.tag == "form" or x.marked)]
    for x in some:
        x.drop = False
    sizes = [_own_chars(x) for x in some]
    total += sum(sizes)
    for x, size in zip(some, sizes):
        x.drop = size * 2 <= total or x.marked and (whole or not any(y.tag == "p" for y in _order(x)))


def measure(root: Node) -> list[Node]:
    _open_containers(root)
    nodes = _order(root)
    for n in reversed(nodes):
        for x in n.items:
            if isinstance(x, str):
                n.chars += len(x.strip()) if x.strip() else 0
            elif not x.drop:
                n.block |= x.block
                n.chars, n.tags = n.chars + x.chars, n.tags + x.tags + 1
                n.link_chars, n.link_tags = n.link_chars + x.link_chars, n.link_tags + x.link_tags + (x.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    share = root.link_chars / max(1, root.chars)
    for n in reversed(nodes):
        if n.chars:
            base = log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + share * n.chars + e)
            n.density = n.chars / max(1, n.tags) * log(max(e, n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.link_tags))) / max(1.0, log(max(e, base)))
        n.total = sum(x.density for x in n.items if isinstance(x, Node) and x.block and not x.drop) + (n.density if any(isinstance(x, str) and x.strip() for x in n.items) else 0.0)
    return nodes


def chosen(root: Node) -> list[Node]:
    """The subtrees that make up the article, in page order: the node with the largest sum (of equal sums the outer, then the earlier one), and beside its path
    to the body what is as dense as the least dense node of that path and no more than half links, and headings that aren't.
    """
    nodes = measure(root)
    top = max((n for n in nodes if n.block and n.chars), key=lambda n: n.total, default=None)
    if top is None:
        return []
    path, least, up = set(), top.density, top
    while up is not None:
        path.add(up)
        least = min(least, up.density)
        up = up.parent
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n is top:
            out.append(n)
        elif n in path:
            todo += [x for x in reversed(n.items) if isinstance(x, Node) and not x.drop]
        elif n.chars and n.link_chars * 2 < n.chars and (n.density >= least or n.tag in _HEADINGS):
            out.append(n)
    return out


def blocks(node: Node) -> list[str]:
    """Text of the blocks under a node, white space made single."""
    out, current, todo = [], [], [node]

    def ended():
        if text := " ".join("".join(current).split()):
            out.append(text)
        current.clear()

    while todo:
        x = todo.pop()
        if x is None:
            ended()
        elif isinstance(x, str):
            current.append(x)
        elif not x.drop:
            if x.tag in INLINE:
                current.append(" " if x.tag == "br" else "")
                todo += reversed(x.items)
            else:
                ended()
                todo.append(None)
                todo += reversed(x.items)
    ended()
    return out


def extract(page: str) -> str:
    return "\n".join(b for n in chosen(parse(page)) for b in blocks(n))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html).

    A null or empty page, or one without text outside what is left out, gives an empty text. Rows with equal or null page_id are read one by one. Of nodes with
    equal sums the outer, then the earlier one is the article. A long page takes time and memory in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x or "") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    small_batches(pages.sparkSession)
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
