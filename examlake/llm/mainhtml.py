"""Main text of web pages by tree scoring.

Text-bearing blocks (paragraphs) pass points for their length and commas to their parent and, halved, to the parent's parent; a container's
points are discounted by its link density. The best container is the article; siblings that score near it, or that are long paragraphs
without links, are kept with it. Elements whose tag or name says that they are no article (menus, notices, comments, ...) are out from the start; so is
a form, unless it holds an article, main or h1 element, as where one form wraps a whole page: then its fields alone are out. All steps walk
the page without recursion and look at each part of it once, so neither depth nor tags left open slow a task down.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import releasing


_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_INSIDE = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z_:][-\w:.]*)")
_BLANK = re.compile(r"\s+")
#: Fixed values of HTML: elements without content, with raw content, that end a paragraph, and that don't break a line of text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_HIDDEN = frozenset("script style noscript iframe template svg math canvas object embed head title textarea select option button input nav footer aside header dialog menu audio video map".split())
#: Words of class, id and role values that say an element is no article: those that say it whatever stands beside them, and those that don't beside _KEEP.
_NEVER = re.compile(r"ads?|adv|advert\w*|breadcrumbs?|captcha|comments?|commentlist|consent|cookies?|disqus|footer|footnav|gdpr|login|masthead|menu\w*|modal|nav\w*|newsletter|pager|pagination|popup|repl(?:y|ies)|respond|sidebar\w*|signup|sponsor\w*|subscribe|subscription", re.I)
_SELDOM = re.compile(r"banner|byline|complementary|contentinfo|dialog|notices?|notification|promo\w*|recommend\w*|shar(?:e|ing)|share\w*|skip|social\w*|teaser|toolbar|widgets?", re.I)
#: Words that are as likely parts of an article: they count for a container alone, and only by themselves or with a word for what holds other pages.
_PERHAPS = re.compile(r"(?:header|related|search|tags)(?:[_-](?:area|articles|bar|block|box|container|form|items|links|list|news|posts|products|section|stories|widget|wrap|wrapper))?|related(?:articles|links|news|posts|stories)", re.I)
_KEEP = re.compile(r"article|body|content|main|post|entry|story|text", re.I)
#: Words by which a class speaks of the layout around a part, or of its state: no-sidebar, content-sidebar-wrap, menu-open.
_AROUND, _STATE = frozenset("no not has with without hide".split()), frozenset("wrap wrapper layout container grid outer row columns open closed active visible enabled disabled expanded collapsed left right on off".split())
_MAIN = frozenset(("html", "body", "main", "article"))
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Elements whose points go to the one around them, and items with the elements that hold them.
_HELD = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption".split())
_ITEMS = (("li", ("ul", "ol")), ("dt", ("dl",)), ("dd", ("dl",)), ("tr", ("table",)), ("td", ("tr", "table")), ("th", ("tr", "table")))
#: Points of a paragraph, of its commas and of its length.
PARAGRAPH, CHARS_A_POINT, MOST_LENGTH_POINTS = 1.0, 100, 3
#: Share of the best score from which a sibling is kept, and from which characters a paragraph beside it; most links in either.
SIBLING, LONG, LINKS = 0.2, 80, 0.25


class Node:
    """An element. block: the element itself or the nearest one around it that breaks lines; within: whether it lies in an article or main element; form: the form around it."""

    __slots__ = ("block", "children", "form", "links", "parent", "points", "tag", "text", "within", "wrapper")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.points = tag, parent, [], 0.0
        self.text = self.links = 0  # characters below, and in links
        self.block = self if tag not in _INLINE or parent is None else parent.block
        self.within = tag in ("article", "main") or (parent is not None and parent.within)
        self.form = self if tag == "form" else parent.form if parent else None
        self.wrapper = False  # of a form: it holds an article, and so a page


def _says_noise(names: list[str], tag: str, within: bool, role: bool) -> bool:
    """Whether the names of an element, each of words joined by - or _, say that it is no article."""
    words = [re.split("[_-]+", name) for name in names]
    keep = [any(_KEEP.fullmatch(w) for w in own) for own in words]
    for k, (name, own) in enumerate(zip(names, words, strict=True)):
        layout = own[0].lower() in _AROUND or ((own[-1].lower() in _STATE) and any(keep))
        if not layout and any(_NEVER.fullmatch(w) for w in own):
            return True
        if (role or not any(keep)) and any(_SELDOM.fullmatch(w) for w in own):
            return True
        if tag not in _HELD and not (keep[k] or (within and name.lower() in ("header", "tags", "search", "related"))) and _PERHAPS.fullmatch(name):
            return True
    return False


def _noise(tag: str, attributes: str, here: Node) -> bool:
    if tag in _HIDDEN and not (tag == "header" and here.within):  # an article's header has its title
        return True
    if not attributes or tag in _MAIN:
        return False
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return True
        if name in ("class", "id", "role") and _says_noise(value.split(), tag, here.within, name == "role"):
            return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name (empty: a comment or declaration), whether it closes, attributes of each tag; send a place to go on from there.

    Quotes in a tag protect its end as long as they come in pairs; from the first tag on where they don't, its end is the nearest. A tag without end is text.
    """
    at, last, paired = 0, page.rfind(">"), True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = yield start, len(page) if end < 0 else end + 3, "", False, ""
            at = len(page) if end < 0 else end + 3
            continue
        if start > last:
            return
        name = _NAME.match(page, start)
        if not name:
            if page.startswith(("<!", "<?"), start):
                end = page.index(">", start) + 1
                yield start, end, "", False, ""
                at = end
            else:
                at = start + 1
            continue
        end = _INSIDE.match(page, name.end()).end() if paired else -1
        if paired and not page.startswith(">", end):
            paired = False
        if not paired:
            end = page.index(">", name.end())
        at = (yield start, end + 1, name[1].lower(), page[start + 1] == "/", page[name.end() : end]) or end + 1


def tree(page: str) -> list[Node]:
    """The elements that may be article, as a tree with strings between them, in page order (a parent before its children); whatever tags are left open or closed in vain."""
    root = here = Node("#root", None)
    nodes, opened = [root], Counter(("#root",))
    at = links = 0
    skipping: list[str] = []  # open elements of the part that is no article

    def close(node: Node) -> Node:
        """The place behind an element and all that is left open in it."""
        nonlocal here
        while here is not node:
            opened[here.tag] -= 1
            here = here.parent
        if node.parent:
            opened[node.tag] -= 1
        return node.parent or node

    def closing(tag: str) -> Node:
        node: Node | None = here if opened[tag] else None
        while node and node.tag != tag:
            if tag in _INLINE and node.tag not in _INLINE:
                return here
            node = node.parent
        return close(node) if node else here

    def before_block() -> Node:
        """A block ends an open paragraph, with the inline elements left open in it."""
        return close(here.block) if here.block.tag in _PARAGRAPHS else here

    def before(tag: str, stop: tuple[str, ...]) -> Node:
        """An item ends the one before it in the same list or table."""
        node: Node | None = here if opened[tag] else None
        while node and node.tag not in stop:
            if node.tag == tag:
                return close(node)
            node = node.parent
        return here

    def raw_end(tag: str, start: int) -> int:
        found = re.compile(f"</{tag}", re.I).search(page, start)
        return found.start() if found else len(page)

    tags = _tags(page)
    found = next(tags, None)
    while found:
        start, end, tag, closes, attributes = found
        jump = None
        if start > at and not skipping:
            here.children.append((html.unescape(page[at:start]), links > 0))
        at = end
        if not tag:
            pass
        elif skipping:
            if closes:
                if tag in skipping:
                    while skipping.pop() != tag:
                        pass
                elif tag in _MAIN and (tag != "article" or opened["article"]):
                    skipping.clear()  # an element left open ends with the one around it
                    here = closing(tag)
            elif tag in _RAW:
                at = jump = raw_end(tag, at)
                skipping.append(tag)
            elif tag not in _VOID and not attributes.endswith("/"):
                if tag in ("p", "li") and skipping[-1] == tag:
                    skipping.pop()
                skipping.append(tag)
        elif closes:
            links -= tag == "a" and links > 0
            here = closing(tag)
        elif tag in _VOID:
            if tag == "br":
                here.children.append((" ", False))
            elif tag == "hr":
                here.children.append(Node("hr", here))
        elif _noise(tag, attributes, here) and not attributes.endswith("/"):
            if tag not in _INLINE:
                here = before_block()
                here.children.append(Node("hr", here))
            skipping.append(tag)
            if tag in _RAW:
                at = jump = raw_end(tag, at)
        else:
            if tag not in _INLINE:
                here, links = before_block(), 0
                for own, stop in _ITEMS:
                    if tag == own or (tag in ("dt", "dd") and own in ("dt", "dd")):
                        here = before(own, stop)
            links += tag == "a"
            here.children.append(node := Node(tag, here))
            if tag in ("article", "main", "h1") and node.form:
                node.form.wrapper = True
            nodes.append(node)
            opened[tag] += 1
            here = node
        found = _sent(tags, jump)
    if at < len(page) and not skipping:
        here.children.append((html.unescape(page[at:]), links > 0))
    return nodes


def _sent(tags: Iterator, jump: int | None):
    try:
        return tags.send(jump)
    except StopIteration:
        return None


def _lines(root: Node) -> list[tuple[Node, str, int]]:
    """The blocks of text in page order: the block element they stand in, the text, characters in links. Forms that are no page are passed over."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[Node, Iterator]] = [(root, iter(root.children))]
    owner = root  # whose line is being read

    def end() -> None:
        nonlocal linked
        text = _BLANK.sub(" ", "".join(parts)).strip()
        if text:
            out.append((owner, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    while stack:
        node, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if node is owner or not _runs_on(node):
                end()
                owner = _owner(stack)
        elif isinstance(child, tuple):
            parts.append(child[0])
            linked += len(child[0].strip()) if child[1] else 0
        elif child.tag == "form" and not child.wrapper:
            end()
        else:
            if not _runs_on(child):  # inline elements without blocks in them belong to the line around them
                end()
                owner = child
            stack.append((child, iter(child.children)))
    return out


def _runs_on(node: Node) -> bool:
    return node.tag in _INLINE and not any(isinstance(x, Node) and x.tag not in _INLINE for x in node.children)


def _owner(stack: list[tuple[Node, Iterator]]) -> Node:
    return next((node for node, _ in reversed(stack) if not _runs_on(node)), stack[0][0]) if stack else Node("#root", None)


def _among_links(node: Node, beside: dict[int, list[bool]]) -> bool:
    """Whether a block that is a link stands in a container that is mostly links, or next to another such block. beside: for each block of a container asked about, whether a neighbour is a link."""
    if node.tag not in ("div", "li") or node.parent is None:
        return False
    if node.parent.links > 0.5 * node.parent.text:
        return True
    if id(node) not in beside:
        blocks = [x for x in node.parent.children if isinstance(x, Node) and x.tag not in _INLINE and x.text]
        link = [False, *(x.tag in ("div", "li") and x.links == x.text for x in blocks), False]
        beside.update({id(x): link[k] or link[k + 2] for k, x in enumerate(blocks)})
    return beside.get(id(node), False)


def main_text(page: str | None) -> str:
    """The article of a page as blocks joined by two line ends; empty if there is none."""
    if not page:
        return ""
    nodes = tree(page)
    lines = _lines(nodes[0])
    if not lines:
        return ""
    scored: dict[int, Node] = {}
    for node, text, linked in lines:
        node.text, node.links = node.text + len(text), node.links + linked
        points = (PARAGRAPH + sum(text.count(c) for c in ",，、") + min(len(text) // CHARS_A_POINT, MOST_LENGTH_POINTS)) * (1 - linked / len(text))
        holder = node.parent if node.tag in _HELD else node
        for share in (1.0, 0.5):
            if holder is None:
                break
            holder.points += points * share
            scored[id(holder)] = holder
            holder = holder.parent
    for node in reversed(nodes[1:]):
        node.parent.text, node.parent.links = node.parent.text + node.text, node.parent.links + node.links
    value = lambda n: n.points * (1 - n.links / n.text if n.text else 0)
    best = max(scored.values(), key=lambda n: (value(n), n.tag in _MAIN))
    around: Node | None = best
    while around and around.tag not in ("article", "main"):  # a part of an article stands for it
        around = around.parent
    best = around if around and around.text else best
    kept = {id(best)}
    for sibling in best.parent.children if best.parent else []:
        if isinstance(sibling, Node) and sibling.text and sibling.links <= LINKS * sibling.text:
            heading = sibling.tag in ("h1", "h2") and best.tag not in ("article", "main")
            if value(sibling) >= SIBLING * value(best) or (sibling.tag == "p" and sibling.text >= LONG) or heading:
                kept.add(id(sibling))
    article = id(best) if best.tag not in ("#root", "html", "body") else None  # its lists and links are its own; a whole page's may be menus
    place: dict[int, tuple[int | None, bool]] = {}  # of each element: the kept one around it, and whether a menu lies between
    for node in nodes:
        above = place[id(node.parent)] if node.parent else (None, False)
        own = node.tag in ("ul", "ol", "table", "dl") and node.links > 0.5 * node.text
        place[id(node)] = (id(node), False) if id(node) in kept else (above[0], above[1] or own)
    out, beside = [], {}
    for node, text, linked in lines:
        above, menu = place[id(node)]
        if above == article is not None or (above is not None and not menu and not (linked == len(text) and _among_links(node, beside))):
            out.append(text)
    return "\n\n".join(out)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Null or empty html, or a page without text outside menus and the like, gives an empty text. White space inside a block is one space;
    blocks are in page order. Repeated rows stay; other columns don't matter; an empty table gives no rows.
    """
    return pages.select("page_id", "url", "html").mapInArrow(releasing(_extracted), "page_id long, url string, text string, n_chars long")
