"""Main text of web pages by scoring the document tree.

A page is read into a tree of its block elements.  What is never main text -
menus, headers and footers of pages, asides, scripts, styles, hidden elements -
goes with all it holds; forms, reader comments, and elements whose class, id or
role says advert, notice, share box and the like, are set aside.  Every other block of text earns
points for its length and its commas and passes them to its parent, and half of
them to its grandparent.  An element's points are discounted by the share of its
text that is in links.  The best element is kept, and of its siblings those that
aren't mostly links and are running text or headings; so is the headline, if it
stands before the best element.  Where several elements are about as good as the
best one, as the sections of an article, their nearest common ancestor takes its
place, and of its children those that hold one of them are kept.

Names: a class or id is read word by word.  ``sidebar``, ``site-footer`` and
``ad-box`` name what they hold; ``no-sidebar``, ``page-with-side-menu`` and
``has-banner`` say something about an element that holds more, and don't count;
nor do names of states and uses, as ``menu-open``, ``hidden-print``, ``ad-free``.
An element that is set aside and holds most of the page's text comes back; one
whose name says advert, menu or the like, and a form, only if it holds several
paragraphs and there is no article element and next to no running text outside of
such elements - less than a tenth of its own, or, for comments, less than a short
paragraph.  Of paragraphs and headings only those go
whose name says so in one word.

Text: character references are decoded; white space within a block becomes one
space; blocks are trimmed, empty ones dropped, and the rest joined by a newline
in page order.  Line breaks within a block are white space.  Malformed pages are
read as browsers would: a paragraph ends where the next block starts, an end tag
closes what is open inside it, one without a start is ignored, and elements are
nested 512 deep at most.  A page is read in time proportional to its length.

Rows: null html is an empty page; a page without text gives an empty string;
null ids and urls stay null; repeated rows are rows like others; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import utf8

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/<>]*)([^>]*)>",
    re.S,
)
_UNFINISHED = re.compile(r"<[A-Za-z/!?]")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_ENDS_SENTENCE = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")

RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td template tfoot th thead tr ul".split()
)
ASIDE = frozenset("nav footer aside menu dialog fieldset head template search option".split())
INLINE_ASIDE = frozenset("svg canvas object select button audio video datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section article main body form #root".split())
LISTS = frozenset("ul ol dl table pre blockquote".split())
# words of a name that set aside: unless there is no other text, and unless the element holds most of the text
SURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer cookie cookies consent newsletter comment comments disqus replies respond related recommended recommendations pagination pager hidden popup popups modal".split()
)
LIKELY = frozenset(
    "banner banners sidebar sidebars side foot masthead header topbar notice notices alert alerts overlay subscribe subscription signup login search share sharing sharebar social "
    "widget widgets tags toolbar legal copyright skip".split()
)
ABOUT = frozenset("no not non with without has have is layout".split())  # what follows doesn't name the element
STATES = frozenset("overflow open opened enabled disabled print xs sm md lg xl free js active visible given".split())  # nor does a name with one of these
COMMENTS = frozenset("comment comments disqus replies respond".split())
SHORT = 140  # characters of a short paragraph
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ()}
DEEPEST = 512
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I | re.A) for tag in RAW}


class _Node:
    """An element: ``gone`` for good, or ``named`` as something to set aside: 1 likely, 2 surely, 3 as comments."""

    __slots__ = ("tag", "parent", "depth", "gone", "named", "sure", "inside", "aside", "score", "text", "link", "prose", "good", "kept", "last")

    def __init__(self, tag: str, parent: _Node | None, gone: bool = False, named: int = 0):
        self.tag, self.parent, self.named = tag, parent, named
        self.sure = (parent.sure if parent else 0) + (named > 1)  # surely named elements from here up
        self.depth = parent.depth + 1 if parent else 0
        self.gone = gone or parent is not None and parent.gone
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.aside = self.kept = False
        self.score, self.text, self.link, self.prose, self.good, self.last = 0.0, 0, 0, 0, 0, ""


def named_aside(value: str, exact: bool = False) -> int:
    """3 if a class or id names comments, 2 if something else that is hardly main text, 1 if likely, else 0; ``exact``: names of one word only."""
    worst = 0
    for name in value.split():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        words = [w for w in words if not w.isdigit()]
        if not words or exact and len(words) > 1 or ABOUT.intersection(words) or STATES.intersection(words):
            continue
        # a name says what it is by its first or last word
        for word in (words[0], words[-1]):
            worst = max(worst, 3 if word in COMMENTS else 2 if word in SURE else 1 if word in LIKELY and not exact else 0)
    return worst


def _set_aside(tag: str, attributes: str, parent: _Node) -> int:
    """9 for good, 1 to 3 by what it is named, 0 not at all."""
    if parent.gone or tag in ASIDE or tag in INLINE_ASIDE or tag == "header" and not parent.inside:
        return 9
    if tag == "form":
        return 2
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    worst = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            worst = max(worst, named_aside(value, tag in HEADINGS or tag in ("p", "blockquote", "pre")))
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            worst = 9
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            worst = 9
    return worst


def read_blocks(html: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All elements, each after its parent, and (element, text, characters in links) of each block that isn't gone for good."""
    root = _Node("#root", None)
    nodes, blocks, opened = [root], [], Counter()
    node, parts, links, open_links = root, [], 0, 0
    at, end, last_mark = 0, len(html), html.rfind(">")

    def flush():
        nonlocal parts, links
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                blocks.append((block_of(node), text, min(links, len(text))))
            parts, links = [], 0

    def block_of(node: _Node) -> _Node:
        while node.tag not in BLOCKS and node.parent is not None:
            node = node.parent
        return node

    def add(raw: str):
        nonlocal links
        if raw and not node.gone:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if open_links:
                links += len(text.strip())

    def enter(tag: str, gone: bool, named: int):
        nonlocal node
        while node.depth >= DEEPEST:
            leave(node)
        node = _Node(tag, node, gone, named)
        nodes.append(node)
        opened[tag] += 1

    def leave(last: _Node):
        """Close ``last`` and what is open inside it."""
        nonlocal node
        up = last.parent
        while node is not up:
            opened[node.tag] -= 1
            node = node.parent

    def nearest(tags, limits=()) -> _Node | None:
        if not any(opened[t] for t in tags):
            return None
        up = node
        while up is not root and up.tag not in tags and up.tag not in limits:
            up = up.parent
        return up if up.tag in tags else None

    while at < end:
        found = _MARKUP.search(html, at) if at <= last_mark else None
        if not found:
            # a tag that the page breaks off in isn't text
            broken = _UNFINISHED.search(html, at)
            add(html[at : broken.start() if broken else end])
            break
        add(html[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.group(1), found.group(2), found.group(3)
        if tag is None:
            closing, tag, attributes = found.group(4), found.group(5), found.group(6)
        if tag is None:
            if found.group().startswith("<![CDATA["):
                add(found.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                close = _CLOSE[tag].search(html, at)
                at = close.end() if close else end
            parts.append(" ")
        elif tag == "a":
            open_links = 0 if closing else 1
        elif tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" ")
        elif tag not in BLOCKS:
            # of these only those that are set aside, as a hidden span, need a place in the tree
            if closing:
                if node.tag == tag:
                    leave(node)
            elif not attributes.endswith("/") and (attributes or tag in INLINE_ASIDE or node.tag == tag) and (node.tag == tag or _set_aside(tag, attributes, node)):
                enter(tag, True, 0)
        else:
            flush()
            if closing:
                last = nearest((tag,))
                if last is not None:
                    leave(last)
                continue
            if tag in CLOSES_P:
                last = block_of(node)
                if last.tag == "p":
                    leave(last)
            if tag in SIBLINGS:
                last = nearest(SIBLINGS[tag], LIMITS[tag])
                if last is not None:
                    leave(last)
            if not attributes.endswith("/"):
                why = _set_aside(tag, attributes, node)
                enter(tag, why == 9, 0 if why == 9 else why)
    flush()
    return nodes, blocks


def _summed(nodes: list[_Node], blocks) -> None:
    """Text, link and running text lengths of every element, with all it holds."""
    for node in nodes:
        node.text = node.link = node.prose = 0
    for node, text, linked in blocks:
        node.text += len(text)
        node.link += linked
        node.prose += _prose(text, linked)
        node.last = text
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.link += node.link
            node.parent.prose += node.prose
            node.parent.last = node.parent.last or node.last


def _prose(text: str, linked: int) -> int:
    """The length of a block that is running text."""
    return len(text) if len(text) >= 80 and 3 * linked < len(text) and _ENDS_SENTENCE.search(text) else 0


def _released(nodes: list[_Node], blocks) -> list[tuple[_Node, str, int]]:
    """The blocks outside of what is set aside."""
    _summed(nodes, blocks)
    levels = Counter()  # running text by the number of surely named elements around it
    for node, text, linked in blocks:
        levels[node.sure] += _prose(text, linked)
    outside, total = [0], nodes[0].text
    article = any(node.tag in ("article", "main") and node.text and not node.sure and not node.gone for node in nodes)
    for depth in range(max((n.sure for n in nodes), default=0)):
        outside.append(outside[-1] + levels[depth])
    for node in nodes:
        node.aside = node.parent is not None and node.parent.aside
        if node.named > 1 and not node.aside:
            enough = SHORT if node.named == 3 else max(SHORT, node.prose / 10)
            node.aside = article or 2 * node.text <= total or node.prose < 3 * SHORT or outside[node.sure] >= enough
    left = [b for b in blocks if not b[0].aside]
    _summed(nodes, left)
    whole = nodes[0].text
    for node in nodes:
        node.aside = node.aside or node.parent is not None and node.parent.aside or node.named == 1 and 2 * node.text <= whole
    return [b for b in left if not b[0].aside]


def _value(node: _Node) -> float:
    return node.score * (1.0 - node.link / max(1, node.text))


def _beside(node: _Node, best: _Node) -> bool:
    """Whether a sibling of the best element goes with it."""
    if node.link >= 0.3 * max(1, node.text):
        return False
    if node.tag == "article":
        return _value(node) >= 0.2 * _value(best)
    return node.tag in HEADINGS or node.tag in LISTS or bool(_ENDS_SENTENCE.search(node.last)) or node.text > 80


def _shared(nodes: list[_Node], best: _Node) -> _Node | None:
    """The element whose children are looked through: the nearest that holds three elements about as good as the best one, or the best one's parent."""
    enough = 0.5 * _value(best)
    for node in nodes:
        node.good = 0
    for node in reversed(nodes):
        # of elements within one another the innermost counts
        node.good = node.good or int(node.score > 0 and _value(node) >= enough)
        if node.parent is not None:
            node.parent.good += node.good
    up = best.parent
    while up is not None and up.good < 3:
        up = up.parent
    if up is None:
        for node in nodes:
            node.good = 0
        return best.parent
    return up


def main_text(html: str | None) -> str:
    """The main text of one page."""
    nodes, blocks = read_blocks(html or "")
    blocks = _released(nodes, blocks)
    if not blocks:
        return ""
    _summed(nodes, blocks)
    for node, text, _ in blocks:
        points = 1.0 + text.count(",") + min(len(text) / 100.0, 3.0)
        # a block's own element is the paragraph; bare text in a container is its own paragraph
        up = node if node.tag in CONTAINERS else node.parent
        up.score += points
        if up.parent is not None:
            up.parent.score += 0.5 * points
    best = max((node for node in nodes if node.score > 0), key=_value)
    # what an article element holds belongs together
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    hub = best.parent if up else _shared(nodes, best)
    for node in nodes:
        inherited = node.parent is not None and node.parent.kept
        node.kept = inherited or node is best or node.parent is hub is not None and (node.good > 0 or _beside(node, best))
    chosen = [node.kept or node is hub and not linked and bool(_ENDS_SENTENCE.search(text)) for node, text, linked in blocks]
    first = next((i for i, (node, _, _) in enumerate(blocks) if node.kept), 0)
    for i in range(first - 1, -1, -1):
        node, text, linked = blocks[i]
        if node.tag == "h1":
            chosen[i] = chosen[i] or 2 * linked < len(text)
            break
    return "\n".join(text for (_, text, _), keep in zip(blocks, chosen) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(F.col(html_col).cast("string")).alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
