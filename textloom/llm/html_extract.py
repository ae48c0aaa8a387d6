"""HTML extraction by tree scoring.

A tolerant parser builds the page's tree in one pass. Elements that by name or role never are main text (navigation,
page headers and footers, asides, forms, scripts and styles) are left out. Each block of text passes points for its
length and its commas to its container, and half as many to each ancestor further up; in an element whose class or id
tells of noise (adverts, notices, comments of readers) as many negative ones, and none to what is around it. A
container's points are discounted by its share of linked text. The best container, or the article around it, is kept, and so are siblings,
its own and those of its ancestors, with points enough of their own, and text between these that is not linked.
Everything is linear in the length of the page, however deep its elements are nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element names of HTML by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose points go to the element around them, and blocks of text that need no points of their own.
LEAVES = frozenset(("p", "pre", "li", "blockquote", *HEADINGS))
TEXTUAL = frozenset(("p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure", *HEADINGS))
DROPPED = frozenset("script style noscript template nav footer aside form button select textarea iframe svg canvas object embed head title menu dialog audio video map datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that tell what an element holds: by the last word that is not of FORMS, or by any word of LEADS.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsors promo promotion sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs header footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social comment comments commentlist disqus reply replies respond discussion pagination pager login search skip hidden copyright toolbar taboola outbrain paywall".split()
)
LEADS = frozenset("related recommended recommendations sponsored promoted".split())
CONTENT = frozenset("article content entry post story main".split())
FORMS = frozenset("area bar block body bottom box button buttons col column container form group head holder icon icons inner item items left link links list middle outer panel region right row section slot text title top unit wrap wrapper zone".split())
QUALIFIERS = frozenset("with has no without".split())
#: What an opening tag ends, up to the nearest element of the second list.
_SCOPE = tuple("table td th caption button object html body".split())
_CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']++)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
#: Points of a block beside those for commas and length; of a container named as content.
BASE, NAMED = 1.0, 5.0
#: A sibling's least points, and its least share of the best container's: beside it, and further up.
LEAST, SHARE, FAR_SHARE = 10.0, 0.2, 0.5


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "names", "core", "out", "noise", "inside", "points", "length", "linked", "peak")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.names = _named(attrs) if tag in BLOCK else 0
        #: whether it holds a page's heading or article; whether it is left out; within noise; within an article or main
        self.core = self.out = self.noise = self.inside = False
        self.points, self.length, self.linked, self.peak = 0.0, 0, 0, 0.0


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTRIBUTE.findall(source)} if source.strip(" /\t\n") else {}


def _named(attrs: dict[str, str]) -> int:
    """How many names of class and id tell of content, less those that tell of noise."""
    out = 0
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [x.lower() for x in _NAME.findall(name)]
        words = [x for i, x in enumerate(words) if not i or words[i - 1] not in QUALIFIERS]
        telling = [x for x in words if x not in FORMS and not x.isdigit()] or words
        if not LEADS.isdisjoint(words) or telling and telling[-1] in NOISE:
            out -= 1
        elif telling and telling[-1] in CONTENT:
            out += 1
    return out


class _Open:
    """The open elements while a page is read: their stack, and by tag where in it they are."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], {"html": [0]}, [0]

    def nearest(self, tags: tuple[str, ...]) -> int:
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=-1)

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Ends the element at a place, which is not the root's, and all in it."""
        while len(self.stack) > max(1, at):
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def close(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        at = self.nearest(tags)
        if at > self.nearest(scope):
            self.cut(at)


def parse(html: str) -> list[Node]:
    """The page's elements in order, the root first; children are nodes and strings with references decoded."""
    root = Node("html", {}, None)
    nodes, held = [root], _Open(root)
    at, size = 0, len(html)
    while at < size:
        found = _TOKEN.search(html, at)
        text = html[at : found.start() if found else size]
        if text:
            held.stack[-1].children.append(unescape(text))
        if not found:
            break
        at = found.end()
        end, tag, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            place = held.nearest((tag,))
            # an inline end tag ends nothing beyond its block
            if place > 0 and (tag in BLOCK or place > held.blocks[-1]):
                held.cut(place)
            continue
        if tag == "html" and len(held.stack) == 1:
            continue
        if tag in BLOCK:
            held.close(("p",), _SCOPE)
        if tag in _CLOSES:
            held.close(*_CLOSES[tag])
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
            at = size if not stop else (html.find(">", stop.end()) + 1 or size)
        elif tag in VOID or rest.endswith("/"):
            if tag in ("br", "hr", "wbr"):
                held.stack[-1].children.append(Node(tag, {}, held.stack[-1]))
        else:
            node = Node(tag, _attributes(rest), held.stack[-1])
            node.parent.children.append(node)
            nodes.append(node)
            held.push(node)
    return nodes


def _left_out(node: Node) -> bool:
    """Whether an element is left out by its name, its role, or because it is hidden."""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED:
        return tag != "form" or not node.core
    if not attrs:
        return tag == "header" and not node.inside
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return tag == "header" and not node.inside or attrs.get("role", "").lower() in DROPPED_ROLES and not node.core


def _judge(nodes: list[Node], names: bool) -> None:
    """Marks what is left out and what is noise; an element that holds the page's heading or article is no noise."""
    for node in reversed(nodes):
        node.core |= node.tag in ("h1", "main") or node.tag == "article" and node.names >= 0
        if node.core and node.parent is not None:
            node.parent.core = True
    for node in nodes:
        up = node.parent
        node.inside = up is not None and (up.inside or up.tag in ("article", "main"))
        node.out = up is not None and up.out or _left_out(node)
        node.noise = names and (up is not None and up.noise or node.names < 0 and not (node.core and node.tag != "article"))


def _blocks(node: Node) -> list[tuple[Node, str, int]]:
    """The blocks of text under a node in page order, but for what is left out: the block element, its text, and how
    much of it is linked."""
    out: list[tuple[Node, str, int]] = []
    held: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append((owner, text, min(linked, len(text))))
        held.clear()
        linked = 0

    stack: list[tuple[Node, int, Node, bool]] = [(node, 0, node, False)]
    while stack:
        at, i, owner, link = stack.pop()
        if i == 0 and at.tag in BLOCK and stack:
            flush(stack[-1][2])
        if i == len(at.children):
            if at.tag in BLOCK:
                flush(at)
            continue
        stack.append((at, i + 1, owner, link))
        child = at.children[i]
        if isinstance(child, str):
            held.append(child)
            if link:
                linked += len(child.strip())
        elif child.tag in ("br", "wbr"):
            held.append(" " if child.tag == "br" else "")
        elif child.tag == "hr":
            flush(owner)
        elif not child.out and (child.children or child.tag in BLOCK):
            stack.append((child, 0, child if child.tag in BLOCK else owner, link or child.tag == "a"))
    flush(node)
    return out


def _worth(node: Node) -> float:
    named = NAMED * max(-1, min(1, node.names + (node.tag in ("article", "main")))) if node.tag != "body" else 0.0
    return (node.points + named) * (1 - node.linked / max(1, node.length)) if node.length else 0.0


def _score(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> Node | None:
    """Passes the blocks' points up; the best container, if any is worth anything."""
    for node in nodes:
        node.points, node.length, node.linked = 0.0, 0, 0
    for owner, text, linked in blocks:
        points = (0.0 if owner.tag in HEADINGS else BASE) + text.count(",") + min(len(text) / 100, 3.0)
        if owner.tag == "li":
            points /= 2
        node = owner.parent if owner.tag in LEAVES and owner.parent is not None else owner
        node.points += -points if owner.noise else points
        owner.length += len(text)
        owner.linked += linked
    best, most = None, 0.0
    for node in reversed(nodes):
        up = node.parent
        if up is not None and node.noise == up.noise:
            up.points += node.points / 2
            up.length += node.length
            up.linked += node.linked
        worth = 0.0 if node.noise or node.out else _worth(node)
        node.peak = max(worth, max((x.peak for x in node.children if isinstance(x, Node)), default=0.0))
        # of equals the first one in the page
        if worth > 0 and worth >= most and node.tag not in LEAVES:
            best, most = node, worth
    return best


def _beside(top: Node, share: float, best: float) -> tuple[list[Node], list[Node]]:
    """What is kept of a container's siblings, before and after it, with text between that is not linked."""
    sides: tuple[list[Node], list[Node]] = ([], [])
    side, held, between = 0, [], []
    for x in top.parent.children:
        if x is not top and not (isinstance(x, Node) and x.tag in BLOCK):
            held.append(x)
            continue
        if held:
            loose = Node("span", {}, None)
            loose.children, held = held, []
            own = _blocks(loose)
            if sum(n for _, _, n in own) < sum(len(t) for _, t, _ in own) / 4:
                between.append(loose)
        if x is top:
            # text before the first part that is kept is no part of it
            sides[0].extend(between if sides[0] else [])
            side, between = 1, []
        elif not x.out and not x.noise and (x.peak >= max(LEAST, share * best) and x.linked < x.length / 3 or share == SHARE and x.length and x.linked < x.length / 4 and (x.tag in TEXTUAL or x.tag == top.tag != "div")):
            sides[side].extend([*between, x] if side or sides[0] else [x])
            between = []
    return sides


def extract(html: str | None) -> str:
    """The main text of a page: its blocks joined by one newline; empty if there is none."""
    if not html:
        return ""
    nodes = parse(html)
    _judge(nodes, True)
    blocks = _blocks(nodes[0])
    best = _score(nodes, blocks)
    if best is None and any(x.noise for x in nodes):
        # names may mislead: what they call noise is taken if it has the points of an article
        _judge(nodes, False)
        best = _score(nodes, blocks)
        best = best if best is not None and best.peak >= LEAST else None
    if best is None:
        return ""
    most, top, node = _worth(best), best, best
    while node is not None and top.tag != "article":
        if node.tag == "article" or node.tag == "main" and top.tag != "main":
            top = node
        node = node.parent
    kept, node, share = [top], top, SHARE
    while node.parent is not None:
        before, after = _beside(node, share, most)
        kept = [*before, *kept, *after]
        node, share = node.parent, FAR_SHARE
    for x in nodes:
        x.out = x.out or x.noise
    return "\n".join(text for x in kept for _, text, _ in _blocks(x))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        texts = [extract(html) for html in x.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([x.column("page_id"), x.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def html_extract(df: DataFrame) -> DataFrame:
    """Per row of df (page_id, url, html): page_id, url, text, n_chars.

    Null, empty and blank html, and pages without main text: an empty text. Markup that is cut off or badly nested is
    read as far as it goes; a page of any length or depth is read whole, in time linear in it. A null page_id or url
    is carried; rows that repeat are returned as often; other columns are ignored; an empty table gives an empty result.
    """
    rows = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op9_html_extract(spark, sf_dir: str) -> DataFrame:
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
