"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and name parts with a set meaning on web pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MUTE = frozenset(
    "head title script style noscript template select button textarea dialog iframe object svg math canvas audio video "
    "datalist label".split()
)
APART = frozenset("nav footer aside form menu fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"}, "p": BLOCKS - {"body", "html"},
}
CLUTTER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner bottombar breadcrumb breadcrumbs byline comment "
    "comments consent cookie cookies copyright discussion disqus footer gdpr header login masthead menu meta modal nav navbar "
    "navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promos promotion "
    "recommended recommendations related replies reply respond responses search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription taboola tags teaser toolbar topbar tracking warning widget".split()
)
PLAIN = frozenset("area bar block box container content group inner item items link links list outer panel row section slot text thread unit wrap wrapper zone".split())
STANCE = frozenset("has is no with without show hide".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SMOOTH = 2
LINKED = 0.2  # what a character of link text counts
CLUTTERED = 1e-6  # evidence of a path through an element that names clutter
MENU = 0.005  # evidence of a path that holds links only
EASED = 0.5  # the threshold inside a container; unlinked text never falls below, as its own share of the kernel is 0.4
FLOOR = 0.1  # the smallest threshold outside
DEEPEST = 512  # deeper elements become siblings, as in browsers; their text stays


def is_clutter(tag: str, attributes: dict[str, str]) -> bool:
    """Do the attributes name something that is never part of an article?"""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "main"):
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [p.lower() for p in NAME.findall(name)]
        if parts and parts[0] in STANCE:
            continue
        while len(parts) > 1 and (parts[-1] in PLAIN or parts[-1].isdigit()):
            parts.pop()
        if parts and (parts[-1] in CLUTTER or (tag != "article" and parts[0] in ("comment", "comments", "ad", "ads", "cookie", "sidebar", "sponsored", "advert"))):
            return True
    return False


def attributes_of(text: str) -> dict[str, str]:
    found = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return found


class Element:
    """An open element. ``mute``: its text is never shown as text; ``apart``: it or an element above names clutter."""

    __slots__ = ("tag", "parent", "block", "path", "mute", "apart", "link", "depth", "article", "header")

    def __init__(self, tag: str, parent: Element | None, mute: bool, apart: bool, name: str = ""):
        self.tag, self.parent, self.mute, self.apart = tag, parent, mute, apart
        self.block = self if parent is None or tag in BLOCKS else parent.block
        part = f"{tag}.{name}" if name else tag
        self.path = f"{parent.path}>{part}" if parent and parent.depth < 64 else part
        self.link = tag == "a" or bool(parent and parent.link)
        self.depth = parent.depth + 1 if parent else 0
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.header = tag == "header" or bool(parent and parent.header)

    def chain(self) -> Iterator[Element]:
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


#: A comment, a declaration, or a tag with its name and attributes; an unclosed quote ends at the next ``>``.
TOKEN = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)"
    r"|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?", re.S)
TELLING = re.compile("class|id|role|style|hidden", re.I)
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in ("script", "style", "title", "textarea", "noscript", "iframe")}


class Leaves:
    """Text leaves ``(element, block number, text)`` of a page, in order."""

    def __init__(self, html: str):
        self.top = self.now = Element("", None, False, False)
        self.block, self.leaves = 0, []
        at = 0
        while m := TOKEN.search(html, at):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if tag := m["tag"]:
                tag = tag.lower()
                if m["end"]:
                    self._end(tag)
                    continue
                self._start(tag, m["attrs"])
                if tag in RAW:
                    close = RAW[tag].search(html, at)
                    at = close.start() if close else len(html)
        if at < len(html):
            self._text(html[at:])

    def _text(self, text: str) -> None:
        self.leaves.append((self.now, self.block, unescape(text) if "&" in text else text))

    def _open(self, tag: str) -> Element | None:
        at = self.now
        while at is not self.top:
            if at.tag == tag:
                return at
            at = at.parent
        return None

    def _start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body"):
            if self._open(tag):
                return
        if tag in BLOCKS:
            self.block += 1
        if tag in ("br", "hr"):
            self.leaves.append((self.now, self.block, " "))
        if tag in VOID:
            return
        if tag in ("article", "main"):
            for name in ("nav", "header", "head"):
                if (found := self._open(name)) and not self._open("article"):
                    self.now = found.parent
        if tag == "body" and (found := self._open("head")):
            self.now = found.parent
        at = self.now
        while at is not self.top and not (at.tag in ("table", "ul", "ol", "dl", "select") and tag != "p"):
            if tag in ENDED_BY.get(at.tag, ()):
                self.now = at.parent
                if at.tag != "p":
                    break
            if at.tag in BLOCKS and at.tag not in ENDED_BY:
                break
            at = at.parent
        inside = self.now if self.now.depth < DEEPEST else self.now.parent
        given = attributes_of(attrs) if attrs and TELLING.search(attrs) else {}
        clutter = bool(given) and is_clutter(tag, given)
        apart = inside.apart or tag in APART or clutter
        if tag == "header" and not inside.article:
            apart = True
        if inside.header and tag in ("p", "div", "ul", "span", "time", "address"):
            apart = True
        if apart and not clutter and tag in ("main", "article") and self._only_form_hides(inside):
            apart = False
        # clutter within a line has no path of its own
        mute = inside.mute or tag in MUTE or (apart and not inside.apart and tag not in BLOCKS and tag not in APART)
        name = re.sub(r"\d+", "", (given.get("class") or given.get("id") or "").split(" ")[0].lower())
        self.now = Element(tag, inside, mute, apart, name)

    def _only_form_hides(self, inside: Element) -> bool:
        """Some pages wrap everything in one form."""
        return all(e.tag == "form" for e in inside.chain() if e.parent and e.apart and not e.parent.apart)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        if found := self._open(tag):
            if tag not in BLOCKS and any(e.tag in BLOCKS for e in self._between(found)):
                return
            self.now = found.parent

    def _between(self, found: Element) -> Iterator[Element]:
        at = self.now
        while at is not found:
            yield at
            at = at.parent


class Block:
    """One line of a page: its block element, its text, and how much of it is link text."""

    __slots__ = ("element", "path", "apart", "text", "linked", "marks")

    def __init__(self, parts: list[tuple[Element, str]]):
        first = next(e for e, t in parts if t.strip())
        self.element = first.block
        self.apart = first.apart
        self.path = ("!" if self.apart else "") + first.block.path
        self.text = " ".join("".join(t for _, t in parts).split())
        self.linked = min(len(self.text), sum(len(" ".join(t.split())) for e, t in parts if e.link))
        self.marks = sum(len(MARKS.findall(t)) for e, t in parts if not e.link)


def blocks_of(html: str) -> list[Block]:
    held: dict[int, list[tuple[Element, str]]] = defaultdict(list)
    for element, number, text in Leaves(html).leaves:
        if not element.mute:
            held[number].append((element, text))
    return [Block(parts) for parts in held.values() if any(t.strip() for _, t in parts)]


def smoothed(values: list[float]) -> list[float]:
    """The geometric mean of each value and its neighbourhood on the page by a Gauss kernel.

    So content lifts what stands between it, and a boundary stays one.
    """
    kernel = [math.exp(-(k * k) / 2.0) for k in range(-SMOOTH, SMOOTH + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[k + SMOOTH], values[i + k]) for k in range(-SMOOTH, SMOOTH + 1) if 0 <= i + k < len(values)]
        out.append(math.sqrt(values[i] * sum(w * v for w, v in near) / sum(w for w, _ in near)))
    return out


def path_scores(blocks: list[Block]) -> dict[str, float]:
    """The fused ratio of each tag path.

    Text length and punctuation per block of a path are smoothed over the page in
    its order and multiplied; the mean over a path's blocks is weighed by the share of
    its text that is no link, and by whether it leads through an element that names clutter.
    """
    size, marks, count, linked, total = (defaultdict(float) for _ in range(5))
    for b in blocks:
        count[b.path] += 1
        size[b.path] += len(b.text) - (1 - LINKED) * b.linked
        marks[b.path] += b.marks
        linked[b.path] += b.linked
        total[b.path] += len(b.text)
    lengths = smoothed([size[b.path] / count[b.path] for b in blocks])
    points = smoothed([1.0 + marks[b.path] / count[b.path] for b in blocks])
    fused: dict[str, float] = defaultdict(float)
    for b, length, point in zip(blocks, lengths, points):
        fused[b.path] += length * point / count[b.path]
    out = {}
    for path, score in fused.items():
        share = linked[path] / total[path]
        evidence = MENU if share > 0.99 else 1.0
        out[path] = score * evidence * (CLUTTERED if path.startswith("!") else 1.0)
    return out


def main_text(html: str | None) -> str:
    """The article of one page: its blocks in order, one per line.

    Paths whose fused score reaches the spread of all scores are content. All
    outermost ``article`` (or else ``main``) elements with content, or else the
    smallest element that holds all of it, are containers. In them a path needs
    only ``EASED``: short blocks count too, mere link lists and paths through
    clutter do not. Outside of them only content counts.
    """
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    scores = path_scores(blocks)
    mean = sum(scores.values()) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores.values()) / len(scores))
    limit = max(FLOOR, min(max(scores.values()), spread))
    content = [b for b in blocks if scores[b.path] >= limit]
    containers = _containers(blocks, content)
    lines = []
    for b in blocks:
        inside = not b.apart and any(id(e) in containers for e in b.element.chain())
        if scores[b.path] >= (min(EASED, limit) if inside else limit):
            lines.append(b.text)
    return "\n".join(lines)


def _containers(blocks: list[Block], content: list[Block]) -> set[int]:
    """The elements (by ``id``) in which short blocks count too."""
    plain = [b for b in blocks if not b.apart]
    named = {id(e): e for b in plain for e in b.element.chain() if e.tag in ("article", "main")}
    tag = "article" if any(e.tag == "article" for e in named.values()) else "main"
    outermost = {k for k, e in named.items() if e.tag == tag and not any(up.tag == tag for up in e.chain() if up is not e)}
    held = {id(e) for b in content for e in b.element.chain()} & outermost
    if held or outermost:
        if held:
            return held
        size = {k: sum(len(b.text) for b in plain if any(id(e) == k for e in b.element.chain())) for k in outermost}
        return {max(size, key=size.get)}
    if not content:
        return set()
    common = [id(e) for e in content[0].element.chain()]
    elements = {id(e): e for e in content[0].element.chain()}
    for b in content[1:]:
        own = {id(e) for e in b.element.chain()}
        common = [k for k in common if k in own]
    at = elements[common[0]]
    while at.parent and at.tag in ("p", "li", "td", "th", "tr", "tbody", "blockquote", *HEADINGS):
        at = at.parent
    return {id(at)}


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` and ``_main_text``; pages are independent of each other.

    NULL and empty pages, and pages without content, give an empty text. Repeated rows
    stay; a column ``_main_text`` that the pages have already is replaced.
    """

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in column], dtype=object)

    return pages.withColumn("_main_text", texts(F.col(html)))
