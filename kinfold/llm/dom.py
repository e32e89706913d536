"""A forgiving HTML reader: a flat list of elements and text blocks in page order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
MARK = re.compile(r"<(?=[/!?a-zA-Z])")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, whatever it looks like.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that begin and end a line of their own.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: What a start tag ends if it is open, up to the elements that shield it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Elements whose end tag closes none beyond the block that it stands in.
INLINE = frozenset(("a", "b", "i", "em", "strong", "span", "font", "u", "small"))
ONLY_P = frozenset({"p"})
ENDS_P = BLOCK - {"body", "head", "html", "title", "option", "optgroup", "template", "textarea", "noscript", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "frameset", "legend"}
SHIELDS_P = frozenset({"article", "aside", "blockquote", "body", "button", "dd", "div", "figure", "footer", "form", "header", "li", "main", "nav", "section", "table", "td", "th"})


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: int
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """``elements`` by number, 0 the root; ``blocks`` are (element, text, characters of it that stand in links)."""

    elements: list[Element]
    blocks: list[tuple[int, str, int]]


def clean(text: str) -> str:
    return SPACE.sub(" ", unescape(text)).strip(" ")


def parse(html: str) -> Page:
    """Read a page. Unclosed elements end where HTML lets them end, stray end tags are skipped, a tag that the page
    breaks off in is dropped.

    The depths at which elements of a tag, and block elements, are open are kept, so that no tag makes it walk through all
    open elements: time is in proportion to the page, however deep or broken it is.
    """
    elements = [Element("#root", {}, -1)]
    open_, blocks, parts = [0], [], []
    depths: dict[str, list[int]] = {}  # of the open elements of a tag
    block_depths = [0]
    owner, linked, links = 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = clean("".join(parts))
            if text:
                blocks.append((owner, text, min(linked, len(text))))
            parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal owner, linked
        if raw:
            if not parts:
                if raw.isspace():
                    return
                owner = open_[block_depths[-1]]
            parts.append(raw)
            if links:
                linked += len(raw.strip())

    def enter(i: int, tag: str) -> None:
        nonlocal links
        if tag in BLOCK:
            block_depths.append(len(open_))
        depths.setdefault(tag, []).append(len(open_))
        open_.append(i)
        links += tag == "a"

    def leave(depth: int) -> None:
        """Close all open elements from this depth on."""
        nonlocal links
        if block_depths[-1] >= depth:
            flush()
            while block_depths[-1] >= depth:
                block_depths.pop()
        for i in open_[depth:]:
            tag = elements[i].tag
            depths[tag].pop()
            links -= tag == "a"
        del open_[depth:]

    def deepest(tags) -> int:
        return max((d[-1] for t in tags if (d := depths.get(t))), default=0)

    def end_if_open(tags, shields) -> None:
        while d := deepest(tags):
            if d <= deepest(shields - tags):
                return
            leave(d)
            if len(tags) == 1:
                return

    at, size = 0, len(html)
    while at < size:
        m = MARK.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.start()
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if html[at + 1] in "!?":
            end = html.find(">", at)
            at = size if end < 0 else end + 1
            continue
        m = TAG.match(html, at)
        if not m:
            if html[at + 1] == "/" and not html[at + 2 : at + 3].isalpha():
                end = html.find(">", at)
                at = size if end < 0 else end + 1
                continue
            break
        closing, tag, rest = m[1] or m[4], (m[2] or m[5]).lower(), m[3] or m[6] or ""
        at = m.end()
        if closing:
            if tag == "br":
                add(" ")
            if (d := depths.get(tag)) and (tag not in INLINE or d[-1] > block_depths[-1]):
                leave(d[-1])
            continue
        if tag in ENDS:
            end_if_open(*ENDS[tag])
        if tag in ENDS_P and depths.get("p"):
            end_if_open(ONLY_P, SHIELDS_P)
        if tag in BLOCK:
            flush()
        if tag == "br":
            add(" ")
            continue
        attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest)} if "=" in rest or rest.strip(" /\n\t") else {}
        elements.append(Element(tag, attributes, open_[-1]))
        me = len(elements) - 1
        elements[open_[-1]].children.append(me)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(html, at)
            if tag in ("textarea", "title"):
                enter(me, tag)
                add(html[at : end.start() if end else size])
                leave(len(open_) - 1)
            at = html.find(">", end.start()) + 1 if end and html.find(">", end.start()) >= 0 else size
            continue
        if rest.endswith("/") and tag in ("svg", "path", "circle", "rect", "use", "g", "line", "polygon"):
            continue
        enter(me, tag)
    leave(1)
    flush()
    return Page(elements, blocks)
