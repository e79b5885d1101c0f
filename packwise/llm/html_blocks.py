"""A small HTML reader: the blocks of text of a page, each with the elements around it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of HTML: elements without content, with raw content, that break lines, and what ends an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript template svg annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section select summary table tbody td tfoot th thead title tr ul xmp".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
            "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("td", "th", "tr", "thead", "tbody"),
            "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"), "body": ("head",)}
HOLDERS = frozenset("ul ol menu dir dl select table body article section div main".split())
MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
XMP_END = re.compile(r"</xmp(?=[\s/>])[^>]*(?:>|\Z)", re.I)
#: Elements below this depth aren't opened; they are counted, so that their end tags close nothing above.
DEPTH = 256


@dataclass(slots=True)
class Element:
    tag: str
    attrs: dict[str, str]
    parent: "Element | None"
    depth: int
    children: list[str] = field(default_factory=list)

    def above(self):
        """This element and those around it, from inside out."""
        e = self
        while e is not None:
            yield e
            e = e.parent


@dataclass(slots=True)
class Block:
    """A line of text and its pieces, each with the element it stands in."""

    holder: Element
    pieces: list[tuple[Element, str]]

    def text(self, keep=None) -> str:
        whole = "".join(t for e, t in self.pieces if keep is None or keep(e))
        return SPACE.sub(" ", whole).strip()


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def read(page: str | None) -> tuple[list[Block], list[Element]]:
    """Blocks in page order, and all elements that hold blocks. Raw elements have no text, but xmp's is its source."""
    page = page or ""
    root = Element("", {}, None, 0)
    blocks: list[Block] = []
    elements: list[Element] = [root]
    pieces: list[tuple[Element, str]] = []
    here = root
    beyond: dict[str, int] = {}
    at = 0

    def flush() -> None:
        nonlocal pieces
        if any(not t.isspace() for _, t in pieces):
            holder = pieces[0][0]
            while holder.parent is not None and holder.tag not in BLOCKS:
                holder = holder.parent
            blocks.append(Block(holder, pieces))
        pieces = []

    def leave(tags: tuple[str, ...], stop: frozenset[str]) -> None:
        """Closes up to the innermost open element of tags, if nothing of stop is in between."""
        nonlocal here
        for e in here.above():
            if e.tag in tags:
                flush()
                here = e.parent or root
                return
            if e.tag in stop:
                return

    while at < len(page):
        m = MARKUP.search(page, at)
        if m is None:
            pieces.append((here, html.unescape(page[at:])))
            break
        if m.start() > at:
            pieces.append((here, html.unescape(page[at:m.start()])))
        at = m.end()
        if m["cdata"]:
            pieces.append((here, m["cdata"]))
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if beyond.get(tag):
                beyond[tag] -= 1
                if tag in BLOCKS:
                    flush()
                continue
            for e in here.above():
                if e.tag == tag:
                    if tag in BLOCKS:
                        flush()
                    here = e.parent or root
                    beyond.clear()
                    break
            continue
        if tag == "br":
            pieces.append((here, " "))
            continue
        if tag in BLOCKS:
            flush()
            if not any(beyond.values()):
                leave(("p",), HOLDERS)
            if tag in SIBLINGS and not any(beyond.values()):
                leave(SIBLINGS[tag], HOLDERS - frozenset(SIBLINGS[tag]))
                if tag == "tr" and here.tag == "tr":
                    here = here.parent or root
        if tag in RAW and not m["attrs"].rstrip().endswith("/"):
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or (tag not in BLOCKS and m["attrs"].rstrip().endswith("/")):
            continue
        opened = here.depth < DEPTH
        if opened:
            here.children.append(tag)
            here = Element(tag, attributes(m["attrs"]) if m["attrs"] else {}, here, here.depth + 1)
            if tag in BLOCKS:
                elements.append(here)
        if tag == "xmp":  # markup inside is text as it stands
            end = XMP_END.search(page, at)
            pieces.append((here, page[at:end.start() if end else len(page)]))
            at = end.end() if end else len(page)
            flush()
            here = here.parent or root if opened else here
        elif not opened:
            beyond[tag] = beyond.get(tag, 0) + 1
    flush()
    return blocks, elements
