"""Leaf blocks of a web page, in page order, with features of the tags above them."""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple
from zlib import crc32

# HTML's own element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are no markup, and end with their end tag only.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "html head body p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 article section nav header footer aside main blockquote pre table caption thead tbody tfoot tr td th "
    "form fieldset legend figure figcaption address details summary dialog hr hgroup menu center".split()
)
#: What stands in these inside a block is a block of its own, and the one around them goes on after it.
ASIDE = frozenset("noscript template svg object canvas audio video select button".split())
#: Start tags that end an open element of the second kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: ... but not one outside of these.
SCOPE = frozenset("ul ol dl table html body article section div nav aside main form".split())

#: Names (tags, classes, ids, roles) are hashed into so many features.
PATH_DIM = 512
_MARKUP = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?|[!?][^>]*>?)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}


class Leaf(NamedTuple):
    ids: tuple[int, ...]
    text: str
    linked: int


class Element(NamedTuple):
    tag: str
    #: Features of it and all elements above, one object for elements that add none; and the innermost three names.
    features: frozenset[int]
    inner: tuple[str, ...]
    #: Text, its linked characters and features of the block around an element of ASIDE.
    around: tuple[list[str], int, tuple[int, ...]] | None


def _feature(name: str) -> int:
    return crc32(name.encode()) % PATH_DIM


@lru_cache(1 << 12)
def _named(tag: str, attributes: str) -> tuple[tuple[str, ...], frozenset[int]]:
    """The element's last three names, and features of all."""
    out = [tag]
    for m in _NAMES.finditer(attributes):
        out += [f".{w}" for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(out[-3:]), frozenset(map(_feature, out))


@lru_cache(1 << 12)
def _ids(features: frozenset[int], inner: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(sorted({*features, *(_feature(f"in:{t}") for t in inner)}))


def leaves(page: str) -> list[Leaf]:
    """Every block of text, with hashed names of the elements around it; the innermost three once more, marked, as they say most.

    Character references are decoded, white space is one space, blank blocks aren't listed. A line
    break inside a block counts as white space. Contents of scripts, styles, titles and text
    fields are no text; an unclosed comment or script runs to the end of the page. Nesting costs
    nothing a block: an element shares the features of the one above, and there are PATH_DIM at most.
    """
    out: list[Leaf] = []
    stack: list[Element] = []
    tags: Counter[str] = Counter()
    some: list[str] = []
    linked = 0
    ids: tuple[int, ...] = ()
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(some)).split())
        if text:
            out.append(Leaf(ids, text, linked))
        some.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal ids, linked
        if not some:
            if piece.isspace():
                return
            ids = _ids(stack[-1].features, stack[-1].inner) if stack else ()
        some.append(piece)
        linked += len(piece) if tags["a"] else 0

    def push(tag: str, attributes: str) -> None:
        nonlocal some, linked
        names, own = _named(tag, attributes)
        if stack:
            above = stack[-1]
            own = above.features if own <= above.features else above.features | own
            names = (above.inner + names)[-3:]
        around = None
        if tag in ASIDE:
            around, some, linked = (some, linked, ids), [], 0
        stack.append(Element(tag, own, names, around))
        tags[tag] += 1

    def pop() -> str:
        nonlocal some, linked, ids
        e = stack.pop()
        if e.around:
            flush()
            some, linked, ids = e.around
        tags[e.tag] -= 1
        return e.tag

    while at < end:
        opened = page.find("<", at)
        if opened < 0:
            add(page[at:])
            break
        if opened > at:
            add(page[at:opened])
        m = _MARKUP.match(page, opened)
        if not m:
            add("<")
            at = opened + 1
            continue
        at = m.end()
        if m[1]:
            stop = page.find("-->", opened + 4)
            at = end if stop < 0 else stop + 3
            continue
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag == "br":
            add(" ") if some else None
            continue
        if tag in BLOCK:
            flush()
        if m[2]:
            while tags[tag] and pop() != tag:
                pass
            if tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            if not m[4].endswith("/"):
                stop = _RAW_END[tag].search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in VOID or (tag in ASIDE and m[4].endswith("/")):
            continue
        if tag in BLOCK and tags["svg"] and not tags["foreignobject"]:  # as HTML has it, a block ends an open drawing
            while pop() != "svg":
                pass
            flush()
        ended = ("p", *CLOSES.get(tag, ()))
        if tag in BLOCK and tag not in ("html", "body") and any(tags[x] for x in ended):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ended:
                    while len(stack) > i:
                        pop()
                    flush()
                    break
                if stack[i].tag in SCOPE or stack[i].around:
                    break
        push(tag, m[4])
    while stack:
        pop() if stack[-1].around else stack.pop()
    flush()
    return out
