"""HTML pages as leaf blocks: runs of text between the edges of block-level elements.

A block knows the elements above it (`path`) and how much of its text is link text. Character
references are decoded, white space inside a block becomes one blank, ends are trimmed; blocks
without text are left out. Scripts, styles, templates, pictures and the head give no text.
Tags are paired leniently: an end tag closes the nearest open element of its name, whatever lies
between; paragraphs, list items, cells and rows end where another of their kind begins.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # comment
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>"  # tag, with quoted values
    r"|<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\Z)"  # declaration
    r"|<(?:/?[a-zA-Z])[^>]*+\Z", re.S)  # tag that never ends
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
DIGITS = re.compile(r"\d+")

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup"
    " option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and those whose text is not shown.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head template svg math object canvas audio video map".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("body button caption html option optgroup select tbody td tfoot th thead tr".split())
#: An element of the first kind ends open elements of the second, up to one of the third.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
#: End tags do not reach beyond these.
FENCES = frozenset({"td", "th", "table", "caption", "button"})


class Element(NamedTuple):
    tag: str
    path: str
    silent: bool


class Block(NamedTuple):
    path: str
    text: str
    link_chars: int


def attributes(text: str) -> str:
    """What tells something about an element: class, id and role, and whether it is hidden."""
    if "=" not in text and "hidden" not in text:
        return ""
    known = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}
    named = " ".join(DIGITS.sub("0", known[k]) for k in ("class", "id", "role") if known.get(k))
    return (named + (" ~hidden" if HIDDEN.search(text) else "")).replace("/", " ").replace(">", " ")


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order. A path is `/tag>attributes/tag>attributes...`."""
    found: list[Block] = []
    open_: list[Element] = [Element("", "", False)]
    parts: list[str] = []
    link_depth, link_chars = 0, 0
    at, end = 0, len(html)

    def flush():
        nonlocal parts, link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(block_path(), text, min(link_chars, len(text))))
            parts, link_chars = [], 0

    def block_path() -> str:
        return next(e.path for e in reversed(open_) if e.tag in BLOCKS or not e.tag)

    def close(k: int):
        nonlocal link_depth
        if any(e.tag in BLOCKS for e in open_[k:]):
            flush()
        link_depth -= sum(e.tag == "a" for e in open_[k:])
        del open_[k:]

    while at < end:
        m = TAG.search(html, at)
        text = html[at:m.start()] if m else html[at:]
        if text and not open_[-1].silent:
            decoded = unescape(text) if "&" in text else text
            parts.append(decoded)
            if link_depth:
                link_chars += len(decoded.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # end tag
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    close(k)
                    break
                if open_[k].tag in FENCES and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            if tag == "br":
                parts.append("\n")
            continue
        if tag == "br":
            parts.append("\n")
        if tag in ENDS_PARAGRAPH:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    close(k)
                    break
                if open_[k].tag in BLOCKS:
                    break
        if tag in ENDED_BY:
            ended, fence = ENDED_BY[tag]
            first = None
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in fence:
                    break
                if open_[k].tag in ended:
                    first = k
            if first is not None:
                close(first)
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if tag in RAW:
            finish = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = finish.end() if finish else end
            continue
        if tag == "a":
            link_depth += 1
        above = open_[-1]
        open_.append(Element(tag, f"{above.path}/{tag}>{attributes(m[3])}", above.silent or tag in SILENT))
    flush()
    return found
