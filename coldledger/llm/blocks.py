"""Leaf blocks of web pages: runs of text between block-level tags, with the tags above them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

# Fixed values of the markup language.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup svg math time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template".split())
# Their content is in the line of text around them, whatever its tags, up to a tag that only pages have.
_FOREIGN = frozenset("svg math".split())
# Blocks of their own if they have text.
_FALLBACK = frozenset("noscript object iframe".split())
_CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# A quote opens a value only right after an equals sign; anywhere else, and where it is never closed, it is a
# character like others. Two dashes that follow the opening ones at once are those of a comment's end.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>])*+)(?:>|\Z)|[^<]+|<",
    re.S,
)
# What is between these tags is no markup. Scripts have comments, in which a script may stand whole.
_PLAIN_ENDS = {
    "script": re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f\r />])", re.I | re.A),
    "style": re.compile(r"<(/)style(?=[\t\n\f\r />])", re.I | re.A),
}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: frozenset[str]
    link_chars: int


def _plain_end(page: str, tag: str, place: int) -> int:
    """Where the end tag of the script or style whose content begins at ``place`` begins."""
    comment = inner = False
    while found := _PLAIN_ENDS[tag].search(page, place):
        place = found.end()
        if found.group() == "<!--":
            comment = True
            place -= 2  # its dashes may be those of its end
        elif found.group() == "-->":
            comment = inner = False
        elif not found.group(1):
            inner = comment
        elif inner:
            inner = False
        else:
            return found.start()
    return len(page)


def _tokens(page: str) -> Iterator[re.Match[str]]:
    """Tags, comments and runs of text, without the content of scripts and styles."""
    place: int | None = 0
    while place is not None:
        start, place = place, None
        for token in _TOKEN.finditer(page, start):
            yield token
            name = token.group(2)
            if name and name.lower() in _PLAIN_ENDS and not token.group(1) and not token.group(3).rstrip().endswith("/"):
                place = _plain_end(page, name.lower(), token.end())
                break


def _own_names(rest: str) -> frozenset[str]:
    return frozenset(p for m in _NAMES.finditer(rest) for p in _NAME_PART.findall(m.group(1).lower()))


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of ``page`` in order. Character references are decoded, white space inside a block
    becomes one space, blocks without text are left out. Scripts, styles and comments have no text."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    links: list[str] = []
    empty: list[int] = []  # places of open fallbacks without text so far
    skipped = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                above = stack[: empty[0]] if empty else stack
                names = frozenset().union(*(own for _, own in above))
                linked = " ".join(html.unescape("".join(links)).split())
                tags = tuple(tag for tag, _ in above if tag not in _INLINE)
                found.append(Block(text, tags, names, len(linked)))
            parts.clear()
            links.clear()

    def pop_to(place: int) -> None:
        if any(tag not in _INLINE and k not in empty for k, (tag, _) in enumerate(stack[place:], place)):
            flush()
        del stack[place:]
        while empty and empty[-1] >= place:
            empty.pop()

    def last(wanted: set[str] | frozenset[str], stop: set[str] | frozenset[str] = frozenset()) -> int | None:
        for place in range(len(stack) - 1, -1, -1):
            if stack[place][0] in wanted:
                return place
            if stack[place][0] in stop:
                return None
        return None

    for token in _tokens(page):
        closing, name, rest = token.group(1), token.group(2), token.group(3)
        if name is None:
            if not skipped and not token.group().startswith(("<!", "<?")):
                if empty and not token.group().isspace():
                    flush()
                    empty.clear()
                parts.append(token.group())
                if any(tag == "a" for tag, _ in stack):
                    links.append(token.group())
            continue
        tag = name.lower()
        shut = rest.rstrip().endswith("/")
        if skipped:
            if tag == "template" and not shut:
                skipped += -1 if closing else 1
            continue
        if closing:
            place = last({tag})
            if place is not None:
                pop_to(place)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _RAW:
            if tag == "template" and not shut:
                skipped = 1
            continue
        if tag in _FALLBACK or tag in _FOREIGN:
            if not shut:
                if tag in _FALLBACK:
                    empty.append(len(stack))
                stack.append((tag, _own_names(rest)))
            continue
        place = last(_FOREIGN)
        if place is not None:
            if tag in _CLOSES_PARAGRAPH or tag in _SAME_LEVEL or tag == "body":
                while (place := last(_FOREIGN)) is not None:
                    pop_to(place)
            elif tag not in _INLINE or shut:
                continue
        if tag in _CLOSES_PARAGRAPH:
            place = last({"p"}, {"td", "th", "button", "li", "div", "article", "section", "body"})
            if place is not None:
                pop_to(place)
        if tag in _SAME_LEVEL:
            place = last(*_SAME_LEVEL[tag])
            if place is not None:
                pop_to(place)
        if tag == "body":
            place = last({"head"})
            if place is not None:
                pop_to(place)
        if tag not in _INLINE:
            flush()
        if tag not in _VOID:
            stack.append((tag, _own_names(rest)))
    flush()
    return found
