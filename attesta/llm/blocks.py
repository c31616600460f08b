"""HTML as a sequence of leaf blocks with their tag paths."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
#: Elements whose content is no text of the page. Everything else is for the labeller to judge.
SKIPPED = frozenset("script style title textarea".split())
#: Of these, the ones that end at the next tag if they are never closed.
_SHORT = frozenset("title textarea".split())
#: Elements that run on inside a block, formulas, drawings and media with their fallback text too.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter "
    "nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time "
    "tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover "
    "munderover mspace semantics annotation svg g path circle rect line polygon polyline ellipse use "
    "defs desc text tspan symbol object embed canvas audio video track param".split()
)
VOID = frozenset(
    "area base br col embed frame hr img input link meta param source track wbr".split()
)
#: A start tag ends an open element of these, up to the nearest one of the second kind.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


_END = {n: re.compile(rf"</{n}\b[^>]*>?", re.I) for n in SKIPPED}


class Block(NamedTuple):
    path: tuple[tuple[str, ...], ...]  # from the root: tag, then words of its class, id and role
    text: str
    linked: int  # characters that stand in links


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order. Character references are decoded, white space is one space.
    End tags that match nothing are ignored, unclosed elements end with what holds them; a script or
    style that is never closed reaches to the end, as browsers have it."""
    stack: list[tuple[str, ...]] = []
    out: list[Block] = []
    parts: list[str] = []
    linked = depth = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(stack), text, min(linked, len(text))))
            parts, linked = [], 0

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        raw = page[at : m.start() if m else len(page)]
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if depth:
                linked += len(raw)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, end = m[2].lower(), bool(m[1])
        if name in SKIPPED:
            if not end and not m[3].endswith("/>"):
                close = _END[name].search(page, at)
                if close:
                    at = close.end()
                else:
                    at = page.find("<", at) if name in _SHORT and "<" in page[at:] else len(page)
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                depth = 0 if end else 1
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        depth = 0
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if name in _CLOSES:
            same, stop = _CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in same:
                    del stack[i:]
                    break
                if stack[i][0] in stop:
                    break
        if name in VOID or m[3].endswith("/>"):
            continue
        words = [w for n in _NAMES.findall(m[3]) for w in _WORDS.findall(" ".join(n).lower())] if len(m[3]) > 1 else []
        stack.append((name, *words))
    flush()
    return out
