"""HTML as a sequence of text blocks with the set of names on the path to each."""

from __future__ import annotations

import re
from html import unescape

#: Element names of HTML that begin and end a block of text.
BLOCK = frozenset(
    "html head title body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section "
    "article main aside nav header footer form fieldset legend label button select option optgroup blockquote pre hr "
    "figure figcaption address details summary dialog menu center noscript iframe object video audio canvas".split()
)
#: Elements without an end tag, and elements whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template svg math textarea".split())
#: Elements that the start of another one ends, up to the nearest of a container.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that stay on the path though they break no block.
CARRIED = frozenset(("a", "span", "time", "cite"))

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^<>])*+)>""", re.DOTALL
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Paths:
    """Sets of names (elements, and the words of their class, id and role) by number; each set once."""

    def __init__(self) -> None:
        self.sets: list[frozenset[str]] = [frozenset()]
        self.number = {frozenset(): 0}
        self.known: dict[tuple[int, str, str], int] = {}

    def below(self, at: int, tag: str, attributes: str) -> int:
        """The set of ``at`` with the names of one more element."""
        key = (at, tag, attributes)
        found = self.known.get(key)
        if found is None:
            words = (NAME.findall("".join(m).lower()) for m in NAMED.findall(attributes))
            names = self.sets[at] | {f"<{tag}"} | {w for ws in words for w in ws}
            found = self.known[key] = self.number.setdefault(names, len(self.sets))
            if found == len(self.sets):
                self.sets.append(names)
        return found


def leaf_blocks(html: str | None, paths: Paths) -> list[tuple[str, int, int]]:
    """(text, number of its path's set, characters inside links) of every block with text, in page order.

    Character references are decoded and white space inside a block becomes one space.  Comments,
    scripts, styles and attributes are no text.  Elements left open, closed twice or crossed never
    lose text; a name stands once in a set, so deeply nested elements cost no more.
    """
    html, found = html or "", []
    stack: list[tuple[str, int]] = []  # open elements and the set above each
    open_count: dict[str, int] = {}
    at = pos = links = 0
    run: list[str] = []
    place: int | None = None  # the set of the block's first word
    linked = 0

    def text(piece: str) -> None:
        nonlocal place, linked
        if not piece:
            return
        if "&" in piece:
            piece = unescape(piece)
        if place is None and not piece.isspace():
            place = at
        run.append(piece)
        if links:
            linked += len(piece.strip())

    def finish() -> None:
        nonlocal place, linked
        if place is not None:
            found.append((" ".join("".join(run).split()), place, linked))
        run.clear()
        place, linked = None, 0

    def close(depth: int) -> None:
        nonlocal at, links
        at = stack[depth][1]
        for name, _ in stack[depth:]:
            open_count[name] -= 1
            links -= name == "a"
        del stack[depth:]

    def end(names: set[str], within: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                close(k)
                return
            if stack[k][0] in within:
                return

    while match := TOKEN.search(html, pos):
        text(html[pos : match.start()])
        pos = match.end()
        name = match[2]
        if name is None:
            continue
        name = name.lower()
        if match[1]:
            if name in BLOCK:
                finish()
            if open_count.get(name):
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in RAW:
            stop = RAW_END[name].search(html, pos) if not match[3].endswith("/") else None
            pos = stop.start() if stop else (pos if match[3].endswith("/") else len(html))
            run.append(" ")
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in BLOCK:
            finish()
            if open_count.get("p"):
                end({"p"}, set())
            if name in ENDED_BY and any(open_count.get(n) for n in ENDED_BY[name][0]):
                end(*ENDED_BY[name])
        elif name not in CARRIED:
            continue
        if name == "a" and links:
            end({"a"}, set())
        if name in VOID or match[3].endswith("/"):
            continue
        stack.append((name, at))
        open_count[name] = open_count.get(name, 0) + 1
        at = paths.below(at, name, match[3])
        links += name == "a"
    text(html[pos:])
    finish()
    return found
