"""A reader of HTML that takes one pass: elements as intervals over the pieces of a page's text.

Every start tag pushes an element and every element is popped once, so the work
grows with the page however its tags are nested or left open.  An element
holds where its text begins and ends among the pieces and how many of the
elements kept lie within it; nobody's text is copied into its ancestors.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container
from dataclasses import dataclass, field

_MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}

# Elements without content, blocks, and which open elements a start tag ends (unless one of the last list was opened since).
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
_BLOCKS = ["address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"]
_ENDS = {
    "li": (["li"], ["ul", "ol", "menu"]), "dt": (["dt", "dd"], ["dl"]), "dd": (["dt", "dd"], ["dl"]), "tr": (["tr"], ["table"]), "td": (["td", "th"], ["tr", "table"]), "th": (["td", "th"], ["tr", "table"]),
    "option": (["option"], ["select"]), "a": (["a"], ["td", "th", "object"]),
} | {block: (["p"], ["td", "th", "button", "object"]) for block in _BLOCKS}


@dataclass(slots=True)
class Element:
    """begin and end count pieces of text, last the elements that began before its end."""

    tag: str
    attrs: dict[str, str]
    begin: int
    end: int = -1
    last: int = -1


@dataclass(slots=True)
class Page:
    elements: list[Element] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    raw: dict[int, str] = field(default_factory=dict)

    def text(self, e: Element) -> str:
        return "".join(self.pieces[e.begin : e.end])


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes of a start tag, the place after it, and whether it ends itself."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if m[1] is None:
            break
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        found[m[1].lower()] = html.unescape(value or "")
        at = m.end()
    at = m.end()
    closed = at > 0 and page[at - 1 : at] == "/"
    return found, at + 1 if at < len(page) else at, closed


def read(page: str, hidden: Container[str] = ("template",)) -> Page:
    """Elements and text of a page; text of scripts and styles is kept apart, that directly in ``hidden`` elements is left out."""
    out = Page()
    elements, pieces = out.elements, out.pieces
    stack: list[int] = []
    open_at: dict[str, list[int]] = {}  # of each tag the places in the stack of its open elements

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = elements[stack.pop()]
            open_at[e.tag].pop()
            e.end, e.last = len(pieces), len(elements)

    def data(a: int, b: int) -> None:
        if a < b and not (stack and elements[stack[-1]].tag in hidden):
            pieces.append(html.unescape(page[a:b]))

    at = 0
    while m := _MARK.search(page, at):
        data(at, m.start())
        if m[3]:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
        elif m[2] is None:
            end = page.find(">", m.end())
            at = len(page) if end < 0 else end + 1
        elif m[1]:
            end = page.find(">", m.end())
            at = len(page) if end < 0 else end + 1
            if places := open_at.get(m[2].lower()):
                close(places[-1])
        else:
            tag = m[2].lower()
            attrs, at, closed = _attributes(page, m.end())
            ends, scope = _ENDS.get(tag, ((), ()))
            wall = max((open_at[s][-1] for s in scope if open_at.get(s)), default=-1)
            place = min((open_at[e][-1] for e in ends if open_at.get(e) and open_at[e][-1] > wall), default=None)
            if place is not None:
                close(place)
            elements.append(Element(tag, attrs, len(pieces)))
            if tag in _VOID or closed:
                elements[-1].end, elements[-1].last = len(pieces), len(elements)
                continue
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(len(elements) - 1)
            if tag in _RAW_END:
                end = _RAW_END[tag].search(page, at)
                stop = end.start() if end else len(page)
                out.raw[len(elements) - 1], at = page[at:stop], stop
    data(at, len(page))
    close(0)
    return out
