"""A lenient reader of HTML in one pass: pieces of text with the elements that hold them.

Ends of p, li, td and the like may be missing, end tags may match nothing, and scripts may hold tags.  Elements are told
apart into *containers*, which lay a page out, and *units*, the outermost elements of text (paragraph, list,
table, ...) in a container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in ("script", "style")}
#: Elements of running text; every other element is a container.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
UNITS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre table blockquote hr figure li dt dd tr td th thead tbody tfoot caption colgroup col figcaption button input select textarea option".split())
#: Elements whose start ends an open paragraph, and what an element's own start ends within its parent.
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "tbody", "thead"), "thead": (), "tfoot": ("tr", "td", "th", "tbody"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Attributes that say what an element is for.
TELLING = ("class", "id", "role", "aria-label", "data-testid", "data-panel-type")
NUMBER = re.compile(r"\d+")
BLANK = re.compile(r"\s+")


def attributes(source: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class Element:
    """An open element.  ``container`` is the nearest container, itself if it is one, and ``path`` the signs of that
    and of the containers around it, ``outer`` the container around its parent; ``unit`` is the outermost element of text in the container, ``block`` the innermost one
    that isn't inline."""

    __slots__ = ("tag", "sign", "path", "container", "outer", "unit", "block", "link", "number")

    def __init__(self, tag: str, sign: str, around: Element | None, number: int, container: bool):
        self.tag, self.sign, self.number = tag, sign, number
        self.block = around.block if around and tag in INLINE else self
        self.outer = around.container if around else None
        if container or around is None:
            self.container, self.unit, self.link = self, None, False
            self.path = f"{around.path}>{sign}" if around else ""
        else:
            self.container, self.path = around.container, around.path
            self.unit, self.link = around.unit or self, around.link or tag == "a" or tag == "button"

    def lay_out(self) -> None:
        """Make a table's cell a container, since blocks begin in it."""
        if self.container is not self:
            self.container, self.unit, self.path = self, None, f"{self.path}>{self.sign}"


class Piece:
    """A piece of text and the element right around it."""

    __slots__ = ("number", "text", "element", "container", "unit")

    def __init__(self, number: int, text: str, element: Element):
        self.number, self.text, self.element = number, text, element
        self.container, self.unit = element.container, element.unit or element


def pieces(html: str) -> Iterator[Piece]:
    """Non-blank pieces of text outside head, script and style, in document order."""
    root = Element("", "", None, 0, True)
    stack, number, elements, at, head = [root], 0, 0, 0, False
    signs: dict[tuple[str, str], str] = {}
    end = len(html)
    while at < end:
        found = TOKEN.search(html, at)
        start = found.start() if found else end
        if start > at and not head:
            text = html[at:start]
            if not text.isspace():
                if "&" in text:
                    text = unescape(text)
                if text and not text.isspace():
                    yield Piece(number, text, stack[-1])
                    number += 1
        if not found:
            return
        at = found.end()
        name = found[2]
        if name is None:
            continue
        tag = name.lower()
        if found[1]:
            if tag == "head":
                head = False
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE or tag in ("p", "li") and stack[i].tag not in INLINE and stack[i].tag not in UNITS:
                    break
            continue
        if tag in RAW:
            at = RAW[tag].search(html, at).end()
            continue
        if tag == "head":
            head = True
            continue
        if tag == "body":
            head = False
        if tag == "html" or tag == "body":
            continue
        if tag in ENDS_PARAGRAPH:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in SIBLINGS:
            closes, scope = SIBLINGS[tag], SCOPES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    del stack[i:]
                elif stack[i].tag in scope or stack[i].tag not in INLINE and stack[i].tag != "p":
                    break
        if tag in VOID:
            continue
        elements += 1
        if (sign := signs.get((tag, found[3]))) is None:
            sign = signs[tag, found[3]] = tag + "".join(f"[{k}={NUMBER.sub('#', v) if k == 'id' else v}]" for k, v in attributes(found[3]).items() if k in TELLING) if found[3] else tag
        top = stack[-1]
        holds_text = tag in INLINE or tag in UNITS
        if top.tag in ("td", "th") and (not holds_text or tag in ENDS_PARAGRAPH):
            top.lay_out()
        stack.append(Element(tag, sign, top, elements, not holds_text))
