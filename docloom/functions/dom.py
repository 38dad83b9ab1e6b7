"""A small tree of a page's elements, from the same lenient rules as ``markup``, and selectors of one step."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from docloom.functions.markup import ATTRIBUTE, BLANK, ENDS_PARAGRAPH, INLINE, RAW, SCOPES, SIBLINGS, TOKEN, UNITS, VOID

STEP = re.compile(r"^([a-zA-Z][\w-]*)?((?:#[\w-]+|\.[\w-]+|\[[^\]]+\])*)$")
PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:([*^]?=)['\"]?([^'\"\]]*)['\"]?\s*(i?))?\]")


class Tag:
    __slots__ = ("name", "attrs", "inner", "outer")

    def __init__(self, name: str, attrs: dict[str, str], outer: Tag | None):
        self.name, self.attrs, self.outer = name, attrs, outer
        self.inner: list[Tag | str] = []

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    @property
    def classes(self) -> list[str]:
        return self.get("class").split()

    def walk(self) -> Iterator[Tag]:
        """The elements below, in document order."""
        for x in self.inner:
            if isinstance(x, Tag):
                yield x
                yield from x.walk()

    def tags(self, *names: str) -> Iterator[Tag]:
        return (x for x in self.walk() if x.name in names)

    def texts(self) -> Iterator[str]:
        for x in self.inner:
            if isinstance(x, Tag):
                yield from x.texts()
            else:
                yield x

    def text(self, glue: str = "") -> str:
        return glue.join(self.texts())

    def flat(self) -> str:
        """The text with its pieces set apart and white space as single blanks."""
        return BLANK.sub(" ", self.text(" ").replace("\xa0", " ")).strip()


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def parse(html: str) -> Tag:
    """The tree of a page; ends may be missing, scripts, styles, comments and the head hold nothing."""
    root = Tag("", {}, None)
    at, top, head = 0, root, False
    for found in iter(lambda: TOKEN.search(html, at), None):
        if found.start() > at and not head:
            top.inner.append(unescape(html[at : found.start()]))
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            head = head and name != "head"
            near = top
            while near is not root and near.name != name and not (name in INLINE and near.name not in INLINE or name in ("p", "li") and near.name not in INLINE and near.name not in UNITS):
                near = near.outer
            if near is not root and near.name == name:
                top = near.outer
            continue
        if name in RAW:
            at = RAW[name].search(html, at).end()
            continue
        if name in ("head", "body", "html"):
            head = name == "head"
            if name == "body":
                root.attrs.update(attributes(found[3]))
            continue
        if name in ENDS_PARAGRAPH or name in SIBLINGS:
            closes = ("p",) if name in ENDS_PARAGRAPH else SIBLINGS[name]
            scope, near = SCOPES.get(name, ()), top
            while near is not root:
                if near.name in closes:
                    top = near.outer
                elif near.name in scope or near.name not in INLINE and near.name != "p":
                    break
                near = near.outer
        tag = Tag(name, attributes(found[3]), top)
        top.inner.append(tag)
        if name not in VOID:
            top = tag
    if at < len(html) and not head:
        top.inner.append(unescape(html[at:]))
    return root


def matches(tag: Tag, selector: str) -> bool:
    """Whether an element fits one of some selectors of one step: name, #id, .class, [attribute], with =, *= and ^=, and i for any case."""
    return any(_fits(tag, step.strip()) for step in selector.split(","))


def _fits(tag: Tag, step: str) -> bool:
    found = STEP.match(step)
    if not found or (found[1] and found[1].lower() != tag.name):
        return False
    for key, kind, attribute, test, value, any_case in PART.findall(found[2]):
        if key and tag.get("id") != key or kind and kind not in tag.classes:
            return False
        if attribute:
            own = tag.attrs.get(attribute.lower())
            if own is None:
                return False
            if any_case:
                own, value = own.lower(), value.lower()
            if test == "=" and own != value or test == "*=" and value not in own or test == "^=" and not own.startswith(value):
                return False
    return bool(step)


def select(root: Tag, selector: str) -> Tag | None:
    """The first element that fits; ``body`` is the root itself."""
    return root if selector.strip() == "body" else next((t for t in root.walk() if matches(t, selector)), None)


def prune(root: Tag, selector: str) -> None:
    """Take out the elements that fit, with all in them."""
    root.inner = [x for x in root.inner if not (isinstance(x, Tag) and matches(x, selector))]
    for x in root.inner:
        if isinstance(x, Tag):
            prune(x, selector)
