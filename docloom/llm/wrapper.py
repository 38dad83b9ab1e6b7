"""Union-free wrappers of the pages of one host: inferred by alignment, and matched with a page.

A page is a tree of containers (see ``functions.markup``), each with the text it holds itself: its slot.  A wrapper is a union-free expression
over such trees: under each node a list of nodes in order, some repeated (siblings that come again are one group), some
optional (not on every page).  Two wrappers are aligned level by level by the longest common subsequence of names; what only one
has becomes optional; nodes that match are merged, and so are their slots.  A slot keeps sums and the counts of its texts.  Those of many pages are
too many to go with the wrapper: they are listed apart under a number of the node, which then keeps the numbers of all nodes merged into it, so that
all texts can be counted by node of the whole wrapper (see ``main_body.wrappers``); ``held`` and ``again`` are what comes of that.

Nodes of one name at different places stay apart: it is the place in the expression that tells a teaser before the body from a
call-out of the same mark-up in it.  Where a level has more than MOST_NODES nodes, as where names are made up for each page, the
rarest are generalised to any name of their tag; nothing of them is lost but the name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import nsmallest

#: As many different titles vary at any number of pages; up to them they are counted, and more aren't told apart.
VARIETY, MOST_NODES = 16, 120
#: A container inside the body is text if at most this share of it is links and recurring texts, and if its blocks are long.
LINK_SHARE, RECURRING, BLOCK_CHARS = 0.35, 0.5, 38
#: Share of pages on which a node holds a first heading, and of distinct texts among those, from which it is a place of titles.
TITLED, VARIED = 0.2, 0.3
#: Characters of varying prose a page from which a node without titles may be a body.
LEAST_PROSE = 60


class Node:
    """One node of a wrapper: pages that have it and repeat it; sums over its slot; counts of its texts, if they aren't listed apart, and of titles; its numbers, and
    how many texts all its pages hold and how many of these came again; the nodes in it in order, and those of any name by tag."""

    __slots__ = ("name", "pages", "repeated", "titles", "blocks", "chars", "links", "texts", "heads", "numbers", "held", "again", "inner", "other")

    def __init__(self, name: str, pages=1, repeated=0, titles=0, blocks=0, chars=0, links=0, heads=None, numbers=None, held=0, again=0, inner=None, other=None):
        self.name, self.pages, self.repeated, self.titles = name, pages, repeated, titles
        self.blocks, self.chars, self.links = blocks, chars, links
        self.texts: dict[int, int] = {}
        self.numbers: list[int] = numbers or []
        self.held, self.again = held, again
        self.heads: dict[int, int] = heads or {}
        self.inner: list[Node] = inner or []
        self.other: dict[str, Node] = other or {}

    def dump(self) -> list:
        pairs = lambda x: [v for pair in x.items() for v in pair]
        return [self.name, self.pages, self.repeated, self.titles, self.blocks, self.chars, self.links, pairs(bottom(self.heads)), self.numbers, self.held, self.again, [n.dump() for n in self.inner], [n.dump() for n in self.other.values()]]

    @staticmethod
    def load(x: list) -> Node:
        pairs = lambda v: dict(zip(v[::2], v[1::2]))
        return Node(*x[:7], pairs(x[7]), *x[8:11], [Node.load(n) for n in x[11]], {n[0]: Node.load(n) for n in x[12]})

    def nodes(self) -> Iterator[Node]:
        """This node and all in it."""
        yield self
        for node in (*self.inner, *self.other.values()):
            yield from node.nodes()

    def listed(self, numbers: Iterator[int]) -> Iterator[tuple[int, dict[int, int]]]:
        """Hand over the counts of texts of all nodes, each with a number of its node."""
        for node in self.nodes():
            if node.texts:
                if not node.numbers:
                    node.numbers = [next(numbers)]
                yield node.numbers[0], node.texts
                node.texts = {}

    def absorb(self, other: Node, same_page: bool) -> None:
        if same_page:
            self.repeated, self.titles = 1, max(self.titles, other.titles)
        else:
            self.pages, self.repeated, self.titles = self.pages + other.pages, self.repeated + other.repeated, self.titles + other.titles
        self.blocks, self.chars, self.links = self.blocks + other.blocks, self.chars + other.chars, self.links + other.links
        for key, n in other.texts.items():
            self.texts[key] = self.texts.get(key, 0) + n
        self.numbers = self.numbers + other.numbers
        self.heads = joined(self.heads, other.heads)
        for tag, node in other.other.items():
            self.generalise(node, tag, same_page)
        self.inner = align(self.inner, other.inner, same_page)
        if len(self.inner) > MOST_NODES:
            rare = sorted(range(len(self.inner)), key=lambda i: (self.inner[i].pages, self.inner[i].name, i))[: len(self.inner) - MOST_NODES // 2]
            for i in rare:
                self.generalise(self.inner[i], tag_of(self.inner[i].name), False)
            gone = set(rare)
            self.inner = [n for i, n in enumerate(self.inner) if i not in gone]

    def generalise(self, node: Node, tag: str, same_page: bool) -> None:
        if (known := self.other.get(tag)) is None:
            node.name = tag
            self.other[tag] = node
        else:
            known.absorb(node, same_page)

    # --- what the sums say ---------------------------------------------------------------------------------------------

    def recurring(self) -> float:
        """Share of the slot's texts, over all pages, that come more than once."""
        held, again = (self.held, self.again) if self.held else (sum(self.texts.values()), sum(c for c in self.texts.values() if c > 1))
        return again / held if held else 0.0

    def prose(self) -> float:
        """Characters a page of text that varies and is no link."""
        return (self.chars - self.links) * (1 - self.recurring()) / self.pages

    def is_title(self) -> bool:
        """Whether titles stand here: first headings on enough pages, and not the same on all (the site's name)."""
        counts = bottom(self.heads).values()
        held = sum(counts)
        return self.titles >= TITLED * self.pages and held > 0 and len(counts) >= (VARIED * min(held, VARIETY) if held > 1 else 1)

    def is_text(self) -> bool:
        return self.links <= LINK_SHARE * self.chars and self.chars >= BLOCK_CHARS * self.blocks and self.recurring() <= RECURRING


def tag_of(name: str) -> str:
    return name.partition("[")[0]


def bottom(counts: dict[int, int]) -> dict[int, int]:
    """The VARIETY smallest hashes with their counts: all, unless there are more."""
    return counts if len(counts) <= VARIETY else {k: counts[k] for k in nsmallest(VARIETY, counts)}


def joined(a: dict[int, int], b: dict[int, int]) -> dict[int, int]:
    """Counts of both, of the smallest hashes: the same for any order of merging, as what is left out has VARIETY smaller ones.  ``a`` is used up."""
    for key, n in b.items():
        a[key] = a.get(key, 0) + n
    return a if len(a) <= 4 * VARIETY else bottom(a)


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists of names."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    out = [(i, i) for i in range(head)]
    common = set(x).intersection(y)
    if common:
        at, bt = [i for i, n in enumerate(x) if n in common], [j for j, n in enumerate(y) if n in common]
        rows, columns = len(at), len(bt)
        best = [[0] * (columns + 1) for _ in range(rows + 1)]
        for i in range(rows - 1, -1, -1):
            own, below, name = best[i], best[i + 1], x[at[i]]
            for j in range(columns - 1, -1, -1):
                own[j] = below[j + 1] + 1 if name == y[bt[j]] else below[j] if below[j] >= own[j + 1] else own[j + 1]
        i = j = 0
        while i < rows and j < columns:
            if x[at[i]] == y[bt[j]]:
                out.append((head + at[i], head + bt[j]))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def align(a: list[Node], b: list[Node], same_page: bool = False) -> list[Node]:
    """The nodes of both in order: matched ones merged, the others optional.  ``a`` and ``b`` are used up."""
    if not a or not b:
        return a or b
    out, i, j = [], 0, 0
    for x, y in matched([n.name for n in a], [n.name for n in b]):
        out += a[i:x] + b[j:y]
        a[x].absorb(b[y], same_page)
        out.append(a[x])
        i, j = x + 1, y + 1
    return out + a[i:] + b[j:]


def grouped(nodes: list[Node]) -> list[Node]:
    """Siblings of a page with runs of one or two names that come again at once made one repeated group."""
    for width in (1, 2):
        out: list[Node] = []
        for node in nodes:
            out.append(node)
            while len(out) >= 2 * width and [n.name for n in out[-width:]] == [n.name for n in out[-2 * width : -width]]:
                for head, again in zip(out[-2 * width : -width], out[-width:]):
                    head.absorb(again, True)
                del out[-width:]
        nodes = out
    return nodes


def match(page: Node, wrapper: Node, pairs: list[tuple[Node, Node | None]]) -> None:
    """Walk a page's tree along a wrapper: ``pairs`` gets each of the page's nodes with that of the wrapper in its place, or None."""
    pairs.append((page, wrapper))
    names = []
    for k, node in enumerate(page.inner):
        if not k or node.name != names[-1]:
            names.append(node.name)
    # a run of equal siblings stands for one repeated group
    place = dict((j, wrapper.inner[i]) for i, j in matched([n.name for n in wrapper.inner], names)) if wrapper else {}
    run = -1
    for k, node in enumerate(page.inner):
        if not k or node.name != page.inner[k - 1].name:
            run += 1
        own = place.get(run)
        if own is None and wrapper:
            own = wrapper.other.get(tag_of(node.name))
            if own is None:
                # a repeated group of several names: any node of that name at this level, if there is but one
                same = [n for n in wrapper.inner if n.name == node.name]
                own = same[0] if len(same) == 1 else None
        if own is None:
            unmatched(node, pairs)
        else:
            match(node, own, pairs)


def unmatched(node: Node, pairs: list[tuple[Node, Node | None]]) -> None:
    pairs.append((node, None))
    for inner in node.inner:
        unmatched(inner, pairs)


def dump(node: Node) -> str:
    return json.dumps(node.dump(), separators=(",", ":"), ensure_ascii=False)


def load(source: str) -> Node:
    return Node.load(json.loads(source))
