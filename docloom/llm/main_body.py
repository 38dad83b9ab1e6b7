"""Problem 3: the main body of each page, by wrappers inferred from the pages of its host.

1. Every page is read once; each task folds its pages into one partial wrapper per host and field (see ``wrapper``) and lists
   the hashes of the paragraphs of what looks like a body, and the blocks of text that models of language are fitted on (see ``residue``).  This is written once.
2. Partial wrappers are folded per host, first in SALTS groups a host and then together.  Paragraphs are counted by distinct page;
   those on at least LEAST_PAGES pages and SHARE of the host's pages are constants of the template, as are short ones that recur on several hosts.
3. Wrappers, small, are broadcast, or joined to the pages by host; every page is read again and matched with its host's wrapper, which tells
   what each of its containers is.

The body is the container at a place of the wrapper where titles stand, a first heading that varies from page to page; without one on
the page, that place of it with the most prose that varies.  A place that holds little but titles gives the title, and the place of most prose
the body.  Main are the pieces of the body from its title on, but for constant paragraphs, and those of containers in it whose place
holds text.  A field that is null, empty or without text has no pieces.  Repeated rows are read once by fetch_id in the results.  Hosts
are taken from page_url; pages without one share the empty host.  All pages count for wrappers and constants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrowmap import map_batches
from docloom.functions.markup import BLANK, HEADINGS, NUMBER, Element, Piece, pieces
from docloom.llm.repeated_lines import site_of
from docloom.llm.wrapper import LEAST_PROSE, Node, dump, grouped, load, match
from docloom.session import checkpointed, written

FIELDS = ("page_html", "export_view_html")
LEAST_PAGES, SHARE = 3, 0.08
#: Groups a host's partial wrappers are folded in first; bytes of all wrappers up to which they are broadcast; wrappers a task holds at once.
SALTS, BROADCAST_BYTES, HOSTS_AT_ONCE = 32, 32 << 20, 2000
#: Units after which a task hands over the counts of its wrappers' texts.
TEXTS_AT_ONCE = 200_000
#: Blocks of long bodies that models are fitted on have at least so many characters, and so have long bodies.
BLOCK_CHARS, LONG_BODY = 40, 1500
#: Short paragraphs that recur on at least LEAST_HOSTS hosts and HOST_SHARE of all hosts are constants everywhere; on a host
#: recurs what is on at least RECUR_PAGES of its pages and RECUR_SHARE of them.
SHORT, LEAST_HOSTS, HOST_SHARE, RECUR_PAGES, RECUR_SHARE = 60, 3, 0.05, 2, 0.01
#: A place of titles with fewer other characters a page than this only holds the title.
TITLE_ONLY = 40


#: Texts whose hashes a process remembers: links and notices come on every page.  Blocks that a task remembers to have sent.
REMEMBERED, SENT = 200_000, 50_000
_hashes: dict[str, int] = {}


def hashed(text: str) -> int:
    """A 62-bit hash of a text without regard to case and blanks, and in short texts to the values of numbers."""
    if (own := _hashes.get(text)) is None:
        if len(_hashes) > REMEMBERED:
            _hashes.clear()
        plain = BLANK.sub(" ", text).strip()
        if len(plain) <= SHORT:
            plain = NUMBER.sub("#", plain)
        own = int.from_bytes(blake2b(plain.lower().encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 2
        if len(text) <= 2 * SHORT:
            _hashes[text] = own
    return own


def plain(text: str) -> str:
    """A text without regard to case, blanks and the values of numbers: texts alike in these have the same n-grams."""
    return BLANK.sub(" ", NUMBER.sub("0", text)).strip().lower()


class Unit:
    """A unit of a page with its pieces."""

    __slots__ = ("container", "tag", "pieces", "links", "found")

    def __init__(self, first: Piece):
        self.container, self.tag, self.pieces, self.links, self.found = first.container, first.unit.tag, [first], None, None

    def all_links(self) -> bool:
        """Whether it is nothing but links, with marks between them."""
        if self.links is None:
            self.links = any(p.element.link for p in self.pieces) and all(p.element.link or len(p.text.strip()) < 3 for p in self.pieces)
        return self.links

    def keys(self) -> list[int]:
        """What is looked up among the constants: the text, or that of each link."""
        if self.found is None:
            self.found = [hashed(p.text) for p in self.pieces if p.element.link] if self.all_links() else [hashed(" ".join(p.text for p in self.pieces))]
        return self.found


def units_of(html: str) -> list[Unit]:
    out: list[Unit] = []
    last = None
    for piece in pieces(html):
        if piece.unit is last and piece.container is out[-1].container:
            out[-1].pieces.append(piece)
        else:
            out.append(Unit(piece))
            last = piece.unit
    return out


class Page:
    """A page's units, and its tree of containers; ``sums`` fills in what their slots hold."""

    def __init__(self, units: list[Unit]):
        self.units = units
        self.root = Node("")
        self.nodes: dict[Element, Node] = {}
        for unit in units:
            self.node(unit.container)
        self.summed = False

    def sums(self) -> Page:
        if self.summed:
            return self
        self.summed = True
        for unit in self.units:
            node, block = self.nodes[unit.container], None
            for p in unit.pieces:
                size = len(p.text)
                node.chars += size
                if p.element.link:
                    node.links += size
                if p.element.block is not block:
                    block = p.element.block
                    node.blocks += 1
            # the first piece stands for a unit's text
            key = hashed(unit.pieces[0].text)
            node.texts[key] = node.texts.get(key, 0) + 1
            if unit.tag == "h1":
                node.titles = 1
                # numbers count here: titles may differ in nothing else
                key = int.from_bytes(blake2b(" ".join(p.text for p in unit.pieces).encode("utf-8", "replace"), digest_size=5).digest(), "big")
                node.heads[key] = node.heads.get(key, 0) + 1
        return self

    def node(self, container: Element) -> Node:
        if (node := self.nodes.get(container)) is None:
            if container.outer is None:
                node = self.root
            else:
                node = Node(container.sign)
                self.node(container.outer).inner.append(node)
            self.nodes[container] = node
        return node

    def wrapper(self) -> Node:
        """The page as a wrapper of its own; uses the tree up."""

        def fold(node: Node) -> Node:
            node.inner = grouped([fold(n) for n in node.inner])
            return node

        return fold(self.root)


def within(container: Element, outer: Element) -> bool:
    while container is not None:
        if container is outer:
            return True
        container = container.outer
    return False


def likely_bodies(units: list[Unit]) -> list[Element]:
    """What looks like the body of a page by itself: the container of its first heading, and that of most text that is no link."""
    sums: dict[Element, int] = {}
    for unit in units:
        sums[unit.container] = sums.get(unit.container, 0) + sum(len(p.text) for p in unit.pieces if not p.element.link)
    titled = next((u.container for u in units if u.tag == "h1"), None)
    most = max(sums, key=sums.get)
    return [most] if titled is None or titled is most else [titled, most]


PLAIN = frozenset(("p", "div", "span", "a", "b", "strong", "em", "i", "small", "section", "td", ""))


class Matched:
    """A page matched with the wrapper of its host: its body, the title outside it, and the containers of text."""

    def __init__(self, units: list[Unit], wrapper: Node | None):
        page = Page(units)
        pairs: list[tuple[Node, Node | None]] = []
        match(page.root, wrapper, pairs)
        if any(w is None for _, w in pairs):
            page.sums()  # places the wrapper hasn't are judged by the page alone
        own = {id(n): w or n for n, w in pairs}
        self.place = {c: own[id(n)] for c, n in page.nodes.items()}
        self.body, self.title = None, None
        titled = [u.container for u in units if u.tag == "h1" and self.place[u.container].is_title()]
        most, prose = None, LEAST_PROSE
        for container in self.place:
            if container.tag != "noscript" and (much := self.place[container].prose()) >= prose and (most is None or much > prose):
                most, prose = container, much
        if titled:
            self.body = titled[0]
            place = self.place[self.body]
            if most is not None and most is not self.body and place.chars - place.links < TITLE_ONLY * place.pages + 1.5 * self.head_chars(units):
                self.title, self.body = self.body, most
        else:
            place = next((c for c in self.place if self.place[c].is_title() and self.place[c].prose() >= LEAST_PROSE), None)
            self.body = place if place is not None else most

    def head_chars(self, units: list[Unit]) -> float:
        place = self.place[self.body]
        return place.pages * sum(len(p.text) for u in units if u.tag == "h1" and u.container is self.body for p in u.pieces)


def main_units(units: list[Unit], wrapper: Node | None, constants: Constants, kept: Callable[[str], bool] = lambda _: False) -> list[Unit]:
    """The units of the main body, in order; a constant that is ``kept`` (a leftover of a template, say) is text all the same."""
    if not units:
        return []
    found = Matched(units, wrapper)
    body = found.body
    if body is None:
        return []
    titled = any(u.tag == "h1" and u.container is body for u in units)
    out, open_ = [], not titled
    inside: dict[Element, bool] = {}
    for unit in units:
        if unit.container is body:
            if unit.tag == "h1":
                open_ = True
            if not open_:
                continue
            if unit.tag in PLAIN and constants.has(unit, kept):
                continue
            out.append(unit)
        elif unit.container is found.title:
            if unit.tag == "h1":
                out.append(unit)
        elif open_:
            if (text := inside.get(unit.container)) is None:
                text = inside[unit.container] = unit.container.tag != "noscript" and found.place[unit.container].is_text() and within(unit.container, body)
            if text:
                out.append(unit)
    return out


class Survey:
    """What a task finds on its pages: rows (host, field, kind, key, page, wrapper).

    Kind 0 are pages, 1 and 4 long and short paragraphs of bodies (``wrapper`` says whether of a long one), 2 partial wrappers, 3 all blocks that models are fitted on (``text``), of which ``page`` is
    the place: long bodies (0), short ones (1), what is outside bodies (2).  Wrappers come once a task; a block that comes often may come more than once.
    Kind 5 are the texts of the wrappers' nodes (``texts`` and ``counts``; ``key`` is a number of the node).
    """

    KINDS = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def __init__(self, numbers: Iterator[int]):
        self.numbers, self.held = numbers, 0
        self.wrappers: dict[tuple[str, str], Node] = {}
        self.noted: list[tuple[int, int, str]] = []
        self.sent: set[tuple[int, int, str]] = set()

    def note(self, place: int, unit: Unit) -> None:
        """List a block of a place, plain, that wasn't met lately."""
        text = " ".join(p.text for p in unit.pieces)
        own = place, hashed(text) if place == 1 else 0, plain(text)
        if own not in self.sent:
            self.sent.add(own)
            self.noted.append(own)

    def read(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[tuple, None] = {}
        hosts, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for column, field in enumerate(batch.schema.names[2:], 2):
            for host, page, html in zip(hosts, pages, batch.column(column).to_pylist()):
                if not html:
                    continue
                units = units_of(html)
                if not units:
                    continue
                key = (host, field)
                self.held += len(units)
                rows[host, field, 0, 0, page, None] = None
                own = Page(units).sums().wrapper()
                if key in self.wrappers:
                    self.wrappers[key].absorb(own, False)
                else:
                    self.wrappers[key] = own
                self.paragraphs(units, key, page, rows)
        out = [(*row, None, None, None) for row in rows] + [("", FIELDS[0], 3, k, place, None, text, None, None) for place, k, text in self.noted]
        if self.held > TEXTS_AT_ONCE:
            out += self.texts()
        self.noted.clear()
        if len(self.sent) > SENT:
            self.sent.clear()
        return self.batch(out)

    def paragraphs(self, units: list[Unit], key: tuple[str, str], page: int, rows: dict[tuple, None]) -> None:
        bodies = likely_bodies(units)
        titled = next((u for u in units if u.tag == "h1"), None)
        short_body = sum(len(p.text) for u in units if u.container in bodies for p in u.pieces) < LONG_BODY
        open_ = titled is None
        for unit in units:
            open_ |= unit is titled
            size = sum(len(p.text) for p in unit.pieces)
            if unit.container not in bodies:
                if key[1] == FIELDS[0] and unit.container.tag != "noscript":
                    self.note(2, unit)
                continue
            if (open_ or unit.container is not titled.container) and unit.tag in PLAIN:
                for k in unit.keys():
                    rows[(*key, 4 if size <= SHORT else 1, k, page, "short" if short_body else "long")] = None
            if open_ and key[1] == FIELDS[0] and unit.tag not in HEADINGS and (short_body or size >= BLOCK_CHARS):
                self.note(int(short_body), unit)

    def rest(self) -> pa.RecordBatch:
        texts = self.texts()  # these number the nodes
        return self.batch(texts + [(host, field, 2, k, 0, dump(node), None, None, None) for k, ((host, field), node) in enumerate(self.wrappers.items())])

    def texts(self) -> list[tuple]:
        self.held = 0
        return [(host, field, 5, number, 0, None, None, list(own), list(own.values())) for (host, field), node in self.wrappers.items() for number, own in node.listed(self.numbers)]

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(self.KINDS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, self.KINDS)], names=["host", "field", "kind", "key", "page", "wrapper", "text", "texts", "counts"])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    numbers = count((context.partitionId() if context else 0) << 32)
    task = Survey(numbers)
    for batch in batches:
        yield task.read(batch)
        if len(task.wrappers) > HOSTS_AT_ONCE:
            yield task.rest()
            task = Survey(numbers)
    yield task.rest()


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    whole: Node | None = None
    for source in group["wrapper"].sort_values():
        own = load(source)
        if whole is None:
            whole = own
        else:
            whole.absorb(own, False)
    first = group.iloc[0]
    return pd.DataFrame({"host": [first["host"]], "field": [first["field"]], "wrapper": [dump(whole)]})


def host_key(url: str = "page_url") -> Column:
    return F.coalesce(site_of(url), F.lit(""))


def survey(fetches: DataFrame, fields: tuple[str, ...] = FIELDS) -> tuple[str, DataFrame]:
    """What all tasks find, as a written table with its path; the blocks are a column of their own, so that only those who ask for them read them."""
    rows = fetches.select(host_key().alias("host"), F.xxhash64("page_url").alias("page"), *fields).where(" or ".join(f"{f} <> ''" for f in fields))
    return written(rows.mapInArrow(_survey, "host string, field string, kind int, key bigint, page bigint, wrapper string, text string, texts array<bigint>, counts array<bigint>"))


#: Pages with long bodies for one with a short one, and at least, from which a constant is furniture and no leftover.
FURNITURE_RATIO, FURNITURE_PAGES = 4, 3


def constants(surveyed: DataFrame) -> DataFrame:
    """(host, field, key, furniture): hashes of the paragraphs that belong to the template; a text met once here and there does not.

    Those that far more long bodies than short ones have, on all hosts, are furniture; others may be what an unfilled template left.
    """
    pages = surveyed.where("kind = 0").select("host", "field", "page").distinct().groupBy("host", "field").agg(F.count("*").alias("pages"))
    met = surveyed.where("kind in (1, 4)").groupBy("host", "field", "key", "page").agg(F.max("kind").alias("kind"), F.max((F.col("wrapper") == "long").cast("int")).alias("long"))
    seen = met.groupBy("host", "field", "key").agg(F.count("*").alias("n"), F.max("kind").alias("kind"), F.sum("long").alias("long"))
    seen = checkpointed(seen.join(pages, ["host", "field"]))
    often = seen.where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= F.col("pages") * SHARE)).select("host", "field", "key")
    # short paragraphs that recur on several hosts, on the hosts that have them
    hosts = pages.agg(F.countDistinct("host").alias("hosts"))
    recur = seen.where((F.col("kind") == 4) & (F.col("n") >= RECUR_PAGES) & (F.col("n") >= F.col("pages") * RECUR_SHARE))
    many = recur.groupBy("key").agg(F.countDistinct("host").alias("n")).join(F.broadcast(hosts)).where((F.col("n") >= LEAST_HOSTS) & (F.col("n") >= F.col("hosts") * HOST_SHARE)).select("key")
    common = seen.where("kind = 4").join(many, "key", "left_semi").select("host", "field", "key")
    found = often.unionByName(common).distinct()
    sums = seen.join(found.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"), F.sum("long").alias("long"))
    furniture = (F.col("long") >= FURNITURE_PAGES) & (F.col("long") >= FURNITURE_RATIO * (F.col("n") - F.col("long")))
    return found.join(sums.select("key", F.coalesce(furniture, F.lit(False)).alias("furniture")), "key").select("host", "field", "key", "furniture")


def _numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [(host, field, number, node.numbers[0]) for host, field, source in zip(*(c.to_pylist() for c in batch.columns)) for node in load(source).nodes() for number in node.numbers]
    columns = zip(*rows) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["host", "field", "number", "node"])


def recurrence(surveyed: DataFrame, folded: DataFrame) -> DataFrame:
    """(host, field, node, held, again): how many texts the pages of a host hold at each node of its wrapper, named by its first number, and how many of these come more than once; all are counted."""
    nodes = map_batches(folded.select("host", "field", "wrapper"), lambda: _numbered, "host string, field string, number bigint, node bigint")
    listed = surveyed.where("kind = 5").select(F.col("key").alias("number"), "texts", "counts").join(nodes.select("number", "node"), "number")
    texts = listed.select("node", F.explode(F.arrays_zip("texts", "counts")).alias("t")).groupBy("node", F.col("t.texts").alias("text")).agg(F.sum("t.counts").alias("n"))
    sums = texts.groupBy("node").agg(F.sum("n").alias("held"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"))
    return sums.join(nodes.where("number = node").select("host", "field", "node"), "node").select("host", "field", "node", "held", "again")


def _filled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The wrappers with the sums of their nodes in place of their numbers."""
    out = []
    for source, sums in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        whole, known = load(source), {s["node"]: s for s in sums or ()}
        for node in whole.nodes():
            if node.numbers:
                node.held, node.again = known[node.numbers[0]]["held"], known[node.numbers[0]]["again"]
                node.numbers = []
        out.append(dump(whole))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["host", "field", "wrapper"])


def wrappers(surveyed: DataFrame) -> DataFrame:
    """(host, field, wrapper, constants): the wrapper of each host and field, and the hashes of its constant paragraphs, negative for furniture."""
    schema = "host string, field string, wrapper string"
    partial = surveyed.where("kind = 2").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    folded = checkpointed(partial.groupBy("host", "field", "salt").applyInPandas(_fold, schema).groupBy("host", "field").applyInPandas(_fold, schema))
    summed = recurrence(surveyed, folded).groupBy("host", "field").agg(F.collect_list(F.struct("node", "held", "again")).alias("sums"))
    folded = map_batches(folded.join(summed, ["host", "field"], "left").select("host", "field", "wrapper", "sums"), lambda: _filled, schema)
    listed = constants(surveyed).select("host", "field", F.when(F.col("furniture"), -F.col("key") - 1).otherwise(F.col("key")).alias("key"))
    return folded.join(listed.groupBy("host", "field").agg(F.collect_list("key").alias("constants")), ["host", "field"], "left")


class Constants:
    """The constants of a host and field: all their hashes, and those of furniture."""

    def __init__(self, listed: list[int] | None = None):
        every = listed if listed is not None else ()
        self.furniture = frozenset(-k - 1 for k in every if k < 0)
        self.all = self.furniture.union(k for k in every if k >= 0)

    def has(self, unit: Unit, kept: Callable[[str], bool]) -> bool:
        """Whether a unit is of the template: most of its keys are constants, and it is furniture or not a leftover that is ``kept``."""
        keys = unit.keys()
        if sum(k in self.all for k in keys) * 2 < len(keys):
            return False
        return unit.tag != "p" or any(k in self.furniture for k in keys) or not kept(" ".join(p.text for p in unit.pieces))


class Reader:
    """Finds the wrapper and constants of a host and field; keeps what it parsed of hosts met."""

    def __init__(self, every: dict | None = None):
        self.every = every
        self.known: dict = {}

    def find(self, host: str, field: str, wrapper: str | None = None, constants: list[int] | None = None) -> tuple[Node | None, Constants]:
        if (out := self.known.get((host, field))) is None:
            if len(self.known) > 2000:
                self.known.clear()
            if self.every is not None:
                wrapper, constants = self.every.get((host, field), (None, None))
            out = self.known[host, field] = load(wrapper) if wrapper else None, Constants(constants)
        return out


def map_pages(fetches: DataFrame, found: DataFrame, make: Callable, schema: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Run ``make(find)`` over batches of (fetch_id, host, page_html, export_view_html), with a function find(row, field) of its wrapper and constants.

    Wrappers of up to BROADCAST_BYTES are broadcast once to each executor, beyond that they are joined to the pages by host.
    """
    found = checkpointed(found)
    spark = fetches.sparkSession
    rows = fetches.select("fetch_id", host_key().alias("host"), *(F.col(f) if f in fields else F.lit(None).cast("string").alias(f) for f in FIELDS))
    size = found.agg(F.sum(F.length("wrapper") + 8 * F.greatest(F.coalesce(F.size("constants"), F.lit(0)), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        every = spark.sparkContext.broadcast({(r[0], r[1]): (r[2], r[3]) for r in found.select("host", "field", "wrapper", "constants").collect()})

        def local():
            reader = Reader(every.value)
            return make(lambda row, field: reader.find(row[1], field))

        return map_batches(rows, local, schema)
    wide = found.groupBy("host").agg(*(F.first(F.when(F.col("field") == f, F.col(c)), ignorenulls=True).alias(f"{f}_{c}") for f in fields for c in ("wrapper", "constants")))

    def joined():
        reader = Reader()
        return make(lambda row, field: reader.find(row[1], field, *row[4 + 2 * fields.index(field) : 6 + 2 * fields.index(field)]))

    return map_batches(rows.join(wide, "host", "left").select(*rows.columns, *(f"{f}_{c}" for f in fields for c in ("wrapper", "constants"))), joined, schema)
