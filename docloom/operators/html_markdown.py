"""HTML pages to Markdown, in Arrow batches, with counts of what was converted; the links of pages.

A page is pruned of its navigation and cut to a scope; its blocks are rendered in document order.  Text that stands in no block is a
paragraph of its own, lists keep their nesting, tables their empty cells, and code in cells follows its table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrowmap import map_batches
from docloom.functions.dom import Tag, matches, parse, prune, select
from docloom.functions.markup import BLANK, HEADINGS, INLINE
from docloom.functions.urls_plain import embedded, followed

#: Selectors of navigation and of what is never text; where the content is looked for, in this order, if no scope is given or found.
NAVIGATION = "nav, aside, [role='navigation'], [data-testid*='sidenavigation' i], [data-testid*='spacenavigation' i], [data-testid*='side-navigation' i], [data-testid*='sidebar' i], [aria-label*='sidebar' i], [aria-label*='navigation' i]"
NOISE = "script, style, noscript, template"
CONTENT_SCOPES = ("#AkMainContent", "#content-body", "[data-test-id='content-body']", ".ak-renderer-document", "body")
#: Kinds of notes, and what their class, in this order, and label are.
NOTE_KINDS = {"warning": "Warning", "note": "Nota", "tip": "Tip", "info": "Info"}
#: Marks of code blocks and of their lines and line numbers; characters from which code without line breaks is big.
CODE_BLOCK, CODE_LINE, LINE_NUMBER, BIG_CODE = "[data-testid='renderer-code-block'], [data-ds--code--code-block], [class*='code-block' i], [class*='prismjs' i]", "[data-testid^='renderer-code-block-line-']", ".linenumber, .ds-line-number", 60
#: First words of shell commands; patterns of languages by how they look.
SHELL_WORDS = ("kubectl", "aws", "eksctl", "terraform", "helm", "docker", "git", "curl", "wget")
LOOKS = {
    "yaml": re.compile(r"(?m)^\s*(apiVersion|kind|metadata):"),
    "shell": re.compile(rf"\A\s*({'|'.join(SHELL_WORDS)})\b"),
    "hcl": re.compile(r'(?m)^\s*(resource|provider|variable|module)\s+"'),
    "python": re.compile(r"(?m)^\s*(?:(?:def|class|import)\s+\w+)"),
    "sql": re.compile(r"(?mi)^\s*(select|insert|update|delete)\b"),
    "xml": re.compile(r"\A\s*<(?s:.*)</\w+>"),
}


def tidy(text: str) -> str:
    """No-break spaces as blanks, runs of blanks as one, no more than one empty line."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace("\xa0", " "))).strip()


def language_of(code: str) -> str:
    """Language of code by how it looks; empty if unknown."""
    text = code.strip()
    if text[:1] in ("{", "["):
        try:
            json.loads(text)
            return "json"
        except ValueError:
            pass
    return next((name for name, look in LOOKS.items() if text and look.search(text)), "")


def is_code_block(tag: Tag) -> bool:
    return matches(tag, CODE_BLOCK) or tag.name == "code" and "white-space: pre" in tag.get("style").lower()


def is_big(code: str) -> bool:
    return "\n" in code or len(code.strip()) >= BIG_CODE


def code_of(tag: Tag) -> tuple[str, str]:
    """The language a code block names and its text, without line numbers."""
    code = tag if tag.name == "code" else next(tag.tags("code"), None)
    named = next((c[9:] for c in (code.classes if code else ()) if c.startswith("language-")), "") or next((c[9:] for c in tag.classes if c.startswith("language-")), "") or tag.get("data-code-lang").strip()
    lines = [x for x in (code or tag).walk() if matches(x, CODE_LINE)]
    for line in lines:
        prune(line, LINE_NUMBER)
    text = "\n".join(x.text().removesuffix("\n") for x in lines) if lines else (tag if tag.name == "pre" else code or tag).text()
    return named, text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ").strip("\n").rstrip()


def note_kind(tag: Tag) -> str | None:
    """Whether and how an element calls something out: by role, by class, by panel type."""
    if tag.get("role").lower() == "note":
        return "note"
    held = tag.get("class").lower()
    panel = tag.get("data-panel-type").lower().strip()
    return next((kind for kind in NOTE_KINDS if kind in held), panel if panel in NOTE_KINDS else None)


def inline(parts: list[Tag | str]) -> str:
    """Running text: code in back-quotes, links and images with their targets, breaks as lines."""

    def said(x: Tag | str) -> str:
        if isinstance(x, str):
            return BLANK.sub(" ", x.replace("\xa0", " "))
        if x.name == "br":
            return "\n"
        if x.name == "code":
            return f"`{x.text().strip()}`" if x.text().strip() else ""
        if x.name == "img":
            return image(x)
        held = "".join(map(said, x.inner))
        if x.name == "a" and (href := x.get("href")):
            return f"[{held.strip() or href}]({href})"
        return held

    return tidy("\n".join(line.strip() for line in "".join(map(said, parts)).split("\n")))


def image(tag: Tag) -> str:
    source = tag.get("src") or tag.get("data-src")
    return "" if not source or source.startswith("data:") else f"![{tag.get('alt')}]({source})"


def rows_of(table: Tag) -> list[list[Tag]]:
    """Rows of a table's own cells, not of tables in them."""
    found = []

    def look(tag: Tag) -> None:
        for x in tag.inner:
            if isinstance(x, Tag) and x.name == "tr":
                found.append([c for c in x.inner if isinstance(c, Tag) and c.name in ("td", "th")])
            elif isinstance(x, Tag) and x.name in ("thead", "tbody", "tfoot"):
                look(x)

    look(table)
    return [r for r in found if r]


def table_lines(head: list[str], rows: list[list[str]]) -> list[str]:
    """A table in Markdown: every row as wide as the widest, columns numbered where they have no heads."""
    width = max(map(len, [head, *rows]))
    cell = lambda text: text.replace("|", "\\|").replace("\n", "<br>").strip()
    line = lambda cells: "| " + " | ".join(map(cell, cells + [""] * (width - len(cells)))) + " |"
    return [line(head or [f"Col {i + 1}" for i in range(width)]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows)]


class Writer:
    """Renders blocks; one method for each kind of element, and ``stats`` of how many of each were written."""

    def __init__(self):
        self.stats: dict[str, int] = {}
        self.methods: dict[str, Callable[[Tag], Iterator[str]]] = {"pre": self.code, "p": self.paragraph, "ul": self.listing, "ol": self.listing, "blockquote": self.quote, "table": self.table, "img": self.img} | dict.fromkeys(HEADINGS, self.heading)

    def count(self, kind: str) -> None:
        self.stats[kind] = self.stats.get(kind, 0) + 1

    def blocks(self, tag: Tag) -> Iterator[str]:
        run: list[Tag | str] = []
        for x in tag.inner:
            if isinstance(x, str) or x.name in INLINE and x.name != "img" and not is_code_block(x) and not any(y.name in self.methods for y in x.walk()):
                run.append(x)
                continue
            yield from self.loose(run)
            run = []
            if is_code_block(x):
                yield from self.code(x)
            elif x.name == "div" and note_kind(x):
                yield from self.note(x)
            else:
                yield from self.methods.get(x.name, self.blocks)(x)
        yield from self.loose(run)

    def loose(self, run: list[Tag | str]) -> Iterator[str]:
        if text := inline(run):
            self.count("p")
            yield text

    def paragraph(self, tag: Tag) -> Iterator[str]:
        return self.blocks(tag) if any(is_code_block(x) for x in tag.walk()) else self.loose(tag.inner)

    def heading(self, tag: Tag) -> Iterator[str]:
        if text := tag.flat():
            self.count("heading")
            yield f"{'#' * int(tag.name[1])} {text}"

    def code(self, tag: Tag) -> Iterator[str]:
        named, text = code_of(tag)
        if text.strip():
            self.count("code")
            yield f"```{named or language_of(text)}\n{text}\n```"

    def items(self, tag: Tag, depth: int) -> Iterator[str]:
        number = 0
        for item in (x for x in tag.inner if isinstance(x, Tag) and x.name == "li"):
            nested = [x for x in item.inner if isinstance(x, Tag) and x.name in ("ul", "ol")]
            if text := BLANK.sub(" ", inline([x for x in item.inner if x not in nested])):
                number += 1
                yield "  " * depth + (f"{number}. {text}" if tag.name == "ol" else f"- {text}")
            for inner in nested:
                yield from self.items(inner, depth + 1)

    def listing(self, tag: Tag) -> Iterator[str]:
        if lines := list(self.items(tag, 0)):
            self.count("list")
            yield "\n".join(lines)

    def quote(self, tag: Tag) -> Iterator[str]:
        if lines := [line for text in tag.texts() if (line := tidy(text))]:
            self.count("quote")
            yield "\n".join(f"> {line}" for line in lines)

    def note(self, tag: Tag) -> Iterator[str]:
        if lines := [line for block in Writer().blocks(tag) for line in block.split("\n") if line.strip()]:
            self.count("note")
            yield "\n".join([f"> **{NOTE_KINDS[note_kind(tag)]}:**", *(f"> {line}" for line in lines)])

    def table(self, tag: Tag) -> Iterator[str]:
        rows = rows_of(tag)
        if not rows:
            return
        texts = [[c.flat() for c in row] for row in rows]
        # the first row heads the columns if all of it are heads; a head at a row's start is one of its cells
        has_head = all(c.name == "th" for c in rows[0])
        self.count("table")
        yield "\n".join(table_lines(texts[0] if has_head else [], [t for t in texts[has_head:] if not (has_head and t == texts[0])]))
        found = []
        for r, row in enumerate(rows):
            for c, cell in enumerate(row):
                inside: set[int] = set()
                for x in cell.walk():
                    if id(x) not in inside and (is_code_block(x) or x.name == "code" and is_big(x.text().strip("\n"))):
                        inside.update(id(y) for y in x.walk())
                        found.append((r, c, x))
        if found:
            yield "> Table embedded code blocks:"
        for r, c, x in found:
            yield f"**(table r{r} c{c})**"
            yield from self.code(x)

    def img(self, tag: Tag) -> Iterator[str]:
        if text := image(tag):
            self.count("img")
            yield text


def absolute(tag: Tag, base: str) -> None:
    """Targets of links and images against the page's own URL; what can't be joined stays as it is."""
    for x in tag.tags("a", "img"):
        for name in ("href", "src", "data-src"):
            if x.get(name) and base:
                try:
                    x.attrs[name] = urljoin(base, x.get(name))
                except ValueError:
                    pass


def to_markdown(html: str, title: str | None, url: str | None = None, scopes: tuple[str, ...] = ()) -> tuple[str, dict[str, int], str]:
    """Markdown of a page under its title, counts of what it holds, and the scope that was used."""
    root = parse(html)
    prune(root, NAVIGATION)
    prune(root, NOISE)
    found = ((s, select(root, s)) for s in (*scopes, *CONTENT_SCOPES))
    name, scope = next(((s, tag) for s, tag in found if tag is not None), ("document", root))
    absolute(scope, url or "")
    writer = Writer()
    parts = [f"# {(title or 'Untitled').strip()}", *writer.blocks(scope)]
    return "\n\n".join(parts).strip() + "\n", writer.stats, name


def best_source(fetches: DataFrame) -> DataFrame:
    """(fetch_id, html_source, html, title, page_url): of each fetch the export view if it has text, then that by URL, then the page; null if none has."""
    order = [("export_view", "export_view_html"), ("url_export_view", "url_export_view_html"), ("page", "page_html")]
    have = [(name, F.nullif(F.col(c), F.lit(""))) for name, c in order if c in fetches.columns]
    source = F.coalesce(*(F.when(x.isNotNull(), F.lit(name)) for name, x in have))
    url = F.col("page_url") if "page_url" in fetches.columns else F.lit(None).cast("string")
    return fetches.dropDuplicates(["fetch_id"]).select("fetch_id", source.alias("html_source"), F.coalesce(*(x for _, x in have)).alias("html"), "title", url.alias("page_url"))


def convert(fetches: DataFrame, scopes: tuple[str, ...] = ()) -> DataFrame:
    """(fetch_id, html_source, markdown, scope_used, stats) of every fetch with text."""
    kind = fetches.schema["fetch_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [to_markdown(h, t, u, scopes) for h, t, u in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            texts, stats, used = zip(*made)
            maps = pa.array([list(s.items()) for s in stats], pa.map_(pa.string(), pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(used, pa.string()), maps], names=["fetch_id", "html_source", "markdown", "scope_used", "stats"])

        return step

    return map_batches(best_source(fetches).where("html is not null"), make, f"fetch_id {kind}, html_source string, markdown string, scope_used string, stats map<string,int>")


#: Where links are looked for first, and where else if there are too few.
LINK_SCOPE, LINK_FALLBACKS = "#AkMainContent", ("#content-body", ".ak-renderer-document", "main", "body")


def page_hrefs(html: str, scope: str = LINK_SCOPE, fallbacks: tuple[str, ...] = LINK_FALLBACKS, least: int = 3, embedded_links: bool = True) -> list[str]:
    """Targets of a page's links in order, each once: those in the scope outside navigation; with fewer than ``least`` also those in all fallbacks and in embedded JSON."""
    root = parse(html)
    prune(root, "nav, aside, [role='navigation']")

    def inside(selector: str) -> list[str]:
        held = select(root, selector)
        return [a.get("href") for a in held.tags("a") if a.get("href")] if held is not None else []

    found = inside(scope)
    if len(found) < least:
        for selector in fallbacks:
            found += inside(selector)
        if embedded_links:
            found += embedded(html)
    return list(dict.fromkeys(found))


def links(fetches: DataFrame, least: int = 3, typos: dict[str, str] | None = None) -> DataFrame:
    """(fetch_id, place, href): absolute links of each page in their order; ``typos`` are replaced in them first."""
    kind = fetches.schema["fetch_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            keys, places, found = [], [], []
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                seen: dict[str, None] = {}
                for href in page_hrefs(html, least=least):
                    for wrong, right in (typos or {}).items():
                        href = href.replace(wrong, right)
                    if followed(href):
                        try:
                            seen.setdefault(urljoin(url or "", href))
                        except ValueError:
                            continue
                keys += [key] * len(seen)
                places += range(len(seen))
                found += seen
            return pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(places, pa.int32()), pa.array(found, pa.string())], names=["fetch_id", "place", "href"]) if keys else None

        return step

    rows = fetches.where("page_html <> ''").select("fetch_id", "page_url", "page_html")
    return map_batches(rows, make, f"fetch_id {kind}, place int, href string").dropDuplicates(["fetch_id", "href"])
