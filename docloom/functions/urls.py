"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import col


def stripped(url: str | Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(col(url), r"[?#][\s\S]*$", "")


def normal(url: str | Column) -> Column:
    """Stripped, trimmed and without slashes at the end."""
    return F.regexp_replace(F.trim(stripped(url)), r"/+$", "")


def authority(url: str | Column) -> Column:
    """Host with port in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path(url: str | Column) -> Column:
    return F.regexp_extract(stripped(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/]*)?(/.*)?$", 1)


def path_depth(url: str | Column) -> Column:
    """Number of non-empty segments of the path."""
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def allowed(url: str | Column, allow: list[str], deny: list[str]) -> Column:
    """Whether a pattern of ``allow`` (or none is given) and none of ``deny`` is found."""
    out = F.lit(True) if not allow else col(url).rlike("|".join(f"(?:{p})" for p in allow))
    return out & ~col(url).rlike("|".join(f"(?:{p})" for p in deny)) if deny else out


def page_id(url: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(url), r"/pages/(\d+)(?:/|$)", 1), F.lit(""))


def safe_name(text: str | Column, most: int = 90) -> Column:
    """A folder name: other characters as underscores, cut; "untitled" if nothing is left."""
    name = F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""), 1, most)
    return F.when(name == "", F.lit("untitled")).otherwise(name)


def short_hash(*parts: str | Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, a newline after each."""
    return F.substring(F.sha2(F.concat(*(x for p in parts for x in (F.coalesce(col(p), F.lit("")), F.lit("\n")))), 256), 1, 16)


def folder_key(title: str | Column, url: str | Column) -> Column:
    return F.concat(safe_name(title), F.lit("_"), F.coalesce(page_id(url), short_hash(url)))


def export_view(url: str | Column) -> Column:
    """With format=export_view in the query (of equal parameters the last counts, at the place of the first), without fragment."""
    base, query = stripped(url), F.regexp_extract(col(url), r"\?([^#]*)", 1)
    pairs = F.filter(F.split(F.concat(query, F.lit("&format=export_view")), "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    names = F.transform(named, lambda p: F.regexp_extract(p, "^([^=]*)=", 1))
    firsts = F.filter(names, lambda n, i: F.array_position(names, n) == i + 1)
    backwards = F.reverse(named)
    behind = F.transform(backwards, lambda p: F.regexp_extract(p, "^([^=]*)=", 1))
    kept = F.transform(firsts, lambda n: F.element_at(backwards, F.array_position(behind, n).cast("int")))
    return F.concat(base, F.lit("?"), F.array_join(kept, "&"))


def embedded_links(html: str | Column) -> Column:
    """Links in JSON inside of pages: values of "href" and then of "url", unescaped as JSON where they can be, each once."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(f'"{k}"\\s*:\\s*"([^"]+)"'), F.lit(1)) for k in ("href", "url")))
    read = lambda u: F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), u, F.lit('"]')), "array<string>"), 0), u)
    return F.array_distinct(F.transform(found, lambda u: F.when(u.contains("\\"), read(u)).otherwise(u)))


def without_typos(url: str | Column, typos: dict[str, str]) -> Column:
    """With known misspellings replaced."""
    out = col(url)
    for wrong, right in typos.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def followable(url: str | Column) -> Column:
    return ~F.lower(F.trim(col(url))).rlike("^(mailto|tel|javascript):")
