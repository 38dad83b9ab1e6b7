"""Problem 5: lines repeated over one site's pages, and texts without them.

Every line is reduced to its letters in lower case and hashed; for each site and hash the distinct pages are
counted, in two steps so that a line on every page of a large site is counted by many tasks; a line is frequent if it is on
at least ``least_pages`` pages and at least ``share`` of its site's pages.  The few frequent lines are joined back.

A page is a file_path, a site the host of page_url in lower case without port.  Rows without text, page or site hold no
lines that count, and their text is left as it is.  Repeated rows count once.  Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PAGES, SHARE, LEAST_LETTERS = 4, (1, 10), 20


def site_of(url: str | Column) -> Column:
    """Host of a URL in lower case without port and user; null if there is none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def lines(sections: DataFrame) -> DataFrame:
    """(section_id, line_no, site, page, line): the lines that count, ``line`` being the hash of their letters."""
    rows = sections.select("section_id", site_of("page_url").alias("site"), F.xxhash64("file_path").alias("page"), "file_path", "raw_content")
    rows = rows.where("site is not null and file_path is not null").select("section_id", "site", "page", F.posexplode(F.split("raw_content", "\n")).alias("pos", "line"))
    rows = rows.where(F.length("line") >= LEAST_LETTERS)
    letters = F.lower(F.regexp_replace("line", r"\P{L}+", ""))
    rows = rows.select("section_id", (F.col("pos") + 1).cast("int").alias("line_no"), "site", "page", letters.alias("letters"))
    return rows.where(F.length("letters") >= LEAST_LETTERS).select("section_id", "line_no", "site", "page", F.xxhash64("letters").alias("line"))


def frequent(sections: DataFrame, least_pages: int = LEAST_PAGES, share: tuple[int, int] = SHARE) -> DataFrame:
    """(site, line, pages, site_pages) of the frequent lines."""
    top, bottom = share
    pages = sections.select(site_of("page_url").alias("site"), "file_path").where("site is not null and file_path is not null").distinct()
    sizes = pages.groupBy("site").agg(F.count("*").alias("site_pages"))
    seen = lines(sections).select("site", "line", "page").distinct().groupBy("site", "line").agg(F.count("*").alias("pages"))
    return seen.where(F.col("pages") >= least_pages).join(sizes, "site").where(F.col("pages") * bottom >= F.col("site_pages") * top)


def frequent_lines(sections: DataFrame, least_pages: int = LEAST_PAGES, share: tuple[int, int] = SHARE) -> DataFrame:
    """(section_id, line_no): all occurrences of frequent lines."""
    often = frequent(sections, least_pages, share).select("site", "line")
    return lines(sections).join(often, ["site", "line"], "left_semi").select("section_id", "line_no").distinct()


def without_frequent_lines(sections: DataFrame, least_pages: int = LEAST_PAGES, share: tuple[int, int] = SHARE) -> DataFrame:
    """(section_id, raw_content): each section, once, without its frequent lines."""
    gone = frequent_lines(sections, least_pages, share).groupBy("section_id").agg(F.collect_set("line_no").alias("gone"))
    rows = sections.select("section_id", "raw_content").dropDuplicates(["section_id"]).join(gone, "section_id", "left")
    kept = F.filter(F.split("raw_content", "\n"), lambda _, i: ~F.array_contains("gone", (i + 1).cast("int")))
    return rows.select("section_id", F.when(F.col("gone").isNull(), F.col("raw_content")).otherwise(F.array_join(kept, "\n")).alias("raw_content"))
