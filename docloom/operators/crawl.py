"""Operators over discovered URLs: de-duplication, filters, partition by domain, and the crawl's frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import urls as U
from docloom.operators import html_markdown
from docloom.session import checkpointed


def requests(found: DataFrame, domains: list[str] = ()) -> DataFrame:
    """(page_url, url_id): each page once, by its first discovery; query and fragment don't count.  With ``domains`` only pages of those hosts."""
    rows = found.where("url is not null")
    if domains:
        rows = rows.where(U.authority("url").isin([d.lower() for d in domains]))
    return rows.groupBy(U.stripped("url").alias("page_url")).agg(F.min("url_id").alias("url_id"))


def sitemap_pages(entries: DataFrame, domains: list[str], allow: list[str], deny: list[str], deepest: int | None = None) -> DataFrame:
    """(url): pages of sitemap entries (loc): without query and fragment, of the domains, no deeper than ``deepest``, allowed by the patterns, each once."""
    rows = entries.select(U.stripped(F.trim("loc")).alias("url")).where(F.col("url") != "").where(U.authority("url").isin([d.lower() for d in domains]))
    rows = rows.where(U.allowed("url", allow, deny))
    return (rows if deepest is None else rows.where(U.path_depth("url") <= deepest)).distinct()


def crawl_pages(pages: DataFrame, seeds: DataFrame, domains: list[str], allow: list[str] = (), deny: list[str] = (), depth_limit: int = 6) -> DataFrame:
    """(url, depth, from_url): a crawl over stored pages (fetch_id, page_url, page_html), breadth first from seeds (url), along the links the pages hold.

    Links to other hosts or against the patterns aren't followed.  Each page is requested once, by the smallest of the pages of its first level that link to it.
    """
    latest = pages.where("page_html <> ''").withColumn("url", U.normal("page_url")).groupBy("url").agg(F.max("fetch_id").alias("fetch_id"))
    held = pages.dropDuplicates(["fetch_id"]).join(latest, "fetch_id")
    out = html_markdown.links(held).join(latest.withColumnRenamed("url", "source"), "fetch_id").select("source", U.normal("href").alias("page"))
    out = out.where(U.authority("page").isin([d.lower() for d in domains]) & U.allowed("page", list(allow), list(deny)))
    out = checkpointed(out.distinct())
    level = checkpointed(seeds.select(U.normal("url").alias("page")).where("page <> ''").distinct().select("page", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("source")))
    reached = level
    for depth in range(1, depth_limit + 1):
        step = level.select(F.col("page").alias("source")).join(out, "source").groupBy("page").agg(F.min("source").alias("source"))
        level = checkpointed(step.join(reached, "page", "left_anti").select("page", F.lit(depth).alias("depth"), "source"))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached.select(F.col("page").alias("url"), "depth", F.col("source").alias("from_url"))


def failures(fetches: DataFrame) -> DataFrame:
    """(fetch_id, kind, status, error): what failed of each fetch's requests: the page itself, the export view by REST and that by URL."""
    kinds = F.array(
        F.struct(F.lit("page").alias("kind"), F.col("status"), F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).alias("error")),
        *(F.struct(F.lit(k).alias("kind"), F.col(f"{k}.status").alias("status"), F.col(f"{k}.error").alias("error")) for k in ("rest_export_view", "url_export_view")),
    )
    return fetches.select("fetch_id", F.explode(kinds).alias("k")).select("fetch_id", "k.*").where("error is not null").distinct()


def by_domain(found: DataFrame, domain: str) -> DataFrame:
    """Rows with ``kind`` internal or external; those without a host are dropped."""
    host = U.authority("url")
    return found.where(host != "").withColumn("kind", F.when(host == domain.lower(), "internal").otherwise("external"))


def external_captures(found: DataFrame, hosts: list[str], below_depth: int) -> DataFrame:
    """External links that are recorded, never followed: from pages of lesser depth, to listed hosts."""
    return found.where((F.col("depth") < below_depth) & U.authority("url").isin(hosts) & U.followable("url"))


def frontier(found: DataFrame, depth_limit: int = 6) -> DataFrame:
    """(page, depth): pages reached from the sitemap's over from_url -> url, breadth first; each page is requested once."""
    links = found.where("from_url is not null and url is not null").select(U.normal("from_url").alias("source"), U.normal("url").alias("page")).distinct()
    level = found.where("source = 'sitemap' and url is not null").select(U.normal("url").alias("page")).distinct().withColumn("depth", F.lit(0))
    links, level = checkpointed(links), checkpointed(level)
    reached = level
    for depth in range(1, depth_limit + 1):
        step = level.select(F.col("page").alias("source")).join(links, "source").select("page").distinct()
        level = checkpointed(step.join(reached, "page", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached
