"""The heading tree of sections: parsing of Markdown, parents, ancestors, descendants, siblings and neighbours.

Sections are rows (file_path, section_id, level, ...), in the order of section_id within a file.  Everything is windows
over a file or equi-joins on it; no recursion.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEADING = r"^(#{1,6})\s+(.*)$"
ARTEFACTS = ("commands", "yamls", "outputs", "scripts", "steps")


@dataclass
class Nodes:
    """Sections read and written once: ``rows``, one for each section, and, where they are known, the tables of their tree."""

    rows: DataFrame
    ancestors: DataFrame | None
    closure: DataFrame | None


def nodes(sections: DataFrame | Nodes, *columns: str) -> DataFrame:
    """Each section once, with the columns asked for."""
    wanted = list(dict.fromkeys(["section_id", *columns]))
    if isinstance(sections, Nodes):
        return sections.rows.select(*wanted)
    return sections.select(*wanted).where("section_id is not null").dropDuplicates(["section_id"])


def parse_markdown(texts: DataFrame, key: str, text: str, title: Column, fence_aware: bool = False) -> DataFrame:
    """(key, section_seq, level, heading, raw_content): the sections of each Markdown text.

    A line of one to six # and a blank opens a section; text before the first opens one of level 1 named by ``title``.
    Without ``fence_aware`` such lines inside code blocks open sections too.  Null texts have no sections.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\z", ""), "\n")
    rows = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key), title.alias("title"), F.posexplode(lines).alias("pos", "line"))
    rows = rows.withColumn("bare", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    order = Window.partitionBy(key).orderBy("pos")
    opens = F.col("bare").rlike(HEADING)
    if fence_aware:
        rows = rows.withColumn("fences", F.sum(F.col("bare").startswith("```").cast("int")).over(order))
        opens = opens & (F.col("fences") % 2 == 0)
    rows = rows.withColumn("opens", opens)
    rows = rows.withColumn("seq", F.sum(F.when(F.col("opens") | (F.col("pos") == 0), 1).otherwise(0)).over(order) - 1)
    lead = F.when(F.col("opens"), F.struct(F.length(F.regexp_extract("bare", HEADING, 1)).alias("level"), F.trim(F.regexp_extract("bare", HEADING, 2)).alias("heading")))
    body = F.when(~F.col("opens"), F.struct("pos", "line"))
    made = rows.groupBy(key, "seq").agg(F.first(lead, ignorenulls=True).alias("lead"), F.array_sort(F.collect_list(body)).alias("body"), F.first("title").alias("title"))
    content = F.array_join(F.transform("body", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return made.select(
        key, F.col("seq").cast("int").alias("section_seq"), F.coalesce("lead.level", F.lit(1)).alias("level"), F.coalesce("lead.heading", F.coalesce("title", F.lit(""))).alias("heading"), content.alias("raw_content")
    )


def parse_flat(texts: DataFrame, key: str, text: str, default: str = "Document") -> DataFrame:
    """(key, section_index, heading, heading_level, content): sections in a flat list with trimmed texts; those without heading and text are left out, and a text of no lines is one empty section."""
    bare = texts.where((F.col(text) == "") | F.col(text).isNull()).select(key, F.lit(0).alias("section_index"), F.lit(default).alias("heading"), F.lit(1).alias("heading_level"), F.lit("").alias("content"))
    rows = parse_markdown(texts, key, text, F.lit(default))
    made = rows.select(key, "section_seq", "heading", F.col("level").alias("heading_level"), F.regexp_replace("raw_content", r"^\s+|\s+\z", "").alias("content")).where("content <> '' or trim(heading) <> ''")
    order = F.row_number().over(Window.partitionBy(key).orderBy("section_seq")) - 1
    return made.select(key, order.alias("section_index"), "heading", "heading_level", "content").unionByName(bare)


def own_file() -> tuple[Column, Column]:
    """What sections of one file share; a section without a file stands alone."""
    return F.col("file_path"), F.when(F.col("file_path").isNull(), F.col("section_id"))


def with_ancestors(sections: DataFrame, deepest: int = 6) -> DataFrame:
    """(file_path, section_id, level, ancestors, parent): the ids above each section from the root down; parent is null at the top.

    The last section of level k before a section is above it if no section of a lesser level came in between.
    """
    if isinstance(sections, Nodes) and sections.ancestors is not None:
        return sections.ancestors
    order = Window.partitionBy(*own_file()).orderBy("section_id").rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.last(F.when(F.col("level") == k, F.col("section_id")), ignorenulls=True).over(order) for k in range(1, deepest)]
    rows = nodes(sections, "file_path", "level").select("file_path", "section_id", "level", *(x.alias(f"last_{k}") for k, x in enumerate(lasts, 1)))
    above: list[Column] = []
    for k in range(1, deepest):
        higher = [F.coalesce(f"last_{j}", F.lit(-1)) for j in range(1, k)]
        floor = reduce(lambda a, b: F.when(a > b, a).otherwise(b), higher, F.lit(-1))
        above.append(F.when((F.col("level") > k) & (F.col(f"last_{k}") > floor), F.col(f"last_{k}")))
    ancestors = F.filter(F.array(*above), lambda x: x.isNotNull())
    return rows.select("file_path", "section_id", "level", ancestors.alias("ancestors")).withColumn("parent", F.when(F.size("ancestors") > 0, F.element_at("ancestors", -1)))


def closure(sections: DataFrame) -> DataFrame:
    """(file_path, ancestor, descendant, distance), at most five rows a section."""
    if isinstance(sections, Nodes) and sections.closure is not None:
        return sections.closure.select("file_path", "ancestor", "descendant", "distance")
    rows = with_ancestors(sections)
    return rows.select("file_path", F.col("section_id").alias("descendant"), F.size("ancestors").alias("depth"), F.posexplode("ancestors").alias("place", "ancestor")).select("file_path", "ancestor", "descendant", (F.col("depth") - F.col("place")).alias("distance"))


def is_useful() -> Column:
    return reduce(lambda a, b: a | b, (F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0 for c in ARTEFACTS))


def useful_descendants(sections: DataFrame) -> DataFrame:
    """(file_path, ancestor, descendant, distance) of the descendants with commands, YAML, outputs, scripts or steps."""
    if isinstance(sections, Nodes) and sections.closure is not None:
        return sections.closure.where("useful").select("file_path", "ancestor", "descendant", "distance")
    useful = nodes(sections, *ARTEFACTS).where(is_useful()).select(F.col("section_id").alias("descendant"))
    return closure(sections).join(useful, "descendant")


def only(rows: DataFrame, of: DataFrame | None) -> DataFrame:
    """Of rows (section_id, ...) those of the sections asked for (section_id); all without such."""
    return rows if of is None else rows.join(of, "section_id", "left_semi")


def siblings(sections: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(section_id, sibling): other children of the same parent; sections at the top have none.  ``of`` (section_id) are the sections asked for."""
    rows = with_ancestors(sections).where("parent is not null").select("parent", "section_id")
    return only(rows, of).join(rows.select("parent", F.col("section_id").alias("sibling")), "parent").where("section_id <> sibling").select("section_id", "sibling")


def neighbours(sections: DataFrame, radius: int = 2) -> DataFrame:
    """(section_id, offset, neighbour): the sections up to ``radius`` places before and after in the file."""
    order = Window.partitionBy(*own_file()).orderBy("section_id")
    rows = nodes(sections, "file_path")
    offsets = [d for d in range(-radius, radius + 1) if d]
    rows = rows.select("section_id", *(F.lag("section_id", -d).over(order).alias(f"at_{k}") for k, d in enumerate(offsets)))
    near = F.array(*(F.struct(F.lit(d).alias("offset"), F.col(f"at_{k}").alias("neighbour")) for k, d in enumerate(offsets)))
    return rows.select("section_id", F.explode(near).alias("n")).select("section_id", "n.offset", "n.neighbour").where("neighbour is not null")


def structural_neighbours(sections: DataFrame, radius: int = 2, most_descendants: int = 6, of: DataFrame | None = None) -> DataFrame:
    """(section_id, neighbour, place): itself, parent, first descendants, siblings, file neighbours, each once, in this order.

    A section has as many siblings as its parent has children; ``of`` (section_id) keeps that to the sections asked for.
    """
    tree = only(with_ancestors(sections), of)
    own = tree.select("section_id", F.col("section_id").alias("neighbour"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("at"))
    up = tree.where("parent is not null").select("section_id", F.col("parent").alias("neighbour"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("at"))
    order = Window.partitionBy("section_id").orderBy("distance", "descendant")
    below = only(closure(sections).select(F.col("ancestor").alias("section_id"), "descendant", "distance"), of)
    down = below.withColumn("at", F.row_number().over(order).cast("bigint")).where(F.col("at") <= most_descendants).select("section_id", F.col("descendant").alias("neighbour"), F.lit(2).alias("kind"), "at")
    side = siblings(sections, of).select("section_id", F.col("sibling").alias("neighbour"), F.lit(3).alias("kind"), F.col("sibling").alias("at"))
    near = only(neighbours(sections, radius), of).select("section_id", "neighbour", F.lit(4).alias("kind"), F.col("offset").cast("bigint").alias("at"))
    met = own.unionByName(up).unionByName(down).unionByName(side).unionByName(near)
    first = met.groupBy("section_id", "neighbour").agg(F.min(F.struct("kind", "at")).alias("first"))
    place = F.row_number().over(Window.partitionBy("section_id").orderBy("first.kind", "first.at", "neighbour"))
    return first.select("section_id", "neighbour", place.alias("place"))
