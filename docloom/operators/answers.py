"""Answers from the sections chosen for each query: collected artefacts, sources, extracts, dispatch, and checks of grounding.

``chosen`` is (query_id, section_id, rank) throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import first_by_key, installs, normalized, sentences, shell_command, terms, urls
from docloom.operators.index import path_text
from docloom.operators.search import Batch, anchors, lexical_search, with_bridge
from docloom.operators.tree import closure, nodes
from docloom.session import kept

#: How many items an answer shows.
MOST = {"yamls": 3, "scripts": 4, "outputs": 3, "steps": 8, "sources": 8}
NO_ANSWER = "No information was found in the documentation."


def collected(chosen: DataFrame, sections: DataFrame, artefact: str, only_installing: bool = False) -> DataFrame:
    """(query_id, items): the artefacts of the chosen sections in their order, each once."""
    rows = chosen.join(nodes(sections, artefact), "section_id").where(F.size(artefact) > 0)
    ordered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(artefact).alias("own")))).alias("lists"))
    items = F.flatten(F.transform("lists", lambda x: x["own"]))
    if only_installing:
        items = F.filter(items, lambda c: installs(c))
    return ordered.select("query_id", items.alias("items")).select("query_id", first_by_key("items").alias("items")).where(F.size("items") > 0)


def sources(chosen: DataFrame, sections: DataFrame, most: int = MOST["sources"]) -> DataFrame:
    """(query_id, place, doc_title, heading, page_url): distinct sources by first use, the first ``most``; a missing URL is N/A."""
    rows = chosen.join(nodes(sections, "doc_title", "heading", "page_url"), "section_id")
    rows = rows.select("query_id", "rank", F.coalesce("doc_title", F.lit("")).alias("doc_title"), F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce(F.nullif(F.col("page_url"), F.lit("")), F.lit("N/A")).alias("page_url"))
    first = rows.groupBy("query_id", "doc_title", "heading", "page_url").agg(F.min("rank").alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "doc_title", "heading", "page_url"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("query_id", "place", "doc_title", "heading", "page_url")


def by_subtopic(anchor: DataFrame, sections: DataFrame) -> DataFrame:
    """(query_id, subtopic, commands): commands of an anchor's descendants, grouped by the path element below the anchor."""
    below = anchor.select("query_id", F.col("section_id").alias("ancestor")).join(closure(sections), "ancestor")
    paths = nodes(sections, "heading_path", "commands")
    depth = paths.select(F.col("section_id").alias("ancestor"), F.size("heading_path").alias("depth"))
    rows = below.join(depth, "ancestor").join(paths, F.col("descendant") == F.col("section_id")).where("size(commands) > 0")
    label = F.when(F.size("heading_path") > F.col("depth"), F.element_at("heading_path", F.col("depth") + 1))
    made = rows.select("query_id", label.alias("subtopic"), "descendant", "commands").where("subtopic is not null").groupBy("query_id", "subtopic").agg(F.array_sort(F.collect_list(F.struct("descendant", "commands"))).alias("own"))
    return made.select("query_id", "subtopic", first_by_key(F.flatten(F.transform("own", lambda x: x["commands"]))).alias("commands"))


def best_sentences(chosen: DataFrame, queries: DataFrame, sections: DataFrame, first: int = 5, most: int = 3) -> DataFrame:
    """(query_id, place, sentence): of each of the first sections the earliest sentence with most of the query's terms; distinct ones, the first ``most``."""
    asked = queries.select("query_id", F.array_distinct(terms("text")).alias("asked"))
    rows = chosen.where(F.col("rank") <= first).join(nodes(sections, "raw_content"), "section_id").select("query_id", "rank", F.posexplode(sentences("raw_content")).alias("at", "sentence")).join(asked, "query_id")
    hits = rows.withColumn("hits", F.size(F.array_intersect("asked", terms("sentence")))).where("hits > 0")
    best = hits.groupBy("query_id", "rank").agg(F.max_by("sentence", F.struct("hits", -F.col("at"))).alias("sentence"))
    once = best.groupBy("query_id", "sentence").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "sentence"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("query_id", "place", "sentence")


def grouped_commands(batch: Batch, chosen: DataFrame, anchor: DataFrame) -> DataFrame:
    """(query_id, place, label, commands): commands of the chosen sections but the anchor (query_id, section_id), grouped by what their path has below the anchor's.

    A section that isn't below the anchor stands under its own heading.  Groups come in the order of their first section; of a query that wants to install, only commands that do.
    Where no chosen section has any, the anchor's own commands are the one group.
    """
    rows = batch.index.rows.select("section_id", "heading", "heading_path", "commands")
    top = anchor.join(rows, "section_id").select("query_id", F.col("section_id").alias("anchor"), F.col("heading").alias("anchor_heading"), F.size("heading_path").alias("depth"), F.col("commands").alias("anchor_commands"))
    wanted = batch.wanted.select("query_id", "installs")

    def wanted_only(commands: Column) -> Column:
        return F.when(F.col("installs"), F.filter(commands, lambda c: installs(c))).otherwise(commands)

    met = chosen.join(rows, "section_id").join(top, "query_id").join(wanted, "query_id").where("section_id <> anchor")
    label = F.when(F.size("heading_path") > F.col("depth"), F.element_at("heading_path", F.col("depth") + 1)).otherwise(F.coalesce("heading", F.lit("")))
    own = met.select("query_id", "rank", label.alias("label"), wanted_only(F.col("commands")).alias("own")).where("size(own) > 0")
    made = own.groupBy("query_id", "label").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("rank", "own"))).alias("lists"))
    made = kept(made.select("query_id", "rank", "label", first_by_key(F.flatten(F.transform("lists", lambda x: x["own"]))).alias("commands")).where("size(commands) > 0"))
    bare = top.join(made.select("query_id").distinct(), "query_id", "left_anti").join(wanted, "query_id")
    bare = bare.select("query_id", F.lit(1).alias("rank"), F.coalesce("anchor_heading", F.lit("")).alias("label"), first_by_key(wanted_only(F.col("anchor_commands"))).alias("commands")).where("size(commands) > 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "label"))
    return made.unionByName(bare).select("query_id", place.alias("place"), "label", "commands")


def _listing(items: Column, most: int | None = None) -> Column:
    return F.array_join(F.slice(items, 1, most) if most else items, "\n")


def answers(batch: Batch, chosen: DataFrame) -> DataFrame:
    """(query_id, kind, answer): output, YAML, script, command or extract, by what the query wants and the sections hold; else the sections' beginnings.

    Outputs of installing come from the output bridge first.  Commands are grouped below the anchor, if that has useful descendants, else listed.
    """
    index, bridge = batch.index, batch.bridge
    chosen = kept(chosen)
    out = batch.wanted.select("query_id", "installs", *(f"wants_{w}" for w in ("commands", "yaml", "output", "script", "steps")))
    before = chosen if bridge is None else with_bridge(chosen, bridge, 1 << 20)
    # one look at the sections for all artefacts
    most = before.withColumn("chosen", F.lit(False)).unionByName(chosen.withColumn("chosen", F.lit(True)))
    held = nodes(index, "outputs", "yamls", "scripts", "steps", "commands").join(most, "section_id")
    parts = {name: F.array_sort(F.collect_list(F.when((F.col("chosen") == (name != "outputs")) & (F.size(name) > 0), F.struct("rank", F.col(name).alias("own"))))) for name in ("outputs", "yamls", "scripts", "steps", "commands")}
    lists = held.groupBy("query_id").agg(*(x.alias(name) for name, x in parts.items()))
    lists = lists.select("query_id", *(first_by_key(F.flatten(F.transform(name, lambda x: x["own"]))).alias(name) for name in parts))
    out = out.join(lists, "query_id", "left").withColumn("commands", F.when(F.col("installs"), F.filter("commands", lambda c: installs(c))).otherwise(F.col("commands")))
    for name in parts:
        out = out.withColumn(name, F.when(F.size(name) > 0, F.col(name)))
    anchor = kept(anchors(batch, lexical_search(batch, 20)))
    holds = anchor.join(index.closure.where("useful").select(F.col("ancestor").alias("section_id")).distinct(), "section_id", "left_semi")
    groups = grouped_commands(batch, chosen, holds).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "label", "commands"))).alias("g"))
    groups = groups.select("query_id", F.array_join(F.transform("g", lambda x: F.concat(x["label"], F.lit("\n"), F.array_join(x["commands"], "\n"))), "\n\n").alias("grouped"))
    out = out.join(groups, "query_id", "left").join(holds.select("query_id", F.lit(True).alias("groups")), "query_id", "left")
    lines = best_sentences(chosen, batch.wanted, index).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("s"))
    lines = lines.select("query_id", F.transform("s", lambda x: x["sentence"]).alias("sentences"))
    first = before.where("rank <= 3").join(nodes(index, "raw_content"), "section_id").where("trim(raw_content) <> ''")
    beginnings = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring(F.trim("raw_content"), 1, 500).alias("text")))).alias("b"))
    beginnings = beginnings.select("query_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("beginnings"))
    out = out.join(lines, "query_id", "left").join(beginnings, "query_id", "left")
    extract = F.concat_ws("\n", F.array_join("sentences", "\n"), F.when(F.col("wants_steps") & F.col("steps").isNotNull(), _listing(F.col("steps"), MOST["steps"])))
    command = F.when(F.col("groups"), F.col("grouped")).otherwise(_listing(F.col("commands")))
    # the first kind a query wants is its kind; without what that shows, the beginnings stand in
    kinds = [("output", F.col("wants_output"), _listing(F.col("outputs"), MOST["outputs"])), ("yaml", F.col("wants_yaml") & ~F.col("wants_commands"), _listing(F.col("yamls"), MOST["yamls"]))]
    kinds += [("script", F.col("wants_script"), _listing(F.col("scripts"), MOST["scripts"])), ("commands", F.col("wants_commands"), command), ("extract", F.lit(True), F.when(F.col("sentences").isNotNull(), extract))]
    kind, answer = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, test, text in reversed(kinds):
        kind, answer = F.when(test, name).otherwise(kind), F.when(test, text).otherwise(answer)
    out = out.select("query_id", kind.alias("kind"), answer.alias("answer"), "beginnings")
    given = F.when(F.col("answer").isNotNull(), F.col("kind")).when(F.col("beginnings").isNotNull(), "beginning").otherwise("none")
    return out.select("query_id", given.alias("kind"), F.coalesce("answer", "beginnings", F.lit(NO_ANSWER)).alias("answer"))


def prompts(chosen: DataFrame, queries: DataFrame, sections: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, prompt): the query and the first sections, cut to size, as JSON for a text generator."""
    cut = lambda c, n: F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, n).alias(c)
    rows = chosen.where(F.col("rank") <= most).join(nodes(sections, "doc_title", "heading", "heading_path", "page_url", "raw_content", "commands", "outputs", "yamls", "steps"), "section_id")
    context = F.struct("rank", "doc_title", "heading", path_text().alias("path"), "page_url", cut("commands", 6), cut("outputs", 3), cut("yamls", 2), cut("steps", 8), F.substring(F.trim("raw_content"), 1, 1500).alias("content"))
    made = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(context)).alias("context"))
    return queries.join(made, "query_id").select("query_id", F.to_json(F.struct(F.col("text").alias("query"), F.col("context"))).alias("prompt"))


# --- grounding ---------------------------------------------------------------------------------------------------


def in_order(needle: Column, hay: Column) -> Column:
    """Whether all items of ``needle`` occur in ``hay`` in their order."""
    at = F.aggregate(hay, F.lit(0), lambda i, x: F.when((i < F.size(needle)) & (F.get(needle, i) == x), i + 1).otherwise(i))
    return at >= F.size(needle)


def supported(command: Column, known: Column) -> Column:
    """Whether a command equals a known one, begins one or is begun by one, or is a subsequence of its words."""
    own = shell_command(command)
    words = F.split(own, " ")
    return F.exists(known, lambda k: (shell_command(k) == own) | shell_command(k).startswith(own) | own.startswith(shell_command(k)) | in_order(words, F.split(shell_command(k), " ")))


def ungrounded_urls(given: DataFrame, chosen: DataFrame, sections: DataFrame) -> DataFrame:
    """(query_id, url): URLs of answers (query_id, answer) that aren't in the chosen sections' text or their own."""
    said = given.select("query_id", F.explode(urls("answer")).alias("url"))
    known = chosen.join(nodes(sections, "raw_content", "page_url"), "section_id").select("query_id", F.explode(F.array_union(urls("raw_content"), F.array(F.coalesce("page_url", F.lit(""))))).alias("url"))
    return said.join(known.distinct(), ["query_id", "url"], "left_anti").distinct()


def ungrounded_commands(given: DataFrame, chosen: DataFrame, sections: DataFrame) -> DataFrame:
    """(query_id, command): commands (query_id, command) that no command of the chosen sections supports."""
    known = collected(chosen, sections, "commands").withColumnRenamed("items", "known")
    rows = given.join(known, "query_id", "left")
    return rows.where(F.col("known").isNull() | ~supported(F.col("command"), F.coalesce("known", F.array().cast("array<string>")))).select("query_id", "command").distinct()


def subject_tiers(found: DataFrame, named: DataFrame, sections: DataFrame) -> DataFrame:
    """(query_id, section_id, tier): of the sections found for each query (query_id, section_id) those of the best tier for its subject (query_id, subject): heading
    equal (1), holding it (2), title (3), content (4), and all of them where there is no subject or nothing holds it (5)."""
    rows = found.select("query_id", "section_id").distinct().join(named.select("query_id", normalized("subject").alias("s")), "query_id", "left").join(nodes(sections, "heading", "doc_title", "raw_content"), "section_id")
    s, h = F.col("s"), normalized("heading")
    tier = F.when(s.isNull() | (s == ""), 5).when(h == s, 1).when(h.contains(s), 2).when(normalized("doc_title").contains(s), 3).when(normalized("raw_content").contains(s), 4).otherwise(5)
    best = rows.select("query_id", "section_id", tier.alias("tier")).withColumn("best", F.min("tier").over(Window.partitionBy("query_id")))
    return best.where("tier = best").drop("best")


def requiring(found: DataFrame, points: DataFrame, sections: DataFrame, artefact: str) -> DataFrame:
    """(query_id, section_id, rank): of the sections found (query_id, section_id, rank) those with the artefact and points (query_id, section_id, points) for the subject, by
    points; where there is none, all as they were."""
    has = nodes(sections, artefact).where(F.size(artefact) > 0).select("section_id")
    fit = found.join(points, ["query_id", "section_id"]).join(has, "section_id", "left_semi")
    again = fit.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("points"), "rank", "section_id"))).select("query_id", "section_id", "rank")
    rest = found.join(fit.select("query_id").distinct(), "query_id", "left_anti")
    return again.unionByName(rest.select("query_id", "section_id", "rank"))
