"""Retrieval by scored subjects: a variant of ``search`` in which subjects are candidates with points and one score decides.

The profile ``sections`` prefers the descendants of what is named; ``headings`` answers from the section of that heading at once.  Phrases of what a question
wants are those of ``grounded``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import normalized, terms
from docloom.operators import grounded
from docloom.operators.answers import requiring
from docloom.operators.index import Index, path_text
from docloom.operators.search import FALLBACK, Batch, _contained, chosen_of, containing, exact_subjects, expansion, query_terms, ranked
from docloom.session import kept

#: Points of candidates for a subject (contained, each shared term, least) by kind, and of a file's name; shortest names.
CANDIDATES, FILE_POINTS, SHORTEST = {"heading": (80, 10, 20), "title": (70, 8, 18)}, 200, 3
#: Points of shared terms by field (bits of the postings' fields), of the content's, at most so many; of the whole question in a field.
SHARED, CONTENT_POINTS, CONTENT_MOST, PHRASE = {1: 10, 2: 8, 4: 5}, 2, 8, {"heading": 30, "path": 24, "title": 18}
#: Points of the subject's best place, by profile; of what is wanted and held; of useful descendants, at most so many.
SUBJECT = {"sections": {"equal": 45, "heading": 30, "path": 22, "title": 18, "content": 10}, "headings": {"equal": 40, "heading": 28, "path": 18, "title": 0, "content": 10}}
WANTED, BELOW_POINTS, BELOW_MOST = {"commands": ("commands", 12), "yaml": ("yamls", 12), "output": ("outputs", 12), "script": ("scripts", 12), "steps": ("steps", 8)}, 3, 8
#: Of the choice of an anchor: shared terms by field, descendants, places of the subject; of a required artefact: places of the subject.
ANCHOR_SHARED, ANCHOR_BELOW, ANCHOR_SUBJECT = {1: 12, 2: 10, 4: 8}, (4, 10), {"equal": 50, "title": 20, "path": 18}
REQUIRED, REQUIRED_FILE, TOP = {"equal": 100, "heading": 70, "path": 60, "content": 50, "title": 15}, 30, 8


def subjects(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, subject, points): the candidate with most points: a file's name, or a heading or title that is in the question or shares terms with it; null without any."""
    keys = index.keys.where(F.length("key") >= SHORTEST)
    named = _contained(queries, keys, SHORTEST).select("query_id", "kind", "key", F.lit(True).alias("inside"), F.lit(0).alias("shared"))
    words = keys.select("kind", "key", F.explode(F.array_distinct(terms("key"))).alias("term")).join(query_terms(queries), "term")
    shared = words.groupBy("query_id", "kind", "key").agg(F.count("*").cast("int").alias("shared")).select("query_id", "kind", "key", F.lit(False).alias("inside"), "shared")
    met = named.unionByName(shared).groupBy("query_id", "kind", "key").agg(F.max("inside").alias("inside"), F.max("shared").alias("shared"))
    points = {k: F.when(F.col("inside"), inside).otherwise(0) + F.col("shared") * each for k, (inside, each, _) in CANDIDATES.items()}
    met = met.withColumn("points", F.when(F.col("kind") == "heading", points["heading"]).otherwise(points["title"]))
    met = met.where((F.col("kind") == "heading") & (F.col("points") >= CANDIDATES["heading"][2]) | (F.col("kind") == "title") & (F.col("points") >= CANDIDATES["title"][2]))
    file = F.regexp_extract("text", r"\b[A-Za-z0-9_.-]+\.(?:yaml|yml|sh|jar)\b", 0)
    files = queries.select("query_id", F.lit("file").alias("kind"), file.alias("key"), F.lit(FILE_POINTS).alias("points")).where("key <> ''")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("points"), "kind", "key"))  # file, heading, title
    best = met.select("query_id", "kind", "key", "points").unionByName(files).withColumn("n", order).where("n = 1")
    return queries.select("query_id").join(best.select("query_id", F.col("key").alias("subject"), "points"), "query_id", "left")


@dataclass
class ScoredBatch(Batch):
    """A batch understood by this variant; its tables are written once."""

    profile: str = "sections"

    @cached_property
    def shared(self) -> DataFrame:
        """(query_id, section_id, heading, path, title, content): numbers of shared terms by field."""
        met = self.index.postings.where("fields > 0").join(self.terms, "term")
        count = lambda bit: F.sum((F.col("fields").bitwiseAND(bit) > 0).cast("int"))
        return met.groupBy("query_id", "section_id").agg(*(count(bit).alias(f"f{bit}") for bit in (1, 2, 4, 16)))

    @cached_property
    def places(self) -> DataFrame:
        """(query_id, section_id, equal, heading, path, title, content): where the subject is."""
        named = self.wanted.where("subject is not null").select("query_id", normalized("subject").alias("word")).where("word <> ''")
        parts = {"heading": F.col("heading"), "path": path_text(), "content": F.col("raw_content"), "title": F.col("doc_title")}
        texts = self.index.rows.select("section_id", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), normalized(x).alias("text")) for k, x in parts.items()))).alias("f")).select("section_id", "f.*")
        found = containing(texts, named.select("word")).groupBy("section_id", "word").agg(*(F.max(F.col("field") == k).alias(k) for k in parts))
        own = self.index.rows.select("section_id", normalized("heading").alias("own"))
        return kept(found.join(named, "word").join(own, "section_id").select("query_id", "section_id", (F.col("own") == F.col("word")).alias("equal"), *parts))

    @cached_property
    def below(self) -> DataFrame:
        """(section_id, below): numbers of useful descendants."""
        return kept(self.index.closure.where("useful").groupBy(F.col("ancestor").alias("section_id")).agg(F.count("*").cast("int").alias("below")))

    @cached_property
    def ranking(self) -> DataFrame:
        return kept(ranked(scores(self).where("score > 0"), FALLBACK))


def understood(queries: DataFrame, index: Index, profile: str = "sections") -> ScoredBatch:
    wanted = queries.select("query_id", "text").join(grounded.intents(queries), "query_id").join(subjects(queries, index).select("query_id", "subject"), "query_id")
    return ScoredBatch(index, kept(wanted), kept(query_terms(queries)), profile)


def first_place(points: dict[str, int]) -> Column:
    """Points of the first of some places that holds the subject."""
    return reduce(lambda rest, item: F.when(F.col(item[0]), item[1]).otherwise(rest), reversed(list(points.items())), F.lit(0))


def all_places(points: dict[str, int]) -> Column:
    return sum((F.when(F.col(name), n).otherwise(0) for name, n in points.items()), F.lit(0))


def held_points() -> Column:
    """Points of what is wanted and held."""
    return sum((F.when(F.col(f"wants_{want}") & F.col(f"has_{artefact}"), n).otherwise(0) for want, (artefact, n) in WANTED.items()), F.lit(0))


def below_points(batch: ScoredBatch) -> Column:
    return F.least(F.coalesce("below", F.lit(0)), F.lit(BELOW_MOST)) * (BELOW_POINTS if batch.profile == "sections" else 0)


def scores(batch: ScoredBatch) -> DataFrame:
    """(query_id, section_id, score): of all sections that share a term with the question, hold it or its subject, or are among the first by what they hold."""
    shared = sum((F.col(f"f{bit}") * n for bit, n in SHARED.items()), F.least("f16", F.lit(CONTENT_MOST)) * CONTENT_POINTS)
    parts = [batch.shared.select("query_id", "section_id", shared.cast("int").alias("points"))]
    asked = batch.wanted.select("query_id", normalized("text").alias("word")).where("word <> ''")
    fields = {"heading": F.col("heading"), "path": path_text(), "title": F.col("doc_title")}
    texts = batch.index.rows.select("section_id", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), normalized(x).alias("text")) for k, x in fields.items()))).alias("f")).select("section_id", "f.*")
    phrase = reduce(lambda rest, item: F.when(F.col("field") == item[0], item[1]).otherwise(rest), PHRASE.items(), F.lit(0))
    parts.append(containing(texts, asked.select("word")).join(asked, "word").select("query_id", "section_id", phrase.alias("points")))
    parts.append(batch.places.select("query_id", "section_id", first_place(SUBJECT[batch.profile]).alias("points")))
    # what scores by itself: the first sections of each combination of what is held and wanted
    has = [f"has_{artefact}" for artefact, _ in WANTED.values()]
    held = batch.index.rows.select("section_id", *has).join(batch.below, "section_id", "left").withColumn("below", F.least(F.coalesce("below", F.lit(0)), F.lit(BELOW_MOST)))
    firsts = held.withColumn("n", F.row_number().over(Window.partitionBy(*has, "below").orderBy("section_id"))).where(F.col("n") <= FALLBACK).drop("n")
    wants = [f"wants_{w}" for w in WANTED]
    key = F.concat_ws("", *(F.col(w).cast("int").cast("string") for w in wants))
    combos = batch.wanted.select(key.alias("key"), *wants).distinct().collect()  # at most 2 ** 5
    if combos:
        every = F.array(*(F.struct(F.lit(r["key"]).alias("key"), *(F.lit(r[w]).alias(w) for w in wants)) for r in combos))
        worth = firsts.select("*", F.explode(every).alias("c")).select("section_id", *has, "below", "c.*").withColumn("worth", held_points() + below_points(batch))
        best = worth.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("worth"), "section_id"))).where(F.col("n") <= FALLBACK).select("key", "section_id")
        parts.append(batch.wanted.select("query_id", key.alias("key")).join(F.broadcast(best), "key").select("query_id", "section_id", F.lit(0).alias("points")))
    met = reduce(DataFrame.unionByName, parts).groupBy("query_id", "section_id").agg(F.sum("points").alias("points"))
    rows = met.join(batch.index.rows.select("section_id", *has), "section_id").join(batch.below, "section_id", "left").join(batch.wanted.select("query_id", *wants), "query_id")
    return rows.select("query_id", "section_id", (F.col("points") + held_points() + below_points(batch)).cast("double").alias("score"))


def anchors(batch: ScoredBatch) -> DataFrame:
    """(query_id, section_id): of the sections named by the subject and the first 20 of the ranking, those with useful descendants, the one with most points."""
    met = exact_subjects(batch).withColumn("rank", F.lit(0)).unionByName(batch.ranking.select("query_id", "section_id", "rank"))
    met = met.groupBy("query_id", "section_id").agg(F.min("rank").alias("rank")).join(batch.below, "section_id")
    rows = met.join(batch.shared, ["query_id", "section_id"], "left").join(batch.places, ["query_id", "section_id"], "left")
    each, most = ANCHOR_BELOW
    points = sum((F.coalesce(f"f{bit}", F.lit(0)) * n for bit, n in ANCHOR_SHARED.items()), F.least("below", F.lit(most)) * each) + all_places(ANCHOR_SUBJECT)
    return rows.withColumn("points", points).groupBy("query_id").agg(F.max_by("section_id", F.struct("points", -F.col("rank"), -F.col("section_id"))).alias("section_id"))


def search(batch: ScoredBatch, top: int = TOP) -> DataFrame:
    """(query_id, section_id, rank): the sections chosen for each question.

    The best section named by the subject, with what is below it (and around it in its file, for the profile ``sections``, which asks for something useful below); else,
    where YAML of a file is wanted, sections with YAML that name the file; else, for ``sections``, the anchor and what is around it; else the ranking.
    """
    named = exact_subjects(batch)
    if batch.profile == "headings":
        own = batch.places.where("equal").select("query_id", "section_id")
        named = named.join(own, ["query_id", "section_id"], "left_semi")
    else:
        named = named.join(batch.below, "section_id", "left_semi")
    scored = named.join(scores(batch), ["query_id", "section_id"])
    best = scored.groupBy("query_id").agg(F.max_by("section_id", F.struct("score", -F.col("section_id"))).alias("section_id"))
    if batch.profile == "sections":
        # the best by name decides, and only if something useful is below it
        top_named = exact_subjects(batch).join(scores(batch), ["query_id", "section_id"]).groupBy("query_id").agg(F.max_by("section_id", F.struct("score", -F.col("section_id"))).alias("section_id"))
        best = top_named.join(batch.below, "section_id", "left_semi").select("query_id", "section_id")
    best = kept(best)
    rest = batch.wanted.join(best, "query_id", "left_anti")
    files = rest.where("wants_yaml and subject is not null and (endswith(subject, '.yaml') or endswith(subject, '.yml'))").select("query_id")
    points = batch.places.select("query_id", "section_id", (all_places({k: n for k, n in REQUIRED.items() if k != "heading"}) + F.when(F.col("heading") & ~F.col("equal"), REQUIRED["heading"]).otherwise(0) + F.when(F.col("content"), REQUIRED_FILE).otherwise(0)).cast("double").alias("points"))
    every = points.join(files, "query_id", "left_semi").join(batch.ranking.select("query_id", "section_id", "rank"), ["query_id", "section_id"], "left").select("query_id", "section_id", F.coalesce("rank", F.lit(FALLBACK + 1)).alias("rank"))
    required = kept(requiring(every, points, batch.index, "yamls"))
    required = required.join(batch.index.rows.where("has_yamls").select("section_id"), "section_id", "left_semi")
    rest = rest.join(required.select("query_id").distinct(), "query_id", "left_anti")
    made = [expansion(batch, best) if batch.profile == "sections" else expansion(batch, best).where("kind < 2"), required.select("query_id", "section_id", F.lit(0).alias("kind"), F.col("rank").cast("bigint").alias("at"))]
    if batch.profile == "sections":
        wanting = rest.where(" or ".join(f"wants_{w}" for w in WANTED)).select("query_id")
        anchor = kept(anchors(batch).join(wanting, "query_id", "left_semi"))
        made.append(expansion(batch, anchor))
        rest = rest.join(anchor, "query_id", "left_anti")
    first = [r[0] for r in batch.index.rows.select("section_id").orderBy("section_id").limit(top).collect()]
    plain = batch.ranking.join(rest.select("query_id"), "query_id", "left_semi").select("query_id", "section_id", F.lit(0).alias("kind"), F.col("rank").cast("bigint").alias("at"))
    spare = rest.select("query_id", F.posexplode(F.lit(first)).alias("at", "section_id")).select("query_id", "section_id", F.lit(9).alias("kind"), F.col("at").cast("bigint").alias("at")) if first else plain.limit(0)
    return chosen_of(reduce(DataFrame.unionByName, [*made, plain, spare]), top)
