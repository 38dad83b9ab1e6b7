"""The stored index of a corpus of sections: built once, read by every batch of queries.

``Index`` stands for the sections wherever an operator takes them: ``tree.nodes`` reads its rows, already one per section, and the tree,
postings and flags are tables of it.  All of it lies in one folder, by default in the one that executors share, and can be opened again.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import contains_any, normalized, terms
from docloom.operators import tree
from docloom.operators.tree import ARTEFACTS, is_useful, nodes
from docloom.session import exists, shared_folder

#: Words in headings of sections that verify something, at all and after installing, and that prepare something.
VERIFYING = ["verify", "validation", "validate", "check", "checks", "expected output", "output", "install helm chart", "post installation", "post-install"]
VERIFYING_INSTALL = ["install helm chart", "verify", "validation", "check"]
PREPARING = ["prereq", "preparation", "requirements"]
#: Weights of shared terms by field; characters of the content that count.
FIELD_WEIGHTS, CONTENT_CHARS = {"heading": 12, "path": 8, "title": 6, "content": 4}, 1600
FIELD_BITS = {"heading": 1, "path": 2, "title": 4, "content": 8, "whole": 16}
FLAGS = [*(f"has_{c}" for c in ARTEFACTS), "verifies", "prepares", "verifies_install"]
TABLES = ("rows", "postings", "terms", "keys", "ancestors", "closure")


@dataclass
class Index(tree.Nodes):
    """Tables of an index: ``rows`` (each section once, with flags), ``postings`` (term, section_id, weight, fields, tf, length), ``terms`` (term, df), ``keys`` (kind,
    key, shown: headings and titles), ``ancestors`` and ``closure`` as the tree has them; the number of sections and the mean of their words."""

    postings: DataFrame
    terms: DataFrame
    keys: DataFrame
    count: int
    mean: float
    folder: str


def path_text(path: str | Column = "heading_path") -> Column:
    return F.coalesce(F.array_join(path, " > "), F.lit(""))


def retrieval_content() -> Column:
    """The text a section is found by: title, path, heading, artefacts (some in part) and content under labels."""

    def part(label: str, column: str, glue: str, most: int) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(label), F.array_join(F.slice(column, 1, most) if most else F.col(column), glue)))

    labelled = (("Document title: ", F.col("doc_title")), ("Heading path: ", path_text()), ("Heading: ", F.col("heading")))
    lead = [F.concat(F.lit(label), F.coalesce(x, F.lit(""))) for label, x in labelled]
    body = F.trim(F.regexp_replace(F.coalesce("raw_content", F.lit("")), r"^\s+|\s+\z", ""))
    artefacts = [part("Commands:\n", "commands", "\n", 0), part("Outputs:\n", "outputs", "\n", 3), part("YAML:\n", "yamls", "\n\n", 2), part("Steps:\n", "steps", "\n", 8)]
    return F.concat_ws("\n\n", *lead, *artefacts, F.when(body != "", F.concat(F.lit("Content:\n"), body)))


def _flags() -> list[Column]:
    empty = F.array().cast("array<string>")
    has = [(F.size(F.coalesce(F.col(c), empty)) > 0).alias(f"has_{c}") for c in ARTEFACTS]
    heading = normalized("heading")
    return [*has, contains_any(heading, VERIFYING).alias("verifies"), contains_any(heading, PREPARING).alias("prepares"), contains_any(heading, VERIFYING_INSTALL).alias("verifies_install"), is_useful().alias("useful")]


def _postings(rows: DataFrame) -> DataFrame:
    """Of each section and term: the weight of the fields that have it, those fields as bits, how often it comes and the section's number of words."""
    content = F.coalesce("raw_content", F.lit(""))
    texts = {"heading": F.col("heading"), "path": path_text(), "title": F.col("doc_title"), "content": F.substring(content, 1, CONTENT_CHARS), "whole": content}

    def said(words: Column, weight: int, bit: int, tf: int) -> Column:
        return F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight"), F.lit(bit).alias("fields"), F.lit(tf).alias("tf")))

    fields = [said(F.array_distinct(terms(text)), FIELD_WEIGHTS.get(name, 0), FIELD_BITS[name], 0) for name, text in texts.items()]
    every = rows.withColumn("words", terms(retrieval_content(), [])).select("section_id", F.size("words").alias("length"), F.explode(F.concat(*fields, said(F.col("words"), 0, 0, 1))).alias("p"))
    sums = [F.sum("p.weight").cast("int").alias("weight"), F.bit_or("p.fields").alias("fields"), F.sum("p.tf").cast("int").alias("tf")]
    return every.groupBy(F.col("p.term").alias("term"), "section_id", "length").agg(*sums)


def build_index(sections: DataFrame, folder: str | None = None) -> Index:
    """Build and store the index of sections.  Copies of a row count once; of rows of one id that differ, one is taken."""
    spark = sections.sparkSession
    folder = folder or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    base = nodes(sections, "file_path", "doc_title", "page_url", "heading", "level", "heading_path", "raw_content", *ARTEFACTS)
    rows = keep("rows", base.select("*", *_flags(), F.size(terms(retrieval_content(), [])).alias("length")))
    # sections stay together: their terms are summed where they are, here and when a batch of queries meets them
    postings = keep("postings", _postings(rows.repartition("section_id")))
    keep("terms", postings.where("tf > 0").groupBy("term").agg(F.count("*").alias("df")))
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("shown")) for kind, c in (("heading", "heading"), ("title", "doc_title"))))
    named = rows.select("section_id", F.explode(kinds).alias("k")).select("section_id", "k.kind", "k.shown").where("shown <> ''").withColumn("key", normalized("shown")).where("key <> ''")
    keep("keys", named.groupBy("kind", "key").agg(F.min_by("shown", "section_id").alias("shown")))
    ancestors = keep("ancestors", tree.with_ancestors(rows))
    useful = rows.where("useful").select(F.col("section_id").alias("descendant"), "useful")
    closure = tree.closure(tree.Nodes(rows, ancestors, None)).join(useful, "descendant", "left").withColumn("useful", F.coalesce("useful", F.lit(False)))
    keep("closure", closure)
    found = rows.agg(F.count("*").alias("count"), F.avg("length").alias("mean")).first()
    spark.createDataFrame([(json.dumps({"count": found["count"], "mean": found["mean"] or 0.0}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/stats")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
    stats = json.loads(spark.read.text(f"{folder}/stats").first()[0])
    return Index(**tables, **stats, folder=folder)


class Engine:
    """Indexes by the path of their sections, one build of a path at a time; a failed build leaves the index before it.

    ``eager`` builds at once, as a service does at its start; otherwise the first use does.
    """

    def __init__(self, spark: SparkSession, eager: list[str] = ()):
        self.spark, self.known, self.errors, self.lock = spark, {}, {}, threading.Lock()
        for path in eager:
            self.index(path)

    def index(self, path: str, force: bool = False) -> Index:
        with self.lock:
            if force or path not in self.known or not exists(self.spark, self.known[path].folder):
                try:
                    self.known[path] = build_index(self.spark.read.parquet(path))
                    self.errors.pop(path, None)
                except Exception as error:
                    self.errors[path] = str(error)
                    raise
            return self.known[path]

    def status(self, path: str) -> dict:
        """What a health or readiness check says; it never builds."""
        own = self.known.get(path)
        return {"ready": own is not None, "sections": own.count if own else 0, "last_error": self.errors.get(path)}


_engines: dict[str, Engine] = {}


def engine(spark: SparkSession) -> Engine:
    """The engine of this application."""
    return _engines.setdefault(spark.sparkContext.applicationId, Engine(spark))
