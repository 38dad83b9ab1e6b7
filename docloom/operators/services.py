"""Embedding and text generation as pluggable services, called for whole batches on the executors, and what is built on vectors.

A service is any object with ``embed(texts) -> list of vectors`` or ``generate(prompts) -> list of answers``; it is pickled to the
executors, so that it opens its connections there.  ``HashedEmbedder`` needs no network: it hashes terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import TERM, profile_terms
from docloom.operators.index import retrieval_content
from docloom.operators.search import vector_search
from docloom.session import kept

#: Texts a service gets at a time, dimensions of hashed vectors, and seconds a service may take for a check and for work.
EMBED_AT_ONCE, DIMENSIONS, CHECK_SECONDS, WORK_SECONDS = 32, 384, 15, 120


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class HashedEmbedder:
    """Vectors of signed counts of a text's terms, hashed to dimensions, of length one; a text without terms has zeros."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re

        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for term in re.findall(TERM, (text or "").lower()):
                code = int.from_bytes(blake2b(term.encode(), digest_size=8).digest(), "little")
                row[code % self.dimensions] += 1 if code >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms, norms, 1)).tolist()


class Extracts:
    """A generator that says what its prompt says, for use where there is none."""

    def generate(self, prompts: list[str]) -> list[str]:
        return list(prompts)


def healthy(service) -> bool:
    """Whether a service answers for one text."""
    try:
        call = service.embed if hasattr(service, "embed") else service.generate
        return len(call(["check"])) == 1
    except Exception:
        return False


def _called(df: DataFrame, key: str, text: str, call, kind: str, made: str, arrow: pa.DataType, at_once: int) -> DataFrame:
    own = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = [t or "" for t in batch.column(1).to_pylist()], []
            for start in range(0, len(texts), at_once):
                block = texts[start : start + at_once]
                given = call(block)
                if len(given) != len(block):
                    raise ValueError(f"the service gave {len(given)} results for {len(block)} texts")
                out += given
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow)], names=[key, made])

    return df.select(key, text).mapInArrow(run, f"`{key}` {own}, {made} {kind}")


def embedded(df: DataFrame, key: str, text: str, embedder: Embedder, at_once: int = EMBED_AT_ONCE) -> DataFrame:
    """(key, embedding): a vector for each text."""
    return _called(df, key, text, embedder.embed, "array<float>", "embedding", pa.list_(pa.float32()), at_once)


def generated(df: DataFrame, key: str, prompt: str, generator: Generator, at_once: int = 8) -> DataFrame:
    """(key, generated): an answer for each prompt."""
    return _called(df, key, prompt, generator.generate, "string", "generated", pa.string(), at_once)


def section_vectors(sections, embedder: Embedder) -> DataFrame:
    """(section_id, embedding) of the retrieval content of an index's sections."""
    return embedded(sections.rows.select("section_id", retrieval_content().alias("text")), "section_id", "text", embedder)


def vector_ranking(queries: DataFrame, vectors: DataFrame, embedder: Embedder, key: str = "section_id", top: int = 12) -> DataFrame:
    """(query_id, key, score, rank): the rows whose vectors are nearest to that of each query; what hybrid search takes as ``vectors``."""
    asked = kept(embedded(queries, "query_id", "text", embedder))
    return vector_search(vectors, asked, key, "embedding", top, same=False)


def expanded(queries: DataFrame, generator: Generator | None, most: int = 3) -> DataFrame:
    """(query_id, variant, text): each query and up to ``most`` other wordings of it, from a generator that answers with a JSON list; without one, or where it says none, the query alone."""
    own = queries.select("query_id", F.lit(0).alias("variant"), "text")
    if generator is None:
        return own
    ask = F.concat(F.lit(f"Give {most} other wordings of this question as a JSON list of strings: "), F.coalesce("text", F.lit("")))
    said = generated(queries.select("query_id", ask.alias("prompt")), "query_id", "prompt", generator)
    listed = F.slice(F.coalesce(F.from_json("generated", "array<string>"), F.array().cast("array<string>")), 1, most)
    more = said.select("query_id", F.posexplode(listed).alias("at", "text")).where("trim(text) <> ''")
    return own.unionByName(more.select("query_id", (F.col("at") + 1).alias("variant"), "text"))


def multi_query(variants: DataFrame, vectors: DataFrame, texts: DataFrame, embedder: Embedder, key: str = "section_id", each: int = 5, top: int = 5, strong: int = 2) -> DataFrame:
    """(query_id, key, overlap, score, rank): each document found by any wording (query_id, variant, text), with its greatest score; by shared terms with the
    query itself and score; if at least two share ``strong`` terms or more, only such.  ``texts`` are (key, text)."""
    numbered = kept(variants.withColumn("wording", F.row_number().over(Window.orderBy("query_id", "variant")).cast("bigint")))  # as many as the batch has wordings
    found = vector_ranking(numbered.select(F.col("wording").alias("query_id"), "text"), vectors, embedder, key, each).withColumnRenamed("query_id", "wording")
    best = found.join(numbered.select("wording", "query_id"), "wording").groupBy("query_id", key).agg(F.max("score").alias("score"))
    asked = variants.where("variant = 0").select("query_id", F.array_distinct(profile_terms("text", "chunks")).alias("asked"))
    rows = best.join(texts.select(key, F.col("text").alias("held")), key).join(asked, "query_id")
    rows = rows.select("query_id", key, F.size(F.array_intersect("asked", profile_terms("held", "chunks"))).alias("overlap"), "score")
    many = F.count_if(F.col("overlap") >= strong).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("many", many).where((F.col("many") < 2) | (F.col("overlap") >= strong)).drop("many")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("score"), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def ask(queries: DataFrame, texts: DataFrame, vectors: DataFrame, embedder: Embedder, generator: Generator, key: str = "section_id", top: int = 5) -> DataFrame:
    """(query_id, answer, sources): plain retrieval by vectors: a generator answers from the nearest texts (key, text, source); sources are distinct and sorted."""
    found = vector_ranking(queries, vectors, embedder, key, top).join(texts, key)
    held = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("held"), F.array_sort(F.collect_set("source")).alias("sources"))
    rows = queries.join(held, "query_id", "left")
    context = F.array_join(F.transform(F.coalesce("held", F.array().cast("array<struct<rank:int,text:string>>")), lambda x: x["text"]), "\n\n")
    prompts = rows.select("query_id", "sources", F.concat(F.lit("Answer from this context only.\n\n"), context, F.lit("\n\nQuestion: "), F.coalesce("text", F.lit(""))).alias("prompt"))
    said = generated(prompts, "query_id", "prompt", generator)
    return prompts.join(said, "query_id").select("query_id", F.col("generated").alias("answer"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
