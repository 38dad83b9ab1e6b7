"""The pN_ queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import encode, leakage, lookalike, near_duplicates, repeated_lines, residue, splitting
from docloom.sources import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary; the folder is a parameter (DOCLOOM_TOKENIZERS) with the package's own as default."""
    import os

    if folder := os.environ.get("DOCLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "sections"), text=False).where("pieces > 1").select("section_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "sections"))


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """For every oversized section: its pieces put together again without their overlaps, as a digest, and whether all keep to the limit and overlap."""
    made = splitting.split_oversized(table(spark, d, "sections"))
    own = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.substring("piece", splitting.OVERLAP + 1, splitting.LIMIT))
    whole = made.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own"), "start", "piece"))).alias("p"), F.max("length").alias("longest"))
    shared = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i)["start"] + splitting.OVERLAP == F.get("p", i - 1)["start"] + F.length(F.get("p", i - 1)["piece"]))
    return whole.select("section_id", F.md5(F.array_join(F.transform("p", lambda x: x["own"]), "")).alias("digest"), ((F.col("longest") <= splitting.LIMIT) & shared).alias("fits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_fetches(table(spark, d, "pages_raw"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "pages_raw"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.main_pieces(table(spark, d, "pages_raw"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = near_duplicates.alike_pairs(*near_duplicates.near_duplicate_texts(near_duplicates.sections_as_rows(table(spark, d, "sections"))), full=True)
    return found.select(F.col("id_a").alias("section_id_a"), F.col("id_b").alias("section_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    found = near_duplicates.classes(*near_duplicates.near_duplicate_texts(near_duplicates.sections_as_rows(table(spark, d, "sections"))))
    return found.withColumnRenamed("id", "section_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.frequent_lines(table(spark, d, "sections"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_frequent_lines(table(spark, d, "sections"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_column(table(spark, d, "documents"), vocabulary())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """For every item that leaked: the number of documents and places."""
    found = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.sum("places").alias("places"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


def p8_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_groups(table(spark, d, "documents"))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_text(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    own = [p1_found, p1_pieces, p1_rebuilt, p2_found, p2_clean, p3_found, p4_found, p4_groups, p5_found, p5_clean, p6_ids, p7_found, p7_report, p8_found, p8_groups, p8_canonical]
    return {f.__name__: f for f in own}
