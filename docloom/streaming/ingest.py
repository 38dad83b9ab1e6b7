"""Incremental ingestion: discovered URLs as a stream, each page once, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import urls as U


def url_stream(spark: SparkSession, place: str, schema) -> DataFrame:
    """Discovered URLs that arrive as parquet files in a directory; a single file is streamed from the one it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        reader, place = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    return reader.parquet(place).withColumn("found_at", F.col("found_at").cast("timestamp"))


def new_pages(stream: DataFrame, lateness: str = "10 days") -> DataFrame:
    """(page_url, found_at): pages not met before, within the watermark; query and fragment don't count."""
    rows = stream.where("url is not null").select(U.stripped("url").alias("page_url"), "found_at")
    return rows.withWatermark("found_at", lateness).dropDuplicatesWithinWatermark(["page_url"])


def arrivals(stream: DataFrame, width: str = "1 day", lateness: str = "10 days") -> DataFrame:
    """(start, source, urls): numbers of discoveries by window of time and source, late ones within the watermark counted."""
    rows = stream.withWatermark("found_at", lateness)
    return rows.groupBy(F.window("found_at", width), "source").agg(F.count("*").alias("urls")).select(F.col("window.start").alias("start"), "source", "urls")


def run_once(frame: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop; the checkpoint lets the next run go on from there."""
    frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
