"""Files: Markdown folders with sidecars, URL lists, HTML folders, sitemaps; and what is written."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.arrowmap import map_batches

URL_ROW = "url string, source string, depth int, path_depth int, `from` string"


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, folder, text) of all *.md files below a path; an error if there are none."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
    if rows.isEmpty():
        raise FileNotFoundError(f"no Markdown files below {path}")
    return rows.withColumn("folder", F.regexp_replace("file_path", "/[^/]*$", ""))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(folder, title, page_url, page_id, valid) of all meta.json files below a path; a broken one has nulls."""
    schema = "title string, page_url string, url string, page_id string"
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="meta.json").select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"), F.from_json("value", schema).alias("m"), F.get_json_object("value", "$").isNotNull().alias("ok"))
    return rows.select("folder", F.nullif(F.col("m.title"), F.lit("")).alias("title"), F.coalesce(F.nullif(F.col("m.page_url"), F.lit("")), F.nullif(F.col("m.url"), F.lit(""))).alias("page_url"), "m.page_id", F.coalesce(F.col("m").isNotNull() & F.col("ok"), F.lit(False)).alias("valid"))


def markdown_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, text, doc_title, page_url): title from the sidecar, else the first heading of level one, else the file's name."""
    rows = markdown_folder(spark, path).join(sidecars(spark, path).drop("valid"), "folder", "left")
    heading = F.nullif(F.trim(F.regexp_extract("text", r"(?m)^\s*#[ \t]+(.*)$", 1)), F.lit(""))
    stem = F.regexp_extract("file_path", r"([^/]*)\.md$", 1)
    return rows.select("file_path", "text", F.coalesce("title", heading, stem).alias("doc_title"), "page_url")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, source): of a JSON-lines file or a plain list (# begins a comment); broken JSON lines and blank ones are dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    parsed = lines.select("line", F.from_json("line", URL_ROW).alias("row"))
    json = parsed.where("startswith(line, '{') and row.url is not null").select(F.col("row.url").alias("url"), F.coalesce("row.source", F.lit("unknown")).alias("source"))
    return json.unionByName(parsed.where("not startswith(line, '{')").select(F.col("line").alias("url"), F.lit("txt").alias("source")))


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, loc): entries of sitemap files, gzip by ending; kind is index or urlset."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    kind = F.when(F.col("value").rlike(r"<sitemapindex[\s>]"), "index").otherwise("urlset")
    return rows.select("file", kind.alias("kind"), F.explode(F.regexp_extract_all("value", F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))).alias("loc")).withColumn("loc", F.replace("loc", F.lit("&amp;"), F.lit("&")))


def sitemap_tree(spark: SparkSession, root: str, stored: str, deepest: int = 5) -> DataFrame:
    """(loc) of all urlsets that a sitemap leads to: an index's entries are files in ``stored`` by the last part of their URL; no file is read twice."""
    name = F.regexp_extract("loc", r"([^/]+)/*$", 1)
    entries, read, out = sitemap_urls(spark, root), {root.rsplit("/", 1)[-1]}, None
    for _ in range(deepest):
        pages = entries.where("kind = 'urlset'").select("loc")
        out = pages if out is None else out.unionByName(pages)
        files = sorted({r[0] for r in entries.where("kind = 'index'").select(name).distinct().collect()} - read - {""})  # as many as sitemap files
        read.update(files)
        if not files:
            break
        entries = sitemap_urls(spark, [f"{stored}/{f}" for f in files])
    return out.distinct()


def html_folder(spark: SparkSession, path: str) -> DataFrame:
    """(folder, title, page_url, page_id, page_html, export_view_html, url_export_view_html) of the page folders below a path that have a valid meta.json."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html").select(F.col("_metadata.file_path").alias("file"), "value")
    rows = rows.withColumn("folder", F.regexp_replace("file", "/[^/]*$", "")).withColumn("name", F.regexp_extract("file", r"([^/]*)\.html$", 1))
    names = {"page": "page_html", "export_view": "export_view_html", "url_export_view": "url_export_view_html"}
    pages = rows.groupBy("folder").agg(*(F.max(F.when(F.col("name") == k, F.col("value"))).alias(v) for k, v in names.items()))
    valid = sidecars(spark, path).where("valid").drop("valid")
    return valid.join(pages, "folder")


def load_config(path: str) -> dict:
    """Settings from a YAML file, where a YAML reader is installed, or from a JSON file."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("no YAML reader is installed; write the settings as JSON") from error
    return yaml.safe_load(text) or {}


def rest_export_view(body: str | Column, title: str | Column) -> tuple[Column, Column, Column]:
    """Of the body of a REST answer: the export view's HTML, the title (its own before the given one), and an error where there is no HTML."""
    body = F.col(body) if isinstance(body, str) else body
    title = F.col(title) if isinstance(title, str) else title
    html = F.nullif(F.get_json_object(body, "$.body.export_view.value"), F.lit(""))
    return html, F.coalesce(F.nullif(F.get_json_object(body, "$.title"), F.lit("")), title), F.when(html.isNull(), F.lit("no export view in the answer"))


#: Keys one of which trailing metadata has.
TRAILING_KEYS = ("title", "page_url", "page_id", "files", "html_file")


def trailing_metadata(text: str) -> tuple[str, dict]:
    """A text without the JSON object of metadata it ends with, and that object; the whole text and nothing if there is none."""
    bare = text.rstrip()
    if bare.endswith("}"):
        at = bare.rfind("{")
        while at >= 0:
            try:
                found = json.loads(bare[at:])
            except ValueError:
                found = None
            if isinstance(found, dict) and any(k in found for k in TRAILING_KEYS):
                return bare[:at].rstrip(), found
            at = bare.rfind("{", 0, at)
    return text, {}


def with_trailing_metadata(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content, metadata): texts apart from the JSON metadata they end with, which is null where there is none."""
    kind = texts.schema[key].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(None, {}) if t is None else trailing_metadata(t) for t in batch.column(1).to_pylist()]
        held = [json.dumps(m, ensure_ascii=False, sort_keys=True) if m else None for _, m in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.string()), pa.array(held, pa.string())], names=[key, "content", "metadata"])

    return map_batches(texts.select(key, text), lambda: step, f"`{key}` {kind}, content string, metadata string")


def cleaned(text: str | Column) -> Column:
    """A Markdown text for indexing: carriage returns as lines, blanks at line ends gone, runs of empty lines as one, trimmed."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_pages(pages: DataFrame, path: str, by: str | None = None) -> None:
    """Pages as parquet, in folders by a column if one is given."""
    writer = pages.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def merged_meta(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: of each column the last value that isn't null, by ``order``."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others))


def write_page_folders(pages: DataFrame, path: str, columns: tuple[str, ...] = ("page_html", "export_view_html"), text: str | None = None) -> None:
    """Pages by folder (a column) with their files and what is known of them as ``meta``, in one table in place of a folder of small files for each page.

    ``columns`` are the files' contents; with ``text`` that column is written as the page's Markdown.
    """
    others = [c for c in pages.columns if c not in (*columns, text, "folder")]
    files = [F.when(F.col(c) != "", F.lit(f"{c.removesuffix('_html')}.html")).alias(c) for c in columns] + ([F.lit("page.md").alias("markdown")] if text else [])
    made = pages.select("folder", *columns, *([F.col(text).alias("markdown")] if text else []), F.to_json(F.struct(*others, F.struct(*files).alias("files"))).alias("meta"))
    made.write.mode("overwrite").parquet(path)


def write_vectors(vectors: DataFrame, path: str, vector: str = "embedding") -> None:
    """A vector store: keys and vectors as arrays of floats."""
    vectors.withColumn(vector, F.col(vector).cast("array<float>")).write.mode("overwrite").parquet(path)
