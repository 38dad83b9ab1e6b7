"""All queries of the core by name.  Each takes (spark, directory) and reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.operators import answers as A
from docloom.operators import crawl, extract, grounded, html_markdown, scored, search, services, tree
from docloom.operators import index as indexes
from docloom.questions import QUESTIONS
from docloom.session import kept, shared_folder
from docloom.sources import table

FLAGSHIP = "hybrid_search"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Parameters of the filters: pages are wanted, labels and attachments aren't.
ALLOW, DENY = [r"/wiki/spaces/", r"/pages/\d+"], [r"/label/", r"/download/", r"\.pdf$"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from docloom.oracle import SQL

    return {name: sql for name, sql in SQL.items() if name in QUERIES}


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The batch of questions: all evaluation items."""
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text").dropDuplicates(["query_id"])


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation items, questions of each intent, and one for the output of installing the first name that a helm command installs."""
    own = spark.createDataFrame([(-1 - i, text) for i, text in enumerate(QUESTIONS)], "query_id long, text string")
    return asked(spark, d).unionByName(own).unionByName(install_questions(spark, d).orderBy("text").limit(1).withColumn("query_id", F.lit(-100).cast("bigint")))


def index_of(spark: SparkSession, d: str) -> indexes.Index:
    """The stored index of the sections, built by the application's first query that needs it."""
    return indexes.engine(spark).index(f"{d}/sections.parquet")


def batch_of(spark: SparkSession, d: str, rows: DataFrame | None = None) -> search.Batch:
    return search.understood(kept(questions(spark, d)) if rows is None else rows, index_of(spark, d))


def first_domain(found: DataFrame) -> str:
    return found.where(U.authority("url") != "").agg(F.min(U.authority("url"))).first()[0] or ""


# --- URLs -------------------------------------------------------------------------------------------------------


@query
def url_parts(spark, d):
    rows = table(spark, d, "discovered_urls").select("url_id", "url").distinct()
    return rows.select("url_id", U.stripped("url").alias("stripped"), U.normal("url").alias("normal"), U.authority("url").alias("host"), U.path_depth("url").alias("depth"), U.page_id("url").alias("page_id"))


@query
def url_split_internal(spark, d):
    found = table(spark, d, "discovered_urls").distinct()
    return crawl.by_domain(found, first_domain(found)).groupBy("kind", "source").agg(F.count("*").alias("urls"), F.countDistinct("url").alias("distinct_urls"))


@query
def url_allow_deny(spark, d):
    return table(spark, d, "discovered_urls").where(U.allowed("url", ALLOW, DENY)).select("url_id", "url").distinct()


@query
def url_export_view(spark, d):
    return table(spark, d, "discovered_urls").select("url_id", U.export_view("url").alias("export_url")).distinct()


@query
def url_requests(spark, d):
    return crawl.requests(table(spark, d, "discovered_urls"))


@query
def url_external_captures(spark, d):
    found = table(spark, d, "discovered_urls").distinct()
    return crawl.external_captures(found.where("source = 'external_l1'"), [first_domain(found)], 4).select("url_id", "url", "depth")


@query
def url_sources(spark, d):
    rows = table(spark, d, "discovered_urls").distinct()
    return rows.groupBy("source").agg(F.count("*").alias("urls"), F.countDistinct(U.normal("url")).alias("pages"), F.max("depth").alias("deepest"))


@query
def crawl_frontier(spark, d):
    return crawl.frontier(table(spark, d, "discovered_urls"))


# --- pages ------------------------------------------------------------------------------------------------------


@query
def page_folders(spark, d):
    return table(spark, d, "pages_raw").select("fetch_id", U.folder_key("title", "page_url").alias("folder"), U.short_hash("page_url", "title").alias("hash")).distinct()


@query
def page_best_html(spark, d):
    return html_markdown.best_source(table(spark, d, "pages_raw")).select("fetch_id", "html_source", F.length("html").alias("chars"))


@query
def page_latest(spark, d):
    rows = table(spark, d, "pages_raw").where("page_html <> ''")
    return rows.groupBy("page_url").agg(F.max_by("fetch_id", F.struct("fetched_at", "fetch_id")).alias("fetch_id"), F.countDistinct("fetch_id").alias("fetches"))


@query
def page_errors(spark, d):
    rows = table(spark, d, "pages_raw").select("fetch_id", "status", "rest_export_view", "url_export_view").distinct()
    return rows.groupBy("status").agg(F.count("*").alias("fetches"), F.count_if("rest_export_view.attempted").alias("rest_attempts"), F.count("rest_export_view.error").alias("rest_errors"), F.count("url_export_view.error").alias("url_errors"))


@query
def page_failures(spark, d):
    return crawl.failures(table(spark, d, "pages_raw"))


@query
def page_crawl(spark, d):
    """A crawl over the stored pages from the sitemap's URLs, on the seeds' hosts."""
    seeds = table(spark, d, "discovered_urls").where("source = 'sitemap'").select("url").distinct()
    hosts = sorted(r[0] for r in seeds.select(U.authority("url")).distinct().collect() if r[0])
    return crawl.crawl_pages(table(spark, d, "pages_raw"), seeds, hosts, deny=DENY)


@query
def sitemap_pages(spark, d):
    found = table(spark, d, "discovered_urls").where("source = 'sitemap'").select(F.col("url").alias("loc"))
    return crawl.sitemap_pages(found, [first_domain(table(spark, d, "discovered_urls"))], ALLOW, DENY, 8)


@query
def page_embedded_links(spark, d):
    """Links in JSON of pages; each page's own URLs stand behind it as an editor embeds them, as pages here hold no such links."""
    own = F.concat(F.coalesce("page_html", F.lit("")), F.lit('{"attrs": {"href": "'), F.replace("page_url", F.lit("/"), F.lit("\\/")), F.lit('"}, "url":"'), F.col("requested_url"), F.lit('"}'))
    return table(spark, d, "pages_raw").select("fetch_id", F.explode(U.embedded_links(own)).alias("link")).distinct()


@query
def page_links(spark, d):
    return html_markdown.links(table(spark, d, "pages_raw"))


@query
def page_markdown(spark, d):
    return html_markdown.convert(table(spark, d, "pages_raw"))


@query
def page_markdown_sections(spark, d):
    pages = html_markdown.convert(table(spark, d, "pages_raw"))
    return tree.parse_markdown(pages, "fetch_id", "markdown", F.lit("Document"))


@query
def page_stats(spark, d):
    rows = table(spark, d, "pages_md").select("page_url", "scope_used", "html_source", F.explode("stats").alias("part", "n"))
    return rows.distinct().groupBy("scope_used", "part").agg(F.count("*").alias("pages"), F.sum("n").alias("total"))


# --- text -------------------------------------------------------------------------------------------------------


@query
def text_normalized(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalized("text")).alias("digest"), F.length(T.normalized("text")).alias("chars"))


@query
def text_terms(spark, d):
    return asked(spark, d).select("query_id", T.terms("text").alias("terms"))


@query
def text_term_frequencies(spark, d):
    rows = table(spark, d, "documents").select(F.explode(F.array_distinct(T.terms("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("documents"))


@query
def text_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("at", "sentence"))


@query
def text_excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt("text").alias("excerpt"))


@query
def text_urls(spark, d):
    return tree.nodes(table(spark, d, "sections"), "raw_content").select("section_id", F.explode(T.urls("raw_content")).alias("url"))


@query
def text_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.word_windows("text")).alias("window", "content"))


# --- extraction -------------------------------------------------------------------------------------------------


@query
def fenced_blocks(spark, d):
    return extract.fenced_blocks(table(spark, d, "sections"))


@query
def numbered_steps(spark, d):
    return tree.nodes(table(spark, d, "sections"), "raw_content").select("section_id", F.posexplode(extract.steps_of("raw_content")).alias("at", "step"))


@query
def yaml_islands(spark, d):
    return extract.yaml_blocks(table(spark, d, "sections"))


@query
def output_islands(spark, d):
    """Command outputs in running text; the tables' last column is named as the rules know it, as no section names it so."""
    text = F.replace("raw_content", F.lit("NAME READY AGE"), F.lit("NAME READY STATUS"))
    return extract.output_blocks(table(spark, d, "sections").withColumn("raw_content", text))


@query
def section_commands(spark, d):
    return extract.section_commands(table(spark, d, "sections"))


@query
def section_artefacts(spark, d):
    return extract.section_artefacts(table(spark, d, "sections"))


@query
def install_commands(spark, d):
    rows = tree.nodes(table(spark, d, "sections"), "commands").select("section_id", F.explode("commands").alias("raw"))
    return rows.select("section_id", T.shell_command("raw").alias("command"), T.installs("raw").alias("installs")).distinct()


@query
def block_kinds(spark, d):
    rows = extract.fenced_blocks(table(spark, d, "sections")).join(tree.nodes(table(spark, d, "sections"), "heading"), "section_id")
    return rows.select("section_id", "block_no", extract.block_kind("lang", "content", "heading").alias("kind"))


@query
def block_documents(spark, d):
    return extract.block_documents(table(spark, d, "sections")).select("section_id", "doc_type", "block_type", "block_lang", "block_index", "topic_tags", F.length("body").alias("body_chars"), F.md5("content").alias("content_md5"))


@query
def fenced_places(spark, d):
    return extract.fenced_places(table(spark, d, "sections"))


@query
def section_commands_routed(spark, d):
    return extract.section_commands(table(spark, d, "sections"), rules=extract.routed)


@query
def flat_sections(spark, d):
    return tree.parse_flat(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "section_index", "heading", "heading_level", F.length("content").alias("chars"))


@query
def topic_tags(spark, d):
    rows = tree.nodes(table(spark, d, "sections"), "doc_title", "heading", "raw_content")
    return rows.select("section_id", F.explode(extract.topic_tags("doc_title", "heading", "raw_content")).alias("tag"))


# --- tree -------------------------------------------------------------------------------------------------------


@query
def markdown_sections(spark, d):
    rows = tree.parse_markdown(table(spark, d, "documents"), "doc_id", "text", F.lit("Document"))
    return rows.select("doc_id", "section_seq", "level", "heading", F.length("raw_content").alias("chars"))


@query
def section_parents(spark, d):
    return tree.with_ancestors(table(spark, d, "sections")).select("section_id", "parent", F.size("ancestors").alias("depth"))


@query
def section_descendants(spark, d):
    return tree.closure(table(spark, d, "sections")).groupBy(F.col("ancestor").alias("section_id")).agg(F.count("*").alias("descendants"), F.max("distance").alias("deepest"))


@query
def section_useful_descendants(spark, d):
    return tree.useful_descendants(table(spark, d, "sections")).select("ancestor", "descendant", "distance")


@query
def section_siblings(spark, d):
    return tree.siblings(table(spark, d, "sections"))


@query
def section_neighbours(spark, d):
    return tree.neighbours(table(spark, d, "sections"))


@query
def section_structural_neighbours(spark, d):
    return tree.structural_neighbours(table(spark, d, "sections"))


# --- retrieval --------------------------------------------------------------------------------------------------


@query
def index_build(spark, d):
    """Builds the application's index of the sections anew and tells what its tables hold."""
    own = indexes.engine(spark).index(f"{d}/sections.parquet", force=True)
    held = own.postings.agg(F.count("*").alias("postings"), F.sum("tf").alias("words"), F.sum("weight").alias("weights"))
    more = [own.terms.agg(F.count("*").alias("terms")), own.keys.agg(F.count("*").alias("keys")), own.closure.agg(F.count("*").alias("closure"), F.count_if("useful").alias("useful"))]
    for part in more:
        held = held.join(part)  # one row each
    return held.withColumn("sections", F.lit(own.count).cast("bigint"))


@query
def query_intents(spark, d):
    return search.intents(questions(spark, d))


@query
def query_subjects(spark, d):
    return search.subjects(questions(spark, d), index_of(spark, d))


@query
def overlap_top(spark, d):
    return search.ranked(search.overlap_scores(batch_of(spark, d)), 10)


@query
def subject_points(spark, d):
    return search.subject_points(batch_of(spark, d))


@query
def lexical_search(spark, d):
    return search.lexical_search(batch_of(spark, d))


@query
def bm25_search(spark, d):
    return search.bm25_search(batch_of(spark, d))


@query
def vector_search(spark, d):
    vectors = table(spark, d, "embeddings")
    return search.vector_search(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query
def scores_minmax(spark, d):
    return search.minmax(bm25_search(spark, d), ["query_id"]).select("query_id", "section_id", F.round("scaled", 5).alias("scaled"))


@query
def ranks_fused(spark, d):
    batch = batch_of(spark, d)
    both = search.lexical_search(batch).select("query_id", "section_id", "rank").unionByName(search.bm25_search(batch).select("query_id", "section_id", "rank"))
    return search.rrf(both).select("query_id", "section_id", F.round("rrf", 9).alias("rrf"))


@query
def hybrid_ranking(spark, d):
    return search.combined(batch_of(spark, d))


@query
def anchor_sections(spark, d):
    batch = batch_of(spark, d)
    return search.anchors(batch, kept(search.combined(batch)))


@query
def hybrid_search(spark, d):
    return search.hybrid_search(batch_of(spark, d))


def install_questions(spark, d):
    """A question for each name that a section's helm command installs: what comes out of installing it.  Its id is a number made of the name."""
    rows = tree.nodes(table(spark, d, "sections"), "commands").select("section_id", F.explode("commands").alias("command"))
    names = rows.select(F.regexp_extract("command", r"helm install ([a-zA-Z0-9._-]+)", 1).alias("name")).where("name <> ''").distinct()
    key = F.conv(F.substring(F.md5("name"), 1, 12), 16, 10).cast("bigint")
    return names.select(key.alias("query_id"), F.concat(F.lit("what output should i expect when i install "), F.col("name")).alias("text"))


@query
def command_matches(spark, d):
    return search.command_matches(batch_of(spark, d, kept(install_questions(spark, d))))


@query
def output_bridge(spark, d):
    return search.output_bridge(batch_of(spark, d, kept(install_questions(spark, d))))


@query
def subject_tiers(spark, d):
    batch = batch_of(spark, d)
    return A.subject_tiers(search.lexical_search(batch), batch.wanted, batch.index)


@query
def require_filter(spark, d):
    batch = batch_of(spark, d)
    return A.requiring(kept(search.bm25_search(batch)), kept(search.subject_points(batch)), batch.index, "yamls")


# --- answers ----------------------------------------------------------------------------------------------------


def chosen(spark, d):
    return kept(bm25_search(spark, d).where("rank <= 10").select("query_id", "section_id", "rank"))


@query
def answer_commands(spark, d):
    return A.collected(chosen(spark, d), index_of(spark, d), "commands")


@query
def answer_sources(spark, d):
    return A.sources(chosen(spark, d), index_of(spark, d))


@query
def answer_sentences(spark, d):
    return A.best_sentences(chosen(spark, d), questions(spark, d), index_of(spark, d))


@query
def answer_subtopics(spark, d):
    tops = tree.nodes(table(spark, d, "sections"), "level").where("level = 1").select(F.col("section_id").alias("query_id"), "section_id")
    return A.by_subtopic(tops, index_of(spark, d))


@query
def answer_groups(spark, d):
    batch = batch_of(spark, d)
    found = kept(search.lexical_search(batch, 20))
    return A.grouped_commands(batch, found.where("rank <= 10").select("query_id", "section_id", "rank"), kept(search.anchors(batch, found)))


@query
def answers(spark, d):
    batch = batch_of(spark, d)
    return A.answers(batch, search.hybrid_search(batch))


@query
def answer_prompts(spark, d):
    return A.prompts(chosen(spark, d), questions(spark, d), index_of(spark, d))


@query
def answer_ungrounded_urls(spark, d):
    given = tree.nodes(table(spark, d, "sections"), "raw_content").select(F.col("section_id").alias("query_id"), F.col("raw_content").alias("answer"))
    places = tree.neighbours(table(spark, d, "sections"), 1).select(F.col("section_id").alias("query_id"), F.col("neighbour").alias("section_id"))
    return A.ungrounded_urls(given, places, table(spark, d, "sections"))


@query
def answer_ungrounded_commands(spark, d):
    given = tree.nodes(table(spark, d, "sections"), "commands").select(F.col("section_id").alias("query_id"), F.explode("commands").alias("command"))
    places = tree.neighbours(table(spark, d, "sections"), 1).select(F.col("section_id").alias("query_id"), F.col("neighbour").alias("section_id"), F.col("offset").alias("rank"))
    return A.ungrounded_commands(given, places, table(spark, d, "sections"))


# --- retrieval by scored subjects -------------------------------------------------------------------------------


def scored_batch(spark, d, profile: str = "sections"):
    return scored.understood(kept(questions(spark, d)), index_of(spark, d), profile)


@query
def scored_subjects(spark, d):
    return scored.subjects(questions(spark, d), index_of(spark, d))


@query
def scored_ranking(spark, d):
    return scored_batch(spark, d).ranking


@query
def scored_search(spark, d):
    return scored.search(scored_batch(spark, d))


@query
def scored_search_headings(spark, d):
    return scored.search(scored_batch(spark, d, "headings"))


# --- services and grounded answers ------------------------------------------------------------------------------


@query
def hybrid_vectors(spark, d):
    """Hybrid search with the vectors of an embedder that needs no network."""
    batch, embedder = batch_of(spark, d), services.HashedEmbedder()
    near = kept(services.vector_ranking(batch.wanted.select("query_id", "text"), kept(services.section_vectors(batch.index, embedder)), embedder))
    return search.hybrid_search(batch, vectors=near)


@query
def multi_query(spark, d):
    index, embedder = index_of(spark, d), services.HashedEmbedder()
    texts = index.rows.select("section_id", F.col("raw_content").alias("text"))
    return services.multi_query(services.expanded(asked(spark, d), None), kept(services.section_vectors(index, embedder)), texts, embedder)


def block_batch(spark, d):
    """Questions with what they want of blocks, the block documents with ids, and the candidates for each question: those of the sections that BM25 finds."""
    batch = batch_of(spark, d)
    documents = extract.block_documents(batch.index).withColumn("doc_id", F.concat_ws("/", F.col("section_id").cast("string"), "doc_type", F.coalesce("block_index", F.lit(""))))
    documents = kept(documents)
    asked_of = kept(grounded.intents(batch.wanted, extract.TOPICS).join(batch.wanted.select("query_id", "text", "subject"), "query_id"))
    near = search.bm25_search(batch, grounded.TOP_RETRIEVED).select("query_id", "section_id", "score")
    found = near.join(documents.select("doc_id", "section_id"), "section_id").select("query_id", "doc_id", "score")
    return asked_of, documents, kept(grounded.retrieve(found, asked_of, documents))


@query
def grounded_documents(spark, d):
    return block_batch(spark, d)[2]


@query
def grounded_blocks(spark, d):
    _, documents, chosen = block_batch(spark, d)
    return grounded.allowed_blocks(chosen, documents)


@query
def grounded_answers(spark, d):
    asked_of, documents, chosen = block_batch(spark, d)
    return grounded.answer_flow(chosen, asked_of, documents)


@query
def grounded_problems(spark, d):
    """What the first section found for each question says, taken as its answer, that the question's documents don't."""
    asked_of, documents, chosen = block_batch(spark, d)
    batch = batch_of(spark, d)
    first = search.bm25_search(batch, 1).select("query_id", "section_id").join(batch.index.rows.select("section_id", F.col("raw_content").alias("answer")), "section_id")
    return grounded.problems(kept(first.select("query_id", "answer")), chosen, documents)


# --- streaming --------------------------------------------------------------------------------------------------


@query
def stream_new_pages(spark, d):
    from docloom.streaming import ingest

    source = table(spark, d, "discovered_urls")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = ingest.url_stream(spark, f"{d}/discovered_urls.parquet", source.schema)
    ingest.run_once(ingest.new_pages(stream, "3650 days"), f"{folder}/pages", f"{folder}/checkpoint")
    ingest.run_once(ingest.new_pages(stream, "3650 days"), f"{folder}/pages", f"{folder}/checkpoint")  # delivered again: nothing new
    return spark.read.parquet(f"{folder}/pages").select("page_url")


@query
def stream_arrivals(spark, d):
    """URLs by day of discovery and source, counted as they arrive; a day is told when it is over."""
    from docloom.streaming import ingest

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = ingest.url_stream(spark, f"{d}/discovered_urls.parquet", table(spark, d, "discovered_urls").schema)
    ingest.run_once(ingest.arrivals(stream, lateness="0 seconds"), f"{folder}/counts", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/counts")
