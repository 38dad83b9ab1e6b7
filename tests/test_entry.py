import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50 and "hybrid_search" in queries


def test_nothing_else_imports_the_training_data_package():
    for source in (ROOT / "docloom").rglob("*.py"):
        if "llm" not in source.relative_to(ROOT / "docloom").parts:
            assert not re.search(r"docloom\.llm|from \.+llm", source.read_text()), source


def test_queries_run_on_empty_tables(spark, tmp_path):
    """Each core query has a defined, empty or default result where tables have no rows."""
    from docloom import catalog

    schemas = {
        "discovered_urls": "url_id long, url string, source string, depth int, path_depth int, from_url string, found_at timestamp, loaded_at timestamp",
        "pages_raw": "fetch_id long, page_url string, requested_url string, status int, title string, page_id string, list_source string, rest_export_view struct<attempted: boolean, status: int, error: string>, url_export_view struct<attempted: boolean, status: int, error: string>, page_html string, export_view_html string, fetched_at timestamp, loaded_at timestamp",
        "sections": "section_id long, node_id string, file_path string, doc_title string, page_url string, heading string, level int, heading_path array<string>, raw_content string, commands array<string>, yamls array<string>, scripts array<string>, outputs array<string>, steps array<string>",
        "documents": "doc_id long, text string, lang string",
        "embeddings": "vec_id long, embedding array<float>, label int",
        "eval_items": "item_id long, text string",
        "pages_md": "page_url string, scope_used string, html_source string, stats map<string,int>",
    }
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("url_parts", "url_requests", "crawl_frontier", "page_best_html", "page_markdown", "page_links", "text_terms", "fenced_blocks", "yaml_islands", "section_artefacts", "section_parents", "vector_search", "bm25_search"):
        assert catalog.queries()[name](spark, str(tmp_path)).count() == 0, name
