import datetime
import json

import pytest
from pyspark.sql import functions as F

from docloom.functions.markup import pieces
from docloom.operators import html_markdown as H
from docloom.sources import files
from docloom.streaming import ingest


def test_reader():
    html = "<head><title>no</title></head><body><p>a<p>b &amp; c<ul><li>d<li>e</ul><script>var x='</p><p>no</p>'</script><!-- <p>no --><td>&nbsp;</td><noscript>n</noscript>"
    got = [(p.number, p.text) for p in pieces(html)]
    assert got == [(0, "a"), (1, "b & c"), (2, "d"), (3, "e"), (4, "n")]
    assert [p.unit.tag for p in pieces("<div><p>x<b>y</b></p></div>")] == ["p", "p"]
    assert list(pieces("")) == [] and [p.text for p in pieces("a < b")] == ["a < b"]


def test_markdown():
    html = "<nav><a href=x>menu</a></nav><h1>T</h1><p>a <code>b</code> <a href='c'>d</a></p><pre class='language-yaml'>k: v</pre><ol><li>x</li><li>y</li></ol><table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table><div role=note><p>careful</p></div>"
    text, stats, scope = H.to_markdown(html, "T", "https://h/p/")
    assert "menu" not in text and "a `b` [d](https://h/p/c)" in text and "```yaml\nk: v\n```" in text and "1. x\n2. y" in text and "| A | B |\n| --- | --- |\n| 1 |  |" in text and "> **Nota:**\n> careful" in text
    assert stats == {"heading": 1, "p": 1, "code": 1, "list": 1, "table": 1, "note": 1} and scope == "body"
    assert H.to_markdown("", None)[0] == "# Untitled\n"


def lines(html, **kw):
    return H.to_markdown(html, "t", **kw)[0].split("\n", 2)[2].rstrip("\n")


def test_tables():
    rows = lambda *rs: "<table>" + "".join("<tr>" + "".join(rs_) + "</tr>" for rs_ in rs) + "</table>"
    td, th = (lambda *x: [f"<td>{v}</td>" for v in x]), (lambda *x: [f"<th>{v}</th>" for v in x])
    assert lines(rows(td("1", "", "3"), td("4", "5", "6"))) == "| Col 1 | Col 2 | Col 3 |\n| --- | --- | --- |\n| 1 |  | 3 |\n| 4 | 5 | 6 |"
    assert lines(rows(th("A", "B"), td("1"), td("a|b", "2", "3"))) == "| A | B |  |\n| --- | --- | --- |\n| 1 |  |  |\n| a\\|b | 2 | 3 |"
    assert lines(rows(th("h1") + td("x"), th("h2") + td("y"))) == "| Col 1 | Col 2 |\n| --- | --- |\n| h1 | x |\n| h2 | y |"
    assert lines("<table><thead><tr><th>A</th></tr></thead><tbody><tr><td><code>a\nb</code></td></tr></tbody></table>").endswith("> Table embedded code blocks:\n\n**(table r1 c0)**\n\n```\na\nb\n```")
    assert lines("<table></table><p>x</p>") == "x"


def test_html_branches():
    assert lines("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>") == "- a\n  - b\n- c"
    assert lines("<img src='i.png' alt=x><img src='data:zz'><p>y <img data-src=/j.png></p>", url="https://h/d/") == "![x](https://h/d/i.png)\n\ny ![](https://h/j.png)"
    assert lines("<blockquote>q<p>r</p></blockquote>") == "> q\n> r"
    code = "<div class='code-block'><code class='language-sh'><span data-testid='renderer-code-block-line-1'><span class='linenumber'>1</span>ls</span><span data-testid='renderer-code-block-line-2'><span class='linenumber'>2</span>cd</span></code></div>"
    assert lines(code) == "```sh\nls\ncd\n```" and lines("<code style='white-space: pre'>kubectl get</code>") == "```shell\nkubectl get\n```"
    assert lines("<div class='my-footnote'>n</div>") == "> **Nota:**\n> n" and lines("<div data-panel-type=info><p>a</p><p>b</p></div>") == "> **Info:**\n> a\n> b"
    assert lines("<p>open<p>next <b>bold<script>var t='</p>'</script>") == "open\n\nnext bold"
    assert H.to_markdown("<div>out</div><div id=content-body><p>in</p></div>", "t")[::2] == ("# t\n\nin\n", "#content-body")
    assert H.to_markdown("<div class=x><p>a</p></div><p>b</p>", "t", scopes=(".x",))[::2] == ("# t\n\na\n", ".x")
    assert [H.language_of(x) for x in ('{"a": 1}', "kind: x", "helm install", 'module "x" {}', "import os", "select 1", "<a>b</a>", "plain", "")] == ["json", "yaml", "shell", "hcl", "python", "sql", "xml", "", ""]


def test_links_of_pages():
    page = "<body><nav><a href=/n>n</a></nav><div id=AkMainContent><a href=/1>x</a></div><a href=/2>y</a><script>{\"href\":\"https:\\/\\/e\\u0041\"}</script>"
    assert H.page_hrefs(page) == ["/1", "/2", "https://eA"] and H.page_hrefs(page, least=1) == ["/1"]
    assert H.page_hrefs("") == []


def test_crawl_over_stored_pages(spark):
    from docloom.operators import crawl

    rows = [(1, "https://h/a", "<a href=b>1</a><a href=c?x=1>2</a><a href=https://o/z>3</a><a href=mailto:q>4</a>"), (2, "https://h/b", "<a href=d>1</a>"), (3, "https://h/c", "<a href=/label/x>1</a><a href=a>2</a>"), (4, "https://h/e", "<a href=f>1</a>"), (5, "https://h/b", "")]
    df = spark.createDataFrame(rows, "fetch_id long, page_url string, page_html string")
    got = crawl.crawl_pages(df, spark.createDataFrame([("https://h/a/",)], "url string"), ["h"], deny=["/label/"])
    assert {tuple(r) for r in got.collect()} == {("https://h/a", 0, None), ("https://h/b", 1, "https://h/a"), ("https://h/c", 1, "https://h/a"), ("https://h/d", 2, "https://h/b")}
    found = spark.createDataFrame([("https://h/a?x",), ("https://h/a",), ("https://o/a",), ("https://h/b/c/d",), ("https://h/label/x",), ("",)], "loc string")
    assert [r[0] for r in crawl.sitemap_pages(found, ["H"], [], ["/label/"], 2).collect()] == ["https://h/a"]


def test_best_source_and_links(spark):
    rows = [(1, "https://h/a/", "<a href='b'>x</a><nav><a href='/c'>y</a></nav><a href='mailto:z'>z</a>", None, "t"), (2, "https://h/", None, "", "t"), (3, None, "p", "e", None), (1, "https://h/a/", "<a href='b'>x</a><nav><a href='/c'>y</a></nav><a href='mailto:z'>z</a>", None, "t")]
    df = spark.createDataFrame(rows, "fetch_id long, page_url string, page_html string, export_view_html string, title string")
    assert {(r["fetch_id"], r["html_source"]) for r in H.best_source(df).collect()} == {(1, "page"), (2, None), (3, "export_view")}
    assert {(r["href"], r["place"]) for r in H.links(df).collect()} == {("https://h/a/b", 0)}
    assert H.convert(df).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "page.md").write_text("x\n# Heading\n")
    (tmp_path / "p1" / "meta.json").write_text(json.dumps({"title": "", "url": "u"}))
    (tmp_path / "p2").mkdir()
    (tmp_path / "p2" / "other.md").write_text("no heading")
    (tmp_path / "p2" / "meta.json").write_text("{broken")
    got = {(r["doc_title"], r["page_url"]) for r in files.markdown_pages(spark, str(tmp_path)).collect()}
    assert got == {("Heading", "u"), ("other", None)}
    (tmp_path / "list.txt").write_text('# c\nhttps://a\n\n{"url": "https://b", "source": "crawl"}\n{bad\n')
    assert {tuple(r) for r in files.url_list(spark, str(tmp_path / "list.txt")).collect()} == {("https://a", "txt"), ("https://b", "crawl")}
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a?x&amp;y </loc></url></urlset>")
    (tmp_path / "index.xml").write_text("<sitemapindex><sitemap><loc>https://h/maps/s.xml</loc></sitemap><sitemap><loc>https://h/index.xml</loc></sitemap></sitemapindex>")
    assert [r[0] for r in files.sitemap_tree(spark, str(tmp_path / "index.xml"), str(tmp_path)).collect()] == ["https://a?x&y"]
    (tmp_path / "p1" / "page.html").write_text("<p>x</p>")
    (tmp_path / "p2" / "page.html").write_text("<p>y</p>")
    assert [(r["page_url"], r["page_html"], r["export_view_html"]) for r in files.html_folder(spark, str(tmp_path)).collect()] == [("u", "<p>x</p>", None)]
    assert files.trailing_metadata('text {a}\n{"title": "x", "files": {"y": 1}}\n') == ("text {a}", {"title": "x", "files": {"y": 1}}) and files.trailing_metadata('a {"b": 1}') == ('a {"b": 1}', {})
    t = files.with_trailing_metadata(spark.createDataFrame([(1, 'a\n{"page_id": 3}'), (2, None)], "k int, t string"), "k", "t")
    assert {tuple(r) for r in t.collect()} == {(1, "a", '{"page_id": 3}'), (2, None, None)}
    rest = spark.createDataFrame([('{"title": "T", "body": {"export_view": {"value": "<p>"}}}', "g"), ("{}", "g")], "body string, title string").select(*files.rest_export_view("body", "title"))
    assert [tuple(r) for r in rest.collect()] == [("<p>", "T", None), (None, "g", "no export view in the answer")]
    assert spark.range(1).select(files.cleaned(F.lit("\na \r\n\n\n\nb\n"))).first()[0] == "a\n\nb"
    (tmp_path / "c.json").write_text('{"a": [1]}')
    assert files.load_config(str(tmp_path / "c.json")) == {"a": [1]}
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.markdown_folder(spark, str(tmp_path / "none"))
    files.write_page_folders(spark.createDataFrame([("f", "t", "<p>", None, "# md")], "folder string, title string, page_html string, export_view_html string, md string"), str(tmp_path / "folders"), text="md")
    assert json.loads(spark.read.parquet(str(tmp_path / "folders")).first()["meta"]) == {"title": "t", "files": {"page_html": "page.html", "markdown": "page.md"}}
    files.write_vectors(spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<double>"), str(tmp_path / "v"))
    assert dict(spark.read.parquet(str(tmp_path / "v")).dtypes)["embedding"] == "array<float>"
    assert [tuple(r)[1:] for r in files.sitemap_urls(spark, str(tmp_path / "s.xml")).collect()] == [("urlset", "https://a?x&y")]
    files.write_pages(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    merged = files.merged_meta(spark.createDataFrame([(1, 1, "a", "x"), (1, 2, None, "y")], "k int, o int, a string, b string"), "k", "o")
    assert tuple(merged.first()) == (1, "a", "y")


def test_stream(spark, tmp_path):
    rows = [(1, "h://a?x", "crawl", datetime.datetime(2025, 1, 1)), (2, "h://a", "crawl", datetime.datetime(2025, 1, 2)), (3, None, "crawl", datetime.datetime(2025, 1, 2))]
    df = spark.createDataFrame(rows, "url_id long, url string, source string, found_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.url_stream(spark, str(tmp_path / "in"), df.schema)
    for _ in range(2):
        ingest.run_once(ingest.new_pages(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [r["page_url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["h://a"]
    ingest.run_once(ingest.arrivals(ingest.url_stream(spark, str(tmp_path / "in"), df.schema), lateness="0 seconds"), str(tmp_path / "n"), str(tmp_path / "check2"))
    assert spark.read.parquet(str(tmp_path / "n")).count() >= 1
