import math

import numpy as np

from docloom.operators import answers as A
from docloom.operators import crawl, search
from docloom.operators.index import ARTEFACTS, Engine, build_index, open_index, retrieval_content

SECTIONS = "section_id long, file_path string, doc_title string, page_url string, heading string, level int, heading_path array<string>, raw_content string, commands array<string>, yamls array<string>, scripts array<string>, outputs array<string>, steps array<string>"


def corpus(spark):
    rows = [
        (1, "a", "Guide", "u1", "Setup gateway", 1, ["Setup gateway"], "The gateway service reads keys. See https://x.example/a now.", ["helm install gateway"], [], [], [], ["Do it"]),
        (2, "a", "Guide", None, "Check gateway", 2, ["Setup gateway", "Check gateway"], "Verify the gateway output.", [], [], [], ["NAME READY\nx 1"], []),
        (3, "b", "Other", "u3", "Storage volumes", 1, ["Storage volumes"], "Volumes hold records.", [], ["a: b"], [], [], []),
        (4, "b", None, "u4", None, 2, None, None, [], [], [], [], []),
    ]
    return spark.createDataFrame(rows + rows[:1], SECTIONS)


def asked(spark):
    return spark.createDataFrame([(1, "what commands setup gateway"), (2, "storage volumes"), (3, ""), (4, None)], "query_id long, text string")


def batch(spark, queries=None, sections=None):
    return search.understood(asked(spark) if queries is None else queries, build_index(corpus(spark) if sections is None else sections))


def test_understanding(spark):
    got = {r["query_id"]: r for r in batch(spark).wanted.collect()}
    assert got[1]["wants_commands"] and got[1]["subject"] == "Setup gateway" and got[2]["subject"] == "Storage volumes"
    assert got[3]["subject"] is None and not got[4]["wants_yaml"]


def test_search_and_answers(spark):
    own = batch(spark)
    top = {r["query_id"]: r["section_id"] for r in search.lexical_search(own).where("rank = 1").collect()}
    assert top[1] == 1 and top[2] == 3
    chosen = search.hybrid_search(own)
    first = {r["query_id"]: r["section_id"] for r in chosen.where("rank = 1").collect()}
    assert first[1] == 1 and first[2] == 3 and first[3] == first[4] == 2  # nothing asked: what verifies scores
    got = {r["query_id"]: r for r in A.answers(own, chosen).collect()}
    assert got[1]["kind"] == "commands" and "helm install gateway" in got[1]["answer"]
    assert A.sources(chosen, own.index).where("page_url = 'N/A'").count() > 0


def test_first_sections_where_nothing_scores(spark):
    own = batch(spark, asked(spark).where("query_id > 2"), corpus(spark).where("section_id > 2"))
    assert {tuple(r) for r in search.combined(own).collect()} == {(q, s, 0.0, s - 2) for q in (3, 4) for s in (3, 4)}


def test_index_is_stored_and_opened_again(spark, tmp_path):
    made = build_index(corpus(spark), str(tmp_path / "index"))
    again = open_index(spark, str(tmp_path / "index"))
    assert again.count == made.count == 4 and again.mean == made.mean > 0
    q = spark.createDataFrame([(1, "storage volumes")], "query_id long, text string")
    assert [tuple(r) for r in search.bm25_search(search.understood(q, again)).collect()] == [tuple(r) for r in search.bm25_search(search.understood(q, made)).collect()]
    corpus(spark).write.parquet(str(tmp_path / "sections.parquet"))
    engine = Engine(spark)
    assert not engine.status(str(tmp_path / "sections.parquet"))["ready"]
    first = engine.index(str(tmp_path / "sections.parquet"))
    assert engine.index(str(tmp_path / "sections.parquet")) is first and engine.index(str(tmp_path / "sections.parquet"), force=True) is not first
    assert engine.status(str(tmp_path / "sections.parquet")) == {"ready": True, "sections": 4, "last_error": None}


def test_subject_points_find_names_inside_words_and_stop_words(spark):
    row = lambda i, heading, text, title=None: (i, "a", title, "u", heading, 1, [heading] if heading else None, text, [], [], [], [], [])
    sections = spark.createDataFrame([row(1, "Cluster sizing table", "the cluster"), row(2, "Installing it", "x"), row(3, "Cluster", None), row(4, None, "my-gateway.", "x"), row(5, "install", "y", "How to install"), row(6, "a.yaml", "see a.yaml")], SECTIONS)
    q = spark.createDataFrame([(1, "Cluster"), (2, "install"), (3, "a.yaml")], "query_id long, text string")
    own = batch(spark, q, sections)
    got = {(r["query_id"], r["section_id"]): r["points"] for r in search.subject_points(own).collect()}
    assert got[1, 1] == 70 + 60 + 45 and got[1, 3] == 160 and got[2, 2] == 130 and got[2, 5] == 180 and got[3, 6] == 100 + 60 + 45 + 30
    tiers = {(r["query_id"], r["section_id"]): r["tier"] for r in A.subject_tiers(spark.createDataFrame([(2, 2), (2, 1), (1, 4)], "query_id long, section_id long"), own.wanted, own.index).collect()}
    assert tiers == {(2, 2): 2, (1, 4): 5}


def test_bm25_by_hand(spark):
    own = batch(spark, spark.createDataFrame([(1, "volumes")], "query_id long, text string"))
    got = search.bm25_search(own).collect()
    rows = {r["section_id"]: r["words"] for r in own.index.rows.select("section_id", search.terms(retrieval_content(), []).alias("words")).collect()}
    mean, tf = sum(map(len, rows.values())) / len(rows), rows[3].count("volumes")
    idf = math.log(1 + (len(rows) - 1 + 0.5) / 1.5)
    assert len(got) == 1 and math.isclose(got[0]["score"], idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(rows[3]) / mean)), abs_tol=1e-5)
    assert ARTEFACTS


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(0)
    vectors = [(i, r.normal(size=8).round(3).tolist()) for i in range(120)] + [(200, None), (201, [0.0] * 8), (202, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["rank"]): x["vec_id"] for x in search.vector_search(df, df.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding"), top=5).collect()}
    m = np.array([v for _, v in vectors[:120]])
    m /= np.linalg.norm(m, axis=1)[:, None]
    for q in (0, 50, 100):
        order = sorted((-round(float(m[q] @ m[i]), 6), i) for i in range(120) if i != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [i for _, i in order]
    assert not any(k[0] == 200 for k in got)


def test_fusion(spark):
    s = spark.createDataFrame([(1, 1, 2.0, 1), (1, 2, 2.0, 2), (2, 1, 5.0, 1), (2, 2, 1.0, 2)], "query_id long, section_id long, score double, rank int")
    assert {(r["query_id"], r["section_id"]): r["scaled"] for r in search.minmax(s, ["query_id"]).collect()} == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 1.0, (2, 2): 0.0}
    assert math.isclose(search.rrf(s.unionByName(s)).where("query_id = 1 and section_id = 2").first()["rrf"], 2 / 62)


def test_grounding(spark):
    s = corpus(spark)
    chosen = spark.createDataFrame([(1, 1, 1)], "query_id long, section_id long, rank int")
    said = spark.createDataFrame([(1, "helm install gateway"), (1, "helm gateway"), (1, "rm -rf x")], "query_id long, command string")
    assert [r["command"] for r in A.ungrounded_commands(said, chosen, s).collect()] == ["rm -rf x"]
    urls = spark.createDataFrame([(1, "https://x.example/a and https://bad.example")], "query_id long, answer string")
    assert [r["url"] for r in A.ungrounded_urls(urls, chosen, s).collect()] == ["https://bad.example"]


def test_frontier(spark):
    rows = [(1, "h://a", "sitemap", None), (2, "h://b?x", "crawl", "h://a"), (3, "h://c", "crawl", "h://b"), (4, "h://a/", "crawl", "h://c"), (5, "h://z", "crawl", "h://y")]
    df = spark.createDataFrame(rows, "url_id long, url string, source string, from_url string")
    assert {tuple(r) for r in crawl.frontier(df).collect()} == {("h://a", 0), ("h://b", 1), ("h://c", 2)}
    assert {tuple(r) for r in crawl.frontier(df, 1).collect()} == {("h://a", 0), ("h://b", 1)}


def test_output_bridge(spark):
    q = spark.createDataFrame([(1, "what output should i expect when i install gateway"), (2, "install gateway"), (3, "expected output of helm install")], "query_id long, text string")
    own = batch(spark, q)
    assert {tuple(r) for r in search.command_matches(own).collect()} == {(1, 1), (2, 1), (3, 1)}
    bridge = search.output_bridge(own)
    assert {tuple(r) for r in bridge.collect()} == {(1, 2, 1), (3, 2, 1)}
    chosen = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 3, 1)], "query_id long, section_id long, rank int")
    assert {tuple(r) for r in search.with_bridge(chosen, bridge).collect()} == {(1, 2, 1), (1, 1, 2), (2, 3, 1), (3, 2, 1)}


def test_command_matches_contain_the_release(spark):
    commands = ["export gateway_limit=3863", "kubectl create -f=my-gateway.sh", "run Gateway", "run gate way", "./a/gateway:9.1"]
    rows = [(10 + i, "c", "T", "u", "H", 1, ["H"], "x", [c], [], [], [], []) for i, c in enumerate(commands)]
    q = spark.createDataFrame([(1, "install gateway"), (2, "install way"), (3, "nothing")], "query_id long, text string")
    expected = {(1, 10), (1, 11), (1, 12), (1, 14), (2, 10), (2, 11), (2, 12), (2, 13), (2, 14)}
    assert {tuple(r) for r in search.command_matches(batch(spark, q, spark.createDataFrame(rows, SECTIONS))).collect()} == expected


def test_questions_for_the_output_of_installing(spark):
    row = lambda i, file, heading, text, commands=(), outputs=(): (i, file, None, "u", heading, 1, [heading], text, list(commands), [], [], list(outputs), [])
    rows = [row(1, "a", "One", "x", ["run zorvex-1"]), row(2, "b", "Two", "see myzorvex here", outputs=["up"]), row(3, "a", "Three", "x", outputs=["ok"]), row(4, "c", "Four", "zorvex zorvex install output"), row(5, "d", "Five", "x", outputs=["no"])]
    s = spark.createDataFrame(rows, SECTIONS)
    q = spark.createDataFrame([(1, "output of install zorvex"), (2, "install zorvex")], "query_id long, text string")
    own = batch(spark, q, s)
    scores = {tuple(r)[:2]: r["score"] for r in search.node_scores(own).collect()}
    # the release in a command 15, in content with outputs 18; commands 18 and outputs 38 as wanted
    assert scores[1, 1] == 15.0 + 18.0 and scores[1, 2] == 18.0 + 38.0 + 45.0 and scores[1, 3] == scores[1, 5] == 38.0 and scores[2, 1] == 18.0
    plain = {tuple(r)[:2]: r["score"] for r in search.combined(own, bridge=spark.createDataFrame([], "query_id long, section_id long, place int")).collect()}
    boosted = {tuple(r)[:2]: r["score"] for r in search.combined(own).collect()}
    assert {k: round(v - plain[k], 6) for k, v in boosted.items() if v != plain[k]} == {(1, 3): 2.75}
    chosen = {r["rank"]: r["section_id"] for r in search.hybrid_search(own).where("query_id = 1").collect()}
    ranking = [r["section_id"] for r in search.combined(own).where("query_id = 1").orderBy("rank").collect()]
    assert [chosen[k] for k in sorted(chosen)] == [3, *(i for i in ranking if i != 3)]


def test_a_question_for_each_installed_name(spark, tmp_path):
    from docloom import catalog

    rows = [(1, "a", None, "u", "H", 1, ["H"], "x", ["helm install one", "helm install two"], [], [], ["up"], [])]
    spark.createDataFrame(rows, SECTIONS).write.parquet(str(tmp_path / "sections.parquet"))
    asked_for = catalog.install_questions(spark, str(tmp_path)).collect()
    assert {r["text"].split()[-1] for r in asked_for} == {"one", "two"} and len({r["query_id"] for r in asked_for}) == 2


def test_scored_subjects_and_search(spark):
    from docloom.operators import scored

    row = lambda i, file, level, path, text, commands=(), yamls=(): (i, file, "Guide of keys", "u", path[-1], level, path, text, list(commands), list(yamls), [], [], [])
    rows = [row(1, "a", 1, ["Gateway setup"], "x"), row(2, "a", 2, ["Gateway setup", "Steps"], "y", ["helm install a"]), row(3, "a", 2, ["Gateway setup", "More"], "z"), row(4, "b", 1, ["Storage"], "see a.yaml", yamls=["k: v"]), row(5, "b", 1, ["Nothing"], "gateway text")]
    index = build_index(spark.createDataFrame(rows, SECTIONS))
    q = spark.createDataFrame([(1, "what commands for gateway setup"), (2, "show yaml a.yaml"), (3, "text"), (4, None)], "query_id long, text string")
    assert {r["query_id"]: (r["subject"], r["points"]) for r in scored.subjects(q, index).collect()} == {1: ("gateway setup", 100), 2: ("a.yaml", 200), 3: (None, None), 4: (None, None)}
    got = {}
    for r in scored.search(scored.understood(q, index)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["section_id"])
    assert got[1][:2] == [1, 2] and got[2] == [4] and got[3][:2] == [1, 5] and got[4] == [1, 2, 3, 4, 5]
    headings = scored.search(scored.understood(q, index, "headings")).where("query_id = 1").orderBy("rank").collect()
    assert [r["section_id"] for r in headings] == [1, 2]
    scores = {(r["query_id"], r["section_id"]): r["score"] for r in scored.scores(scored.understood(q, index)).collect()}
    assert scores[1, 1] == 2 * 10 + 2 * 8 + 45 + 3 and scores[1, 2] == 2 * 8 + 22 + 12 and scores[3, 5] == 2


def test_prompts_hold_the_first_sections(spark):
    import json

    own = batch(spark)
    chosen = spark.createDataFrame([(1, 1, 1), (1, 2, 7), (2, 3, 1)], "query_id long, section_id long, rank int")
    got = {r["query_id"]: json.loads(r["prompt"]) for r in A.prompts(chosen, asked(spark), own.index).collect()}
    assert set(got) == {1, 2} and got[1]["query"] == "what commands setup gateway" and [c["heading"] for c in got[1]["context"]] == ["Setup gateway"]
    assert got[1]["context"][0]["commands"] == ["helm install gateway"] and got[2]["context"][0]["yamls"] == ["a: b"]


def test_vectors_in_the_combined_score(spark):
    own = batch(spark)
    near = spark.createDataFrame([(1, 3, 0.9, 1), (1, 4, 0.1, 2)], "query_id long, section_id long, score double, rank int")
    plain = {tuple(r)[:2]: r["score"] for r in search.combined(own).collect()}
    with_vectors = {tuple(r)[:2]: r["score"] for r in search.combined(own, near).collect()}
    gain = {k: round(v - plain.get(k, 0.0), 6) for k, v in with_vectors.items() if v != plain.get(k)}
    assert gain == {(1, 3): round(0.25 + 10 / 61, 6), (1, 4): round(10 / 62, 6)}
