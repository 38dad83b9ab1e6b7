import pytest

from docloom.operators import answers as A
from docloom.operators import grounded as G
from docloom.operators import services as S
from docloom.operators.index import build_index
from pyspark.sql import functions as F

DOCS = "doc_id string, doc_type string, block_type string, heading string, doc_title string, page_url string, topic_tags array<string>, body string, content string"
ROWS = [
    ("a", "section", None, "Gateway", "Guide", "https://h/a", ["install"], "The gateway reads keys.", "The gateway reads keys. It waits."),
    ("b", "block", "shell_command", "Gateway", "Guide", "https://h/a", ["install"], "helm install gateway ./x\nls", "helm install gateway ./x"),
    ("c", "block", "yaml", "Gateway keys", "Guide", "https://h/c", [], "a: 1\n# no\nb: 2\nc: 3", "a: 1"),
    ("d", "block", "output", "Other", "Gateway guide", None, [], "NAME READY STATUS\nx 1/1 up", "NAME READY STATUS"),
]
ASKED = [(1, "what commands to install gateway", "gateway"), (2, "show yaml", None), (3, "the gateway keys", "gateway"), (4, "nothing", "zz")]


@pytest.fixture(scope="module")
def data(spark):
    documents = spark.createDataFrame(ROWS, DOCS)
    queries = spark.createDataFrame(ASKED, "query_id long, text string, subject string")
    asked = G.intents(queries, {"install": ["install"], "tls": ["tls"]}).join(queries, "query_id")
    found = queries.select("query_id", F.explode(F.lit(["a", "b", "c", "d"])).alias("doc_id"), F.lit(0.5).alias("score"))
    return documents, asked, G.retrieve(found, asked, documents)


def test_retrieve(spark, data):
    documents, asked, chosen = data
    got = {}
    for r in chosen.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got[1] == ["b", "a"]  # the subject is the heading of both; commands are wanted
    assert got[2][0] == "c" and len(got[2]) == 4 and sorted(got[4]) == ["a", "b", "c", "d"]  # no subject, or one that nothing holds: all
    wants = {r["query_id"]: r for r in asked.collect()}
    assert wants[1]["installs"] and wants[1]["topic"] == "install" and wants[2]["wants_yaml"] and wants[2]["topic"] is None


def test_blocks_and_support(spark, data):
    documents, asked, chosen = data
    blocks = {(r["query_id"], r["block_type"]): r["blocks"] for r in G.allowed_blocks(chosen, documents).collect()}
    assert blocks[1, "shell_command"] == ["helm install gateway ./x\nls"] and blocks[2, "yaml"] == ["a: 1\n# no\nb: 2\nc: 3"]
    said = spark.createDataFrame([("a: 1\nb: 2",), ("b: 2\na: 1",), ("",), ("# x\na: 1\n\nb: 2\nc: 3",)], "y string").withColumn("k", F.array(F.lit(ROWS[2][7])))
    assert [r[0] for r in said.select(G.supported_yaml(F.col("y"), F.col("k"))).collect()] == [True, False, False, True]
    out = spark.createDataFrame([("name  ready status",), ("x 2",)], "o string").withColumn("k", F.array(F.lit(ROWS[3][7])))
    assert [r[0] for r in out.select(G.supported_output(F.col("o"), F.col("k"))).collect()] == [True, False]


def test_problems(spark, data):
    documents, asked, chosen = data
    answers = [(1, "see https://h/a and https://bad\n```bash\nhelm install gateway\nrm -rf x\nhelm delete y\n```"), (2, "```yaml\nb: 2\na: 1\n```\n```\nkubectl get z\n```"), (4, "```text\nNAME READY STATUS\nq 0/1\n```")]
    got = {tuple(r) for r in G.problems(spark.createDataFrame(answers, "query_id long, answer string"), chosen, documents).collect()}
    assert got == {(1, "url", "https://bad"), (1, "command", "helm delete y"), (2, "yaml", "b: 2\na: 1"), (2, "command", "kubectl get z"), (4, "output", "NAME READY STATUS\nq 0/1")}


def test_flow(spark, data):
    documents, asked, chosen = data
    plain = {r["query_id"]: r for r in G.answer_flow(chosen, asked, documents).collect()}
    assert plain[1]["kind"] == "deterministic" and plain[1]["answer"] == "```bash\nhelm install gateway ./x\n```"
    assert plain[2]["kind"] == "deterministic" and "a: 1" in plain[2]["answer"] and plain[3]["kind"] == "fallback" and "gateway reads keys" in plain[3]["answer"]

    class Says:
        def generate(self, prompts):
            return ["It reads keys." if "keys" in p.rsplit("Question", 1)[1] else "see https://made.up" for p in prompts]

    told = {r["query_id"]: r for r in G.answer_flow(chosen, asked, documents, Says()).collect()}
    assert (told[3]["kind"], told[3]["answer"]) == ("generated", "It reads keys.") and told[4]["kind"] == "fallback"
    none = G.answer_flow(chosen.limit(0), asked, documents).collect()
    assert {r["answer"] for r in none} == {A.NO_ANSWER}


def test_services(spark):
    texts = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta eps"), (3, None)], "section_id long, text string")
    embedder = S.HashedEmbedder(64)
    vectors = S.embedded(texts, "section_id", "text", embedder)
    assert {len(r["embedding"]) for r in vectors.collect()} == {64} and S.healthy(embedder) and not S.healthy(object())
    q = spark.createDataFrame([(1, "beta gamma"), (2, "eps delta")], "query_id long, text string")
    near = {r["query_id"]: (r["section_id"], r["score"]) for r in S.vector_ranking(q, vectors, embedder).where("rank = 1").collect()}
    assert near[1][0] == 1 and near[2] == (2, 1.0)

    class Words:
        def generate(self, prompts):
            return ['["delta eps", "", "x"]' if "beta" in p else "broken" for p in prompts]

    more = S.expanded(q, Words())
    assert {tuple(r) for r in more.collect()} == {(1, 0, "beta gamma"), (2, 0, "eps delta"), (1, 1, "delta eps"), (1, 3, "x")}
    found = S.multi_query(more, vectors, texts, embedder, each=1)
    assert {(r["query_id"], r["section_id"], r["overlap"]) for r in found.where("overlap > 0").collect()} == {(1, 1, 2), (2, 2, 2)}
    told = {r["query_id"]: r for r in S.ask(q, texts.withColumn("source", F.lit("u")), vectors, embedder, S.Extracts(), top=1).collect()}
    assert "alpha beta gamma" in told[1]["answer"] and told[1]["sources"] == ["u"]

    class Short:
        def embed(self, texts):
            return []

    with pytest.raises(Exception, match="0 results"):
        S.embedded(texts, "section_id", "text", Short()).collect()


def test_require_filter(spark):
    rows = [(i, "a", "T", "u", "H", 1, ["H"], "x", [], ["k: v"] if i < 3 else [], [], [], []) for i in range(1, 5)]
    schema = "section_id long, file_path string, doc_title string, page_url string, heading string, level int, heading_path array<string>, raw_content string, commands array<string>, yamls array<string>, scripts array<string>, outputs array<string>, steps array<string>"
    index = build_index(spark.createDataFrame(rows, schema))
    found = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 3, 1), (2, 4, 2)], "query_id long, section_id long, rank int")
    points = spark.createDataFrame([(1, 1, 20.0), (1, 2, 45.0), (1, 3, 70.0), (2, 3, 20.0)], "query_id long, section_id long, points double")
    assert {tuple(r) for r in A.requiring(found, points, index, "yamls").collect()} == {(1, 2, 1), (1, 1, 2), (2, 3, 1), (2, 4, 2)}
