from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import urls as U


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_normalized_and_terms(spark):
    assert one(spark, T.normalized("t"), t=" A\u00a0b \n C ") == "a b c"
    assert one(spark, T.normalized("t"), t=None) == ""
    assert one(spark, T.terms("t"), t="How to reset dns. DNS and a.b/c-d x") == ["reset", "dns.", "dns", "a.b/c-d"]
    assert one(spark, T.terms("t"), t=None) == []


def test_sentences_and_excerpt(spark):
    assert one(spark, T.sentences("t"), t=" One. Two!  Three: four") == ["One.", "Two!", "Three:", "four"]
    assert one(spark, T.sentences("t"), t=None) == []
    assert one(spark, T.excerpt("t", 12), t="Aaa. Bbb. Cccccc.") == "Aaa. Bbb."
    assert one(spark, T.excerpt("t", 4), t="Abcdefgh ijk.") == "Abcd"


def test_first_by_key(spark):
    df = spark.createDataFrame([([" a", "a ", "", "b", "a"],)], "t array<string>")
    assert df.select(T.first_by_key("t").alias("x")).first()["x"] == [" a", "b"]


def test_windows(spark):
    words = [str(i) for i in range(400)]
    made = one(spark, T.word_windows("t", 100, 20, 50), t=" ".join(words))
    assert made[0].split() == words[:100] and made[1].split()[0] == "80"
    assert [w for i, m in enumerate(made) for w in m.split()[20 if i else 0 :]] == words
    assert one(spark, T.word_windows("t"), t="") == []


def test_shell_command(spark):
    assert one(spark, T.shell_command("t"), t="`$ helm  install a \\\n b`") == "helm install a b"
    assert one(spark, T.installs("t"), t="$ kubectl apply -f x.yaml") is True
    assert one(spark, T.installs("t"), t="Helm install x") is False


def test_urls(spark):
    u = "HTTPS://Host.Example:8080/a//b/pages/12/?x=1&x=2&y=#f"
    assert one(spark, U.stripped("u"), u=u).endswith("/pages/12/")
    assert one(spark, U.normal("u"), u=u).endswith("/pages/12")
    assert one(spark, U.authority("u"), u=u) == "host.example:8080"
    assert one(spark, U.path_depth("u"), u=u) == 4
    assert one(spark, U.page_id("u"), u=u) == "12"
    assert one(spark, U.export_view("u"), u=u).endswith("?x=2&y=&format=export_view")
    assert one(spark, U.folder_key("t", "u"), t="  ", u=u) == "untitled_12"
    assert one(spark, U.embedded_links("h"), h='{"url":"b\\/c","href":"a"}') == ["a", "b/c"]
    assert one(spark, U.path_depth("u"), u="https://h") == 0


def test_allow_deny(spark):
    df = spark.createDataFrame([("https://h/pages/1",), ("https://h/pages/1/label/x",), ("https://h/x",)], "url string")
    assert [r["url"] for r in df.where(U.allowed("url", [r"/pages/\d"], ["label"])).collect()] == ["https://h/pages/1"]
    assert df.where(U.allowed("url", [], [])).count() == 3 and F is not None
