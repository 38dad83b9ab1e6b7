import random

from pyspark.sql import functions as F

from docloom.operators import tree


def table(spark, seed=0):
    r = random.Random(seed)
    rows, n = [], 0
    for f in range(12):
        for _ in range(r.randrange(1, 14)):
            n += 1
            rows.append((f"f{f}", n, r.randrange(1, 7)))
    return rows, spark.createDataFrame(rows, "file_path string, section_id long, level int")


def stacks(rows):
    out, stack, last = {}, [], None
    for f, i, level in rows:
        if f != last:
            stack, last = [], f
        while stack and stack[-1][1] >= level:
            stack.pop()
        out[i] = [s[0] for s in stack]
        stack.append((i, level))
    return out


def test_ancestors_against_a_stack(spark):
    rows, df = table(spark)
    expected = stacks(rows)
    got = {r["section_id"]: (r["ancestors"], r["parent"]) for r in tree.with_ancestors(df.unionByName(df)).collect()}
    assert got == {i: (a, a[-1] if a else None) for i, a in expected.items()}
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in tree.closure(df).collect()}
    assert pairs == {(a, i, len(up) - k) for i, up in expected.items() for k, a in enumerate(up)}
    near = {(r["section_id"], r["sibling"]) for r in tree.siblings(df).collect()}
    assert near == {(a, b) for a in expected for b in expected if a != b and expected[a] and expected[b] and expected[a][-1] == expected[b][-1]}


def test_neighbours(spark):
    rows, df = table(spark, 1)
    ids = {}
    for f, i, _ in rows:
        ids.setdefault(f, []).append(i)
    expected = {(o[k], d, o[k + d]) for o in ids.values() for k in range(len(o)) for d in (-2, -1, 1, 2) if 0 <= k + d < len(o)}
    assert {tuple(r) for r in tree.neighbours(df).collect()} == expected
    first = {(r["section_id"], r["neighbour"]) for r in tree.structural_neighbours(df).where("place = 1").collect()}
    assert first == {(i, i) for _, i, _ in rows}


def test_parse_markdown(spark):
    text = "intro\n# A\nx\n```\n# no\n```\n### B\n\ny"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "# only")], "k long, t string")
    got = sorted(tuple(r) for r in tree.parse_markdown(df, "k", "t", F.lit("T")).collect())
    assert [g[:4] for g in got] == [(1, 0, 1, "T"), (1, 1, 1, "A"), (1, 2, 1, "no"), (1, 3, 3, "B"), (4, 0, 1, "only")]
    assert got[3][4] == "\ny\n"
    aware = sorted(tuple(r) for r in tree.parse_markdown(df, "k", "t", F.lit("T"), True).collect())
    assert [g[3] for g in aware] == ["T", "A", "B", "only"]
