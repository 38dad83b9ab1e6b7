import random

import numpy as np

from docloom.functions.words import words_of
from docloom.llm import near_duplicates as N


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 30 else None


def sample(seed, count):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(60))
    notice = [word() for _ in range(12)]
    rows, bases = [], []
    for i in range(count):
        if bases and r.random() < 0.7:
            words = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 2, 4, 6, 9])):
                k = r.randrange(len(words))
                words[k : k + r.randrange(2)] = [word() for _ in range(r.randrange(3))]
        else:
            words = [word() for _ in range(r.randrange(20, 90))] + notice * r.randrange(2)
            bases.append(words)
        rows.append((i, " ".join(words)))
    return rows + [(1000, None), (1001, ""), (1002, "a b c"), rows[0], rows[1]]


def test_pairs_against_brute_force(spark):
    for seed in (1, 2):
        rows = sample(seed, 160)
        sets = {i: s for i, t in rows if (s := shingles(t))}
        expected = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}
        members, pairs = N.near_duplicate_texts(spark.createDataFrame(rows, "id long, text string").repartition(3))
        assert {tuple(r) for r in N.alike_pairs(members, pairs).collect()} == expected and len(expected) > 50
        assert {tuple(r) for r in N.alike_pairs(*N.near_duplicate_texts(spark.createDataFrame(rows, "id long, text string"), hot=3)).collect()} == expected
        roots = {i: i for i in sets}
        for _ in sets:
            for a, b in expected:
                roots[a] = roots[b] = min(roots[a], roots[b])
        got = {r["id"]: r for r in N.classes(members, pairs).collect()}
        assert {i: g["class_id"] for i, g in got.items()} == roots


def test_texts_of_few_distinct_runs(spark):
    texts = ["w " * 30, "w " * 40, "a b c " * 10, "a b c " * 12, "a b c d " * 9, "a b c d " * 10 + "a", "a b c d e " * 8, "a b c " * 10 + "d", "a b c d e f g " * 5, "w " * 31 + "v"]
    rows = list(enumerate(texts)) + [(20, "z " * 29)]
    sets = {i: s for i, t in rows if (s := shingles(t))}
    expected = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}
    assert {(0, 1), (2, 3), (4, 5), (2, 7)} <= expected
    assert {tuple(r) for r in N.alike_pairs(*N.near_duplicate_texts(spark.createDataFrame(rows, "id long, text string"))).collect()} == expected


def test_many_copies_stay_one_text(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(i, text) for i in range(300)] + [(500, text + " more")]
    members, pairs = N.near_duplicate_texts(spark.createDataFrame(rows, "id long, text string"))
    assert pairs.count() == 1
    linked = {tuple(r) for r in N.alike_pairs(members, pairs).collect()}
    assert {(0, i) for i in range(1, 300)} | {(i, 500) for i in range(300)} <= linked and len(linked) < 300 * 299 / 2
    assert {r["class_id"] for r in N.classes(members, pairs).collect()} == {0}


def test_every_pair_of_large_groups(spark, tmp_path):
    from docloom.llm import queries

    words = [f"word{i}" for i in range(50)]
    rows = [(i, None, (" " if i % 2 else ", ").join(words)) for i in range(102)] + [(500 + i, None, " ".join([*words, "more"])) for i in range(101)]
    spark.createDataFrame(rows, "section_id long, doc_title string, raw_content string").write.parquet(str(tmp_path / "sections.parquet"))
    got = [tuple(r) for r in queries.p4_found(spark, str(tmp_path)).collect()]
    ids = [r[0] for r in rows]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in ids for b in ids if a < b}


def test_empty(spark):
    rows = spark.createDataFrame([], "id long, text string")
    members, pairs = N.near_duplicate_texts(rows)
    assert N.alike_pairs(members, pairs).count() == 0 and N.classes(members, pairs).count() == 0


def test_greedy_probes_are_the_optimum_of_the_dynamic_programme():
    r = random.Random(5)
    for _ in range(150):
        sizes = [r.randrange(1, 5) for _ in range(r.randrange(2, 9))]
        costs = [r.choice([1, 2, 3, 7, 50, 900]) for _ in sizes]
        groups = np.array([cost << 32 | g for g, (cost, size) in enumerate(zip(costs, sizes)) for _ in range(size)], np.uint64)
        bits = np.array(r.sample(range(10**6), len(groups)), np.uint64)
        if (total := len(bits) - -(-len(bits) * 6 // 10) + N.SHARED) > len(bits):
            continue
        chosen, own, size = N.probed(bits, groups, (6, 10))
        allocated, least = N.thresholds(costs, sizes, total)
        assert size == len(bits) and len(chosen) == total == sum(t + 1 for t in allocated)
        assert sum(int(g) >> 32 for g in own) == least


def test_a_bit_of_half_of_all_texts(spark):
    r = random.Random(7)
    notice = [f"notice{i}" for i in range(12)]
    rows = []
    for i in range(4000):
        words = [f"w{r.randrange(10**6)}" for _ in range(25)] if i % 10 or not i else list(own)
        own = words
        rows.append((i, " ".join([*words[:5], *notice, *words[5:], "end"] if i % 2 else [*words, f"x{i}", "end", "of", "text", "now"])))
    sets = {i: s for i, t in rows if (s := shingles(t))}
    by_run = {}
    for i, s in sets.items():
        for run in s:
            by_run.setdefault(run, []).append(i)
    met = {(a, b) for own in by_run.values() if len(own) < 100 for a in own for b in own if a < b}
    expected = {(a, b) for a, b in met if 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}
    assert max(map(len, by_run.values())) >= 1900
    for hot in (100, N.HOT_BIT):
        got = {tuple(r) for r in N.alike_pairs(*N.near_duplicate_texts(spark.createDataFrame(rows, "id long, text string").repartition(3), hot=hot)).collect()}
        assert got == expected
