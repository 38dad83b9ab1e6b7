"""Splitting, repeated lines, encoding, leakage and look-alike text against brute force and exact round trips."""

import base64
import random
import unicodedata

import pytest

from docloom.llm import encode, leakage, lookalike, repeated_lines, splitting
from docloom.llm.queries import vocabulary

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu".split()


def text_of(r, n):
    return "".join(r.choice([*WORDS, "\n", "\n\n", ". ", " ", "```\n", "# h\n", "é", "漢", "😀"]) + r.choice(["", " "]) for _ in range(n))


# --- 1 ---


def test_pieces_round_trip():
    r = random.Random(1)
    for n in (0, 1, 50, 400, 3000):
        for _ in range(12):
            text = text_of(r, n)
            found = splitting.pieces(text, 300, 40)
            assert all(b - a <= 300 for a, b in found) and found[0][0] == 0 and found[-1][1] == len(text)
            assert all(y[0] == max(0, x[1] - 40) for x, y in zip(found, found[1:]))
            assert "".join(text[a + (40 if i else 0) : b] for i, (a, b) in enumerate(found)) == text or min(b for _, b in found) < 40
            assert (len(found) > 1) == (len(text) > 300)


def test_pieces_cut_where_the_text_allows_it():
    text = "# A\n" + "a b. " * 50 + "\n\n# B\n" + "c d. " * 30
    (_, first), *_ = splitting.pieces(text, 300, 20)
    assert text[first:].startswith("# B")
    assert splitting.pieces("x" * 1000, 300, 20)[0] == (0, 280) or splitting.pieces("x" * 1000, 300, 20)[0][1] <= 300
    with pytest.raises(ValueError):
        splitting.split_oversized(None, 100, 100)


def test_split_oversized(spark):
    rows = [(1, "h", "y" * 1998), (2, None, "y" * 1999), (3, None, "y" * 2000), (4, "h", None), (5, "x", "z " * 9000), (5, "x", "z " * 9000), (6, None, "😀" * 1999), (7, "", "")]
    df = spark.createDataFrame(rows, "section_id long, heading string, raw_content string").selectExpr("*", "1 as piece_no", "2 as start")
    got = splitting.split_oversized(df).collect()
    assert {g["section_id"] for g in got} == {3, 5}
    own = sorted((g["piece_no"], g["piece"]) for g in got if g["section_id"] == 5)
    assert own[0][1] + "".join(p[200:] for _, p in own[1:]) == "x\n" + "z " * 9000 and max(len(p) for _, p in own) <= 2000
    assert splitting.split_oversized(df.limit(0)).count() == 0


# --- 5 ---


def test_repeated_lines_against_brute_force(spark):
    r = random.Random(5)
    notices = ["This notice stands on many of the pages 12", "Shared by the whole documentation team", "Too short", "Another line that is seen here and there"]
    rows = []
    for i in range(300):
        host = r.choice(["https://A.example:80/x", "http://a.example/y?z", "https://b.example", None, ""])
        lines = [f"unique line with words number {WORDS[i % 12] * 3} {chr(97 + i % 26) * (i % 40 + 1)}"] + [r.choice(notices).replace("12", str(i)) for _ in range(r.randrange(3))]
        rows.append((i, f"f{i // 3}" if i % 50 else None, host, r.choice([None, "", "\n".join(lines), "\n".join(lines)])))
    df = spark.createDataFrame(rows + rows[:40], "section_id long, file_path string, page_url string, raw_content string")
    site = lambda u: u.split("//")[1].split("/")[0].split(":")[0].lower() if u else ""
    pages, seen, places = {}, {}, {}
    for i, f, u, t in rows:
        if not site(u) or f is None:
            continue
        pages.setdefault(site(u), set()).add(f)
        for n, line in enumerate((t or "").split("\n"), 1):
            letters = "".join(c for c in line.lower() if unicodedata.category(c)[0] == "L")
            if len(letters) >= 20:
                seen.setdefault((site(u), letters), set()).add(f)
                places.setdefault((site(u), letters), set()).add((i, n))
    expected = {p for k, fs in seen.items() if len(fs) >= 4 and len(fs) * 10 >= len(pages[k[0]]) for p in places[k]}
    assert {tuple(x) for x in repeated_lines.frequent_lines(df).collect()} == expected and expected
    clean = {x["section_id"]: x["raw_content"] for x in repeated_lines.without_frequent_lines(df).collect()}
    for i, _, _, t in rows:
        assert clean[i] == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in expected))


# --- 6 ---


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_exact(reference):
    r = random.Random(6)
    texts = [text_of(r, r.randrange(80)) for _ in range(300)] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(1, 0x250), r.randrange(0x2000, 0x3100)])) for _ in range(r.randrange(60))) for _ in range(600)]
    texts += ["", None, "a" * 3000, "\x1c \x1d", "12² ½", "  \n\n x", "<|endoftext|>", "don't WE'LL 'tis", "\r\n\r\n  y"]
    encoder = encode.Encoder(encode.Vocabulary(vocabulary()))
    ids, counts = encoder.encode(texts)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == (reference.encode_ordinary(text) if text else [])
        at += n
    assert 0 < encoder.failed < encoder.met


def test_encode_column(spark, reference):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (3, "")], "doc_id long, text string").selectExpr("*", "'x' as ids")
    got = sorted((r["doc_id"], r["ids"]) for r in encode.encode_column(df, vocabulary()).collect())
    assert got == [(1, reference.encode_ordinary("Hello world")), (2, []), (3, []), (3, [])]
    assert encode.encode_column(df.limit(0), vocabulary()).count() == 0


# --- 7 ---


def test_leakage_against_brute_force(spark):
    r = random.Random(7)
    items = [(i, " ".join(r.choice(WORDS) + str(r.randrange(3)) for _ in range(n))) for i, n in enumerate([0, 1, 4, 5, 11, 12, 13, 30, 60] * 2)] + [(90, None), (91, "...")]
    docs = []
    for i in range(200):
        words = [r.choice(WORDS) + str(r.randrange(3)) for _ in range(r.randrange(120))]
        own = leakage.words_of(r.choice(items)[1])
        a = r.randrange(len(own) + 1)
        docs.append((i, " ".join(words[:40] + own[a : a + r.choice([3, 11, 12, 40])] + words[40:]).upper()))
    docs += [(900, None), (901, ""), (902, items[7][1]), (902, items[7][1])]
    padded = {d: f" {' '.join(leakage.words_of(t))} " for d, t in docs}
    expected = set()
    for i, t in items:
        w = leakage.words_of(t)
        size = min(12, len(w))
        units = {f" {' '.join(w[k : k + size])} " for k in range(len(w) - size + 1)} if size else set()
        expected |= {(d, i) for d, p in padded.items() if any(u in p for u in units)}
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:3], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in leakage.leaked_items(d, q).collect()} == expected and expected
    assert {(x["doc_id"], x["item_id"]) for x in leakage.leaked_items(d, q, broadcast_units=0).collect()} == expected
    assert leakage.leaked_items(d, q.limit(0)).count() == 0 and leakage.leaked_items(d.limit(0), q).count() == 0


# --- 8 ---


SAME = [("Ａｂｃ１２．", "Abc12."), ("éa", "éa"), ("e​́", "é"), ("ﬁﬄ", "fiffl"), ("a b c　d", "a b c d"), ("сору", "copy"), ("Αλ", "Aλ"), ("a­b﻿⁠", "ab"), ("ё", "ë"), ("한", "한"), ("q̣̇", "q̣̇")]
OTHER = [("A", "a"), ("é", "e"), ("1", "¹"), ("a  b", "a b"), ("-", "–"), ('"', "“"), ("'", "`"), ("½", "1/2"), ("…", "..."), ("👩‍💻", "👩💻")]


def test_canonical_form():
    form = lookalike.Canonical()
    for a, b in SAME:
        assert form(a) == form(b), (a, b)
    for a, b in OTHER:
        assert form(a) != form(b), (a, b)
    r = random.Random(8)
    chars = "abc é́​ﬁＡс ο漢🙂\ṇё" + "xyz "
    for _ in range(400):
        text = "".join(r.choice(chars) for _ in range(r.randrange(30)))
        once = form(text)
        assert form(once) == once
        whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(lookalike.folding()))
        assert once == unicodedata.normalize("NFC", whole), text
    stable = "Größe naïve 漢字"
    assert form(stable) is stable


def test_pairs(spark):
    rows = [(1, "abc"), (2, "ａbc"), (3, "abc"), (4, "ab​c"), (5, "Abc"), (6, None), (7, ""), (8, "​"), (2, "ａbc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as form", "2 as own")
    assert {tuple(r) for r in lookalike.lookalike_pairs(df).collect()} == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert {r["doc_id"]: r["canonical"] for r in lookalike.canonical_text(df).collect()} == {1: "abc", 2: "abc", 3: "abc", 4: "abc", 5: "Abc", 6: None, 7: "", 8: ""}
    skeletons = {r["doc_id"]: r["skeleton"] for r in lookalike.canonical_text(df).collect()}
    assert skeletons[1] == skeletons[2] == skeletons[3] == skeletons[4] != skeletons[5] and skeletons[6] is None
    assert {tuple(r) for r in lookalike.lookalike_groups(df).collect()} == {(1, 1, 1, 3, 4), (2, 1, 2, 3, 4), (3, 1, 1, 3, 4), (4, 1, 4, 3, 4)}
    assert lookalike.lookalike_groups(df.limit(0)).count() == 0
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0


def test_pairs_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "DEAL", 7)
    rows = [(i, "abc") for i in range(60)] + [(100 + i, "аbc") for i in range(30)] + [(200, "aЬc")]
    got = [tuple(r) for r in lookalike.lookalike_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, 100 + b) for a in range(60) for b in range(30)}


def test_canonical_text_keeps_words_in_their_script():
    write = lookalike.InScript()
    assert write("рок и шоk") == "рок и шоk"  # two scripts, truly
    assert write("пaпка рок") == "папка рок"  # Latin a in a Cyrillic word; a word of look-alikes in a Cyrillic text
    assert write("сору the file") == "copy the file"  # look-alikes alone in a Latin text
    assert write("pаssword") == "password" and write("ＡＢ é") == "AB é"
    assert write("Ελλάδα και Oλα") == "Ελλάδα και Ολα"
    assert write("ёлка") == "ёлка" and write("") == ""
    r = random.Random(11)
    for _ in range(300):
        text = "".join(r.choice("aсbоpшжλο é-") for _ in range(r.randrange(20)))
        assert write(write(text)) == write(text) and lookalike.Canonical()(write(text)) == lookalike.Canonical()(text)


def test_an_id_with_two_texts_is_split_twice(spark):
    df = spark.createDataFrame([(1, "a", "x " * 1500), (1, "a", "y " * 2500), (1, "a", "x " * 1500)], "section_id long, heading string, raw_content string")
    got = splitting.split_oversized(df).collect()
    assert sorted(r["pieces"] for r in got) == [2, 2, 3, 3, 3]


def test_units_of_many_items_and_a_text_of_one_unit(spark):
    unit = " ".join(WORDS)
    d = spark.createDataFrame([(1, f"{unit} . {unit}"), (2, f"{unit} " * 50), (3, "x")], "doc_id long, text string")
    q = spark.createDataFrame([(i, unit) for i in range(200)] + [(500, "x")], "item_id long, text string")
    for most in (10**6, 0):
        got = {(r["doc_id"], r["item_id"], r["places"]) for r in leakage.leaked_items(d, q, broadcast_units=most).collect()}
        assert {(1, i, 2) for i in range(200)} | {(3, 500, 1)} <= got and len(got) == 401 and {r[2] for r in got if r[0] == 2} == {50}
