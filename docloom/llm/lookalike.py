"""Problem 8: one form for text that looks the same but is written with different characters.

A character is *stable* if the form leaves it alone wherever it stands: it is no combining mark, can't compose with
what precedes it and isn't folded.  This is the quick-check property of normalisation, extended by the folding
below.  Runs of unstable characters are found by one character class; each is taken with the one character
before it, which is all the context a composition can reach, is decomposed, folded and composed, and is put back into the
text, whose stable stretches are never touched.  Text without unstable characters is returned as it is.

Folded are full-width and half-width forms, ligatures, spaces of other kinds, letters of other scripts drawn like Latin ones,
and characters that show nothing, which vanish.  Kept apart are case, accents, digits, raised digits, fractions,
the number of spaces, and the kinds of quotes and dashes.  A joiner between two pictographs is kept, as it shows.

Two forms come of it.  The *skeleton*, for comparison, makes every letter drawn like a Latin one Latin, in words of other scripts too, so that any two
spellings meet.  The *canonical* text, to train on, leaves words their script: a word with a letter that no Latin one looks like is written in that
letter's script throughout, one of look-alikes only in the script that such letters of the whole text have, or Latin without any.

Null stays null, and an empty text stays empty; neither takes part in pairs.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrowmap import map_batches
from docloom.session import checkpointed

#: Rows of one spelling that a task pairs with another.
DEAL = 1000

#: Letters of other scripts that are drawn like Latin ones, and the Latin ones.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj")
ARMENIAN = ("ՕՏՍսոօհց", "OSUunohg")
CHEROKEE = ("ᎪᏴᏟᎠᎬᏀᎻᏆᎫᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHIJLMPRSTVWZ")
#: Formats that do show, format characters by another category that don't, and marks of pictographs.
SHOWING = [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD]
SELECTORS = [0x34F, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
PICTOGRAPH = "[☀-➿⬀-⯿\U0001f000-\U0001faff]"
OGHAM_SPACE, JOINER = 0x1680, 0x200D
#: Blocks of the scripts of the tables above, by their first and last letters.
SCRIPTS = {"cyrillic": ("Ѐ", "ԯ"), "greek": ("Ͱ", "Ͽ"), "armenian": ("Ա", "֏"), "cherokee": ("Ꭰ", "Ᏽ")}
LETTERS = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


@lru_cache(maxsize=1)
def folding() -> dict[int, str]:
    """What each decomposed character becomes, from Unicode's own properties and the tables above."""
    fold = {ord(a): b for kind in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE) for a, b in zip(*kind, strict=True)}
    for point in range(0xAD, sys.maxunicode + 1):
        char = chr(point)
        kind = unicodedata.category(char)
        if kind == "Zs" and point != OGHAM_SPACE:
            fold[point] = " "
        elif kind == "Cf" and point not in SHOWING:
            fold[point] = ""
        elif tag := unicodedata.decomposition(char):
            parts = "".join(chr(int(x, 16)) for x in tag.split() if x[0] != "<")
            if tag.startswith(("<wide>", "<narrow>")) or (tag.startswith("<compat>") and len(parts) > 1 and kind in ("Lu", "Ll", "Lt") and parts.isalpha()):
                fold[point] = "".join(fold.get(ord(c), c) for c in unicodedata.normalize("NFD", parts))
    fold[0xA0] = " "
    return fold | dict.fromkeys(SELECTORS, "") | dict.fromkeys([*range(9), 0xB, 0xC, *range(0xE, 0x20), *range(0x7F, 0xA0)], "")


@lru_cache(maxsize=1)
def unstable() -> str:
    """A pattern of runs of unstable characters."""
    fold, points = folding(), []
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if point == JOINER:
            continue
        if point in fold or (point > 0x2FF and (unicodedata.combining(char) or not unicodedata.is_normalized("NFC", char) or 0x1160 <= point < 0x1200)):
            points.append(point)
        elif point > 0xBF and not 0xAC00 <= point < 0xD7A4 and any(ord(c) in fold for c in unicodedata.normalize("NFD", char)):
            points.append(point)
        elif unicodedata.category(char) in ("Mc", "Mn"):
            points.append(point)
    ranges, start = [], points[0]
    for a, b in zip(points, [*points[1:], -2]):
        if b != a + 1:
            ranges.append(f"\\U{start:08x}-\\U{a:08x}")
            start = b
    joined = rf"(?!(?<={PICTOGRAPH})\u200d(?={PICTOGRAPH})|(?<={PICTOGRAPH}\ufe0f)\u200d(?={PICTOGRAPH}))"
    return f"(?:[{''.join(ranges)}]|{joined}\u200d)+"


class Canonical:
    """The skeleton of texts."""

    def __init__(self, fold: dict[int, str] | None = None, pattern: str | None = None):
        self.fold = fold or folding()
        self.find = re.compile(pattern or unstable())
        self.stable: set[str] = set()  # characters met that are stable alone

    def __call__(self, text: str) -> str:
        if text.isascii() and not CONTROLS.search(text):
            return text
        if new := set(text) - self.stable:
            self.stable.update(c for c in new if c != "\u200d" and not self.find.match(c))
            if new <= self.stable:
                return text
        else:
            return text
        out, done = [], 0
        for found in self.find.finditer(text):
            start, end = max(done, found.start() - 1), found.end()
            out.append(text[done:start])
            out.append(unicodedata.normalize("NFC", unicodedata.normalize("NFD", text[start:end]).translate(self.fold)))
            done = end
        return "".join([*out, text[done:]]) if out else text


class InScript:
    """The canonical text: consistent, with every word in one script."""

    def __init__(self, fold: dict[int, str] | None = None, pattern: str | None = None):
        fold = dict(fold or folding())
        self.tables = {}
        for name, (letters, latin) in {"cyrillic": CYRILLIC, "greek": GREEK, "armenian": ARMENIAN, "cherokee": CHEROKEE}.items():
            self.tables[name] = dict(zip(letters, latin)), {b: a for a, b in reversed(list(zip(letters, latin)))}
            for letter in letters:
                fold.pop(ord(letter), None)
        self.form = Canonical(fold, pattern)
        self.foreign = re.compile("[" + "".join(f"{a}-{b}" for a, b in SCRIPTS.values()) + "]")

    def __call__(self, text: str) -> str:
        text = self.form(text)
        if not self.foreign.search(text):
            return text
        own = dict.fromkeys(SCRIPTS, 0)
        for char in self.foreign.findall(text):
            name = self.script(char)
            own[name] += char not in self.tables[name][0]
        most = max(own, key=own.get)
        return unicodedata.normalize("NFC", LETTERS.sub(lambda m: self.word(m[0], most if own[most] else None), text))

    @staticmethod
    def script(char: str) -> str | None:
        return next((name for name, (a, b) in SCRIPTS.items() if a <= char <= b), None)

    def word(self, word: str, most: str | None) -> str:
        if not self.foreign.search(word):
            return word
        chars = unicodedata.normalize("NFD", word)
        kinds = [self.script(c) for c in chars]
        # what only one script has settles the word; then a Latin letter that no other script has a like of
        sure = next((k for c, k in zip(chars, kinds) if k and c not in self.tables[k][0]), None)
        if sure is None and most is not None and all(k == most or c in self.tables[most][1] or unicodedata.combining(c) for c, k in zip(chars, kinds)):
            sure = most
        if sure is None:
            return unicodedata.normalize("NFC", "".join(self.tables[k][0].get(c, c) if k else c for c, k in zip(chars, kinds)))
        if any(k is None and not unicodedata.combining(c) and c not in self.tables[sure][1] for c, k in zip(chars, kinds)):
            return word  # truly of two scripts
        back = self.tables[sure][1]
        return unicodedata.normalize("NFC", "".join(c if k == sure else back.get(self.tables[k][0].get(c, c) if k else c, c) for c, k in zip(chars, kinds)))


def digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def canonical_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, canonical, skeleton) of each row: the canonical form of its text, and a digest (hexadecimal) of its skeleton; null for null."""
    kind, fold, pattern = df.schema[key].dataType.simpleString(), folding(), unstable()

    def make():
        form, write = Canonical(fold, pattern), InScript(fold, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = batch.column(1).to_pylist()
            forms = [x if x is None else write(x) for x in values]
            bones = [x if x is None else digest(form(x)).hex() for x in values]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string()), pa.array(bones, pa.string())], names=[key, "canonical", "skeleton"])

        return step

    return map_batches(df.select(key, text), make, f"`{key}` {kind}, canonical string, skeleton string")


def lookalike_keys(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, own): digests of the skeleton and of the text itself; no row for null or empty texts."""
    kind, fold, pattern = df.schema[key].dataType.simpleString(), folding(), unstable()

    def make():
        form = Canonical(fold, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            forms, own = [], []
            for text in batch.column(1).to_pylist():
                own.append(digest(text))
                same = form(text)
                forms.append(own[-1] if same == text else digest(same))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.binary()), pa.array(own, pa.binary())], names=[key, "form", "own"])

        return step

    return map_batches(df.where(F.length(text) > 0).select(key, text), make, f"`{key}` {kind}, form binary, own binary")


def lookalike_spellings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(form, own, key), written once: the rows whose skeleton has several spellings."""
    rows = checkpointed(lookalike_keys(df, key, text).distinct())
    several = rows.groupBy("form").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("form")
    return checkpointed(rows.join(several, "form").select("form", "own", key))


def lookalike_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, spelling, spellings, members): each row whose text has look-alikes, with the smallest key of its class and of its spelling, and what these hold.

    The same for any size of class: copies and spellings are never paired.
    """
    rows = lookalike_spellings(df, key, text)
    own = rows.groupBy("form", "own").agg(F.min(key).alias("spelling"), F.count("*").alias("members"))
    whole = own.groupBy("form").agg(F.min("spelling").alias("class_id"), F.count("*").cast("int").alias("spellings"), F.sum("members").alias("members"))
    return rows.join(own.drop("members"), ["form", "own"]).join(whole, "form").select(key, "class_id", "spelling", "spellings", "members")


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), smaller first: rows whose texts have one skeleton but differ in characters.

    Only skeletons with several spellings are joined.  Spellings are paired, not rows: copies of one spelling meet the copies of another, those of
    the first dealt to tasks of DEAL rows, and never meet each other.
    """
    rows = lookalike_spellings(df, key, text)
    own = rows.groupBy("form", "own").agg(F.count("*").alias("copies"))
    other = own.select("form", F.col("own").alias("other"))
    pairs = own.join(other, "form").where("own < other").select("form", "own", "other", F.ceil(F.col("copies") / DEAL).cast("int").alias("deals"))
    a = pairs.join(rows.select("form", "own", F.col(key).alias("a")), ["form", "own"]).withColumn("deal", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int"))
    b = pairs.select("form", "own", "other", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal")).join(rows.select("form", F.col("own").alias("other"), F.col(key).alias("b")), ["form", "other"])
    met = a.join(b, ["form", "own", "other", "deal"])
    return met.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).where(f"{key}_a <> {key}_b").distinct()
