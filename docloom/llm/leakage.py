"""Problem 7: evaluation texts inside a training corpus, by size-partitioned MinHash containment search.

An item leaks into a document that holds ``run`` of its words in a row, or the whole of a shorter item.  So what is searched for are
units: an item's windows of ``run`` words, or the whole short item.  Units are partitioned by their number of words, each partition
with its own shingle width and number of shingles.  A unit's signature are HASHES MinHashes of its shingles.

Documents are long, and a MinHash of all their shingles would tell next to nothing of what is contained in them.  So a document
gets, for each partition, the MinHashes of every stretch of that partition's size, by sliding minima.  The share of MinHashes that agree estimates how
much of a unit a stretch contains; all of it is asked for, so that a stretch is a candidate if its whole signature is a unit's.  A stretch that holds a unit
always is one, and candidates are verified by their exact words.

The index (size, signature, unit, item) is a table built once.  Up to BROADCAST_UNITS units it is sent to all executors and the
documents are read once and never moved; beyond that, stretches that pass a bitmap of BITS signatures meet it in an equi-join.  A unit that many items have is one unit.

Null or empty texts, on either side, hold no words and give no rows; repeated rows give each pair once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrowmap import chunks_by_chars, map_batches
from docloom.functions.words import mixed, runs_hashed, words_of
from docloom.session import checkpointed

RUN, WIDTH, HASHES, BROADCAST_UNITS, BITS = 12, 5, 4, 1_000_000, 1 << 26
#: Characters of documents taken at once, and words whose hashes a task remembers.
CHARS_AT_ONCE, KNOWN_WORDS = 1 << 19, 500_000


def word_code(word: str) -> int:
    """A hash of a word that isn't 0, which stands for words of no unit and for the end of a text."""
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1


def signatures(codes: np.ndarray, size: int, width: int = WIDTH) -> np.ndarray:
    """One hash of the HASHES MinHashes of each stretch of ``size`` words."""
    if len(codes) < size:
        return np.zeros(0, np.uint64)
    wide = min(width, size)
    count = len(codes) - size + 1
    shingles = runs_hashed(codes, wide)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            own = shingles if not k else mixed(shingles + np.uint64(k))
            least = own[:count].copy()
            for i in range(1, size - wide + 1):
                np.minimum(least, own[i : i + count], out=least)
            out = mixed(out + least)
    return out


def units(items: DataFrame, run: int = RUN) -> DataFrame:
    """(size, signature, unit, item_id), each once: the index."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            if size := min(run, len(words)):
                own = signatures(np.fromiter(map(word_code, words), np.uint64, len(words)), size).view(np.int64).tolist()
                rows += {(size, s, " ".join(words[i : i + size]), item) for i, s in enumerate(own)}
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["size", "signature", "unit", "item_id"])

    known = items.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return map_batches(known, lambda: step, "size int, signature bigint, unit string, item_id bigint").distinct()


class Corpus:
    """Documents end to end: the codes of their words, with a 0 after each, and whose they are."""

    def __init__(self, texts: list[str | None], code):
        found = [words_of(t) for t in texts]
        self.words: list[str] = []
        for own in found:
            self.words += own
            self.words.append("")
        self.codes = np.fromiter(map(code, self.words), np.uint64, len(self.words))
        self.ends = np.cumsum([len(own) + 1 for own in found])
        self.gaps = np.concatenate([[0], np.cumsum(self.codes == 0)])

    def stretches(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the stretches of known words of one text, and all signatures."""
        count = len(self.codes) - size + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = np.flatnonzero(self.gaps[size : size + count] == self.gaps[:count])
        return whole, signatures(self.codes, size) if len(whole) else np.zeros(0, np.uint64)

    def document(self, place: int) -> int:
        return int(np.searchsorted(self.ends, place, side="right"))

    def stretch(self, place: int, size: int) -> str:
        return " ".join(self.words[place : place + size])


class Index:
    """The units of all items at hand, by size."""

    def __init__(self, rows: list[tuple[int, int, str, list[int]]]):
        self.codes: dict[str, int] = {}
        self.sizes: dict[int, tuple[np.ndarray, dict[int, dict[str, list[int]]]]] = {}
        tables: dict[int, dict[int, dict[str, list[int]]]] = defaultdict(lambda: defaultdict(dict))
        for size, signature, unit, items in rows:
            tables[size][signature & 0xFFFFFFFFFFFFFFFF][unit] = items
            for word in unit.split(" "):
                if word not in self.codes:
                    self.codes[word] = word_code(word)
        for size, table in tables.items():
            self.sizes[size] = np.sort(np.fromiter(table, np.uint64, len(table))), dict(table)

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(number of the text, item, places) of the items with a unit in a text."""
        get = self.codes.get
        corpus = Corpus(texts, lambda w: get(w, 0))
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        for size, (keys, table) in self.sizes.items():
            whole, own = corpus.stretches(size)
            own = own[whole] if len(whole) else own
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            for k in np.flatnonzero(keys[at] == own).tolist():
                place = int(whole[k])
                for item in table[int(own[k])].get(corpus.stretch(place, size), ()):
                    found[corpus.document(place), item].add(place)
        for (number, item), places in found.items():
            yield number, item, len(places)


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, broadcast_units: int = BROADCAST_UNITS) -> DataFrame:
    """(doc_id, item_id, places): the documents that hold a unit of an item, and the number of places where they do."""
    index = checkpointed(units(items, run))
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.where(F.length("text") > 0).select("doc_id", "text")
    if index.count() <= broadcast_units:
        rows = index.groupBy("size", "signature", "unit").agg(F.collect_list("item_id").alias("items")).collect()
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def make():
            own = Index(sent.value)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                keys, values = batch.column(0), batch.column(1).to_pylist()
                out = [(i + n, item, places) for i, j in chunks_by_chars(values, CHARS_AT_ONCE) for n, item, places in own.search(values[i:j])]
                if not out:
                    return None
                numbers, found, places = zip(*out)
                return pa.RecordBatch.from_arrays([keys.take(pa.array(numbers)), pa.array(found, pa.int64()), pa.array(places, pa.int32())], names=["doc_id", "item_id", "places"])

            return step

        return map_batches(texts, make, f"doc_id {kind}, item_id bigint, places int").groupBy("doc_id", "item_id").agg(F.max("places").alias("places"))

    sizes = sorted(r[0] for r in index.select("size").distinct().collect())  # no more than run
    marks = np.zeros(BITS // 8, np.uint8)
    for (bit,) in index.select(F.pmod(F.col("signature"), F.lit(BITS)).cast("int").alias("bit")).distinct().toLocalIterator():  # no more than BITS
        marks[bit >> 3] |= np.uint8(1 << (bit & 7))
    bitmap = spark.sparkContext.broadcast(marks)

    def stretches():
        known: dict[str, int] = {"": 0}

        def code(word: str) -> int:
            if (own := known.get(word)) is None:
                if len(known) > KNOWN_WORDS:
                    known.clear()
                    known[""] = 0
                own = known[word] = word_code(word)
            return own

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            keys, values, rows = batch.column(0), batch.column(1).to_pylist(), []
            for i, j in chunks_by_chars(values, CHARS_AT_ONCE):
                corpus = Corpus(values[i:j], code)
                for size in sizes:
                    whole, own = corpus.stretches(size)
                    own = own[whole].view(np.int64) if len(whole) else own
                    bits = own % BITS
                    for k in np.flatnonzero(bitmap.value[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).tolist():
                        place = int(whole[k])
                        rows.append((i + corpus.document(place), place, size, int(own[k]), corpus.stretch(place, size)))
            if not rows:
                return None
            numbers, *rest = zip(*rows)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(numbers)), *(pa.array(c, k) for c, k in zip(rest, (pa.int64(), pa.int32(), pa.int64(), pa.string())))], names=["doc_id", "place", "size", "signature", "unit"])

        return step

    met = map_batches(texts, stretches, f"doc_id {kind}, place bigint, size int, signature bigint, unit string").join(index, ["size", "signature", "unit"])
    return met.groupBy("doc_id", "item_id").agg(F.countDistinct("place").cast("int").alias("places"))
