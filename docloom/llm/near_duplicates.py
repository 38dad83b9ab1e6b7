"""Problem 4: near-duplicate texts by the generalised pigeonhole principle, exactly.

A text is a set of bits, one for each distinct run of three words.  Texts A and B are alike if |A & B| / |A | B| is at least
top / bottom; then at most D = |A| - ceil(|A| top / bottom) bits of A are missing in B.

* Grouping of correlated bits: runs that share their rarest word stand and fall together; they form a partition.
* Thresholds: partition g gets t(g) >= -1 with the sum of t(g) + 1 equal to D + SHARED.  For every such allocation B has at
  least SHARED of the bits probed, if t(g) + 1 bits of each partition are probed.  The cost of a threshold is the estimated number of
  candidates its bits bring, from counts of words over all texts in a sketch of SLOTS counters.  All bits of a partition cost
  the same, so the dynamic programme over partitions (``thresholds``) has the greedy solution as its optimum, which the tests
  prove: whole partitions in the order of their estimates, and a part of the last.  (A partition left out has threshold -1.)  As the order is
  the same for all texts, texts that are alike share SHARED probed bits on *both* sides, so that only probed bits are indexed, not all.
* Probing: texts that share at least SHARED probed bits are candidates; bits go through one exchange, and tasks turn runs of
  equal bits into pairs as they read them.  How many probes a pair needs follows from both sizes (``could_be_alike``): bits beyond don't count
  for it.  Texts of few distinct runs share all they have in common at least, where that is less than SHARED.
* Hot bits: no more texts hold a bit than its rarest word, so that bits of words in more than HOT_BIT texts by the sketch are dealt to
  SALTS tasks from the start, counted in two steps, and paired by as many tasks as their count asks for.
* Verification: exact counts over the 64-bit hashes of the candidates' runs.

Nothing is lost: no cap on candidates, partners or bucket sizes.  Copies of one text are one text till the end; each
task sends the bits of a text once.

Texts with fewer than LEAST_WORDS words, null or empty ones, take no part.  A null title counts as empty.  Repeated rows of one id count
once; were an id to come with different texts, each would count.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.arrowmap import chunks_by_chars
from docloom.functions.words import mixed, runs_hashed, words_of
from docloom.session import checkpointed, dropped, written

WIDTH, LEAST_WORDS, SIMILARITY, SHARED, SLOTS = 3, 30, (6, 10), 4, 1 << 17
#: Words a task remembers and characters it takes at once; texts it remembers as sent; ids up to which the texts of candidates are fetched by a broadcast of their ids.
KNOWN_WORDS, CHARS_AT_ONCE, REMEMBERED, BROADCAST_IDS = 500_000, 1 << 20, 200_000, 2_000_000
#: Texts of one bit that a task pairs by itself; tasks that the texts of bits of frequent words are read by, and that pair large groups; digits of a mark below its size.
HOT_BIT, SALTS, PLACE = 1000, 32, 32
#: Pairs of ids up to which two groups of ids are paired by one task; beyond, in full by SALTS tasks or in short by first ids.
FULL_PAIRS = 10_000


def titled(title: str = "doc_title", content: str = "raw_content") -> Column:
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(content), F.lit("")))


class Words:
    """Hashes of the words of several texts end to end: ``codes``, and the bounds of each text in them."""

    def __init__(self, texts: list[str | None], known: dict[str, int]):
        found = [words_of(t) for t in texts]
        every = list(chain.from_iterable(found))
        if new := set(every).difference(known):
            if len(known) > KNOWN_WORDS:
                known.clear()
                new = set(every)
            for word in new:
                known[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self.codes = np.fromiter(map(known.__getitem__, every), np.uint64, len(every))
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.own = np.repeat(np.arange(len(found)), self.sizes)
        self.enough = np.flatnonzero(self.sizes >= LEAST_WORDS)

    def keys(self) -> np.ndarray:
        """A signed 64-bit hash of the words of each text in their order; 0 without words."""
        place = (np.arange(len(self.codes)) - self.starts[self.own]).astype(np.uint64)
        with np.errstate(over="ignore"):
            spread = mixed(self.codes * (mixed(place + np.uint64(1)) | np.uint64(1)) + place)
        out = np.zeros(len(self.sizes), np.uint64)
        some = self.sizes > 0
        if some.any():
            out[some] = np.bitwise_xor.reduceat(spread, self.starts[some])
        return mixed(out ^ self.sizes.astype(np.uint64)).view(np.int64)

    def slots(self) -> np.ndarray:
        return (self.codes % np.uint64(SLOTS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, slot, n): rows of ids with the key of their text, and at the task's end the numbers of texts by slot of word."""
    known, counts = {}, np.zeros(SLOTS, np.int64)
    names = ["id", "key", "slot", "n"]
    for batch in batches:
        ids, texts = np.array(batch.column(0).to_pylist(), np.int64), batch.column(1).to_pylist()
        for i, j in chunks_by_chars(texts, CHARS_AT_ONCE):
            words = Words(texts[i:j], known)
            if len(words.enough):
                taken = np.isin(words.own, words.enough)
                pairs = np.unique(words.own[taken] * SLOTS + words.slots()[taken])
                counts += np.bincount(pairs % SLOTS, minlength=SLOTS)
                none = pa.nulls(len(words.enough), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][words.enough]), pa.array(words.keys()[words.enough]), none, none.cast(pa.int64())], names=names)
    slots = np.flatnonzero(counts)
    if len(slots):
        none = pa.nulls(len(slots), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(slots.astype(np.int32)), pa.array(counts[slots])], names=names)


def partitions(words: Words, counts: np.ndarray, width: int) -> np.ndarray:
    """The partition of each run of words: the rank of its rarest word by estimate and, among equals, by hash."""
    estimate = np.minimum(counts[words.slots()], (1 << 31) - 1).astype(np.uint64)
    rank = estimate << np.uint64(32) | mixed(words.codes) >> np.uint64(32)
    size = len(rank) - width + 1
    out = rank[:size]
    for i in range(1, width):
        out = np.minimum(out, rank[i : size + i])
    return out


def overlap_needed(size_a, size_b, similarity: tuple[int, int]):
    """The bits that texts of so many distinct bits have in common at least if they are alike; of numbers or arrays."""
    top, bottom = similarity
    return -(-(size_a + size_b) * top // (top + bottom))


def thresholds(costs: list[float], sizes: list[int], total: int) -> tuple[list[int], float]:
    """The thresholds t(g) from -1 to sizes[g] - 1 with the sum of t(g) + 1 equal to ``total`` of least cost, by dynamic programming; and that cost.

    A threshold t of partition g costs t + 1 probes of costs[g] candidates each.  ``probed`` has the same optimum without a table, by
    order of cost, as the tests prove; this is the definition it is held against.
    """
    best: list[tuple[float, list[int]] | None] = [(0.0, []), *[None] * total]
    for cost, size in zip(costs, sizes):
        after: list[tuple[float, list[int]] | None] = [None] * (total + 1)
        for spent, known in enumerate(best):
            for probes in range(min(size, total - spent) + 1) if known else ():
                if (own := after[spent + probes]) is None or known[0] + cost * probes < own[0]:
                    after[spent + probes] = known[0] + cost * probes, [*known[1], probes - 1]
        best = after
    if best[total] is None:
        raise ValueError("there are fewer bits than probes")
    return best[total][1], best[total][0]


def probed(bits: np.ndarray, groups: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """The bits that the allocation of thresholds has a text probe, of its distinct bits the cheapest partitions', ties by bit, in that order; their partitions; the number of distinct bits."""
    top, bottom = similarity
    distinct, first = np.unique(bits, return_index=True)
    groups = groups[first]
    missing = len(distinct) - -(-len(distinct) * top // bottom)
    order = np.argsort(groups, kind="stable")[: missing + SHARED]
    return distinct[order], groups[order], len(distinct)


def released(df: DataFrame) -> DataFrame:
    """A checkpoint, after which the shuffle files it was made from may go: Spark drops them when the driver collects garbage, which is asked for here."""
    df = checkpointed(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def could_be_alike(key_a, mark_a, key_b, mark_b, similarity: tuple[int, int]):
    """Whether a bit that two texts share lies within the probes that this very pair needs, and the number of such bits alike texts have.

    A mark is a text's number of distinct bits, and below it the place of the bit among its probes.  Of the o bits that texts of sizes a and b have
    in common at least, the first s = min(SHARED, o) in the order of probes are among the first a - o + s and b - o + s.
    """
    size_a, size_b = mark_a >> PLACE, mark_b >> PLACE
    common = overlap_needed(size_a, size_b, similarity)
    need = np.minimum(common, SHARED)
    mask = (1 << PLACE) - 1
    low = np.minimum(size_a, size_b)
    return (key_a != key_b) & (common <= low) & ((mark_a & mask) < size_a - common + need) & ((mark_b & mask) < size_b - common + need), need


def meet(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """From rows (bit, key, mark, salt) sorted by bit and key: (a, b, n, need), the pairs of texts that share bits which aren't hot, n of them; of bits
    that may be hot the rows themselves as (bit, key, 0, null, mark).  A row that comes again (a copy, sent by another task) is dropped."""
    names = ["a", "b", "n", "need", "mark"]
    held = [np.zeros(0, np.int64)] * 3
    last = None

    def pairs(bit, key, mark):
        starts = np.flatnonzero(np.r_[True, bit[1:] != bit[:-1]]) if len(bit) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(bit)])
        found = []
        for size in np.unique(sizes[sizes > 1]).tolist():
            own = starts[sizes == size]
            left, right = np.triu_indices(size, 1)
            # many runs of one size at once, in blocks of bounded memory
            step = max(1, (1 << 20) // len(left))
            for at in range(0, len(own), step):
                x, y = (own[at : at + step, None] + left).ravel(), (own[at : at + step, None] + right).ravel()
                good, need = could_be_alike(key[x], mark[x], key[y], mark[y], similarity)
                if good.any():
                    found.append((key[x][good], key[y][good], need[good]))
        if found:
            a, b, need = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((b, a))
            a, b, need = a[order], b[order], need[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            n = np.diff(np.r_[first, len(a)])
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(n.astype(np.int32)), pa.array(need[first].astype(np.int8)), pa.nulls(len(first), pa.int64())], names=names)

    for batch in batches:
        bit, key, mark, salt = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        fresh = np.r_[last != (bit[0], key[0]), (bit[1:] != bit[:-1]) | (key[1:] != key[:-1])]
        last = bit[-1], key[-1]
        warm = fresh & (salt >= 0)
        if warm.any():
            yield pa.RecordBatch.from_arrays([pa.array(bit[warm]), pa.array(key[warm]), pa.array(np.zeros(warm.sum(), np.int32)), pa.nulls(warm.sum(), pa.int8()), pa.array(mark[warm])], names=names)
        cold = fresh & (salt < 0)
        bit, key, mark = (np.concatenate([h, c[cold]]) for h, c in zip(held, (bit, key, mark)))
        cut = np.searchsorted(bit, bit[-1]) if len(bit) else 0
        yield from pairs(bit[:cut], key[:cut], mark[:cut])
        held = [bit[cut:], key[cut:], mark[cut:]]
    yield from pairs(*held)


def near_duplicate_texts(rows: DataFrame, similarity: tuple[int, int] = SIMILARITY, width: int = WIDTH, hot: int = HOT_BIT) -> tuple[DataFrame, DataFrame]:
    """From rows (id BIGINT, text STRING): members (id, key), and the pairs (key_a, key_b, common, size_a, size_b) of different texts that are alike."""
    top, bottom = similarity
    counted = checkpointed(rows.mapInArrow(_counts, "id bigint, key bigint, slot int, n bigint"))
    members = counted.where("id is not null").select("id", "key").distinct()
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in counted.where("slot is not null").groupBy("slot").agg(F.sum("n")).toLocalIterator():
        counts[slot] = n

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sent = {}, set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in chunks_by_chars(texts, CHARS_AT_ONCE):
                words = Words(texts[i:j], known)
                if not len(words.enough):
                    continue
                every, groups, keys, owners, marks, salts, bits = runs_hashed(words.codes, width), partitions(words, counts, width), words.keys(), [], [], [], []
                for n in words.enough.tolist():
                    if (key := int(keys[n])) in sent:
                        continue
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(key)
                    a, b = words.starts[n], words.ends[n] - width + 1
                    chosen, own, size = probed(every[a:b], groups[a:b], similarity)
                    bits.append(chosen)
                    owners.append(key)
                    marks.append((size << PLACE) + np.arange(len(chosen)))
                    # no more texts hold a bit than its rarest word: only bits of frequent words are dealt to several tasks
                    salts.append(np.where(own >> np.uint64(32) > hot, key % SALTS, -1).astype(np.int8))
                if owners:
                    owner = np.repeat(np.array(owners, np.int64), np.fromiter(map(len, bits), np.int64, len(bits)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bits).view(np.int64)), pa.array(owner), pa.array(np.concatenate(marks)), pa.array(np.concatenate(salts))], names=["bit", "key", "mark", "salt"])

    # one exchange by bit; tasks turn runs of equal bits into pairs as they read them
    probes = rows.select("text").mapInArrow(probe, "bit bigint, key bigint, mark bigint, salt tinyint").repartition("bit", "salt").sortWithinPartitions("bit", "key")
    folder, met = written(probes.mapInArrow(lambda batches: meet(batches, similarity), "a bigint, b bigint, n int, need tinyint, mark bigint"))
    # bits of frequent words are counted, and the texts of one are dealt to as many tasks as its heat asks for, each of which sees all on the other side
    warm = met.where("n = 0").select(F.col("a").alias("bit"), F.col("b").alias("key"), "mark")
    heat = warm.groupBy("bit").agg(F.count("*").alias("texts")).where("texts > 1").select("bit", F.ceil(F.col("texts") / hot).cast("int").alias("deals"))
    shared = warm.join(heat, "bit")
    left = shared.select("bit", F.col("key").alias("key_a"), F.col("mark").alias("mark_a"), F.pmod(F.xxhash64("key"), F.col("deals")).cast("int").alias("deal"))
    right = shared.select("bit", F.col("key").alias("key_b"), F.col("mark").alias("mark_b"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    size_a, size_b = F.shiftright("mark_a", PLACE), F.shiftright("mark_b", PLACE)
    common = -F.floor(-(size_a + size_b) * top / F.lit(top + bottom))
    need, mask = F.least(common, F.lit(SHARED)), (1 << PLACE) - 1
    within = (common <= F.least(size_a, size_b)) & (F.col("mark_a").bitwiseAND(mask) < size_a - common + need) & (F.col("mark_b").bitwiseAND(mask) < size_b - common + need)
    hotly = left.join(right, ["bit", "deal"]).where((F.col("key_a") < F.col("key_b")) & within).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), F.lit(1).alias("n"), need.cast("tinyint").alias("need"))
    every = met.where("n > 0").select("a", "b", "n", "need").unionByName(hotly).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    candidates = released(every.where("n >= need").select(F.col("a").alias("key_a"), F.col("b").alias("key_b")))
    dropped(rows.sparkSession, folder)

    wanted = candidates.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    first = checkpointed(members.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("id").alias("id")))
    ids = first.select("id")
    texts = rows.join(F.broadcast(ids) if first.count() <= BROADCAST_IDS else ids, "id", "left_semi")

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in chunks_by_chars(texts, CHARS_AT_ONCE):
                words = Words(texts[i:j], known)
                if len(words.enough):
                    every = runs_hashed(words.codes, width)
                    sets = [np.unique(every[words.starts[n] : words.ends[n] - width + 1]).view(np.int64) for n in words.enough]
                    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(words.keys()[words.enough]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["key", "bits"])

    sets = texts.select("text").mapInArrow(bits_of, "key bigint, bits array<bigint>").dropDuplicates(["key"])
    met = candidates.join(sets.select(F.col("key").alias("key_a"), F.col("bits").alias("bits_a")), "key_a").join(sets.select(F.col("key").alias("key_b"), F.col("bits").alias("bits_b")), "key_b")
    sized = met.select("key_a", "key_b", F.size(F.array_intersect("bits_a", "bits_b")).alias("common"), F.size("bits_a").alias("size_a"), F.size("bits_b").alias("size_b"))
    return members, released(sized.where(F.col("common") * bottom >= (F.col("size_a") + F.col("size_b") - F.col("common")) * top))


def alike_pairs(members: DataFrame, pairs: DataFrame, full: bool = False) -> DataFrame:
    """(id_a, id_b), smaller first, of ids whose texts are alike or the same: with ``full`` every such pair.

    Without it, groups of ids of one key are paired in full up to FULL_PAIRS pairs of ids only; larger ones by their first ids, which leaves
    them connected.  Ids of one key have the same words, not always the same text.
    """
    groups = members.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    own = groups.where("copies > 1").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))
    links = pairs.select("key_a", "key_b").unionByName(own)
    for side in ("a", "b"):
        links = links.join(groups.select(F.col("key").alias(f"key_{side}"), F.col("first").alias(f"first_{side}"), F.col("copies").alias(f"copies_{side}")), f"key_{side}")
    small = F.col("copies_a") * F.col("copies_b") <= FULL_PAIRS
    ids = {side: members.select(F.col("key").alias(f"key_{side}"), F.col("id").alias(f"id_{side}")) for side in ("a", "b")}
    # within a group each pair is met both ways round
    once = (F.col("key_a") != F.col("key_b")) | (F.col("id_a") < F.col("id_b"))
    if full:
        # the ids of the first group of a link are dealt to tasks, HOT_BIT to one, each of which sees all of the second
        deals = F.ceil(F.col("copies_a") / HOT_BIT).cast("int")
        dealt = links.select("key_a", "key_b", deals.alias("deals")).join(ids["a"], "key_a").withColumn("salt", F.pmod(F.xxhash64("id_a"), F.col("deals")).cast("int"))
        others = links.select("key_a", "key_b", F.explode(F.sequence(F.lit(0), deals - 1)).alias("salt")).join(ids["b"], "key_b")
        met = dealt.join(others, ["key_a", "key_b", "salt"]).where(once).select("id_a", "id_b")
    else:
        met = links.where(small).join(ids["a"], "key_a").join(ids["b"], "key_b").where(once).select("id_a", "id_b")
        large = links.where(~small)
        left = large.join(ids["a"], "key_a").select("id_a", F.col("first_b").alias("id_b"))
        right = large.join(ids["b"], "key_b").select(F.col("first_a").alias("id_a"), "id_b")
        met = met.unionByName(left).unionByName(right)
    return met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).where("id_a < id_b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of undirected edges (a, b): the smallest node of its component, by large-star and small-star.

    Edges are spread over their nodes' neighbours in aggregates; each round is checkpointed.  Raises if it has not come to rest after most_rounds.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("b < a")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a")
        after = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))).where("b < a").distinct()
        after = checkpointed(after)
        changed = after.join(edges, ["a", "b"], "left_anti").limit(1).count() + edges.join(after, ["a", "b"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root"))).distinct()
    raise RuntimeError("components have not come to rest")


def classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, links): each id with the smallest id of its class and the number of different texts alike to its own."""
    first = members.groupBy("key").agg(F.min("id").alias("first"))
    a, b = first.select(F.col("key").alias("key_a"), F.col("first").alias("a")), first.select(F.col("key").alias("key_b"), F.col("first").alias("b"))
    edges = checkpointed(pairs.select("key_a", "key_b").join(a, "key_a").join(b, "key_b").select("a", "b"))
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.groupBy(F.col("a").alias("first")).agg(F.count("*").alias("links"))
    roots = components(edges).withColumnRenamed("node", "first")
    texts = first.join(roots, "first", "left").join(links, "first", "left")
    return members.join(texts, "key").select("id", F.coalesce("root", "first").alias("class_id"), F.coalesce("links", F.lit(0)).cast("int").alias("links"))


def sections_as_rows(sections: DataFrame) -> DataFrame:
    return sections.select(F.col("section_id").cast("long").alias("id"), titled().alias("text"))
