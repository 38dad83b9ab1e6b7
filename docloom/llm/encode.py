"""Problem 6: encoding a corpus with a public byte-level BPE vocabulary, by speculation and verification.

A text is cut into words by the vocabulary's published pattern.  For every word not met before,

1. greedy longest match *proposes* a token sequence;
2. every adjacent pair of all proposals is *verified* at once: the two tokens are walked back down the
   spines of their merge trees, with numpy, until either a merge across the border is found that would
   have come first (incompatible) or both spines are used up (compatible);
3. a word with an incompatible pair is encoded by exact merging.

A sequence whose pairs are all compatible is the one exact merging gives, so the result is exact.

Texts that are null or empty have an empty list of ids.  Extra columns are ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from docloom.functions.arrowmap import chunks_by_chars, map_batches

#: Published splitting pattern of the vocabulary (fixed value), once for ``re`` and once, exactly, for ``regex``.
#: ``re`` has no \p{L}; both agree on texts without the characters that _odd() names.
FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What lies between white space, with the one space before it, or white space: no word reaches over its ends.
STRETCH = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
EXACT = regex.compile(rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

SEPARATOR = re.compile("[\x1c-\x1f]")
#: Strings a worker remembers before it starts anew; characters handled at once; bytes of a word merged alone.
KNOWN_WORDS, CHARS_AT_ONCE, LONG = 600_000, 1 << 20, 48
NOT_MERGED = np.int64(1 << 40)


@lru_cache(maxsize=4096)
def _odd(char: str) -> bool:
    """Whether FAST and EXACT may treat the character differently."""
    kind = unicodedata.category(char)
    return (char.isalnum() != (kind[0] in "LN")) or kind in ("No", "Nl") or "\x1c" <= char <= "\x1f" or (char.isdecimal() != (kind == "Nd"))


def split_words(text: str) -> list[str]:
    if text.isascii():
        return (EXACT if SEPARATOR.search(text) else FAST).findall(text)
    return (EXACT if any(map(_odd, set(text))) else FAST).findall(text)


class Vocabulary:
    """Ranks of a byte-level BPE and what is derived from them: merges by pair, and the two parts of each token."""

    def __init__(self, path: str):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        self.reach: dict[bytes, int] = {}  # the longest token that begins with three bytes
        for token in self.rank:
            if len(token) > 2 and self.reach.get(token[:3], 0) < len(token):
                self.reach[token[:3]] = len(token)
        size = max(self.rank.values()) + 1
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self._parts()

    def _parts(self) -> None:
        """The two tokens that each token is merged from, and the ranks of pairs that follow.

        Where just one cut gives two tokens of lower rank it is the one; where several do, the bytes are merged.
        """
        self.pair_keys, self.pair_ranks = np.zeros(1, np.int64) - 1, np.zeros(1, np.int64)
        todo = sorted((r, t) for t, r in self.rank.items() if len(t) > 1)
        rank, keys, ranks = self.rank, [], []
        for r, t in todo:
            splits = [(a, b) for i in range(1, len(t)) if (a := rank.get(t[:i], r)) < r and (b := rank.get(t[i:], r)) < r]
            if len(splits) > 1:
                splits = [self._replay(t, r)]
            if splits and splits[0]:
                a, b = splits[0]
                self.left[r], self.right[r] = a, b
                keys.append(a << 32 | b)
                ranks.append(r)
        order = np.argsort(keys := np.array(keys, np.int64))
        self.pair_keys, self.pair_ranks = keys[order], np.array(ranks, np.int64)[order]

    def _replay(self, token: bytes, below: int) -> tuple[int, int] | None:
        """Merging of a token's bytes, without the token itself: two tokens are left if it can be reached."""
        parts = [token[i : i + 1] for i in range(len(token))]
        rank = self.rank
        while len(parts) > 2:
            best, at = min((rank.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return rank[parts[0]], rank[parts[1]]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging, lowest rank first and leftmost among equals, until no pair merges.

        Words of one length are the rows of a matrix of tokens beside one of the ranks of adjacent pairs; each
        step merges one pair of every row.  A word over LONG bytes is done alone with a heap.
        """
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, own in by_length.items():
            if length > LONG:
                for i in own:
                    out[i] = self._merge_long(words[i])
                continue
            tokens = self.byte[np.frombuffer(b"".join(words[i] for i in own), np.uint8).reshape(len(own), length)]
            index = np.array(own)
            ranks = self.merged(tokens[:, :-1], tokens[:, 1:])
            while len(index):
                columns = tokens.shape[1]
                if columns == 1:
                    active = np.zeros(len(index), bool)
                else:
                    at = ranks.argmin(1)
                    best = ranks[np.arange(len(index)), at]
                    active = best < NOT_MERGED
                if not active.all():
                    for i, row in zip(index[~active].tolist(), tokens[~active].tolist()):
                        out[i] = row
                    if not active.any():
                        break
                    index, tokens, ranks, at, best = index[active], tokens[active], ranks[active], at[active], best[active]
                rows = np.arange(len(index))
                tokens[rows, at] = best
                shift = np.arange(columns - 1)[None, :]
                tokens = np.take_along_axis(tokens, shift + (shift > at[:, None]), 1)
                ranks = np.take_along_axis(ranks, shift[:, : columns - 2] + (shift[:, : columns - 2] >= at[:, None]), 1)
                if (some := np.flatnonzero(at > 0)).size:
                    k = at[some]
                    ranks[some, k - 1] = self.merged(tokens[some, k - 1], tokens[some, k])
                if (some := np.flatnonzero(at < columns - 2)).size:
                    k = at[some]
                    ranks[some, k] = self.merged(tokens[some, k], tokens[some, k + 1])
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        rank, size = self.rank, len(word)
        ends, after, before = list(range(1, size + 1)), list(range(1, size + 1)), list(range(-1, size - 1))
        alive, heap = bytearray(b"\1") * size, []

        def offer(i: int) -> None:
            if (j := after[i]) < size and (r := rank.get(word[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[j]))

        for i in range(size):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= size or ends[j] != end:
                continue
            alive[j] = 0
            ends[i], after[i] = end, after[j]
            if after[j] < size:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < size:
            out.append(rank[word[i : ends[i]]])
            i = after[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        if (whole := self.rank.get(word)) is not None:
            return [whole]
        get, out, i, n, reach = self.rank.get, [], 0, len(word), self.reach
        while i < n:
            j = min(n, i + reach.get(word[i : i + 3], 2))
            while (token := get(word[i:j])) is None:
                j -= 1
            out.append(token)
            i = j
        return out

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or NOT_MERGED."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NOT_MERGED)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether exact merging of the two tokens' bytes leaves just these two tokens, for all pairs at once.

        Going back in time, the newer of the two border tokens is taken apart.  In each state the border could
        be merged until the merge just undone happened: a border merge of lower rank than that would have won.
        Among equal ranks the leftmost merge is first, so a merge on the right only loses at a rank it exceeds.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        until = np.full(len(a), NOT_MERGED)
        while len(live):
            fine = self.merged(a, b) >= until
            good[live[~fine]] = False
            undo_left = a > b
            inner_left = np.where(undo_left, self.right[a], a)
            inner_right = np.where(undo_left, b, self.left[b])
            # a single byte can't be undone: then the other side is, if it can
            stuck = np.where(undo_left, inner_left == a, inner_right == b)
            other_left = np.where(stuck & ~undo_left, self.right[a], a)
            other_right = np.where(stuck & undo_left, self.left[b], b)
            done = stuck & (other_left == a) & (other_right == b)
            left_was_undone = undo_left ^ stuck
            until = np.where(left_was_undone, a, b + 1)
            a, b = np.where(stuck, other_left, inner_left), np.where(stuck, other_right, inner_right)
            keep = fine & ~done
            live, a, b, until = live[keep], a[keep], b[keep], until[keep]
        return good


class Table:
    """Token sequences by string, kept end to end in one array."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, keys: list[str], flat: np.ndarray, length: np.ndarray) -> None:
        self.code.update(zip(keys, range(len(self.start), len(self.start) + len(keys))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def gather(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of all keys end to end, and the length of each."""
        codes = np.fromiter(map(self.code.__getitem__, keys), np.int64, len(keys))
        length = self.length[codes]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.start[codes] - (ends - length), length) + np.arange(int(length.sum()))], length


def sums(values: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sum of each run of ``counts[i]`` consecutive values."""
    upto = np.concatenate([[0], np.cumsum(values)])[np.cumsum(np.array(counts, np.int64))]
    return np.diff(upto, prepend=0)


class Encoder:
    """Encodes texts.  Remembers the stretches between white space and their words, up to KNOWN_WORDS of them;
    ``failed`` of the ``met`` words needed exact merging."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.failed, self.met = vocabulary, 0, 0
        self.stretches, self.words = Table(), Table()

    def learn_words(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        sequences = list(map(self.v.propose, raw))
        length = np.fromiter(map(len, sequences), np.int64, len(sequences))
        flat = np.fromiter(chain.from_iterable(sequences), np.int64, int(length.sum()))
        owner = np.repeat(np.arange(len(words)), length)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        keys, where = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
        good = self.v.compatible(keys >> 32, keys & 0xFFFFFFFF)
        bad = np.unique(owner[inside[~good[where]]]).tolist()
        self.met, self.failed = self.met + len(words), self.failed + len(bad)
        if bad:
            for i, exact in zip(bad, self.v.merge([raw[i] for i in bad])):
                sequences[i] = exact
            length = np.fromiter(map(len, sequences), np.int64, len(sequences))
            flat = np.fromiter(chain.from_iterable(sequences), np.int64, int(length.sum()))
        self.words.add(words, flat, length)

    def learn(self, stretches: list[str]) -> None:
        split = list(map(split_words, stretches))
        words = list(chain.from_iterable(split))
        if new := set(words).difference(self.words.code):
            self.learn_words(list(new))
        flat, length = self.words.gather(words)
        self.stretches.add(stretches, flat, sums(length, list(map(len, split))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        found = [STRETCH.findall(text) if text else [] for text in texts]
        stretches = list(chain.from_iterable(found))
        if len(self.stretches.code) + len(self.words.code) > KNOWN_WORDS:
            self.stretches, self.words = Table(), Table()
        if new := set(stretches).difference(self.stretches.code):
            self.learn(list(new))
        ids, length = self.stretches.gather(stretches)
        return ids, sums(length, list(map(len, found)))


@lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(Vocabulary(path))


_sent: set[tuple[str, str]] = set()


def encode_column(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids ARRAY<INT>) of each row of ``df``; ``vocabulary`` is the path of a rank file on the driver, which sends it to the executors."""
    kind = df.schema[key].dataType.simpleString()
    context, name = df.sparkSession.sparkContext, os.path.basename(vocabulary)
    if (context.applicationId, vocabulary) not in _sent:
        context.addFile(vocabulary)  # once for each application; a file of that name that differs is refused
        _sent.add((context.applicationId, vocabulary))

    def make():
        encoder = encoder_for(SparkFiles.get(name))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, values, counts = batch.column(1).to_pylist(), [], []
            for i, j in chunks_by_chars(texts, CHARS_AT_ONCE):
                ids, per_text = encoder.encode(texts[i:j])
                values.append(ids)
                counts.append(per_text)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

        return step

    return map_batches(df.select(key, text), make, f"`{key}` {kind}, ids array<int>")
