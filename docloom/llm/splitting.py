"""Problem 1: oversized texts in pieces under a limit, cut where their Markdown allows it, with an overlap.

The hierarchy of boundaries is heading or rule, closed code block, paragraph, line, sentence, word, character.  A text is split at the
highest boundary; a part that still can't be packed is split at the next one, and so on; parts are packed greedily
until the next would not fit.  Every piece but the first begins with the last ``overlap`` characters of the one before,
so pieces without their overlaps are the text again, character by character.

A text is heading, newline and content; a null heading counts as empty, and so does a null content.  A text within the limit
is one piece.  Repeated rows are split once.  Characters are Unicode code points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from bisect import bisect_right as bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrowmap import map_batches

LIMIT, OVERLAP = 2000, 200
#: Places to cut, from the best: each pattern's match begins or ends there (the cut is at its end, or start for a lookahead).
HEADING = re.compile(r"\n(?=#{1,6}[ \t]|(?:---+|\*\*\*+|___+)[ \t]*\n)")
FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n?", re.M)
PARAGRAPH = re.compile(r"\n[ \t]*\r?\n[ \t\r\n]*")
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"[.!?…][\"'”»)\]]*\s+|[。！？]|[:;]\s+")
WORD = re.compile(r"\s+")


def fenced(text: str) -> list[tuple[int, int]]:
    """Ranges of code blocks; one left open ends with the text."""
    out, start, mark = [], None, ""
    for found in FENCE.finditer(text):
        if start is None:
            start, mark = found.start(), found[1]
        elif found[1][0] == mark[0] and len(found[1]) >= len(mark):
            out.append((start, found.end()))
            start = None
    if start is not None:
        out.append((start, len(text)))
    return out


def boundaries(text: str) -> list[list[int]]:
    """Sorted places to cut, by level."""
    blocks = fenced(text)

    def outside(places: list[int]) -> list[int]:
        kept, k = [], 0
        for p in places:
            while k < len(blocks) and blocks[k][1] <= p:
                k += 1
            if k == len(blocks) or not blocks[k][0] < p < blocks[k][1]:
                kept.append(p)
        return kept

    ends = lambda pattern: [m.end() for m in pattern.finditer(text)]
    return [outside(ends(HEADING)), sorted({x for block in blocks for x in block}), outside(ends(PARAGRAPH)), ends(LINE), ends(SENTENCE), ends(WORD)]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Where the pieces' new parts end; the last is the end of the text."""
    size = len(text)
    if size <= limit:
        return [size]
    room = limit - overlap
    atoms: list[int] = []  # ends of parts that fit
    levels = boundaries(text)

    def split(start: int, end: int, level: int) -> None:
        if end - start <= room:
            atoms.append(end)
        elif level == len(levels):
            while end - start > room:
                cut = start + room
                while cut > start + 1 and (unicodedata.combining(text[cut]) or text[cut] in "\u200d\ufe0f" or text[cut - 1] == "\u200d"):
                    cut -= 1
                atoms.append(cut if cut > start + 1 else start + room)
                start = atoms[-1]
            atoms.append(end)
        else:
            places = levels[level]
            for cut in places[bisect(places, start) : bisect_left(places, end)]:
                split(start, cut, level + 1)
                start = cut
            split(start, end, level + 1)

    split(0, size, 0)
    out, packed = [], 0
    for i, end in enumerate(atoms):
        allowed = limit if not out else room
        if i + 1 == len(atoms) or atoms[i + 1] - packed > allowed:
            out.append(end)
            packed = end
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece."""
    ends = cuts(text, limit, overlap)
    return [(max(0, start - overlap) if i else 0, end) for i, (start, end) in enumerate(zip([0, *ends], ends))]


def whole(heading: str = "heading", content: str = "raw_content") -> Column:
    return F.concat(F.coalesce(F.col(heading), F.lit("")), F.lit("\n"), F.coalesce(F.col(content), F.lit("")))


def split_oversized(sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, text: bool = True) -> DataFrame:
    """(section_id, piece_no, pieces, start, length[, piece]) of every section over the limit; the small ones stay in the JVM, unread.

    Were an id to come with different texts, each would be split."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap has to be smaller than the limit")
    rows = sections.select("section_id", whole().alias("whole")).where(F.length("whole") > limit).select("section_id", "whole", F.xxhash64("whole").alias("text_hash"))
    kind = sections.schema["section_id"].dataType.simpleString()
    schema = f"text_hash bigint, section_id {kind}, piece_no int, pieces int, start int, length int" + ", piece string" * text

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(6 + text)]
            for key, value, own in zip(*(c.to_pylist() for c in batch.columns)):
                found = pieces(value, limit, overlap)
                for i, (a, b) in enumerate(found):
                    for column, x in zip(out, (own, key, i, len(found), a, b - a, value[a:b])):
                        column.append(x)
            kinds = [pa.int64(), batch.schema.field(0).type, *[pa.int32()] * 4, pa.string()]
            names = ["text_hash", "section_id", "piece_no", "pieces", "start", "length", "piece"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names[: len(out)])

        return step

    return map_batches(rows, make, schema).dropDuplicates(["section_id", "text_hash", "piece_no"]).drop("text_hash")
