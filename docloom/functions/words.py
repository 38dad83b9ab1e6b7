"""Words as maximal runs of Unicode letters and digits, in lower case, and hashes of runs of them."""

from __future__ import annotations

import re

import numpy as np

#: ``str.isalnum`` holds for the categories L and N alone, and ``\\w`` adds the underscore to it.
WORD = re.compile(r"[^\W_]+")
#: Odd multipliers of the hashes (fixed values, from the golden ratio and a 64-bit mixer).
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads them."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * MIX
        return (values ^ (values >> np.uint64(27))) * STEP ^ (values >> np.uint64(31))


def runs_hashed(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive codes; the order in a run counts."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) - width + 1, np.uint64)
        for i in range(width):
            total = mixed(total + codes[i : len(codes) - width + 1 + i] + STEP)
    return total
