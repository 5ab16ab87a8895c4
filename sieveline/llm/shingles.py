"""Hashes of word n-grams, computed over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from .decontaminate import NORMAL

BASE, JOIN = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and for each text the number of words before it (with the total behind)."""
    flat = np.frombuffer(b" ".join(texts).translate(NORMAL) + b" ", np.uint8)
    inside = flat != 32
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    before = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    last = np.zeros(len(flat), np.int64)
    last[starts] = starts
    place = np.arange(len(flat)) - np.maximum.accumulate(last)
    # Separators count nothing; a word's bytes count by their place in it.
    reach = np.where(inside, place, 0)
    powers = np.cumprod(np.full(int(reach.max()) + 1, BASE))
    value = np.where(inside, flat.astype(np.uint64) * powers[reach], np.uint64(0))
    return mix(np.add.reduceat(value, starts)), before


def shingle_hashes(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words in order, with repeats, and for each text the number before it.

    A text of fewer words, but not none, has one n-gram of all its words.
    """
    words, before = word_hashes(texts)
    many = np.diff(before)
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n if len(rolled) else 0):
        rolled = rolled * JOIN + words[k : k + len(rolled)]
    count = np.where(many >= n, many - n + 1, np.minimum(many, 1))
    after = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(after[-1], np.uint64)
    full = many >= n
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(after[-1]) - after[owner] + before[owner]
    whole = full[owner]
    out[whole] = rolled[at[whole]]
    for i in np.flatnonzero(~full & (many > 0)):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in words[before[i] : before[i + 1]]:
                h = h * JOIN + w
        out[after[i]] = h
    return mix(out, 1), after


def sets(hashes: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, and the number before each text."""
    owner = np.repeat(np.arange(len(after) - 1), np.diff(after))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(o[new], minlength=len(after) - 1)))).astype(np.int64)
