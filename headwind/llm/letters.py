"""Letters, words and letter trigrams of many texts at once, by code points."""

from __future__ import annotations

import functools

import numpy as np

from headwind.llm import kernel as K


@functools.cache
def _folded() -> np.ndarray:
    """For each code point its lower case (if that is one code point) where it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offs): folded letters and 0 for all else, code point by code point, and where each document begins."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    return _folded()[codes], first[offs]


def neighbours(codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code before and after each one within its document, 0 at its ends."""
    before, after = np.zeros_like(codes), np.zeros_like(codes)
    before[1:], after[:-1] = codes[:-1], codes[1:]
    edge = offs[(offs > 0) & (offs < len(codes))]
    before[edge] = 0
    after[edge - 1] = 0
    return before, after


def hashed(bits: int, *parts: np.ndarray) -> np.ndarray:
    """A bucket below 2**bits of some arrays of codes."""
    h = np.zeros(len(parts[0]), np.uint32)
    for part, factor in zip(parts, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)):
        h = (h ^ (part * np.uint32(factor))) * np.uint32(0x27D4EB2F)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def letter_words(codes: np.ndarray, before: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where, starts, at): indices of letters; where in them each word begins; each document's first word."""
    where = np.flatnonzero(codes)
    starts = np.flatnonzero(before[where] == 0)
    return where, starts, np.searchsorted(where[starts], offs)


def word_batches(column, limit: int = K.BATCH):
    """text_batches(), as (first row, end row, codes, before, after, offs)."""
    for lo, hi, data, offs in K.text_batches(column, limit):
        codes, at = letters(data, offs)
        yield (lo, hi, codes, *neighbours(codes, at), at)
