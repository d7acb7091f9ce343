"""Array kernels on the UTF-8 bytes of many texts at once.

A batch is (data, offs): the bytes of its documents one after another, and where each begins (one more entry
than documents). Words, shingles and sums are computed for a whole batch with array operations; no Python code
runs per word. Batches hold about BATCH bytes or one document, so memory is bounded by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH = 1 << 19
U64 = np.uint64


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z; every byte of a longer UTF-8 sequence is one.
ALNUM = _class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Bytes of words [^\x20\x09-\x0D]+.
VISIBLE = ~_class(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

# Hash constants: odd 64-bit multipliers.
_BYTE, _WORD, _SEQ = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or of its inverse."""
    key = (base, inverse)
    if key not in _powers or len(_powers[key]) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        size = max(n, BATCH + 1)
        out = np.ones(1, U64)
        while len(out) < size:
            out = np.concatenate([out, out * U64(pow(step, len(out), 1 << 64))])
        _powers[key] = out[:size]
    return _powers[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_batches(column: pa.Array, limit: int = BATCH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offs) of pieces of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, at): maximal runs of the table's bytes within documents; at: each document's first word."""
    member = table[data]
    edge = offs[(offs > 0) & (offs < len(data))]
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    begins[edge] = member[edge]
    stops = member.copy()
    stops[:-1] &= ~member[1:]
    stops[edge - 1] = member[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """A 64-bit hash of each span's bytes, folded (lower-cased) unless fold is None."""
    if not len(starts):
        return np.zeros(0, U64)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(((fold[data] if fold is not None else data).astype(U64) + U64(1)) * powers(_BYTE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BYTE, len(data) + 1, True)[starts] + (ends - starts).astype(U64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words that begin at each word; the last k - 1 entries are not usable."""
    out = words.copy()
    for j in range(1, k):
        out *= U64(_WORD)
        out[: len(words) - j] += words[j:]
    return mix(out)


def place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, its position in its document and how many words follow from it on, itself included."""
    counts = np.diff(at)
    index = np.arange(at[-1] if len(at) else 0)
    return index - np.repeat(at[:-1], counts), np.repeat(at[1:], counts) - index


def segment_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums over values[at[i]:at[i+1]]; empty ranges give 0."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def sequence_digests(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each document's word sequence, as an array of two columns."""
    position, _ = place(at)
    longest = int(np.diff(at).max(initial=0)) + 1
    out = np.empty((len(at) - 1, 2), U64)
    for j, base in enumerate((_SEQ, _BYTE)):
        out[:, j] = mix(segment_sum((words ^ U64(j)) * powers(base, longest)[position], at) + np.diff(at).astype(U64))
    return out


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, at): each document's k-word shingles in order; a text of fewer words, but not none, is one shingle."""
    counts = np.diff(at)
    _, left = place(at)
    grams = gram_hashes(words, k)
    keep = left >= k
    short = (counts > 0) & (counts < k)
    if short.any():
        first = at[:-1][short]
        keep[first] = True
        grams[first] = sequence_digests(words, at)[short, 0]
    made = np.where(short, 1, np.maximum(counts - k + 1, 0))
    return grams[keep], np.concatenate([[0], np.cumsum(made)])
