"""Words and word shingles of whole texts as 64-bit numbers, in numpy inside tasks.

A batch of texts is one run of UTF-8 bytes.  A table of 256 entries folds every
byte: 0 ends a word, anything else is the byte to compare by.  All contracts
here fold only ASCII, so bytes above 0x7F stand for themselves.  Work goes in
slices of whole texts of a few megabytes, which bounds memory; a single longer
text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
ONE = np.uint64(0x9E3779B97F4A7C15)
TWO = np.uint64(0xC2B2AE3D27D4EB4F)
SHIFT = np.uint64(29)
PREFIX = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def fold_table(word: str = "non_space", lower: bool = True, break_lines: bool = False) -> np.ndarray:
    """Byte classes.  ``non_space``: all but ASCII white space; ``alnum``: a-z, 0-9, non-ASCII;
    ``alpha``: a-z and non-ASCII."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    keep = np.ones(256, dtype=bool)
    if word == "non_space":
        keep[[0x20, *range(0x09, 0x0E)]] = False
        # A zero byte is a word byte here and must not read as an end.
        table[0] = 1
        table[1] = 2
    else:
        keep[:128] = False
        keep[97:123] = keep[65:91] = True
        if word == "alnum":
            keep[48:58] = True
    table[~keep] = 0
    return table


def mix64(h: np.ndarray) -> np.ndarray:
    """A mixed copy of the numbers; wraps on overflow."""
    h = (h ^ (h >> SHIFT)) * TWO
    h = (h ^ (h >> SHIFT)) * ONE
    return h ^ (h >> SHIFT)


@dataclass
class Words:
    """Words of ``rows`` texts: hashes, byte places in the slice, first word of each text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray  # rows + 1 entries
    folded: np.ndarray  # bytes of the slice after folding, and eight spare ones
    raw: np.ndarray  # bytes of the slice
    text_starts: np.ndarray  # rows + 1 entries

    @property
    def rows(self) -> int:
        return len(self.firsts) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words_of(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    folded = np.zeros(len(raw) + 8, dtype=np.uint8)
    np.take(table, raw, out=folded[:len(raw)])
    inside = folded[:len(raw)] != 0
    # Boundaries: where the class changes, and at every text start.
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    tails = heads[1:] - 1
    finish[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    return Words(hash_runs(folded, starts, ends), starts, ends, np.searchsorted(starts, offsets),
                 folded, raw, offsets)


def hash_runs(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs; ``folded`` ends with eight spare bytes."""
    lanes = eights(folded)
    lengths = ends - starts
    with np.errstate(over="ignore"):
        first = lanes[starts] & PREFIX[np.minimum(lengths, 8)]
        hashes = mix64(first ^ (lengths.astype(np.uint64) * ONE))
        rest = np.flatnonzero(lengths > 8)
        at = 8
        while len(rest):
            lane = lanes[starts[rest] + at] & PREFIX[np.minimum(lengths[rest] - at, 8)]
            hashes[rest] = mix64(hashes[rest] * ONE + lane)
            at += 8
            rest = rest[lengths[rest] > at]
    return hashes


def eights(folded: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, without copying."""
    return np.ndarray(len(folded) - 7, dtype="<u8", buffer=folded.data, strides=(1,))


def beginnings(found: Words, words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first ``size`` (at most eight) bytes of some words."""
    with np.errstate(over="ignore"):
        return mix64((eights(found.folded)[found.starts[words]] & PREFIX[size]) + np.uint64(size) * TWO)


def joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` numbers in a row (over all borders); len - size + 1 of them."""
    count = max(0, len(hashes) - size + 1)
    with np.errstate(over="ignore"):
        out = hashes[:count].copy()
        for i in range(1, size):
            out = mix64(out * ONE + hashes[i:i + count])
    return out


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``size`` words inside units of words, in order; (hashes, unit of each).

    A unit of fewer words, but not none, is one shingle of all of them.
    """
    counts = np.diff(firsts)
    units = np.repeat(np.arange(len(counts)), np.maximum(0, counts - size + 1))
    whole = joined(hashes, size)
    place = np.arange(len(units)) - np.repeat(
        np.cumsum(np.maximum(0, counts - size + 1)) - np.maximum(0, counts - size + 1),
        np.maximum(0, counts - size + 1))
    out, of = [whole[firsts[units] + place]], [units]
    for few in range(1, size):
        small = np.flatnonzero(counts == few)
        if len(small):
            out.append(joined(hashes, few)[firsts[small]])
            of.append(small)
    if len(out) == 1:
        return out[0], of[0]
    hashes, units = np.concatenate(out), np.concatenate(of)
    order = np.argsort(units, kind="stable")
    return hashes[order], units[order]


def distinct(hashes: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unit's distinct numbers, ascending; units ascending."""
    order = np.lexsort((hashes, units))
    hashes, units = hashes[order], units[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (units[1:] != units[:-1])
    return hashes[new], units[new]


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def lists(values: pa.Array | np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """One list per row from flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
