"""Word hashes against regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from turnstile.llm.words import distinct, fold_table, joined, shingles, slices, words_of

PATTERNS = {
    "non_space": r"[^\x20\x09-\x0D]+",
    "alnum": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
    "alpha": r"[^\x00-\x60\x7B-\x7F]+",
}


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


@pytest.mark.parametrize("kind", PATTERNS)
def test_words(kind):
    dice = random.Random(4)
    texts = [None, "", "a", "\x00 \x01", "é" * 9, "abcdefgh abcdefghi ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    texts += ["".join(dice.choice("abAB \n.é1漢") for _ in range(dice.randrange(70))) for _ in range(800)]
    seen = {}
    for first, raw, offsets in slices(pa.array(texts)):
        found = words_of(raw, offsets, fold_table(kind))
        for row in range(found.rows):
            expected = re.findall(PATTERNS[kind], lower(texts[first + row] or ""))
            span = range(found.firsts[row], found.firsts[row + 1])
            got = [lower(bytes(raw[found.starts[i]:found.ends[i]]).decode()) for i in span]
            assert got == expected
            for word, i in zip(expected, span):
                assert seen.setdefault(word, found.hashes[i]) == found.hashes[i]
    assert len(set(seen.values())) == len(seen)


def test_slices_cover_all_texts():
    texts = ["x" * n for n in (0, 3 << 20, 5, 0, 1 << 20, 1 << 20, 1 << 20, 0)]
    got = [(first, len(offsets) - 1, len(raw)) for first, raw, offsets in slices(pa.array(texts))]
    assert sum(rows for _, rows, _ in got) == len(texts)
    assert sum(size for _, _, size in got) == sum(map(len, texts))


def test_shingles():
    dice = np.random.default_rng(3)
    counts = [0, 1, 4, 5, 9, 0, 2]
    firsts = np.concatenate([[0], np.cumsum(counts)])
    hashes = dice.integers(0, 2**63, firsts[-1], dtype=np.uint64)
    got, units = shingles(hashes, firsts, 5)
    expected = []
    for unit, count in enumerate(counts):
        part = hashes[firsts[unit]:firsts[unit + 1]]
        expected += [(h, unit) for h in joined(part, min(5, count))] if count else []
    assert list(zip(got.tolist(), units.tolist())) == [(int(h), u) for h, u in expected]


def test_distinct():
    values, units = distinct(np.array([5, 5, 1, 5, 2, 2], np.uint64), np.array([0, 0, 0, 1, 1, 1]))
    assert list(zip(units.tolist(), values.tolist())) == [(0, 1), (0, 5), (1, 2), (1, 5)]
