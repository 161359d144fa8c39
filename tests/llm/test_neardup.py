import re

import numpy as np
import pyarrow as pa
import pytest
from samples import corpus, documents, empty_documents, odd_documents, prose

from turnstile.llm import neardup
from turnstile.llm.common import ARROW_BYTES, arrow_bytes, staged
from turnstile.llm.components import components
from turnstile.llm.neardup import NearDuplicates


def brute(rows, size, percent):
    """Smallest id that links reach, by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        sets[doc_id] = {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    label = {i: i for i in sets}

    def root(i):
        return i if label[i] == i else root(label[i])

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            union = sets[a] | sets[b]
            if union and 100 * len(sets[a] & sets[b]) >= percent * len(union):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def result(found):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_against_all_pairs(spark, size):
    rows = corpus(seed=size, count=120)
    assert result(NearDuplicates(documents(spark, rows), size=size).report()) == brute(rows, size, 80)


def test_large_group_in_blocks(spark, monkeypatch):
    """A family whose members match some others only, over several blocks."""
    import random

    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 4)
    dice = random.Random(8)
    base, rows = prose(dice, 90).split(" "), []
    for i in range(70):
        words = list(base)
        for _ in range(dice.randrange(1, 9)):
            words[dice.randrange(len(words))] = f"w{dice.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    assert result(NearDuplicates(documents(spark, rows), size=2).report()) == brute(rows, 2, 80)


def test_estimate_is_near_the_truth():
    dice = np.random.default_rng(2)
    from turnstile.llm.neardup import REGISTERS, registers

    for share in (0.5, 0.8, 0.95):
        both = dice.integers(0, 2**63, 4000, dtype=np.uint64)
        cut = int(4000 * share)
        rest = (4000 - cut) // 2
        a = np.sort(both[:cut + rest])
        b = np.sort(np.concatenate([both[:cut], both[cut + rest:]]))
        lines = registers(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        assert abs((lines[0] == lines[1]).mean() - share) < 4 * (share * (1 - share) / REGISTERS) ** 0.5


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_odd_documents(spark):
    found = NearDuplicates(odd_documents(spark)).report().collect()
    assert len(found) == odd_documents(spark).count()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[0].component_id == 0 and by_id[0].n_shingles == 0 and by_id[0].kept
    assert by_id[14].component_id == 13 and not by_id[14].kept
    assert all(r.component_id == 3 for r in found if r.doc_id == 3)


def test_empty_table(spark):
    assert NearDuplicates(empty_documents(spark)).report().count() == 0


def test_tasks_get_bounded_batches(spark, monkeypatch):
    """While sets are made and compared, a task is sent some megabyte of texts at a time."""
    seen = []

    def recorded(frame, purpose):
        seen.append(spark.conf.get(ARROW_BYTES))
        return staged(frame, purpose)

    before = spark.conf.get(ARROW_BYTES)
    monkeypatch.setattr(neardup, "staged", recorded)
    NearDuplicates(documents(spark, [(1, "a b c d e f"), (2, "a b c d e f g")]))
    assert seen and set(seen) == {str(1 << 20)} and spark.conf.get(ARROW_BYTES) == before


def test_batches_are_cut_by_bytes(spark):
    docs = spark.range(0, 400, 1, 1).selectExpr("repeat('word ', 4000) AS text")  # 8 MB

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    with arrow_bytes(spark):
        found = [r.n for r in docs.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) >= 8_000_000 and max(found) < 2 << 20
