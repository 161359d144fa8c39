import random
import re

import pytest
from samples import documents, empty_documents, odd_documents, prose

from turnstile.llm.mixing import mix


def targets(sizes, weights=(5, 2, 1), share=1.5, passes=2):
    """Shares by weight, the excess over the caps dealt out again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(passes * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level >= passes * sizes[s]}
        if not over:
            return {s: passes * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_limits(spark, seed):
    dice = random.Random(seed)
    names = ["hot"] * 6 + ["a", "b", "é", None, "A", "z1", "z2", "empty"]
    rows = [(i, "" if (s := dice.choice(names)) == "empty" else prose(dice, dice.randrange(0, 300)), s)
            for i in range(250)]
    got = mix(documents(spark, rows), block_words=40).taken().collect()
    count = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((i, count(t)) for i, t, _ in rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    goal, taken = targets(sizes), {s: 0 for s in sizes}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in sizes)


def test_schedule_spreads_every_source(spark):
    dice = random.Random(5)
    rows = [(i, prose(dice, 50), "abc"[i % 3]) for i in range(300)]
    plan = mix(documents(spark, rows), block_words=10)
    slots = sorted((r.slot, r.number, r["rank"]) for r in plan.slots.collect())
    total = len(slots)
    for number in range(3):
        own = [slot for slot, n, _ in slots if n == number]
        for part in (0.25, 0.5, 0.75):
            before = sum(slot <= part * total for slot in own)
            assert abs(before - part * len(own)) <= 4
        ranks = [rank for _, n, rank in slots if n == number]
        assert ranks == list(range(len(ranks)))


def test_reruns_agree(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 4}") for i in range(200)]
    one, two = (sorted(map(tuple, mix(documents(spark, rows).repartition(n)).taken().collect())) for n in (1, 7))
    assert one == two


def test_odd_and_empty_tables(spark):
    got = mix(odd_documents(spark)).taken().collect()
    assert len(got) == odd_documents(spark).count()
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mix(empty_documents(spark)).taken().count() == 0
    blank = documents(spark, [(1, " ", "a"), (2, None, None)])
    assert sorted((r.doc_id, r.taken, r.target) for r in mix(blank).taken().collect()) == [
        (1, 0, 0.0), (2, 0, 0.0)]
