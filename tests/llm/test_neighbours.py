import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstile.llm.neighbours import Classifier, LearnedPartitions, balanced_parts, nearest, unit

KIND = "vec_id long, embedding array<float>, label int, row long, part string, score double"


def vectors(spark, rows, kind=KIND):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 7, "p", 0.5)
                                  for i, v in rows], kind)


def exact(rows, k, wanted):
    """(query, rank, id, score) over all rows; rows are their own vectors whatever their id."""
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
            if v and None not in v and np.isfinite(v).all() and any(v)]
    size = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, size - len(v)))) for i, v in good]
    out = []
    for n, (i, v) in enumerate(good):
        if i is None or not wanted(i):
            continue
        near = sorted((-float(v @ w) / math.sqrt(float(v @ v) * float(w @ w)), j is None, j or 0, j)
                      for m, (j, w) in enumerate(good) if m != n)
        out += [(i, rank + 1, j, -s) for rank, (s, _, _, j) in enumerate(near[:k])]
    return out


def got(found):
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in found.orderBy("query_id", "rank").collect()]


def clusters(seed, count, size=16, groups=12):
    dice = np.random.default_rng(seed)
    centres = dice.standard_normal((groups, size))
    return [(int(i), (centres[i % groups] + 0.4 * dice.standard_normal(size)).astype(np.float32).tolist())
            for i in dice.permutation(count)]


@pytest.mark.parametrize("structure", [True, False])
def test_recall_against_brute_force(spark, structure):
    rows = clusters(1, 3000, groups=12 if structure else 1)
    index = LearnedPartitions(vectors(spark, rows).repartition(4), part_rows=200, row_block=100, query_block=7)
    found = got(index.search(F.col("vec_id") % 50 == 0))
    true = exact(rows, 5, lambda i: i % 50 == 0)
    scores = {(q, j): s for q, _, j, s in true}
    hits = [scores[q, j] - s for q, _, j, s in found if (q, j) in scores]
    assert len(hits) >= 0.9 * len(true) and max(map(abs, hits)) < 1e-12
    assert [(q, r) for q, r, _, _ in found] == [(q, r) for q, r, _, _ in sorted(true)]
    chances = index.router.probes(unit(np.array([v for _, v in rows])))
    if structure:
        assert np.mean([len(p) for p in chances]) < index.router.parts / 2
    again = LearnedPartitions(vectors(spark, rows).repartition(3), part_rows=200)
    assert got(again.search(F.col("vec_id") % 50 == 0)) == found


def test_every_row_is_indexed_and_large_groups_of_copies_are_exact(spark):
    same = [3.0, 4.0] + [0.0] * 14
    rows = clusters(2, 400) + [(i, same) for i in range(9000, 8000, -1)]
    index = LearnedPartitions(vectors(spark, rows).repartition(4), part_rows=100)
    assert index.rows.count() == 400 + 6
    found = got(index.search(F.col("vec_id") % 250 == 0))
    copies = [f for f in found if f[0] > 8000]
    assert [(q, j) for q, _, j, _ in copies] == [
        (q, j) for q in (8250, 8500, 8750, 9000) for j in range(8001, 8006)]
    assert {s for *_, s in copies} == {1.0}


def test_small_and_odd_tables_are_exact(spark):
    rows = [(0, [1, 2]), (1, None), (2, []), (3, [0, 0]), (4, [1, None]), (5, [math.nan, 1]), (6, [math.inf, 1]),
            (7, [1, 2]), (7, [2, 1]), (None, [1, 2.5]), (None, [1, 2]), (10, [5]), (11, [1, 2, 3]), (20, [-1, -2]),
            (-50, [3e38, 3e38]), (50, [1e-45, 0]), (50, [1, 2])]
    found = LearnedPartitions(vectors(spark, rows)).search(F.col("vec_id") % 10 == 0)
    true = exact(rows, 5, lambda i: i % 10 == 0)
    assert sorted(str(f[:3]) for f in got(found)) == sorted(str(t[:3]) for t in true)
    assert LearnedPartitions(vectors(spark, [])).search(F.lit(True)).count() == 0
    alone = LearnedPartitions(vectors(spark, [(50, [1, 1])]))
    assert alone.search(F.col("vec_id") == 50).count() == 0
    assert LearnedPartitions(vectors(spark, rows)).search(F.lit(False)).count() == 0


def test_doubles_out_of_range_of_squares(spark):
    kind = KIND.replace("array<float>", "array<double>")
    rows = [(0, [1e200, 0]), (1, [1e-200, 1e-200]), (2, [0, 1e300]), (3, [1, 0])]
    found = got(LearnedPartitions(vectors(spark, rows, kind)).search(F.col("vec_id") == 0))
    assert [(j, round(s, 12)) for _, _, j, s in found] == [(3, 1.0), (1, round(math.sqrt(0.5), 12)), (2, 0.0)]


def test_parts_are_balanced_and_keep_neighbours_together():
    x = unit(np.array([v for _, v in clusters(5, 1200)], dtype=float))
    edges = nearest(x, x, np.arange(len(x)), 8)
    part = balanced_parts(x, edges, 12)
    sizes = np.bincount(part, minlength=12)
    assert sizes.max() <= 1.1 * 100 + 1
    inside = (part[edges] == part[:, None]).mean()
    assert inside > 0.6
    y = np.eye(12)[part]
    guess = Classifier.fit(x, y).probabilities(x).argmax(axis=1)
    assert (guess == part).mean() > 0.7
