import math
import random
import re
from collections import Counter

import pytest
from samples import corpus, documents, empty_documents, odd_documents, prose

from turnstile.llm.search import MaxSketchIndex

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked(docs, items, k):
    """Every document scored for every item; (item, rank, doc, score)."""
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, Counter(w), len(w)) for i, w in found if w]
    total = sum(n for _, _, n in found)
    out = []
    for item, text in items:
        scores = []
        weight = {t: math.floor(1000 * math.log((2 * len(found) + 2) / (2 * sum(t in c for _, c, _ in found) + 1)))
                  for t in set(terms(text))}
        for i, count, n in found:
            m = 100 - 50 + (50 * n * len(found)) // total
            score = sum(w * ((10**9 * count[t]) // (1000 * count[t] + 20 * m)) for t, w in weight.items())
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, doc_id string, n int")


def got(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


# A narrow sketch collides all the time, which must only cost bounds.
@pytest.mark.parametrize(("width", "k", "block_terms"), [(8192, 5, 1 << 16), (16, 3, 40), (4, 50, 1)])
def test_equals_brute_force(spark, width, k, block_terms):
    docs = corpus(seed=7, count=300)
    items = [(n, " ".join(t.split()[:30])) for n, (_, t) in enumerate(docs[::11])]
    items += [(900, ""), (901, None), (902, "Unheard-of words"), (903, docs[0][1] * 3)]
    index = MaxSketchIndex(documents(spark, docs).repartition(5), width)
    found = index.search(items_of(spark, items), k, block_terms)
    assert got(found) == sorted(ranked(docs, items, k), key=str)


def test_equal_scores_go_by_id_across_tasks(spark):
    docs = [(i, "same words here") for i in range(700, 0, -1)] + [(0, "other words")]
    found = MaxSketchIndex(documents(spark, docs).repartition(7)).search(items_of(spark, [(1, "same")]), 50)
    assert [(r["rank"], r.doc_id) for r in found.orderBy("rank").collect()] == [(i, i) for i in range(1, 51)]


def test_odd_and_empty_tables(spark):
    odd = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    items = [(1, "one two a words line"), (1, "same TEXT"), (None, "id 漢字"), (2, "0" * 3000 + " x")]
    found = MaxSketchIndex(odd_documents(spark)).search(items_of(spark, items), 4)
    assert got(found) == sorted(ranked(odd, items, 4), key=str)
    assert MaxSketchIndex(empty_documents(spark)).search(items_of(spark, items)).count() == 0
    assert MaxSketchIndex(odd_documents(spark)).search(items_of(spark, [])).count() == 0


def test_long_texts(spark):
    dice = random.Random(3)
    docs = [(1, prose(dice, 400_000)), (2, "rare " + prose(dice, 50)), (3, "rare " * 100_000)]
    items = [(0, "rare baden kerik")]
    assert got(MaxSketchIndex(documents(spark, docs)).search(items_of(spark, items))) == sorted(
        ranked(docs, items, 50), key=str)
