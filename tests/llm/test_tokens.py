import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from samples import corpus, documents, empty_documents, odd_documents

from turnstile.llm.queries import VOCABULARY
from turnstile.llm.tokens import Counter, build, count_tokens, edit, with_edits


@pytest.fixture(scope="module")
def vocabulary():
    return Path(VOCABULARY).read_bytes()


@pytest.fixture(scope="module")
def counter(vocabulary):
    return Counter(vocabulary)


def full(counter, text):
    return len(counter.coding.encode_ordinary(text))


def test_edits_equal_counting_anew(counter):
    dice = random.Random(2)
    parts = ["a", "é", " ", "  ", "\n", "'", "'re", "1", "!!", " the", "ll", "\t", "x1", "漢"]
    encoded = total = 0
    for _ in range(500):
        text = "".join(dice.choice(parts) for _ in range(dice.randrange(0, 900)))
        tree = build(text, counter)
        assert tree.tokens == full(counter, text)
        for _ in range(5):
            start = dice.randrange(len(text) + 2)
            new = "".join(dice.choice(parts) for _ in range(dice.randrange(6)))
            text, n = edit(text, tree, start, start + dice.choice([0, 1, 3, 50]), new, counter)
            encoded, total = encoded + n, total + int(tree.nodes[1][0])
            assert tree.tokens == full(counter, text) and tree.chars == len(text)
            assert int(tree.nodes[1][0]) == len(counter.cut(text))
            assert tree.nodes[tree.width:].sum(0).tolist() == tree.nodes[1].tolist()
    assert encoded < total / 2


def test_a_long_text_is_touched_in_places_only(counter):
    text = "some words and more\n" * 20000
    tree = build(text, counter)
    text, n = edit(text, tree, len(text) // 2, len(text) // 2 + 5, "other", counter)
    assert n < 300 and tree.tokens == full(counter, text)


def test_table(spark, vocabulary, counter):
    rows = corpus(seed=4, count=30)
    edits = spark.createDataFrame(
        [(i, [(0, 2, "New "), (10, 10, "x"), (10**6, 10**7, " end")]) for i, _ in rows[:20]],
        "doc_id long, edits array<struct<start:int,end:int,new:string>>")
    got = {r.doc_id: r for r in count_tokens(with_edits(documents(spark, rows), edits), vocabulary).collect()}
    for n, (doc_id, text) in enumerate(rows):
        changed = text
        if n < 20:
            changed = "New " + changed[2:]
            changed = changed[:10] + "x" + changed[10:] + " end"
        row = got[doc_id]
        assert (row.n_tokens, row.n_tokens_edited) == (full(counter, text), full(counter, changed))


def test_odd_and_empty_tables(spark, vocabulary, counter):
    none = F.lit(None).cast("array<struct<start:int,end:int,new:string>>")
    docs = odd_documents(spark)
    got = count_tokens(docs.withColumn("edits", none), vocabulary).collect()
    assert len(got) == docs.count() and all(r.n_tokens == r.n_tokens_edited for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[0] == 0
    assert count_tokens(empty_documents(spark).withColumn("edits", none), vocabulary).count() == 0
