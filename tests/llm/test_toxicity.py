import random

import numpy as np
import pyarrow as pa
from samples import documents, empty_documents, odd_documents, prose

from turnstile.llm.toxicity import (
    PART_ROWS, best_cut, corpus_chain, features, fit_linear, parts, score, sigmoid, train, without_toxic,
)
from turnstile.llm.words import fold_table, slices

BAD = ["scoundrel", "rotten", "vermin"]


def labelled(spark, seed=1, count=400):
    dice = random.Random(seed)
    rows, labels = [], []
    for i in range(count):
        toxic = i % 6 == 0
        words = prose(dice, dice.randrange(10, 60)).split(" ")
        if toxic:
            for _ in range(dice.randrange(1, 4)):
                words[dice.randrange(len(words))] = dice.choice(BAD) + dice.choice(["", "s!", ",", "ly"])
        low = i % 5 == 0
        if low:
            words += ["click", "buy"]
        rows.append((i, " ".join(words)))
        if i < count // 2:
            labels.append((i, int(not low), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    chain = corpus_chain(docs, labels)
    assert chain.categories == ("low_quality", "toxic")
    # A later model has a weight for every earlier probability.
    assert [len(w) - len(chain.markers) for w in chain.weights] == [0, 1]
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in score(docs, chain).collect()}
    right = [(got[i][0] > chain.cuts[0]) == (i % 5 == 0) for i in range(200, 400)]
    assert np.mean(right) > 0.95
    right = [(got[i][1] > chain.cuts[1]) == (i % 6 == 0) for i in range(200, 400)]
    assert np.mean(right) > 0.97
    kept = without_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, p in got.items() if p[1] <= chain.cuts[1]}


def test_fit_and_cut():
    dice = np.random.default_rng(1)
    x = (dice.random((500, 6)) < 0.3).astype(float)
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    w, b = fit_linear(x, y)
    assert ((sigmoid(x @ w + b) > 0.5) == y).all() and np.abs(w[2:]).max() < w[:2].min() / 2
    assert 0.3 < best_cut(np.array([0.9, 0.8, 0.8, 0.3, 0.1]), np.array([1, 1, 1, 0, 0])) < 0.8


def test_labels_of_one_kind_or_none(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    clean = spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(3, None, None), (None, 0, 1)],
                                  "doc_id long, quality int, toxic int")
    for labels in (none, clean):
        chain = corpus_chain(docs, labels)
        assert all(r.p_toxic < 1e-6 for r in score(docs, chain).collect())
        assert without_toxic(docs, chain).count() == docs.count()
    assert score(empty_documents(spark), corpus_chain(docs, clean)).count() == 0


def test_sample_is_bounded(spark):
    docs, labels = labelled(spark, seed=4, count=120)
    chain = train(docs, labels.select("doc_id", "toxic"), ("toxic",), max_examples=30)
    assert len(chain.weights) == 1


def test_training_is_the_same_in_every_run(spark):
    docs, labels = labelled(spark, seed=7, count=200)
    # Copies of labelled texts under later ids, with other labels.
    copies = docs.filter("doc_id < 60").withColumn("doc_id", docs.doc_id + 1000)
    more = labels.filter("doc_id < 60").selectExpr("doc_id + 1000 AS doc_id", "1 AS quality", "0 AS toxic")
    docs, labels = docs.unionByName(copies), labels.unionByName(more)
    one = corpus_chain(docs.repartition(3, "text"), labels.repartition(2))
    two = corpus_chain(docs.repartition(7, "doc_id"), labels.repartition(5, "doc_id"))
    assert one.cuts == two.cuts and one.biases == two.biases and (one.markers == two.markers).all()
    assert all((a == b).all() for a, b in zip(one.weights, two.weights))
    right = [r.p_toxic > one.cuts[1] for r in score(docs.filter("doc_id < 60"), one).orderBy("doc_id").collect()]
    assert right == [i % 6 == 0 for i in range(60)]


def test_scores_equal_sums_text_by_text(spark):
    docs, labels = labelled(spark, seed=8)
    chain = corpus_chain(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000, None), (5001, ""), (5002, "rotten " * 90_000)]
    got = {r.doc_id: r for r in score(documents(spark, rows).repartition(3), chain).collect()}
    markers = {int(m): i for i, m in enumerate(chain.markers)}
    for doc_id, text in rows:
        present = set()
        for _, raw, offsets in slices(pa.array([text or ""])):
            present = {markers[int(h)] for h in features(raw, offsets, fold_table("alpha"))[0] if int(h) in markers}
        earlier = []
        for category, weights, bias in zip(chain.categories, chain.weights, chain.biases):
            total = bias + sum(float(weights[i]) for i in present)
            total += sum(float(w) * p for w, p in zip(weights[len(markers):], earlier))
            earlier.append(1 / (1 + np.exp(-total)))
            assert abs(got[doc_id][f"p_{category}"] - earlier[-1]) < 1e-5


def test_filter_copies_few_rows_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(["a b"] * 700)], ["doc_id", "text"])
    cut = list(parts(batch))
    assert pa.Table.from_batches(cut).to_pydict() == batch.to_pydict()
    assert max(part.num_rows for part in cut) <= PART_ROWS < 700
    assert not list(parts(batch.slice(0, 0)))
