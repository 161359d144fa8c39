"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other.  The model of a category sees
which markers (words, and beginnings of words, which catch inflected ones) a
document has and the probabilities of all categories before it; in training these are out-of-fold predictions, so that a later model
never learns from probabilities that were fitted to its own rows.

Markers are found in Spark: of all words and beginnings of the sample, those
whose presence differs most between labels.  Fitting is numpy on at most
``max_examples`` labelled documents (those with the smallest hashes of their
ids; of equal texts one), a documented bound; scoring reads every word of every
document and moves no text.

Defined cases: a null text has no words; documents without a label are scored
like others; rows that repeat a ``doc_id`` are scored each by its own text; a
category without labels of both kinds has the probability 0; a document
labelled twice counts with its highest label.  Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import staged
from turnstile.llm.words import beginnings, distinct, fold_table, lists, signed, slices, words_of

MAX_EXAMPLES = 6000
MARKERS = 200  # for each category
BEGINNINGS = (3, 4, 5, 6, 7)  # bytes
LEAST_DOCS = 5
FOLDS = 3
PENALTY = 0.1
STEPS = 15
PART_ROWS = 256  # documents that pass a filter at a time


@dataclass(frozen=True)
class Chain:
    """Fitted models: one line of ``weights`` per category, over the markers and then over
    the probabilities of the categories before it."""

    categories: tuple[str, ...]
    markers: np.ndarray  # ascending hashes
    weights: tuple[np.ndarray, ...]
    biases: tuple[float, ...]
    cuts: tuple[float, ...]  # above them a category counts as present

    def predict(self, present: np.ndarray) -> np.ndarray:
        """Probabilities (rows x categories) from presence (rows x markers)."""
        out = np.zeros((len(present), len(self.categories)))
        for i, (weights, bias) in enumerate(zip(self.weights, self.biases, strict=True)):
            out[:, i] = sigmoid(present @ weights[:len(self.markers)]
                                + out[:, :i] @ weights[len(self.markers):] + bias)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Logistic regression with a light square penalty, by Newton's method."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), -60.0 if not len(y) or not y[0] else 60.0
    full = np.hstack([x, np.ones((len(x), 1))])
    weights = np.zeros(full.shape[1])
    ridge = np.full(full.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        p = sigmoid(full @ weights)
        slope = full.T @ (p - y) + ridge * weights
        bend = (full * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ full
        bend[np.diag_indices_from(bend)] += ridge
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-3:
            break
    return weights[:-1], float(weights[-1])


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on held-out probabilities, amid the widest gap that has it."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    below = np.append(p[1:], 0.0)
    f1[below == p] = 0  # no cut between equal probabilities
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    widest = best[np.argmax((p - below)[best])]
    return float((p[widest] + below[widest]) / 2)


def fit_chain(
    present: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: Sequence[str],
    markers: np.ndarray,
) -> Chain:
    """Models in order; ``labels`` rows x categories, ``folds`` a fold number per row."""
    earlier = np.zeros((len(present), 0))
    weights, biases, cuts = [], [], []
    for i in range(len(categories)):
        x = np.hstack([present, earlier])
        held_out = np.zeros(len(present))
        for fold in range(FOLDS):
            rest = folds != fold
            w, b = fit_linear(x[rest], labels[rest, i])
            held_out[~rest] = sigmoid(x[~rest] @ w + b)
        w, b = fit_linear(x, labels[:, i])
        weights.append(w)
        biases.append(b)
        cuts.append(best_cut(held_out, labels[:, i]))
        earlier = np.hstack([earlier, held_out[:, None]])
    return Chain(tuple(categories), markers, tuple(weights), tuple(biases), tuple(cuts))


def features(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, kept=None):
    """Hashes of all words and their beginnings, and the text of each; only kept ones if asked."""
    found = words_of(raw, offsets, table)
    texts = np.repeat(np.arange(found.rows), found.counts())
    lengths = found.ends - found.starts
    hashes, of = [], []
    for size in (0, *BEGINNINGS):
        if size:
            longer = np.flatnonzero(lengths > size)
            values = beginnings(found, longer, size)
        else:
            longer, values = np.arange(len(texts)), found.hashes
        if kept is not None:
            keep = np.flatnonzero(kept(values))
            longer, values = longer[keep], values[keep]
        hashes.append(values)
        of.append(texts[longer])
    return np.concatenate(hashes), np.concatenate(of)


def labelled_words(docs: DataFrame, labels: DataFrame, categories: Sequence[str], most: int) -> DataFrame:
    """The sample: ``doc_id``, labels as 0 or 1, distinct words as hashes."""
    wanted = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        *[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in categories])
    sample = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``most`` rows
        # Of equal texts one, with the least id and any label that one of them has, in every run.
        .groupBy(F.xxhash64("text").alias("_text")).agg(
            F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), *[F.max(c).alias(c) for c in categories])
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table("alpha")
        for batch in batches:
            for first, raw, offsets in slices(batch.column(1)):
                hashes, of = distinct(*features(raw, offsets, table))
                rows = batch.slice(first, len(offsets) - 1)
                edges = np.searchsorted(of, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *[rows.column(2 + i) for i in range(len(categories))],
                     lists(signed(hashes), edges)], ["doc_id", *categories, "words"])

    fields = ", ".join(f"`{c}` int" for c in categories)
    return texts.select(F.col("doc_id").cast("long"), "text", *categories).mapInArrow(
        emit, f"doc_id bigint, {fields}, words array<bigint>")


def train(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_examples: int = MAX_EXAMPLES,
) -> Chain:
    sample = staged(labelled_words(docs, labels, categories, max_examples), "examples")
    totals = sample.agg(F.count(F.lit(1)), *[F.sum(c) for c in categories]).first()
    rows = totals[0]
    counted = (
        sample.select("doc_id", *categories, F.explode("words").alias("word")).groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("where"),
             *[F.sum(c).alias(c) for c in categories])
        .filter(F.col("n") >= LEAST_DOCS)
        # Of a word and its beginnings that occur in the same documents, one is enough.
        .groupBy("n", "where", *categories).agg(F.min("word").alias("word"))
    )
    counted = staged(counted, "words")
    found = set()
    for i, category in enumerate(categories):
        share = (totals[1 + i] or 0) / max(1, rows)
        # Distance of the labels among documents with the word from what chance gives, in
        # standard errors.
        gap = F.abs(F.col(category) - share * F.col("n")) / F.sqrt(share * (1 - share) * F.col("n") + 1e-9)
        best = counted.orderBy(gap.desc(), "word").limit(MARKERS).select("word").collect()
        found.update(r[0] for r in best)
    markers = np.sort(np.array(sorted(found), dtype=np.int64).view(np.uint64))
    listed = F.array_intersect("words", F.array(*[F.lit(int(m)) for m in signed(markers)]).cast("array<bigint>"))
    local = sample.select("doc_id", *categories, listed.alias("words")).orderBy(
        "doc_id", F.array_sort("words")).toPandas()
    present = np.zeros((len(local), len(markers)))
    for row, words in enumerate(local["words"]):
        present[row, np.searchsorted(markers, np.array(list(words), dtype=np.int64).view(np.uint64))] = 1
    folds = (local["doc_id"].to_numpy(dtype=np.int64) * 2654435761 >> 7) % FOLDS
    return fit_chain(present, local[list(categories)].to_numpy(dtype=float), folds, categories, markers)


def probabilities(chain: Chain, texts: pa.Array) -> np.ndarray:
    """Probabilities of whole texts, in numpy."""
    table = fold_table("alpha")
    # A small filter first: few words are or begin with markers.
    bits = np.zeros(1 << 16, dtype=bool)
    bits[(chain.markers & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = [np.zeros((0, len(chain.categories)))]
    for _, raw, offsets in slices(texts):
        hashes, of = features(
            raw, offsets, table, lambda h: bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(chain.markers, hashes)
        at[at == len(chain.markers)] = 0
        hit = chain.markers[at] == hashes if len(chain.markers) else np.zeros(len(hashes), bool)
        present = np.zeros((len(offsets) - 1, len(chain.markers)), dtype=np.float32)
        present[of[hit], at[hit]] = 1
        out.append(chain.predict(present))
    return np.vstack(out)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id`` and a probability ``p_<category>`` for each category."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"p_{c}" for c in chain.categories]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = probabilities(chain, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(values[:, i]) for i in range(len(names))]],
                ["doc_id", *names])

    fields = ", ".join(f"`{name}` double" for name in names)
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, {fields}")


def without_toxic(docs: DataFrame, chain: Chain, category: str = "toxic") -> DataFrame:
    """Documents, all columns, that the chain does not reject; one pass, no shuffle."""
    at, of = docs.columns.index("text"), chain.categories.index(category)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield part.filter(pa.array(probabilities(chain, part.column(at))[:, of] <= chain.cuts[of]))

    return docs.mapInArrow(keep, docs.schema)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows, few at a time, so that whole texts are not copied a batch at once."""
    for first in range(0, batch.num_rows, PART_ROWS):
        yield batch.slice(first, PART_ROWS)


def corpus_chain(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Chain:
    """The chain for the ``labels`` table: low quality first, then toxicity."""
    marked = labels.select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))
    return train(docs, marked, ("low_quality", "toxic"), max_examples)
