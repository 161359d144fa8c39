"""Ranked lexical search with hashed max-sketches and descending-bound rescoring.

A document's impact for a term grows with the term's occurrences and falls with
the document's length; the term's weight is the query's side of the score.  The
index folds the documents' terms into ``width`` cells by hash and keeps each
cell's largest occurrence, which stands for its largest impact, as impact grows
with occurrences.  It needs no statistics of the corpus, so documents may be
added later.  Beside the sketch stand the document's distinct terms.

A batch of queries is looked up in the sketches: the sum over a query's terms of
weight times cell can only be too high, never too low.  Inside a task, the
documents are scored exactly from the highest bound downwards until no bound
reaches the query's k-th best score so far (equal ones are scored, too, as the
smaller id wins).  A task reports ``k`` rows per query at most, and the best of
all tasks are the result, so that nothing is approximate.

Queries go in blocks of a bounded number of terms, each a pass over the index.

Defined cases: null or empty texts have no terms and count nowhere; queries
without terms find nothing; rows that repeat a ``doc_id`` or ``item_id`` are each
ranked for themselves; rows without a ``doc_id`` come after others of their score.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from turnstile.llm.common import arrow_rows, staged
from turnstile.llm.words import fold_table, lists, signed, slices, words_of

WIDTH = 1 << 13
# Documents whose sketches are one dense matrix: 16 MB at the default width.
BLOCK_ROWS = 256
# Terms of a block of queries (a single longer query is a block of its own).
BLOCK_TERMS = 1 << 16
# Bounds scored at a time, per query.
CHUNK = 64
GROUPS = 64
# Documents that a task is sent at a time.
SENT_ROWS = 2048

INDEX = ("doc_id bigint, n bigint, terms array<bigint>, counts array<int>, "
         "cells array<int>, tops array<int>")


def runs(values: np.ndarray) -> np.ndarray:
    """Where a sorted array's values begin."""
    first = np.ones(len(values), dtype=bool)
    first[1:] = values[1:] != values[:-1]
    return np.flatnonzero(first)


def indexed(docs: DataFrame, width: int) -> DataFrame:
    """Per document: its terms with repeats, distinct terms with counts, and the sketch."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table("alnum")
        for batch in batches:
            for first, raw, offsets in slices(batch.column(1)):
                found = words_of(raw, offsets, table)
                units = np.repeat(np.arange(found.rows), found.counts())
                terms = signed(found.hashes)
                order = np.lexsort((terms, units))
                terms, units = terms[order], units[order]
                new = np.ones(len(terms), dtype=bool)
                new[1:] = (terms[1:] != terms[:-1]) | (units[1:] != units[:-1])
                heads = np.flatnonzero(new)
                counts = np.diff(np.append(heads, len(terms)))
                terms, units = terms[heads], units[heads]
                slots = units * width + (terms & (width - 1))
                order = np.argsort(slots, kind="stable")
                slots = slots[order]
                heads = runs(slots)
                tops = np.maximum.reduceat(counts[order], heads) if len(heads) else counts
                rows = np.arange(found.rows + 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, found.rows), pa.array(found.counts().astype(np.int64)),
                    lists(terms, np.searchsorted(units, rows)),
                    lists(counts.astype(np.int32), np.searchsorted(units, rows)),
                    lists((slots[heads] % width).astype(np.int32), np.searchsorted(slots[heads], rows * width)),
                    lists(tops.astype(np.int32), np.searchsorted(slots[heads], rows * width)),
                ], ["doc_id", "n", "terms", "counts", "cells", "tops"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, INDEX)


@dataclass
class Queries:
    """A block of queries: ids, and for each the places of its terms in ``vocabulary``."""

    numbers: np.ndarray
    ids: list
    vocabulary: np.ndarray
    firsts: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, object, np.ndarray]]) -> Queries:
        vocabulary, places = np.unique(
            np.concatenate([terms for _, _, terms in rows]), return_inverse=True)
        sizes = [len(terms) for _, _, terms in rows]
        return cls(np.array([number for number, _, _ in rows], dtype=np.int64), [key for _, key, _ in rows],
                   vocabulary, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), places.reshape(-1))

    def __len__(self) -> int:
        return len(self.ids)


def query_blocks(items: DataFrame, block_terms: int) -> Iterator[Queries]:
    """The queries that have terms, in blocks; one block at a time is on the driver."""
    table, block, held = fold_table("alnum"), [], 0
    for number, row in enumerate(items.select("item_id", "text").toLocalIterator()):
        for _, raw, offsets in slices(pa.array([row.text], pa.string())):
            terms = np.unique(signed(words_of(raw, offsets, table).hashes))
            if not len(terms):
                continue
            if block and held + len(terms) > block_terms:
                yield Queries.of(block)
                block, held = [], 0
            block.append((number, row.item_id, terms))
            held += len(terms)
    if block:
        yield Queries.of(block)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the first one of each row."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


class Best:
    """The k best (query, document) pairs of a task so far, and each query's k-th score."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.floor = np.zeros(queries, dtype=np.int64)
        self.query = np.zeros(0, dtype=np.int64)
        self.score, self.doc = self.query.copy(), self.query.copy()
        self.no_id = np.zeros(0, dtype=bool)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        keep = (score > 0) & (score >= self.floor[query])
        query, score = np.append(self.query, query[keep]), np.append(self.score, score[keep])
        doc, no_id = np.append(self.doc, doc[keep]), np.append(self.no_id, no_id[keep])
        order = np.lexsort((doc, no_id, -score, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], np.arange(self.queries))[query[order]]
        order = order[rank < self.k]
        self.query, self.score, self.doc, self.no_id = query[order], score[order], doc[order], no_id[order]
        last = np.searchsorted(self.query, np.arange(self.queries)) + self.k - 1
        full = np.searchsorted(self.query, np.arange(self.queries), side="right") > last
        self.floor[full] = self.score[last[full]]


class MaxSketchIndex:
    """Sketches and terms of all documents, written once to the shared folder."""

    def __init__(self, docs: DataFrame, width: int = WIDTH):
        if width & (width - 1):
            raise ValueError("the width must be a power of two")
        self.width = width
        with arrow_rows(docs.sparkSession, SENT_ROWS):
            self.rows = staged(indexed(docs, width), "sketches")
        total = self.rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.documents, self.length = total

    def search(self, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
        """The ``k`` best documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``."""
        kind = items.schema["item_id"].dataType
        schema = f"number bigint, item_id {kind.simpleString()}, doc_id bigint, score bigint, part int"
        found = []
        for block in query_blocks(items, block_terms):
            with arrow_rows(items.sparkSession, SENT_ROWS):
                found.append(staged(self._candidates(block, k, schema, to_arrow_type(kind)), "found"))
        if not found:
            found = [items.sparkSession.createDataFrame([], schema)]
        for more in found[1:]:
            found[0] = found[0].unionByName(more)
        # First within groups of tasks, so that a query's rows of very many tasks do not meet at once.
        for key in (["number", "part"], ["number"]):
            order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            found[0] = found[0].withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return found[0].select("item_id", "rank", "doc_id", "score")

    def weights(self, queries: Queries) -> np.ndarray:
        """Whole-number weights of the block's terms, by the documents that hold them."""
        vocabulary = queries.vocabulary

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(len(vocabulary), dtype=np.int64)
            for batch in batches:
                place, known = lookup(vocabulary, flat(batch.column(0))[0])
                held += np.bincount(place[known], minlength=len(vocabulary))
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["place", "n"])

        # One row per term of the block at most.
        counted = self.rows.select("terms").mapInArrow(count, "place bigint, n bigint")
        with arrow_rows(self.rows.sparkSession, SENT_ROWS):
            counts = counted.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        df = np.zeros(len(vocabulary), dtype=np.int64)
        df[counts["place"].to_numpy()] = counts["n"].to_numpy()
        top = 2 * self.documents + 2
        return np.array([math.floor(1000 * math.log(top / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)

    def _candidates(self, queries: Queries, k: int, schema: str, id_type: pa.DataType) -> DataFrame:
        weights, width = self.weights(queries), self.width
        documents, length = self.documents, max(1, self.length)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, best = TaskContext.get().partitionId() % GROUPS, Best(len(queries), k)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    scored(batch.slice(at, BLOCK_ROWS), queries, weights, documents, length, width, best)
            yield pa.RecordBatch.from_arrays([
                pa.array(queries.numbers[best.query]), pa.array([queries.ids[i] for i in best.query], id_type),
                pa.array(best.doc, mask=best.no_id), pa.array(best.score),
                pa.array(np.full(len(best.query), part, dtype=np.int32)),
            ], ["number", "item_id", "doc_id", "score", "part"])

        return self.rows.filter("n > 0").mapInArrow(search, schema)


def lookup(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each term in the sorted vocabulary, and whether it is there."""
    place = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    return place, vocabulary[place] == terms


def scored(
    batch: pa.RecordBatch, queries: Queries, weights: np.ndarray, documents: int, length: int, width: int,
    best: Best,
) -> None:
    """Bounds of all queries for a block of documents, then exact scores in descending order of bounds."""
    n = batch.column("n").to_numpy()
    half_full = 20 * (50 + (50 * n * documents) // length)

    def impact(count: np.ndarray, row: np.ndarray) -> np.ndarray:
        count = count.astype(np.int64)
        return (1_000_000_000 * count) // (1000 * count + half_full[row])

    cells, firsts = flat(batch.column("cells"))
    tops, _ = flat(batch.column("tops"))
    row = np.repeat(np.arange(len(n)), np.diff(firsts))
    sketch = np.zeros((width, len(n)))
    sketch[cells, row] = impact(tops, row)

    terms, firsts = flat(batch.column("terms"))
    counts, _ = flat(batch.column("counts"))
    row = np.repeat(np.arange(len(n)), np.diff(firsts))
    place, known = lookup(queries.vocabulary, terms)
    size = len(queries.vocabulary)
    keys = row[known] * size + place[known]
    impacts = impact(counts[known], row[known])

    slots = (queries.vocabulary & (width - 1))[queries.places]
    weight = weights[queries.places]
    bounds = np.empty((len(queries), len(n)))
    for i in range(len(queries)):
        own = slice(queries.firsts[i], queries.firsts[i + 1])
        bounds[i] = weight[own].astype(float) @ sketch[slots[own]]
    # Sums of whole numbers, exact unless huge; then this keeps them on the safe side.
    bounds = bounds * (1 + 1e-9)

    doc = batch.column("doc_id")
    no_id, doc = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
    order = np.argsort(-bounds, axis=1, kind="stable")
    done = 0
    while done < len(n):
        part = order[:, done:done + CHUNK]
        near = np.take_along_axis(bounds, part, axis=1)
        query, column = np.nonzero((near >= np.maximum(best.floor, 1)[:, None]))
        if not len(query):
            break
        row = part[query, column]
        best.add(query, exact(query, row, queries, weight, keys, impacts, size), doc[row], no_id[row])
        done += CHUNK


def exact(
    query: np.ndarray, row: np.ndarray, queries: Queries, weight: np.ndarray,
    keys: np.ndarray, impacts: np.ndarray, size: int,
) -> np.ndarray:
    """Scores of (query, document) pairs from the documents' own terms."""
    if not len(keys):
        return np.zeros(len(query), dtype=np.int64)
    sizes = np.diff(queries.firsts)[query]
    starts = np.cumsum(sizes) - sizes
    entry = np.arange(sizes.sum()) + np.repeat(queries.firsts[query] - starts, sizes)
    place, known = lookup(keys, np.repeat(row, sizes) * size + queries.places[entry])
    return np.add.reduceat(np.where(known, weight[entry] * impacts[place], 0), starts)
