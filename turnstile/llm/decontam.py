"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (a shorter item is
one window); a window occurs where a document holds all its words in a row.
Containment must be whole, so of a window's shingles any one is a sufficient
prefix, and the rarest in the corpus is the cheapest.  Documents report the
places of prefix shingles with the words around them; a place joins the windows
that own the shingle, the shingle's offset fixes where the window would start
(positional bound), the words left on either side must hold it (length bound),
and equal words verify it.

Documents are read twice: once to count the benchmark's shingles over the whole
corpus, once to report places.  What tasks get from the driver is a bitmap of
fixed size; it only spares rows that the join would drop.

Defined cases: null or empty texts have no words and no windows; items without
words never occur; an item without an id marks words but is not named; rows
that repeat a ``doc_id`` are judged each by its own text; an empty benchmark
marks nothing.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.common import staged
from turnstile.llm.filters import bit_filter, tester
from turnstile.llm.words import fold_table, joined, lists, signed, slices, words_of

SHINGLE = 3
BROADCAST_WINDOWS = 100_000
FLUSH = 1 << 18


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """Windows of every item, once each: ``item_id``, ``words``, ``shingles`` (in order)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table("alnum")
        for batch in batches:
            ids, words, marks = [], [], []
            for first, raw, offsets in slices(batch.column(1)):
                found = words_of(raw, offsets, table)
                for row in range(found.rows):
                    h = found.hashes[found.firsts[row]:found.firsts[row + 1]]
                    if not len(h):
                        continue
                    for at in range(max(1, len(h) - window + 1)):
                        part = h[at:at + window]
                        ids.append(batch.column(0)[first + row].as_py())
                        words.append(signed(part))
                        marks.append(signed(joined(part, min(shingle, len(part)))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(words, pa.list_(pa.int64())),
                 pa.array(marks, pa.list_(pa.int64()))], ["item_id", "words", "shingles"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(
        cut, f"item_id {kind}, words array<bigint>, shingles array<bigint>").distinct()


def places(firsts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Whether ``size`` words from each place on belong to one text."""
    fits = np.ones(max(0, total - size + 1), dtype=bool)
    for back in range(1, size):
        ends = firsts[1:-1] - back
        fits[ends[(ends >= 0) & (ends < len(fits))]] = False
    return fits


def shingle_counts(docs: DataFrame, wanted: np.ndarray, sizes: list[int]) -> DataFrame:
    """Occurrences in all documents of (at least) the wanted shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, test = fold_table("alnum"), tester(wanted)
        held: list[np.ndarray] = []

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(signed(values)), pa.array(counts.astype(np.int64))], ["shingle", "n"])

        for batch in batches:
            for _, raw, offsets in slices(batch.column(0)):
                found = words_of(raw, offsets, table)
                for size in sizes:
                    marks = joined(found.hashes, size)
                    held.append(marks[places(found.firsts, size, len(found.hashes)) & test(marks)])
                if sum(map(len, held)) > FLUSH:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(
        F.sum("n").alias("n"))


def reported_places(
    docs: DataFrame, wanted: np.ndarray, sizes: list[int], window: int, shingle: int,
) -> DataFrame:
    """Per document: a row number, its word count and the places of prefix shingles.

    A place has the shingle, the word it starts at, how many words before it are
    included, and the words around it that a window could cover.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, test = fold_table("alnum"), tester(wanted)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, raw, offsets in slices(batch.column(1)):
                found = words_of(raw, offsets, table)
                total = len(found.hashes)
                at, marks = [], []
                for size in sizes:
                    joint = joined(found.hashes, size)
                    here = np.flatnonzero(places(found.firsts, size, total) & test(joint))
                    at.append(here)
                    marks.append(joint[here])
                at = np.concatenate(at) if at else np.zeros(0, np.int64)
                marks = np.concatenate(marks) if marks else np.zeros(0, np.uint64)
                order = np.argsort(at, kind="stable")
                at, marks = at[order], marks[order]
                text = np.searchsorted(found.firsts, at, side="right") - 1
                low = np.maximum(found.firsts[text], at - window + 1)
                high = np.minimum(found.firsts[text + 1], at + window)
                spans = high - low
                edges = np.concatenate([[0], np.cumsum(spans)])
                around = np.arange(edges[-1]) + np.repeat(low - edges[:-1], spans)
                listed = pa.StructArray.from_arrays(
                    [pa.array(signed(marks)), pa.array(at - found.firsts[text], pa.int64()),
                     pa.array(at - low, pa.int64()), lists(signed(found.hashes[around]), edges)],
                    ["shingle", "place", "before", "around"])
                rows = np.searchsorted(at, found.firsts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(found.rows), pa.int64()),
                     batch.column(0).slice(first, found.rows),
                     pa.array(found.counts(), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(rows, pa.int32()), listed)],
                    ["row", "doc_id", "n_words", "places"])
                row += found.rows

    return docs.select("doc_id", "text").mapInArrow(
        report,
        f"row bigint, doc_id {kind}, n_words bigint, places array<struct<shingle:bigint,"
        "place:bigint,before:bigint,around:array<bigint>>>",
    )


class Decontamination:
    """Occurrences of benchmark windows (``item_id``, ``text``) in ``docs`` (``doc_id``, ``text``)."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = SHINGLE):
        windows = staged(item_windows(benchmark, window, shingle), "windows")
        sizes = [r[0] for r in windows.select(
            F.least(F.size("words"), F.lit(shingle)).alias("s")).distinct().orderBy("s").collect()]
        owned = windows.withColumn("window", F.xxhash64("words")).select(
            "window", "item_id", "words", F.posexplode("shingles").alias("offset", "shingle"))
        counts = shingle_counts(docs, bit_filter(owned, "shingle"), sizes)
        rarest = F.min(F.struct(F.coalesce("n", F.lit(0)), "offset", "shingle"))
        prefixes = staged(
            owned.join(counts, "shingle", "left").groupBy("item_id", "window", "words")
            .agg(rarest.alias("prefix"))
            .select("item_id", "words", "prefix.offset", "prefix.shingle"),
            "prefixes",
        )
        self.prefixes = prefixes
        self.docs = staged(
            reported_places(docs, bit_filter(prefixes, "shingle"), sizes, window, shingle), "places")

    def hits(self) -> DataFrame:
        """Verified occurrences: ``row``, ``doc_id``, ``item_id``, first word and end."""
        prefixes = self.prefixes
        if prefixes.count() <= BROADCAST_WINDOWS:  # beyond it, a shuffled join
            prefixes = F.broadcast(prefixes)
        start = F.col("before") - F.col("offset")
        size = F.size("words")
        fits = (start >= 0) & (start + size <= F.size("around"))
        same = F.when(fits, F.slice("around", F.greatest(start, F.lit(0)).cast("int") + 1, size)
                      == F.col("words"))
        first = F.col("place") - F.col("offset")
        return (
            self.docs.select("row", "doc_id", F.explode("places").alias("at"))
            .select("row", "doc_id", "at.*")
            .join(prefixes, "shingle").filter(same)
            .select("row", "doc_id", "item_id", first.alias("first"), (first + size).alias("end"))
        )

    def report(self) -> DataFrame:
        """Per document: words, hit words, items that occur, whether any does."""
        hits = self.hits()
        ordered = Window.partitionBy("row").orderBy("first", "end").rowsBetween(
            Window.unboundedPreceding, -1)
        reached = F.coalesce(F.max("end").over(ordered), F.lit(0))
        new = F.greatest(F.lit(0), F.col("end") - F.greatest("first", reached))
        per_row = (
            hits.withColumn("new", new).groupBy("row")
            .agg(F.sum("new").alias("n_hit"), F.collect_set("item_id").alias("items"))
        )
        names = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda i: i.cast("string")))
        return self.docs.drop("places").join(per_row, "row", "left").select(
            "doc_id", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(names).cast("long").alias("n_items"),
            F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """Ids of documents that hold a window of an item."""
    return Decontamination(docs, benchmark, **settings).hits().select("doc_id").distinct()
