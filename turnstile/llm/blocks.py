"""Comparing the members of groups of any size inside tasks, two blocks at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, size: int, group: str, *columns: str) -> DataFrame:
    """Every pair of blocks of every group: (``group``, ``i``, ``j``, ``block``, columns), dealt
    out by the first three and sorted, so that a task sees two blocks at a time.  Groups are
    counted unless ``rows`` have their ``members``."""
    if "members" in rows.columns:
        counted = rows.filter("members > 1")
    else:
        counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
        counted = rows.join(counts.filter("members > 1"), group)
    blocks = F.ceil(F.col("members") / size).cast("int")
    key = [group, "i", "j"]
    return (
        counted.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "block", *columns)
        .repartition(*key).sortWithinPartitions(*key)
    )


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows that agree in the first columns, over batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy() for i in range(keys)], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            key = tuple(values[low])
            if key != last and held:
                yield pa.concat_batches(held)
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.concat_batches(held)


def bundles(batches: Iterator[pa.RecordBatch], keys: int, most: int = 64, rows: int = 8192) -> Iterator[
        tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of up to ``most`` rows, many at a time, and longer ones alone: (rows, first row of
    each run and the end)."""
    held: list[pa.RecordBatch] = []
    for run in runs(batches, keys):
        if run.num_rows > most:
            yield run, np.array([0, run.num_rows])
            continue
        held.append(run)
        if len(held) * most >= rows:
            yield bundle(held)
            held = []
    if held:
        yield bundle(held)


def bundle(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
    return pa.concat_batches(held), np.concatenate([[0], np.cumsum([run.num_rows for run in held])])


def pairs_within(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of each run, in order."""
    rows = np.arange(edges[-1])
    counts = np.repeat(edges[1:], np.diff(edges)) - rows - 1
    a = np.repeat(rows, counts)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)


def shared_in_pairs(marks: np.ndarray, units: np.ndarray, edges: np.ndarray,
                    a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of some rows' sets of marks; the pairs are those of
    ``pairs_within``, in its order."""
    if not len(a):
        return np.zeros(0, dtype=np.int64)
    run = np.searchsorted(edges, units, side="right")
    order = np.lexsort((units, marks, run))
    marks, units, run = marks[order], units[order], run[order]
    new = np.append(True, (marks[1:] != marks[:-1]) | (run[1:] != run[:-1]))
    i, j = pairs_within(np.append(np.flatnonzero(new), len(marks)))
    rows = edges[-1]
    return np.bincount(np.searchsorted(a * rows + b, units[i] * rows + units[j]), minlength=len(a))


def block_pairs(run: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of two blocks, or within one."""
    block = run.column(3).to_numpy()
    if run.column(1)[0].as_py() == run.column(2)[0].as_py():
        return np.triu_indices(len(block), 1)
    a, b = np.meshgrid(
        np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min()), indexing="ij")
    return a.ravel(), b.ravel()


def shared_counts(marks: np.ndarray, units: np.ndarray, rows: int) -> np.ndarray:
    """Sizes of all intersections of sets, by products of 0/1 matrices of the shared marks."""
    _, column, times = np.unique(marks, return_inverse=True, return_counts=True)
    often = times[column] > 1
    column, units = column[often], units[often]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((rows, rows), dtype=np.float64)
    width = 4096
    order = np.argsort(column, kind="stable")
    column, units = column[order], units[order]
    count = column[-1] + 1 if len(column) else 0
    edges = np.searchsorted(column, np.arange(0, count + width, width))
    for at, (low, high) in enumerate(zip(edges, edges[1:])):
        if low < high:
            part = np.zeros((rows, width), dtype=np.float32)
            part[units[low:high], column[low:high] - at * width] = 1
            out += part @ part.T
    return out.astype(np.int64)
