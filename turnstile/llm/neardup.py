"""Near-duplicate documents by HyperMinHash.

A document's shingles are hashed by four functions into 32 buckets each.  A
bucket keeps its smallest hash, compressed to a register of 16 bits: the count
of leading zeros and ten mantissa bits.  A band has one register of each
function; at a similarity of 0.8 a pair shares none of the 32 bands with a
probability below 1e-7.  Registers then estimate the similarity of a candidate,
less the matches that chance alone gives registers this short; what lies six
standard errors below the threshold goes, the rest is confirmed on full sets.
Documents of few shingles carry them all, and need no estimate.

Documents with equal sets form a class and only the class's first member takes
part, so copies cost one aggregation.  Members of a band's bucket are compared
to its first one, which links most large groups.  Where a bucket still holds
several components, its members are compared among themselves, inside tasks and
in blocks, so that no task holds a whole bucket and no pair becomes a row: a task
hands out which members belong to one family, connected by likely pairs.
Families are then confirmed in the same way, in blocks, on full sets, and hand
out the links that join their components.  So no link that decides about a
component is lost, however large the group.

Defined cases: a text without words, or null, has no shingles and is linked
with nothing; rows that repeat a ``doc_id`` are one document, linked with
each other; rows without a ``doc_id`` follow their class but never represent it;
an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.blocks import block_pairs, in_blocks, runs, shared_counts
from turnstile.llm.common import arrow_bytes, rows_of_ids, staged
from turnstile.llm.components import components
from turnstile.llm.words import (
    ONE, TWO, Words, distinct, fold_table, mix64, shingles, signed, slices, words_of,
)

FUNCTIONS = 4
BUCKET_BITS = 5
BUCKETS = 1 << BUCKET_BITS
REGISTERS = FUNCTIONS * BUCKETS
MANTISSA_BITS = 10
UNIT_BITS = 21  # texts in a slice; all have a byte or more, but for empty ones
ROWS = FUNCTIONS  # a band has a register of each function
BANDS = BUCKETS
SIGMAS = 6
FEW = 32  # documents of at most this many shingles are compared by them
BUCKET_BLOCK = 2048  # members of a bucket in one block
FAMILY_BLOCK = 512  # members of a family in one block


def shingle_sets(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text and the text of each, both ascending."""
    return distinct(*shingles(found.hashes, found.firsts, size))


def registers(marks: np.ndarray, units: np.ndarray, rows: int) -> np.ndarray:
    """HyperMinHash registers, one line per text; 0 is an empty bucket.

    ``FUNCTIONS`` independent hash functions have ``BUCKETS`` buckets each, so
    that short texts leave fewer buckets empty; register ``i * FUNCTIONS + f`` is
    bucket ``(i + f) mod BUCKETS`` of function ``f``.
    """
    out = np.zeros((rows, BUCKETS, FUNCTIONS), dtype=np.uint16)
    unit = units.astype(np.uint64) << np.uint64(64 - UNIT_BITS)
    rest_bits = 64 - UNIT_BITS - BUCKET_BITS
    for f in range(FUNCTIONS):
        with np.errstate(over="ignore"):
            hashes = mix64(marks + np.uint64(f) * ONE)
        if rows > 1 << UNIT_BITS:
            raise ValueError("too many texts in a slice")
        # Text, bucket and the leading bits behind it in one number: the first of a bucket is least.
        packed = np.sort(unit | (hashes >> np.uint64(UNIT_BITS)))
        cell = packed >> np.uint64(rest_bits)
        first = np.ones(len(cell), dtype=bool)
        first[1:] = cell[1:] != cell[:-1]
        cell = cell[first].astype(np.int64)
        rest = packed[first] & np.uint64((1 << rest_bits) - 1)
        # One guard bit bounds the zeros; fewer than 53 bits convert to float exactly.
        _, length = np.frexp((rest * np.uint64(2) + np.uint64(1)).astype(np.float64))
        zeros = (rest_bits + 1 - length).astype(np.uint64)
        mantissa = ((rest << (zeros + np.uint64(1))) & np.uint64((1 << rest_bits) - 1)) >> np.uint64(
            rest_bits - MANTISSA_BITS)
        at = (cell % BUCKETS - f) % BUCKETS
        out[cell // BUCKETS, at, f] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS)) | mantissa
    return out.reshape(rows, REGISTERS)


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: ``doc_id``, set size, 128-bit key of the set, registers (and a small set itself)."""
    few_shingles = FEW * 100 // percent  # what a small set may be linked with is small, too

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table("non_space")
        for batch in batches:
            for first, raw, offsets in slices(batch.column(1)):
                found = words_of(raw, offsets, table)
                marks, units = shingle_sets(found, size)
                edges = np.searchsorted(units, np.arange(found.rows + 1))
                with np.errstate(over="ignore"):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(marks * TWO), dtype=np.uint64)])
                    sums = sums[edges[1:]] - sums[edges[:-1]]
                    others = np.concatenate([[np.uint64(0)], np.cumsum(mix64(marks ^ ONE), dtype=np.uint64)])
                    others = others[edges[1:]] - others[edges[:-1]]
                lines = registers(marks, units, found.rows)
                few = np.diff(edges) <= few_shingles
                sketch = [lines[i].tobytes() + (marks[edges[i]:edges[i + 1]].tobytes() if few[i] else b"")
                          for i in range(found.rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, found.rows), pa.array(np.diff(edges), pa.int64()),
                     pa.array(signed(sums)), pa.array(signed(others)), pa.array(sketch, pa.binary())],
                    ["doc_id", "n", "key_a", "key_b", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        emit, "doc_id bigint, n bigint, key_a bigint, key_b bigint, sketch binary")


def matrix(column: pa.Array) -> np.ndarray:
    """The registers of sketches, a line each."""
    joint = b"".join(sketch[:2 * REGISTERS] for sketch in column.to_pylist())
    return np.frombuffer(joint, dtype=np.uint16).reshape(-1, REGISTERS)


def band_rows(firsts: DataFrame) -> DataFrame:
    """(``key``, ``node``, ``n``) for every band of a document that has a shingle in it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = matrix(batch.column(2)).reshape(-1, BANDS, ROWS)
            packed = np.ascontiguousarray(lines).view(np.uint64).reshape(-1, BANDS)
            row, band = np.nonzero(packed)
            with np.errstate(over="ignore"):
                keys = mix64(mix64(packed[row, band]) + band.astype(np.uint64) * ONE)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(keys)), batch.column(0).take(take), batch.column(1).take(take)],
                ["key", "node", "n"])

    return firsts.select("node", "n", "sketch").mapInArrow(cut, "key bigint, node bigint, n bigint")


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of these sizes match."""
    zeros = np.arange(48)
    low, high = 0.5 ** (zeros + 1), 0.5 ** zeros

    def held(sizes):
        load = sizes[:, None] / BUCKETS
        return np.exp(-load * low) - np.exp(-load * high)

    return (held(n) * held(m)).sum(axis=1) / 2**MANTISSA_BITS


class Judge:
    """Which pairs of sketches the threshold is not ruled out for."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray, percent: int):
        self.sketches, self.sizes, self.percent = sketches, sizes, percent
        joint = b"".join(sketch[:2 * REGISTERS] for sketch in sketches)
        self.lines = np.frombuffer(joint, dtype=np.uint16).reshape(-1, REGISTERS)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), dtype=bool)
        for at in range(0, len(a), 1 << 14):
            part = slice(at, at + (1 << 14))
            out[part] = self._judge(a[part], b[part])
        return out

    def _judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = self.sizes[a], self.sizes[b]
        fits = 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)
        small = fits & (np.minimum(n, m) <= FEW)
        large = np.flatnonzero(fits & ~small)
        x, y = self.lines[a[large]], self.lines[b[large]]
        used = ((x != 0) | (y != 0)).sum(axis=1)
        same = ((x == y) & (x != 0)).sum(axis=1)
        by_chance = chance(n[large], m[large])
        estimate = (same / used - by_chance) / (1 - by_chance)
        threshold = self.percent / 100
        slack = SIGMAS * np.sqrt(threshold * (1 - threshold) / used)
        fits[large] = estimate >= threshold - slack
        for i in np.flatnonzero(small):
            shared = len(self._set(a[i]) & self._set(b[i]))
            fits[i] = 100 * shared >= self.percent * (n[i] + m[i] - shared)
        return fits

    def _set(self, i: int) -> frozenset:
        return frozenset(memoryview(self.sketches[i])[2 * REGISTERS:].cast("Q"))


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches don't rule the threshold out."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            both = Judge(batch.column(2).to_pylist() + batch.column(3).to_pylist(),
                         np.concatenate([batch.column(i).to_numpy() for i in (4, 5)]), percent)
            fits = both(np.arange(rows), np.arange(rows) + rows)
            yield batch.filter(pa.array(fits)).select(["a", "b"])

    return pairs.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(
        judge, "a bigint, b bigint")


def apart(run: pa.RecordBatch, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that differ in their labels."""
    a, b = block_pairs(run)
    differ = labels[a] != labels[b]
    return a[differ], b[differ]


class Joined:
    """Union-find over small numbers."""

    def __init__(self, count: int):
        self.parent = list(range(count))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def families(rest: DataFrame, percent: int) -> DataFrame:
    """Edges that connect the members of a bucket that likely pairs connect."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 3):
            labels, nodes = run.column(5).to_numpy(), run.column(4).to_numpy()
            a, b = apart(run, labels)
            fits = Judge(run.column(7).to_pylist(), run.column(6).to_numpy(), percent)(a, b)
            tree = Joined(run.num_rows)
            for i in np.flatnonzero(fits):
                tree.join(int(a[i]), int(b[i]))
            # A star around the least member: as many edges as members, and the same in all buckets
            # that hold the family.
            roots = np.array([tree.root(i) for i in range(run.num_rows)])
            least = np.full(run.num_rows, np.iinfo(np.int64).max)
            np.minimum.at(least, roots, nodes)
            rim = np.flatnonzero(least[roots] != nodes)
            yield pa.RecordBatch.from_arrays([pa.array(least[roots[rim]]), pa.array(nodes[rim])], ["a", "b"])

    return in_blocks(rest, BUCKET_BLOCK, "key", "node", "label", "n", "sketch").mapInArrow(
        connect, "a bigint, b bigint")


def family_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (``a``, ``b``) that join components of a family."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table("non_space")
        for run in runs(batches, 3):
            nodes, labels = run.column(4).to_numpy(), run.column(5).to_numpy()
            a, b = apart(run, labels)
            if not len(a):
                continue
            marks, units = [], []
            for first, raw, offsets in slices(run.column(6)):
                found = shingle_sets(words_of(raw, offsets, table), size)
                marks.append(found[0])
                units.append(found[1] + first)
            marks, units = np.concatenate(marks), np.concatenate(units)
            sizes = np.bincount(units, minlength=run.num_rows)
            shared = shared_counts(marks, units, run.num_rows)[a, b]
            fits = 100 * shared >= percent * (sizes[a] + sizes[b] - shared)
            at = {label: i for i, label in enumerate(np.unique(labels).tolist())}
            tree = Joined(len(at))
            kept = [i for i in np.flatnonzero(fits)
                    if tree.join(at[int(labels[a[i]])], at[int(labels[b[i]])])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[a[kept]], pa.int64()), pa.array(nodes[b[kept]], pa.int64())], ["a", "b"])

    return in_blocks(members, FAMILY_BLOCK, "family", "node", "label", "text").mapInArrow(
        link, "a bigint, b bigint")


def confirmed(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``, ``text_a``, ``text_b``) whose full sets reach the threshold."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table("non_space")
        for batch in batches:
            for first, raw, offsets in slices(batch.column(2)):
                rows = len(offsets) - 1
                sets = [shingle_sets(words_of(raw, offsets, table), size)]
                others = [s for s in slices(batch.column(3).slice(first, rows))]
                raw_b = np.concatenate([s[1] for s in others])
                starts = np.cumsum([0] + [len(s[1]) for s in others])
                offsets_b = np.concatenate(
                    [s[2][:-1] + at for s, at in zip(others, starts)] + [starts[-1:]])
                sets.append(shingle_sets(words_of(raw_b, offsets_b, table), size))
                marks = np.concatenate([s[0] for s in sets])
                units = np.concatenate([s[1] for s in sets])
                order = np.lexsort((marks, units))
                marks, units = marks[order], units[order]
                twice = (marks[1:] == marks[:-1]) & (units[1:] == units[:-1])
                shared = np.bincount(units[1:][twice], minlength=rows)
                union = np.bincount(units, minlength=rows) - shared
                linked = (100 * shared >= percent * union) & (union > 0)
                yield batch.slice(first, rows).filter(pa.array(linked)).select(["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a bigint, b bigint")


class NearDuplicates:
    """Components of ``docs`` (``doc_id``, ``text``) under shingle similarity."""

    def __init__(self, docs: DataFrame, size: int = 5, percent: int = 80):
        self.docs, self.size, self.percent = docs, size, percent
        with arrow_bytes(docs.sparkSession):
            self._find()

    def _find(self) -> None:
        self.sketches = staged(sketches(self.docs, self.size, self.percent), "sketches")
        sets = ["n", "key_a", "key_b"]
        self.classes = staged(
            self.sketches.filter("n > 0").groupBy(*sets).agg(F.min("doc_id").alias("node")), "classes")
        members = self.sketches.withColumnRenamed("doc_id", "node")
        self.firsts = staged(
            members.join(self.classes, ["node", *sets], "left_semi").select("node", "n", "sketch"),
            "firsts")
        self.labels = self._linked()

    def _linked(self) -> DataFrame:
        """``node`` and ``label`` of every document that a link reaches."""
        bands = band_rows(self.firsts)
        hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
        shared = staged(bands.join(hubs.filter("hub < last").select("key", "hub"), "key"), "buckets")
        pairs = shared.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        edges = staged(self._confirm(pairs), "links")
        labels = components(edges)

        # All others of a bucket, where they belong to more than one component.
        rest = staged(
            shared.filter("node > hub").join(labels, "node", "left")
            .select("key", "node", F.coalesce("label", "node").alias("label")), "rest")
        mixed = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        rest = rest.join(mixed.filter("low < high").select("key"), "key").distinct()
        likely_edges = staged(families(rest.join(self.firsts, "node"), self.percent), "families")
        family = components(likely_edges).withColumnRenamed("label", "family")
        members = family.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        members = members.join(self._texts(family), "node")
        found = staged(family_links(members, self.size, self.percent), "links")
        return components(edges.unionByName(found))

    def _confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (``a``, ``b``) that are links."""
        side = {s: self.firsts.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"),
                                      F.col("sketch").alias(f"sketch_{s}")) for s in "ab"}
        sizes = pairs.distinct().join(side["a"], "a").join(side["b"], "b")
        fits = 100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")
        close = staged(likely(sizes.filter(fits), self.percent), "pairs")
        texts = self._texts(close.select(F.explode(F.array("a", "b")).alias("node")))
        side = {s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"}
        return confirmed(close.join(side["a"], "a").join(side["b"], "b"), self.size, self.percent)

    def _texts(self, nodes: DataFrame) -> DataFrame:
        docs = self.docs.select(F.col("doc_id").cast("long").alias("node"), "text")
        return staged(rows_of_ids(docs, nodes, "node"), "texts")

    def report(self) -> DataFrame:
        """Per row: set size, smallest document that links reach, whether it is that one."""
        sets = ["n", "key_a", "key_b"]
        classes = self.classes.join(self.labels, "node", "left").select(
            *sets, F.coalesce("label", "node").alias("of"))
        return (
            self.sketches.drop("sketch").join(classes, sets, "left")
            .select(
                "doc_id", F.col("n").alias("n_shingles"),
                F.coalesce("of", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        )
