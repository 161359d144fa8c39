"""Approximate nearest neighbours by learned partitions, nearness being the cosine.

The partition is learned on a sample of at most ``SAMPLE`` vectors: their
neighbour graph is cut into parts of about equal size with few edges between
them, and a small classifier learns which parts a vector's neighbours lie in.  The
classifier then gives every vector of the table its part, and every query the
parts to look in, most probable first, until they hold enough probability.  How
much is enough is measured on sampled vectors that the classifier has not seen,
against their exact neighbours, so that vectors without any structure are searched
in more parts rather than badly.

The vectors of the chosen parts are compared with the query exactly.  Parts and
their queries are cut into blocks of bounded size, so that a part with a third of
all vectors is many tasks' work.  Of equal vectors, which the parts cannot tell
apart, only the smallest ids can be among the nearest; one more than asked for is
kept of each, and none but those.

Defined cases: vectors that are null, empty, zero or hold a null or a number that
is not finite take no part, neither as queries; a shorter vector goes on with zeros;
rows that repeat a ``vec_id`` are vectors of their own, and one without a ``vec_id``
comes after others of its score; a table without vectors has no neighbours.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.common import staged

# Vectors that the partition is learned on, and the share of them it is measured on.
SAMPLE = 8192
HELD_OUT = 8
# Rows that a part should have, and sampled ones that it must have.
PART_ROWS = 512
PART_SAMPLE = 32
# Share of the sample's true neighbours that the chosen parts must hold.
TARGET = 0.98
EDGES = 10
# Rows and queries compared in one group, and queries of them at a time.
ROW_BLOCK = 8192
QUERY_BLOCK = 16384
AT_ONCE = 512
# What a product of matrices may differ from sums taken one by one.
ROUNDING = 1e-9


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of doubles, scaled by powers of two so that squares stay in range."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.float64)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), size))
    if len(lengths) and (lengths == size).all():
        out[:] = values.reshape(-1, size)
    else:
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(values)) - (offsets[:-1] - offsets[0])[row]] = values
    _, exponent = np.frexp(np.abs(out).max(axis=1, initial=0))
    return np.ldexp(out, -exponent[:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def nearest(queries: np.ndarray, among: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """For each unit vector, the places of its ``k`` nearest, without the place ``own``."""
    out = np.empty((len(queries), k), dtype=np.int64)
    for at in range(0, len(queries), AT_ONCE):
        near = queries[at:at + AT_ONCE] @ among.T
        near[np.arange(len(near)), own[at:at + AT_ONCE]] = -np.inf
        out[at:at + AT_ONCE] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def halves(vectors: np.ndarray, rows: np.ndarray, parts: int, first: int, out: np.ndarray) -> None:
    """Cut along the direction of largest spread, again and again, into ``parts`` equal parts."""
    out[rows] = first
    if parts == 1:
        return
    centred = vectors[rows] - vectors[rows].mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    order = rows[np.argsort(centred @ axes[:, -1], kind="stable")]
    left = parts // 2
    cut = len(rows) * left // parts
    halves(vectors, order[:cut], left, first, out)
    halves(vectors, order[cut:], parts - left, first + left, out)


def balanced_parts(vectors: np.ndarray, edges: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Parts of the neighbour graph: vertices move to where most of their edges end, as long
    as there is room."""
    part = np.zeros(len(vectors), dtype=np.int64)
    halves(vectors, np.arange(len(vectors)), parts, 0, part)
    room = int(np.ceil(1.1 * len(vectors) / parts))
    tail, head = np.repeat(np.arange(len(vectors)), edges.shape[1]), edges.reshape(-1)
    for _ in range(rounds):
        ends = np.zeros((len(vectors), parts), dtype=np.int32)
        np.add.at(ends, (tail, part[head]), 1)
        np.add.at(ends, (head, part[tail]), 1)
        load = np.bincount(part, minlength=parts)
        gain = ends.max(axis=1) - ends[np.arange(len(part)), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable")[:np.count_nonzero(gain)]:
            best = int(np.argmax(np.where(load < room, ends[v], -1)))
            if ends[v, best] > ends[v, part[v]]:
                load[part[v]] -= 1
                load[best] += 1
                part[v] = best
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Classifier:
    """One hidden layer; probabilities of the parts."""

    layers: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = 128, epochs: int = 30, batch: int = 256,
            rate: float = 0.005) -> Classifier:
        """Cross entropy with the shares ``y``, by Adam; the same sample gives the same classifier."""
        dice = np.random.default_rng(0)
        x, y = x.astype(np.float32), y.astype(np.float32)
        sizes = [x.shape[1], hidden, y.shape[1]]
        w = []
        for a, b in zip(sizes, sizes[1:]):
            w += [(dice.standard_normal((a, b)) * np.sqrt(2 / a)).astype(np.float32), np.zeros(b, np.float32)]
        # Unit vectors have small components.
        w[0] *= np.float32(np.sqrt(x.shape[1]))
        mean, square = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        step = 0
        for _ in range(epochs):
            order = dice.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at:at + batch]
                middle = np.maximum(x[rows] @ w[0] + w[1], 0)
                slope = (softmax(middle @ w[2] + w[3]) - y[rows]) / np.float32(len(rows))
                back = (slope @ w[2].T) * (middle > 0)
                slopes = [x[rows].T @ back, back.sum(axis=0), middle.T @ slope, slope.sum(axis=0)]
                step += 1
                for v, g, m, s in zip(w, slopes, mean, square):
                    m += np.float32(0.1) * (g - m)
                    s += np.float32(0.001) * (g * g - s)
                    v -= np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (
                        np.sqrt(s / np.float32(1 - 0.999**step)) + np.float32(1e-8))
        return cls([v.astype(np.float64) for v in w])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return softmax(np.maximum(x @ a + b, 0) @ c + d)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Router:
    """Parts of vectors, and the parts that a query looks in."""

    parts: int
    enough: float
    classifier: Classifier | None = None

    @classmethod
    def learn(cls, vectors: np.ndarray, rows: int, k: int, target: float, part_rows: int) -> Router:
        """``vectors`` are sampled from ``rows`` in an order that means nothing."""
        parts = min(max(8, rows // part_rows), len(vectors) // PART_SAMPLE)
        if parts < 2:
            return cls(1, 1.0)
        x = unit(vectors)
        held = len(x) // HELD_OUT
        fit = x[held:]
        edges = nearest(fit, fit, np.arange(len(fit)), min(EDGES, len(fit) - 1))
        part = balanced_parts(fit, edges, parts)
        shares = np.zeros((len(fit), parts))
        np.add.at(shares, (np.repeat(np.arange(len(fit)), edges.shape[1]), part[edges].reshape(-1)), 1)
        shares[np.arange(len(fit)), part] += 1
        router = cls(parts, 1.0, Classifier.fit(fit, shares / shares.sum(axis=1, keepdims=True)))
        # Probability of the parts before the one in which a true neighbour is indexed.
        near = nearest(x[:held], x, np.arange(held), min(k, len(x) - 1))
        chances = router.classifier.probabilities(x)
        where = chances.argmax(axis=1)[near]
        own = np.take_along_axis(chances[:held], where, axis=1)
        before = np.stack([(chances[:held] * (chances[:held] > own[:, [i]])).sum(axis=1)
                           for i in range(near.shape[1])], axis=1)
        router.enough = float(np.quantile(before, target))
        return router

    def part_of(self, x: np.ndarray) -> np.ndarray:
        if self.classifier is None:
            return np.zeros(len(x), dtype=np.int64)
        return self.classifier.probabilities(x).argmax(axis=1)

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """Parts of each query, most probable first, until those before hold enough."""
        if self.classifier is None:
            return [np.zeros(1, dtype=np.int64)] * len(x)
        chances = self.classifier.probabilities(x)
        order = np.argsort(-chances, axis=1, kind="stable")
        ranked = np.take_along_axis(chances, order, axis=1)
        before = np.cumsum(ranked, axis=1) - ranked
        return [order[i, :max(1, n)] for i, n in enumerate((before <= self.enough).sum(axis=1))]


class LearnedPartitions:
    """An index over all vectors, written once to the shared folder."""

    def __init__(self, vectors: DataFrame, k: int = 5, sample: int = SAMPLE, target: float = TARGET,
                 part_rows: int = PART_ROWS, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK):
        self.k, self.row_block, self.query_block = k, row_block, query_block
        finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < double('inf'))"
        self.vectors = staged(
            vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
            .filter(f"embedding IS NOT NULL AND {finite} AND exists(embedding, x -> x != 0)")
            .select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"), "vectors")
        self.count, self.size = self.vectors.agg(
            F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
        self.router = Router.learn(
            matrix(self._sample(sample), self.size), self.count, k, target, part_rows)
        router, size = self.router, self.size

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = router.part_of(unit(matrix(batch.column("embedding"), size)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

        kind = self.vectors.schema["embedding"].dataType.simpleString()
        self._kind = f"row bigint, vec_id bigint, embedding {kind}"
        self.rows = staged(self._told_apart().mapInArrow(assign, f"{self._kind}, part bigint"), "parts")

    def _sample(self, most: int) -> pa.Array:
        """At most ``most`` vectors, chosen by a hash of id and vector."""
        spread = 1 << 30
        share = min(1.0, 2 * most / max(1, self.count))
        number = F.xxhash64("vec_id", "embedding")
        chosen = self.vectors.filter(F.pmod(number, F.lit(spread)) < int(share * spread) + 1)
        rows = chosen.orderBy(number, "vec_id").limit(most).select("embedding").toArrow()
        return rows["embedding"].combine_chunks()

    def _told_apart(self) -> DataFrame:
        """Of equal vectors the rows of smallest ids: ``k``, and one that may be the query."""
        order = Window.partitionBy("hash", "embedding").orderBy(F.asc_nulls_last("vec_id"), "row")
        return self.vectors.withColumn("hash", F.xxhash64("embedding")).withColumn(
            "copy", F.row_number().over(order)).filter(F.col("copy") <= self.k + 1).select(
            "row", "vec_id", "embedding")

    def _routed(self, queries: DataFrame) -> DataFrame:
        """Queries with each part to look in."""
        router, size = self.router, self.size

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                probes = router.probes(unit(matrix(batch.column("embedding"), size)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(probes, pa.list_(pa.int64()))], [*batch.schema.names, "parts"])

        routed = queries.mapInArrow(route, f"{self._kind}, parts array<bigint>")
        return routed.withColumn("part", F.explode("parts")).drop("parts")

    def search(self, wanted: Column) -> DataFrame:
        """The ``k`` nearest found of each vector that is ``wanted``: ``query_id``, ``rank``,
        ``vec_id``, ``score``."""
        k, size = self.k, self.size
        routed = staged(self._routed(self.vectors.filter(wanted)), "routed")
        # One row per part: how many blocks its rows and its queries make.
        blocks = self.rows.groupBy("part").count().select(
            "part", F.ceil(F.col("count") / self.row_block).alias("row_blocks")).join(
            routed.groupBy("part").count().select(
                "part", F.ceil(F.col("count") / self.query_block).alias("query_blocks")), "part")
        blocks = F.broadcast(staged(blocks, "blocks"))

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            """Rows in a block of their own side, with every block of the other."""
            number = F.pmod(F.xxhash64("row", F.lit(own)), F.col(f"{own}_blocks"))
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1))
            return df.join(blocks, "part").select(
                "row", "vec_id", "embedding", "part", number.alias(f"{own}_block"),
                every.alias(f"{other}_block"))

        def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
            return compared(queries, rows, k, size)

        key = ["part", "row_block", "query_block"]
        found = dealt(routed, "query", "row").groupBy(*key).cogroup(
            dealt(self.rows, "row", "query").groupBy(*key)).applyInArrow(
            compare, "query bigint, query_id bigint, vec_id bigint, score double")
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score")


def compared(queries: pa.Table, rows: pa.Table, k: int, size: int) -> pa.Table:
    """The ``k`` nearest of a block's rows for each of its queries."""

    def parts(table: pa.Table):
        table = table.combine_chunks()
        ids = table["vec_id"].combine_chunks()
        return (table["row"].to_numpy(), ids.fill_null(0).to_numpy(),
                ids.is_null().to_numpy(zero_copy_only=False), matrix(table["embedding"].combine_chunks(), size))

    out = [[], [], [], [], [], []]
    if len(queries) and len(rows):
        own, query_id, query_no_id, a = parts(queries)
        row, vec_id, no_id, b = parts(rows)
        lengths = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (a, b)]
        left, right = a / lengths[0][:, None], b / lengths[1][:, None]
        for at in range(0, len(a), AT_ONCE):
            near = left[at:at + AT_ONCE] @ right.T
            near[own[at:at + AT_ONCE, None] == row[None, :]] = -np.inf
            if near.shape[1] > k:
                last = np.partition(near, -k, axis=1)[:, -k]
                chosen = near >= np.maximum(last, -2)[:, None] - ROUNDING
            else:
                chosen = near > -2
            q, r = np.nonzero(chosen & (near > -2))
            q += at
            # Summed alike for every pair, so that equal vectors have equal scores.
            score = np.einsum("ij,ij->i", a[q], b[r]) / (lengths[0][q] * lengths[1][r])
            order = np.lexsort((vec_id[r], no_id[r], -score, q))
            q, r, score = q[order], r[order], score[order]
            rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(a)))[q]
            q, r, score = q[rank < k], r[rank < k], score[rank < k]
            for held, new in zip(out, (own[q], query_id[q], query_no_id[q], vec_id[r], no_id[r], score)):
                held.append(new)
    if not out[0]:
        none = [pa.array([], kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
        return pa.table(none, ["query", "query_id", "vec_id", "score"])
    query, query_id, query_no_id, vec_id, no_id, score = map(np.concatenate, out)
    return pa.table([pa.array(query), pa.array(query_id, mask=query_no_id), pa.array(vec_id, mask=no_id),
                     pa.array(score)], ["query", "query_id", "vec_id", "score"])
