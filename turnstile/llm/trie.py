"""The trie of conversations' beginnings, with totals of all subtrees by time-forward processing.

A node is a distinct sequence of first turns.  Turns are numbered after one range
sort, and a node is known by the exclusive or of 128-bit hashes of its (place,
role, text), which is a prefix scan over places, cut into stretches, so that a
conversation of any length is spread over tasks.

Totals go up the trie.  A node's ``below`` (turns that its members still have)
bounds its subtree and needs no trie.  Where it is at most ``limit``, the whole
subtree is dealt to one shard.  A shard's nodes are sorted by Spark in reverse
level order, outside of memory if need be; each node takes what its children sent
from a priority queue, adds its own and sends the sum on to its parent.  The queue
holds a bounded number of messages and spills sorted runs.  Shard roots then send
to the few nodes above the limit, added up before they are shuffled however many
children such a node has, and those are processed in the same way.

A node's ends are hashed in order: stretches of ids are joined in parallel, and one
task streams a node's stretches through its digest.

Spilled runs are scratch of the running task, as Spark's own spills are: unnamed
files that go with it, while a task that is repeated starts from its input.

Defined cases: null roles and texts are empty; turns go by ``turn``, null first,
equal ones by a hash of role and text, so repeated rows are turns in a row; rows
without a ``conv_id`` belong to no conversation; no conversations, no nodes.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.common import staged, word_count

# Most turns below a node whose subtree is one shard's.
SHARD_TURNS = 200_000
# Turns of a conversation in one window.
STRETCH = 4096
# Messages that a queue holds before it spills.
QUEUE_MESSAGES = 1 << 20
# Ids joined to one text.
JOINED_IDS = 4096
# Nodes above the limit that are sent to all tasks; more are joined.
BROADCAST_NODES = 100_000

PLACE = ["depth", "pa", "pb"]
REPORT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
          "ends_sha256"]


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns with their place in the conversation: ``conv_id``, ``pos`` (from 0), ``key``, ``words``.

    Rows are sorted by ranges; whatever tells rows apart is a sort key, also a number
    where nothing else does, so that no conversation and no row repeated very often
    has to stand in one range.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = ["conv_id", "turn", "key", "number"]
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
        F.xxhash64(F.monotonically_increasing_id()).alias("number"),
        word_count(text).alias("words"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            heads = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            at = np.arange(len(conv)) - np.repeat(heads, np.diff(np.append(heads, len(conv))))
            if conv[0] == last:
                first = heads[1] if len(heads) > 1 else len(conv)
                at[:first] += held
            last, held = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(conv), part, dtype=np.int32)), pa.array(at),
                 batch.column(1), batch.column(2)], ["conv_id", "part", "at", "key", "words"])

    placed = staged(
        turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "words")
        .mapInArrow(place, "conv_id bigint, part int, at bigint, key binary, words bigint"), "placed")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "before", F.sum("rows").over(before)).filter("before > 0").drop("rows")
    # At most one row per range: only its first conversation can have begun earlier.
    return placed.join(F.broadcast(parts), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "words")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their ``group``, as (turns, conversations).

    ``h``, a hash of the id below ``heads``, says how many first turns of that one
    stand in for as many of the conversation's own.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")).select(
        "conv_id", "n_own", (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = staged(own.join(first, "base", "left").select(
        "conv_id", "base", "h", (head - F.col("h")).alias("shift"),
        (head + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    begin = turns.filter(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "base").join(
        convs.select("conv_id", "base", "h", "n"), "base").filter("pos < h").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "key", "words", "n")
    rest = turns.join(convs.select("conv_id", "h", "shift", "n"), "conv_id").filter("pos >= h").select(
        "conv_id", (F.col("pos") + F.col("shift") + 1).alias("depth"), "key", "words", "n")
    return begin.unionByName(rest), convs.select("conv_id", "n")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their own turns, as (turns, conversations)."""
    convs = staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversations")
    return turns.join(convs, "conv_id").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "key", "words", "n"), convs


def with_prefixes(turns: DataFrame, stretch: int) -> DataFrame:
    """Turns with the hash of all turns up to theirs (``pa``, ``pb``) and before it (``qa``, ``qb``)."""
    turns = staged(turns.select(
        "conv_id", "depth", "n", "words", F.floor((F.col("depth") - 1) / stretch).alias("stretch"),
        F.xxhash64("depth", "key").alias("ea"), F.xxhash64("key", "depth", F.lit("second")).alias("eb")), "turns")
    inside = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    hashes = ("a", "b")
    scanned = turns.select("*", *[F.bit_xor(f"e{x}").over(inside).alias(f"p{x}") for x in hashes])
    # What comes before a stretch; conversations of a single one have none.
    ahead = turns.filter(F.col("n") > stretch).groupBy("conv_id", "stretch").agg(
        *[F.bit_xor(f"e{x}").alias(f"e{x}") for x in hashes]).select(
        "conv_id", "stretch", *[F.bit_xor(f"e{x}").over(before).alias(f"before_{x}") for x in hashes])

    def whole(rows: DataFrame, *carried: Column) -> DataFrame:
        places = [F.col(f"p{x}").bitwiseXOR(c) for x, c in zip(hashes, carried)]
        return rows.select("conv_id", "depth", "n", "words", places[0].alias("pa"), places[1].alias("pb"),
                           places[0].bitwiseXOR(F.col("ea")).alias("qa"),
                           places[1].bitwiseXOR(F.col("eb")).alias("qb"))

    none = F.lit(0).cast("long")
    later = scanned.filter("stretch > 0").join(ahead, ["conv_id", "stretch"])
    return whole(scanned.filter("stretch = 0"), none, none).unionByName(
        whole(later, F.col("before_a"), F.col("before_b")))


@dataclass
class Run:
    """Messages of one level sorted by receiver, in memory or in a scratch file."""

    parts: list = field(default_factory=list)  # one array, or (file, byte places) of chunks
    at: int = 0

    CHUNK = 1 << 16

    @classmethod
    def of(cls, messages: np.ndarray, spill: bool) -> Run:
        if not spill:
            return cls([messages])
        out, places = tempfile.TemporaryFile(), []
        for i in range(0, len(messages), cls.CHUNK):
            places.append(out.tell())
            np.save(out, messages[i:i + cls.CHUNK])
        return cls([(out, place) for place in places])

    def take(self, last: int) -> Iterator[np.ndarray]:
        """Messages to receivers up to ``last`` that were not taken before."""
        while self.parts:
            if isinstance(self.parts[0], tuple):
                out, place = self.parts[0]
                out.seek(place)
                self.parts[0] = np.load(out)
            messages = self.parts[0]
            end = int(np.searchsorted(messages["to"], last, side="right"))
            yield messages[self.at:end]
            if end < len(messages):
                self.at = end
                return
            self.parts.pop(0)
            self.at = 0


MESSAGE = np.dtype([("to", np.int64), ("children", np.int64), ("leaves", np.int64), ("saved", np.int64)])
TOTALS = ("children", "leaves", "saved")


def summed(messages: np.ndarray) -> np.ndarray:
    """One message for each receiver, in their order."""
    if not len(messages):
        return messages
    messages = messages[np.argsort(messages["to"], kind="stable")]
    heads = np.flatnonzero(np.append(True, messages["to"][1:] != messages["to"][:-1]))
    out = messages[heads]
    for name in TOTALS:
        out[name] = np.add.reduceat(messages[name], heads)
    return out


class LevelQueue:
    """A priority queue of messages: deepest level first, then by receiver.

    Nodes only send one level up, so two levels are open at most: one that is
    taken from and one that is filled.
    """

    def __init__(self, most: int = QUEUE_MESSAGES):
        self.most, self.held, self.fresh = most, 0, []
        self.level: int | None = None
        self.filled: list[Run] = []
        self.taken: list[Run] = []

    def push(self, messages: np.ndarray) -> None:
        """Messages to the level above the one that is taken from."""
        self.fresh.append(messages)
        self.held += len(messages)
        if self.held > self.most:
            self._close(spill=True)

    def _close(self, spill: bool) -> None:
        if self.fresh:
            self.filled.append(Run.of(summed(np.concatenate(self.fresh)), spill))
        self.fresh, self.held = [], 0

    def pop(self, level: int, last: int) -> np.ndarray:
        """All messages to receivers of ``level`` up to ``last``, added up for each."""
        if level != self.level:
            self._close(spill=False)
            # A level nobody sent to is skipped: its messages would be the level's above.
            self.taken = self.filled if self.level is None or level == self.level - 1 else []
            self.filled, self.level = [], level
        found = [part for run in self.taken for part in run.take(last)]
        return summed(np.concatenate(found)) if found else np.zeros(0, MESSAGE)


FORWARD = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, pa bigint, pb bigint, "
           "top boolean, children bigint, leaves bigint, saved bigint")


def forward(most: int):
    """Totals of all nodes of a partition in reverse level order, by id within a level.

    Nodes come with what was sent to them from elsewhere and their own ``saved``.
    A ``top`` node's parent is elsewhere.
    """

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = LevelQueue(most)
        for batch in batches:
            depth = batch.column("depth").to_numpy()
            if not len(depth):
                continue
            conv = batch.column("conv_id").to_numpy()
            parent = batch.column("parent_conv_id").fill_null(0).to_numpy()
            top = batch.column("top").to_numpy(zero_copy_only=False)
            sums = {name: batch.column(name).to_numpy().copy() for name in TOTALS}
            heads = np.flatnonzero(np.append(True, depth[1:] != depth[:-1]))
            for first, end in zip(heads, np.append(heads[1:], len(depth))):
                own = slice(first, end)
                got = queue.pop(int(depth[first]), int(conv[end - 1]))
                at = first + np.searchsorted(conv[own], got["to"])
                for name in TOTALS:
                    sums[name][at] += got[name]
                sums["leaves"][own][sums["children"][own] == 0] = 1
                on = first + np.flatnonzero(~top[own])
                sent = np.zeros(len(on), MESSAGE)
                sent["to"], sent["children"] = parent[on], 1
                sent["leaves"], sent["saved"] = sums["leaves"][on], sums["saved"][on]
                queue.push(sent)
            kept = batch.num_columns - len(TOTALS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], *[pa.array(sums[name]) for name in TOTALS]], batch.schema.names)

    return totals


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, pa, pb, conv_id) rows to (depth, pa, pb, first, ids): stretches of a node's ids."""
    for batch in batches:
        columns = [column.to_numpy() for column in batch.columns]
        if not len(columns[0]):
            continue
        new = np.append(True, np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0))
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(new)))
        cuts = np.concatenate([np.arange(a, a + n, JOINED_IDS) for a, n in zip(heads, sizes)])
        ids = columns[3].astype(str)
        texts = [",".join(ids[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(new)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[cuts]) for c in columns] + [pa.array(texts, pa.string())], [*PLACE, "first", "ids"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's stretches, which come in order; one digest is open at a time."""
    place, digest = None, None
    for batch in batches:
        done = []
        for *now, _, ids in zip(*[column.to_pylist() for column in batch.columns]):
            if now != place:
                if place:
                    done.append((*place, digest.hexdigest()))
                place, digest = now, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield digest_rows(done)
    if place:
        yield digest_rows([(*place, digest.hexdigest())])


def digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], [*PLACE, "ends_sha256"])


class PrefixTrie:
    """The trie over (turns, conversations), as ``rebuilt`` or ``as_they_are`` return them."""

    def __init__(self, turns: DataFrame, convs: DataFrame, limit: int = SHARD_TURNS,
                 stretch: int = STRETCH, most: int = QUEUE_MESSAGES):
        self.convs, self.limit, self.most = convs, limit, most
        self.turns = staged(with_prefixes(turns, stretch), "prefixes")

    def nodes(self) -> DataFrame:
        """Nodes with their parent's id; ``heavy`` ones are too large for a shard."""
        deeper = self.turns.groupBy(*PLACE).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
            F.max("qa").alias("qa"), F.max("qb").alias("qb"), F.sum(F.col("n") - F.col("depth")).alias("below"))
        zero = F.lit(0).cast("long")
        root = self.convs.agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("n").alias("below"),
        ).filter("n_convs > 0").select(
            "*", *[zero.alias(name) for name in (*PLACE, "words", "qa", "qb")])
        heavy = (F.col("below") > self.limit) | (F.col("depth") == 0)
        nodes = staged(deeper.unionByName(root).withColumn("heavy", heavy), "nodes")
        parents = nodes.select(
            (F.col("depth") + 1).alias("depth"), F.col("pa").alias("qa"), F.col("pb").alias("qb"),
            F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("top"))
        linked = nodes.join(parents, ["depth", "qa", "qb"], "left")
        return staged(linked.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "pa", "pb", F.coalesce("top", F.lit(False)).alias("top"),
            "heavy", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "linked")

    def report(self) -> DataFrame:
        """One row per node."""
        nodes = self.nodes()
        zero = F.lit(0).cast("long")
        order = [F.desc("depth"), F.asc("conv_id")]
        columns = [name.split()[0] for name in FORWARD.split(", ")]
        light = nodes.filter("NOT heavy").join(self._shards(nodes), "conv_id").withColumns(
            {"children": zero, "leaves": zero})
        light = staged(
            light.repartition("shard").sortWithinPartitions(*order).select(*columns)
            .mapInArrow(forward(self.most), FORWARD), "light")
        sent = light.filter("top").groupBy(
            (F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(
            F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("more"))
        # At most total turns / limit nodes of a level.
        heavy = nodes.filter("heavy").join(sent, ["depth", "conv_id"], "left").withColumns({
            "top": F.col("depth") == 0, "children": F.coalesce("children", zero),
            "leaves": F.coalesce("leaves", zero), "saved": F.col("saved") + F.coalesce("more", zero)})
        heavy = heavy.repartition(1).sortWithinPartitions(*order).select(*columns).mapInArrow(
            forward(self.most), FORWARD)
        return light.unionByName(heavy).join(self._ends(), PLACE, "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))

    def _shards(self, nodes: DataFrame) -> DataFrame:
        """For each conversation, the shard of the first node on its way that is not heavy."""
        heavy = nodes.filter("heavy AND depth > 0").select(*PLACE)
        if heavy.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
            heavy = F.broadcast(heavy)
        roots = self.turns.select("conv_id", *PLACE).join(heavy, PLACE, "left_anti").groupBy("conv_id").agg(
            F.min(F.struct(*PLACE)).alias("root"))
        return roots.select("conv_id", F.xxhash64("root.pa", "root.pb").alias("shard"))

    def _ends(self) -> DataFrame:
        """Digest of the ids that end at a node, for nodes at which any do."""
        zero = F.lit(0).cast("long")
        ends = self.turns.filter("depth = n").select(*PLACE, "conv_id").unionByName(
            self.convs.filter("n = 0").select(*[zero.alias(name) for name in PLACE], "conv_id"))
        counts = ends.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("ends"), F.min("conv_id").alias("only"))
        counts = staged(counts, "ends")
        one = counts.filter("ends = 1").select(
            *PLACE, F.sha2(F.col("only").cast("string").cast("binary"), 256).alias("ends_sha256"))
        several = ends.join(counts.filter("ends > 1").select(*PLACE), PLACE, "left_semi")
        key = [*PLACE, "conv_id"]
        stretches = several.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(
            joined_ids, "depth bigint, pa bigint, pb bigint, first bigint, ids string")
        hashed = stretches.repartition(*PLACE).sortWithinPartitions(*PLACE, "first").mapInArrow(
            digests, "depth bigint, pa bigint, pb bigint, ends_sha256 string")
        return one.unionByName(hashed)
