"""Mixing sources to target weights by a low-discrepancy schedule.

A mix is a sequence of slots of equally many words.  Slot ``i`` has the point
``i * golden ratio mod 1``; the source whose stretch of cumulative target
shares holds the point fills the slot, so that every source is spread evenly
over the mix and its count never strays from its share by more than a few
slots.  Ranked within its source, a slot names the block it takes: documents of
a source are laid end to end in shuffled order, the line is cut into blocks of
equally many words, and rank ``r`` takes block ``r mod blocks`` in pass ``r div
blocks``.  The last block a source is due is cut where its target is reached.

No source is ordered in one task: prefix sums go over hash buckets of documents
and over chunks of slots, first their totals, then inside each.

Defined cases: a null text has no words; null sources are one source, last in
order; a document without words is never taken; rows that repeat a ``doc_id``
are documents of their own; an empty table gives no rows.  Other columns of the
input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.common import staged, word_count

# The golden ratio as a fraction of 2**31; products stay below 2**63.
PERIOD = 2**31
GOLDEN = 1327217885
GRID = 1024
BUCKETS = 4096
CHUNK = 65536


@dataclass(frozen=True)
class Mix:
    """A mix of ``docs`` (``doc_id``, ``text``, ``source``).

    ``weights`` repeat over the sources in code point order; the mix holds
    ``share`` times all words, a source at most ``passes`` times its own.
    """

    docs: DataFrame
    weights: Sequence[float] = (5, 2, 1)
    share: float = 1.5
    passes: int = 2
    block_words: int = 1000
    seed: int = 7

    @cached_property
    def sized(self) -> DataFrame:
        """One row per document: its size and its place in the shuffled order."""
        order = F.xxhash64(F.lit(self.seed), F.col("doc_id"))
        return staged(
            self.docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
            .withColumn("place", order)
            .withColumn("bucket", F.pmod(order, F.lit(BUCKETS)).cast("int")),
            "mix-sizes",
        )

    @cached_property
    def sources(self) -> DataFrame:
        """One row per source: number, words, weight, target, slots due, stretch of shares.

        The excess over a cap goes to the others by weight: with sources in
        order of cap per weight, one is capped if its even share of what the
        earlier ones leave is no less than its cap.
        """
        everything = Window.orderBy(F.col("source").asc_nulls_last())
        filling = Window.orderBy("cap_per_weight", "number")
        before = filling.rowsBetween(Window.unboundedPreceding, -1)
        all_rows = Window.partitionBy()
        weight = F.element_at(
            F.array(*[F.lit(float(w)) for w in self.weights]),
            (F.pmod(F.col("number"), F.lit(len(self.weights))) + 1).cast("int"),
        )
        level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
            F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        spare = F.try_divide(
            F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(all_rows),
            F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(all_rows),
        )
        shares = Window.orderBy("number")
        due = F.least(F.round("target").cast("long"), self.passes * F.col("source_size"))
        blocks = F.ceil(F.col("source_size") / self.block_words)
        whole = F.try_divide(F.col("due_words"), F.col("source_size")).cast("long")
        rest = F.col("due_words") - F.col("whole") * F.col("source_size")
        return staged(
            self.sized.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("number", F.row_number().over(everything) - 1)
            .withColumn("weight", weight)
            .withColumn("cap", F.lit(float(self.passes)) * F.col("source_size"))
            .withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
            .withColumn("total", self.share * F.sum("source_size").over(all_rows))
            .withColumn("capped", F.col("cap_per_weight") <= level)
            .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(
                F.col("weight") * spare))
            .withColumn("due_words", due)
            .withColumn("blocks", blocks)
            .withColumn("whole", F.coalesce(whole, F.lit(0)))
            .withColumn("due", F.col("whole") * F.col("blocks") + F.ceil(rest / self.block_words))
            .withColumn("all_due", F.sum("due").over(all_rows))
            .withColumn("upto", F.try_divide(F.sum("due").over(shares), F.col("all_due")))
            .withColumn("since", F.try_divide(F.sum("due").over(shares) - F.col("due"), F.col("all_due")))
            .select("source", "number", "source_size", "target", "due_words", "blocks", "due",
                    "since", "upto"),
            "mix-sources",
        )

    @cached_property
    def slots(self) -> DataFrame:
        """The schedule: ``slot``, ``number`` of its source, ``rank`` within it, block and words.

        Slots beyond what a source is due are left out, and the few that the
        schedule leaves a source short of stand at its end.
        """
        spark = self.docs.sparkSession
        count = self.sources.agg(F.sum("due")).first()[0] or 0
        point = F.pmod((F.col("slot") % PERIOD) * GOLDEN, F.lit(PERIOD)) / float(PERIOD)
        points = (
            spark.range(1, count + 1).select(F.col("id").alias("slot"))
            .withColumn("point", point)
            .withColumn("cell", F.floor(F.col("point") * GRID))
        )
        # A source lies in every cell of the unit interval that its stretch touches.
        stretches = (
            self.sources.filter("due > 0")
            .select("number", "due", "since", "upto", F.explode(F.sequence(
                F.floor(F.col("since") * GRID),
                F.least(F.floor(F.col("upto") * GRID), F.lit(GRID - 1)))).alias("cell"))
        )
        drawn = (
            points.join(stretches, "cell")
            .filter("point >= since AND (point < upto OR upto >= 1)")
            .select("slot", "number", "due", F.floor(F.col("slot") / CHUNK).alias("chunk"))
        )
        chunks = drawn.groupBy("number", "chunk").count()
        earlier = Window.partitionBy("number").orderBy("chunk")
        starts = chunks.select(
            "number", "chunk", (F.sum("count").over(earlier) - F.col("count")).alias("start"))
        inside = Window.partitionBy("number", "chunk").orderBy("slot")
        ranked = (
            drawn.withColumn("inside", F.row_number().over(inside) - 1)
            .join(starts, ["number", "chunk"])
            .select("slot", "number", (F.col("start") + F.col("inside")).alias("rank"), "due")
            .filter("rank < due").drop("due")
        )
        got = chunks.groupBy("number").agg(F.sum("count").alias("got"))
        short = (
            self.sources.join(got, "number", "left")
            .withColumn("got", F.coalesce("got", F.lit(0)))
            .filter("got < due")
            .select((F.lit(count) + 1 + F.col("number")).alias("slot"), "number",
                    F.explode(F.sequence("got", F.col("due") - 1)).alias("rank"))
        )
        turn = F.floor(F.col("rank") / F.col("blocks"))
        start = F.col("block") * self.block_words
        end = F.least(
            start + self.block_words,
            F.col("source_size"),
            F.col("due_words") - F.col("turn") * F.col("source_size"),
        )
        return (
            ranked.unionByName(short)
            .join(self.sources.select("number", "blocks", "source_size", "due_words"), "number")
            .withColumn("turn", turn)
            .withColumn("block", F.col("rank") - F.col("turn") * F.col("blocks"))
            .select("slot", "number", "rank", "block", start.alias("start"), end.alias("end"))
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Documents with words on the line of their source: ``at`` is the first word's place."""
        numbered = self.sized.join(
            self.sources.select(F.col("source").alias("_source"), "number", "source_size", "target"),
            F.col("source").eqNullSafe(F.col("_source")),
        ).drop("_source")
        totals = numbered.groupBy("number", "bucket").agg(F.sum("size").alias("words"))
        buckets = Window.partitionBy("number").orderBy("bucket")
        bases = totals.select(
            "number", "bucket", (F.sum("words").over(buckets) - F.col("words")).alias("base"))
        inside = Window.partitionBy("number", "bucket").orderBy("place", "doc_id", "size").rowsBetween(
            Window.unboundedPreceding, -1)
        return (
            numbered.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(bases, ["number", "bucket"])
            .withColumn("at", F.col("base") + F.col("before"))
            .select("doc_id", "source", "size", "number", "source_size", "target", "at")
        )

    def pieces(self) -> DataFrame:
        """One row per document and block it lies in, with the words of it that are in the block."""
        first = F.floor(F.col("at") / self.block_words)
        last = F.floor((F.col("at") + F.col("size") - 1) / self.block_words)
        return self.lines.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))

    def taken(self) -> DataFrame:
        """Per document: size, its source's size and target, and the words that the mix takes."""
        slots = self.slots.select("number", "block", F.col("start").alias("_start"),
                                  F.col("end").alias("_end"))
        overlap = F.least(F.col("at") + F.col("size"), F.col("_end")) - F.greatest("at", "_start")
        words = F.when(F.col("_start").isNull(), 0).otherwise(F.greatest(F.lit(0), overlap))
        key = ["doc_id", "source", "size", "number", "source_size", "target", "at"]
        with_words = (
            self.pieces().join(slots, ["number", "block"], "left")
            .groupBy(*key).agg(F.sum(words).alias("taken"))
        )
        without = self.lines.filter("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
        return with_words.unionByName(without).select(
            "doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, **settings) -> Mix:
    return Mix(docs, **settings)
