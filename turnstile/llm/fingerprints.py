"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A document is the set of digests of its paragraphs: lines, cut after ``CUT`` code
points.  A digest is 48 hash bits and a 16-bit check of them, so that it vouches
for itself.  Three of a sketch's cells hold each digest; a cell is the count and
the exclusive or of its digests.  Subtracting two versions' sketches leaves the
digests they don't share.  A cell with count 1 or -1 whose value passes its own
check is one of them; taking it out of its other cells bares more, until all
cells are empty (the difference is known) or none is left to take (it is not).
Pairs that fail are tried again with sketches four times as large.

The likeness of two documents is 1 less the part of their paragraphs that the
difference holds; two without paragraphs are alike.

Defined cases: a null text is empty; equal texts have equal fingerprints, also in
rows that repeat a ``doc_id``; a row without a ``doc_id`` has no next document (its
next text is empty); a single document is its own next one; an empty table gives
no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.llm.common import staged

CUT = 256
SLOTS = 16  # in each of three parts of the smallest sketch
PARTS = 3
GROWTH = 4
BUCKET_ROWS = 4000
MAX_CUTS = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def check(digest: Column) -> Column:
    return F.xxhash64(F.shiftrightunsigned(digest, 16)).bitwiseAND(F.lit(0xFFFF))


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs."""
    parts = F.regexp_extract_all(text, F.lit(f"[^\n]{{1,{CUT}}}"), F.lit(0))

    def digest(part: Column) -> Column:
        high = F.shiftleft(F.xxhash64(part), 16)
        return high.bitwiseOR(check(high))

    return F.array_distinct(F.transform(parts, digest))


def slots_of(digest: Column, slots: int) -> Column:
    """The digest's slot in each part of a sketch."""
    return F.array(*[F.pmod(F.xxhash64(digest, F.lit(part)), F.lit(slots)).cast("int") for part in range(PARTS)])


def by_slot(placed: Column, slots: int, cell: Callable[[int, Column, Column], Column]) -> Column:
    """``cell(part, slot, digests in it)`` for all slots of all parts, in order.

    Digests are first dealt out to ``SLOTS`` runs of slots, so that a slot looks
    through its run's digests only.
    """
    width = slots // SLOTS
    shift = width.bit_length() - 1

    def run(part: int, g: Column) -> Column:
        here = F.filter(placed, lambda p: F.shiftright(p["at"][part], shift) == g)
        if width == 1:
            return F.array(let(here, lambda held: cell(part, g, held)))
        slots_ = F.sequence(g * width, g * width + (width - 1))
        return let(here, lambda all_: F.transform(slots_, lambda i: let(
            F.filter(all_, lambda p: p["at"][part] == i), lambda held: cell(part, i, held))))

    runs = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    def part_of(part: int) -> Column:
        return F.transform(runs, lambda g: run(part, g))

    return F.flatten(F.concat(*[part_of(part) for part in range(PARTS)]))


def sketch(values: Column, slots: int) -> Column:
    """The cells of a set of digests: counts and exclusive ors."""
    placed = F.transform(values, lambda d: F.struct(d.alias("d"), slots_of(d, slots).alias("at")))

    def cell(part: int, slot: Column, held: Column) -> Column:
        return F.struct(
            F.size(held).alias("n"),
            F.aggregate(held, F.lit(0).cast("long"), lambda x, p: x.bitwiseXOR(p["d"])).alias("x"))

    return let(placed, lambda all_: by_slot(all_, slots, cell))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["n"] - y["n"]).alias("n"), x["x"].bitwiseXOR(y["x"]).alias("x")))


def peel(difference: Column, slots: int) -> Column:
    """``left`` and ``right``: digests of one side only; ``done``: whether that is all."""

    def pure(cells: Column) -> Column:
        alone = F.filter(cells, lambda c: (F.abs(c["n"]) == 1)
                         & (check(c["x"]) == c["x"].bitwiseAND(F.lit(0xFFFF))))
        return F.array_distinct(F.transform(alone, lambda c: F.struct(
            c["x"].alias("d"), c["n"].alias("n"), slots_of(c["x"], slots).alias("at"))))

    def without(cells: Column, taken: Column) -> Column:
        def less(part: int, slot: Column, here: Column) -> Column:
            return let(F.get(cells, slot + part * slots), lambda c: F.when(F.size(here) == 0, c).otherwise(F.struct(
                F.aggregate(here, c["n"], lambda x, p: x - p["n"]).alias("n"),
                F.aggregate(here, c["x"], lambda x, p: x.bitwiseXOR(p["d"])).alias("x"))))

        return by_slot(taken, slots, less)

    def one_side(taken: Column, sign: int) -> Column:
        return F.transform(F.filter(taken, lambda p: p["n"] == sign), lambda p: p["d"])

    def step(state: Column, _: Column) -> Column:
        def go(taken: Column) -> Column:
            return F.when(F.size(taken) == 0, F.struct(
                state["cells"].alias("cells"), state["left"].alias("left"),
                state["right"].alias("right"), F.lit(True).alias("stuck"),
            )).otherwise(F.struct(
                without(state["cells"], taken).alias("cells"),
                F.concat(state["left"], one_side(taken, 1)).alias("left"),
                F.concat(state["right"], one_side(taken, -1)).alias("right"),
                F.lit(False).alias("stuck"),
            ))

        return F.when(state["stuck"], state).otherwise(let(pure(state["cells"]), go))

    none = F.array().cast("array<bigint>")
    start = F.struct(difference.alias("cells"), none.alias("left"), none.alias("right"),
                     F.lit(False).alias("stuck"))
    # Every round takes a digest or is the last; few rounds do in practice, and a
    # sketch that needs more counts as failed.
    rounds = F.sequence(F.lit(1), F.lit(8 + 2 * slots.bit_length()))
    return F.aggregate(rounds, start, step, lambda s: F.struct(
        s["left"].alias("left"), s["right"].alias("right"),
        (~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["x"] != 0))).alias("done")))


def text_of(values: Column) -> Column:
    """The fingerprint as a string: how many paragraphs, then the cells of the smallest sketch."""
    cells = F.transform(sketch(values, SLOTS), lambda c: F.concat(
        F.hex(c["n"]), F.lit("."), F.hex(c["x"])))
    return F.concat_ws(":", F.size(values).cast("string"), F.array_join(cells, "-"))


def differences(pairs: DataFrame) -> DataFrame:
    """Pairs (``key``, digests ``a`` and ``b``) with the digests ``left`` only in ``a``, ``right``
    only in ``b``, found by peeling sketches, larger ones where smaller fail."""
    slots, todo, solved = SLOTS, pairs, []
    while True:
        tried = staged(
            todo.withColumn("out", peel(subtract(sketch(F.col("a"), slots), sketch(F.col("b"), slots)), slots)),
            "peeled")
        # A cell that sums several digests may pass for one; then what was peeled is not of the sets.
        true = (
            (F.size(F.array_except("out.left", "a")) == 0) & (F.size(F.array_except("out.right", "b")) == 0)
            & ~F.arrays_overlap("out.left", "out.right")
            & (F.size(F.array_distinct("out.left")) == F.size("out.left"))
            & (F.size(F.array_distinct("out.right")) == F.size("out.right")))
        tried = tried.withColumn("whole", F.col("out.done") & true)
        solved.append(tried.filter("whole").select("key", "a", "b", "out.left", "out.right"))
        todo = tried.filter("NOT whole").select("key", "a", "b")
        if not todo.limit(1).count():
            break
        slots *= GROWTH
    out = solved[0]
    for more in solved[1:]:
        out = out.unionByName(more)
    return out


def likeness(a: Column, b: Column, left: Column, right: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(1.0 - (F.size(left) + F.size(right)) / both)


def ranges(rows: DataFrame, count: int) -> Column:
    """The range of a ``doc_id``: of about ``BUCKET_ROWS`` documents, however ids are spread.

    At most ``MAX_CUTS`` quantiles cut the ids, and where these leave more documents between
    them, each stretch is cut into equal widths.
    """
    parts = max(1, min(MAX_CUTS, -(-count // BUCKET_ROWS)))
    wanted = [i / parts for i in range(parts)] + [1.0]
    # At most ``MAX_CUTS + 1`` numbers.
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", wanted, 40 * MAX_CUTS)).first()[0]))
    starts = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    halves = [1 << i for i in reversed(range((len(cuts) - 1).bit_length()))]
    within = -(-count // (parts * BUCKET_ROWS))

    def place(starts: Column) -> Column:
        # The last cut that is not above the id, by halving steps.  A fold, as a step written into
        # the next one would stand there three times, with all cuts.
        at = F.aggregate(
            F.array(*[F.lit(half) for half in halves]).cast("array<int>"), F.lit(0),
            lambda at, half: F.when(
                F.coalesce(F.get(starts, at + half) <= F.col("doc_id"), F.lit(False)), at + half).otherwise(at))
        if within == 1:
            return at.cast("long")

        def stretch(at: Column) -> Column:
            low, high = (F.get(starts, at + i).cast("double") for i in (0, 1))
            share = (F.col("doc_id").cast("double") - low) / (high - low)
            return F.coalesce(F.least(F.floor(share * within), F.lit(within - 1)), F.lit(0))

        return let(at, lambda at: at.cast("long") * within + stretch(at))

    return let(starts, place)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``digests`` and those of the next document by ascending ``doc_id``.

    Ids are cut into ranges of about ``BUCKET_ROWS`` documents at their quantiles, each ordered by
    itself; the first document of a range stands at the end of the one before, too.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    count = rows.agg(F.count("doc_id")).first()[0]
    rows = rows.withColumn("digests", digests(F.col("text")))
    nothing = rows.filter("doc_id IS NULL").withColumn("next_text", F.lit("")).withColumn(
        "next_digests", F.array().cast("array<bigint>"))
    if not count:
        return nothing
    place = ranges(rows, count)
    known = rows.filter("doc_id IS NOT NULL").withColumn("bucket", place)
    by_bucket = Window.orderBy("bucket")
    firsts = docs.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL").withColumn(
        "bucket", place).groupBy("bucket").agg(F.min("doc_id").alias("first"))
    # One row for every few thousand documents.
    ends = staged(firsts.select(
        F.col("first").alias("doc_id"),
        F.coalesce(F.lag("bucket").over(by_bucket), F.max("bucket").over(Window.partitionBy())).alias("before"),
    ), "firsts")
    places = F.when(F.col("before").isNull(), F.array(F.struct("bucket", F.lit(False).alias("copy")))).otherwise(
        F.array(F.struct("bucket", F.lit(False).alias("copy")),
                F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copy"))))
    ordered = Window.partitionBy("bucket").orderBy("copy", "doc_id", "hash")
    following = (
        known.join(ends, "doc_id", "left").withColumn("at", F.explode(places))
        .select("doc_id", "text", "digests", "at.*", F.xxhash64("text").alias("hash"))
        .withColumn("next_text", F.lead("text").over(ordered))
        .withColumn("next_digests", F.lead("digests").over(ordered))
        .filter("NOT copy")
        .select("doc_id", "text", "digests", "next_text", "next_digests")
    )
    return following.unionByName(nothing)


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last quarter replaced by the beginning of the next text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter),
                    F.substring(next_text, F.lit(1), quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, its edited version's, and likenesses to that and the next."""
    versions = staged(
        with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
        .select(
            F.monotonically_increasing_id().alias("row"), "doc_id",
            F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            "digests", digests(F.col("edited")).alias("edited_digests"), "next_digests"),
        "versions")
    pairs = versions.select("row", "digests", F.explode(F.array(
        F.struct(F.lit("edited").alias("to"), F.col("edited_digests").alias("b")),
        F.struct(F.lit("next").alias("to"), F.col("next_digests").alias("b")))).alias("pair")).select(
        F.struct("row", "pair.to").alias("key"), F.col("digests").alias("a"), "pair.b")
    alike = differences(pairs).select(
        "key.row", "key.to", likeness(F.col("a"), F.col("b"), F.col("left"), F.col("right")).alias("near"))
    near = alike.groupBy("row").agg(
        F.max(F.when(F.col("to") == "edited", F.col("near"))).alias("near_edited"),
        F.max(F.when(F.col("to") == "next", F.col("near"))).alias("near_next"))
    return versions.join(near, "row").select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("digests")).alias("fingerprint"),
        text_of(F.col("edited_digests")).alias("edited_fingerprint"), "near_edited", "near_next")
