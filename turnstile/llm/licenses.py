"""License scans by MinHash over text windows, in DataFrame functions only.

A text's word triples are hashed once; windows of ``2 * BLOCK`` triples start
every ``BLOCK`` triples.  A window's MinHash values are the least of its hashes
under ``FUNCTIONS`` exclusive ors, computed per block and combined.  Every value is
a band of one row, which favours recall: a notice of five words fills a quarter of
a window and shares a band with it with a probability of 0.997, a longer one or a
window inside a longer text more surely.  Templates of up to ``SHORT`` triples are
retrieved by any of their triples, as a notice of three words fills too little of a
window.  Longer templates are cut at every triple, so
that a window inside one equals one of theirs.  What a window retrieves is
verified by exact containment: of a template's distinct triples, at least
``percent`` must be found in the words around the window, no farther away than
the longest template of its family is long.  Templates are of one family if one has
``percent`` of another's triples, also by way of third ones.  A window retrieves whole
families.  A verified template is reported unless a better contained one of its family
covers all places where its triples stand, as variants differ in a word or a version.

Templates are a parameter: they are part of the plan, as literals for the first
test and as a small broadcast table for retrieval.  Only texts that share a band
with a template keep their triples and values beyond the scan.

Defined cases: a null or empty text, or one of two words, holds no license; rows
that repeat a ``doc_id`` are scanned each by its own text; no templates find
nothing.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm.common import staged
from turnstile.llm.notices import NOTICES

BLOCK = 6
FUNCTIONS = 20
PERCENT = 60
SHORT = 5  # triples of a template that is retrieved by any of them
# A run of odd multiples of the golden ratio as exclusive-or masks.
MASKS = [((2 * i + 1) * 0x9E3779B97F4A7C15) % 2**64 for i in range(FUNCTIONS)]
MASKS = [m - 2**64 if m >= 2**63 else m for m in MASKS]


def neighbours(values: Column) -> Column:
    """A hash of every two elements in a row."""
    less = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(
        F.slice(values, F.lit(1), less), F.slice(values, F.lit(2), less), lambda a, b: F.xxhash64(a, b))


def word_triples(text: Column) -> Column:
    """Hashes of every three words in a row, by their two pairs; words are runs of letters,
    digits and non-ASCII."""
    words = F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    pairs = F.get(F.transform(F.array(words), lambda w: neighbours(w)), F.lit(0))
    return F.get(F.transform(F.array(pairs), lambda p: neighbours(p)), F.lit(0))


def least_values(triples: Column) -> Column:
    """MinHash values, one for each mask."""
    masks = F.array(*[F.lit(m) for m in MASKS])
    return F.transform(masks, lambda m: F.array_min(F.transform(triples, lambda h: h.bitwiseXOR(m))))


def blocks(triples: Column) -> Column:
    count = F.ceil(F.size(triples) / BLOCK).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: least_values(F.slice(triples, i * BLOCK + 1, F.lit(BLOCK))))


def windows(cut: Column) -> Column:
    """Values of every two blocks in a row; a text of one block is a window."""
    first = F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(1)))
    return F.zip_with(first, F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(1))),
                      lambda a, b: F.when(b.isNull(), a).otherwise(
                          F.zip_with(a, b, lambda x, y: F.least(x, y))))


def templates(spark: SparkSession, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """``template``, ``license``, its distinct triples and length, and all MinHash values of its windows."""
    width = 2 * BLOCK
    starts = F.sequence(F.lit(1), F.greatest(F.size("triples") - width + 1, F.lit(1)))
    values = F.flatten(F.transform(starts, lambda i: least_values(F.slice("triples", i, F.lit(width)))))
    rows = [(i, name, text) for i, (name, text) in enumerate(notices)]
    return (
        spark.createDataFrame(rows, "template int, license string, text string")
        .withColumn("triples", word_triples(F.col("text"))).filter(F.size("triples") > 0)
        .select("template", "license", F.array_distinct("triples").alias("template_triples"),
                F.size("triples").alias("length"), F.array_distinct(values).alias("values"))
    )


def numbers(rows: DataFrame, column: str) -> list[int]:
    return sorted({v for row in rows.select(column).collect() for v in row[0]})


def beats(other: Column, template: Column) -> Column:
    """Whether another template accounts for all that is found of this one."""
    return (
        (other["containment"] > template["containment"])
        | (other["containment"] == template["containment"])
        & (F.size(other["places"]) > F.size(template["places"]))
    ) & (F.size(F.array_except(template["places"], other["places"])) == 0)


def families(templates: DataFrame, percent: int) -> DataFrame:
    """``templates`` with their ``family`` and its ``reach``, the length of its longest."""
    rows = templates.collect()
    root = {r.template: r.template for r in rows}

    def top(template: int) -> int:
        while root[template] != template:
            template = root[template]
        return template

    sets = {r.template: set(r.template_triples) for r in rows}
    for a in rows:
        for b in rows:
            if 100 * len(sets[a.template] & sets[b.template]) >= percent * len(sets[a.template]):
                root[top(a.template)] = top(b.template)
    reach: dict[int, int] = {}
    for r in rows:
        reach[top(r.template)] = max(r.length, reach.get(top(r.template), 0))
    return templates.sparkSession.createDataFrame(
        [(*r, top(r.template), reach[top(r.template)]) for r in rows],
        f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in templates.schema)}, family int, reach int")


class LicenseScan:
    """License notices in ``docs`` (``doc_id``, ``text``)."""

    def __init__(self, docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, percent: int = PERCENT):
        self.percent = percent
        self.templates = families(templates(docs.sparkSession, notices), percent)
        self.short = self.templates.filter(F.size("template_triples") <= SHORT)
        self.short_triples = numbers(self.short, "template_triples")
        # As a text, for one call to the parser instead of one for every number.
        known = ", ".join(map(str, numbers(self.templates, "values")))
        hit = F.expr(f"exists(blocks, b -> exists(b, v -> v IN ({known})))") if known else F.lit(False)
        if self.short_triples:
            hit = hit | F.exists("triples", lambda t: t.isin(self.short_triples))
        # A least value that is a template's is one of its triples, so texts without any need no blocks.
        own = ", ".join(map(str, numbers(self.templates, "template_triples")))
        holds = F.expr(f"exists(triples, t -> t IN ({own}))") if own else F.lit(False)
        count = F.ceil(F.size("triples") / BLOCK)
        # Only texts with a hit keep their triples and windows.
        self.scanned = staged(
            docs.select("doc_id", word_triples(F.coalesce("text", F.lit(""))).alias("triples"))
            .withColumn("blocks", F.when(holds, blocks(F.col("triples"))))
            .withColumn("hit", F.col("blocks").isNotNull() & hit)
            .select(
                F.monotonically_increasing_id().alias("row"), "doc_id",
                F.size("triples").cast("long").alias("n_triples"),
                F.greatest(count - 1, F.least(count, F.lit(1))).cast("long").alias("n_windows"),
                F.when(F.col("hit"), F.col("triples")).alias("triples"),
                F.when(F.col("hit"), windows(F.col("blocks"))).alias("windows")),
            "windows")

    def matches(self) -> DataFrame:
        """``row``, ``doc_id``, ``template``, ``license``, ``window`` and the verified ``containment``."""
        hits = self.scanned.filter("windows IS NOT NULL")
        by_value = (
            hits.select("row", F.posexplode("windows").alias("window", "values"))
            .select("row", "window", F.explode("values").alias("value"))
            .join(F.broadcast(self.templates.select("family", "reach", F.explode("values").alias("value")).distinct()),
                  "value")
        )
        last = F.greatest(F.col("n_windows") - 1, F.lit(0))
        by_triple = (
            hits.select("row", "n_windows", F.posexplode("triples").alias("at", "value"))
            .filter(F.col("value").isin(self.short_triples))
            .select("row", F.least(F.floor(F.col("at") / BLOCK), last).cast("int").alias("window"), "value")
            .join(F.broadcast(self.short.select(
                "family", "reach", F.explode("template_triples").alias("value")).distinct()), "value")
        )
        retrieved = by_value.unionByName(by_triple).select("row", "window", "family", "reach").distinct()
        start = F.greatest(F.col("window") * BLOCK - F.col("reach"), F.lit(0))
        around = F.slice("triples", start + 1, 2 * F.col("reach") + 2 * BLOCK)
        found = F.size(F.array_intersect("template_triples", "around")) / F.size("template_triples")
        places = F.filter(
            F.transform("around", lambda t, i: F.when(F.array_contains("template_triples", t), i)),
            lambda i: i.isNotNull())
        verified = (
            retrieved.join(hits.select("row", "doc_id", "triples"), "row")
            .select("row", "doc_id", "window", "family", around.alias("around"))
            .join(F.broadcast(self.templates.select("family", "template", "license", "template_triples")), "family")
            .withColumn("containment", found)
            .filter(F.col("containment") * 100 >= self.percent)
            .withColumn("places", places)
        )
        # At most one row for each template of a family.
        return (
            verified.groupBy("row", "doc_id", "window", "family")
            .agg(F.collect_list(F.struct("template", "license", "containment", "places")).alias("all"))
            .select("row", "doc_id", "window", F.inline(
                F.filter("all", lambda t: ~F.exists("all", lambda u: beats(u, t)))))
            .select("row", "doc_id", "template", "license", "window", "containment")
        )

    def report(self) -> DataFrame:
        """Per document: windows, licenses found (comma-joined, in order) and the best containment."""
        found = self.matches().groupBy("row").agg(
            F.array_sort(F.collect_set("license")).alias("names"),
            F.max("containment").alias("best"))
        return self.scanned.select("row", "doc_id", "n_windows").join(found, "row", "left").select(
            "doc_id", "n_windows",
            F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
            F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"),
            F.coalesce("best", F.lit(0.0)).alias("containment"))
