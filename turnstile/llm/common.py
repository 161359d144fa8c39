"""Helpers shared by the operators: staged tables and checked inputs."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.session import shared_dir
from turnstile.sources import files

# ASCII white space as the contracts write it, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back.

    Its lineage ends there, so a lost executor repeats a read instead of the
    work before it, and a frame that is used twice is computed once.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read any more."""
    for df in tables:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            files.delete(df.sparkSession, folder)


GIVEN = "__given_id"


def own_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``doc_id`` of its own for each unlike row, and the given one as ``GIVEN``.

    Rows that repeat an id keep it where their text has the least hash (so rows that are
    equal are one document); all others get ids beyond those that are given, so that
    nothing decided for one row falls on another.  Only rows of repeated ids are
    shuffled; usually there are none.
    """
    given = docs.withColumn(GIVEN, F.col("doc_id")).withColumn("doc_id", F.col("doc_id").cast("long"))
    counts = given.filter("doc_id IS NOT NULL").groupBy("doc_id").count()
    repeated = staged(counts.filter("count > 1").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        discard(repeated)
        return given
    spark = docs.sparkSession
    texts = rows_of_ids(given.select("doc_id", F.xxhash64("text").alias("hash")), repeated, "doc_id").distinct()
    first = texts.groupBy("doc_id").agg(F.min("hash").alias("hash"))
    low, high = given.agg(F.min("doc_id"), F.max("doc_id")).first()
    if high >= 1 << 62 and low <= -(1 << 62):
        raise ValueError("ids of repeated rows leave no room for others beyond them")
    number = F.monotonically_increasing_id()
    beyond = F.lit(high + 1) + number if high < 1 << 62 else F.lit(low - 1) - number
    more = staged(texts.join(first, ["doc_id", "hash"], "left_anti").select(
        "doc_id", "hash", beyond.alias("__own_id")), "ids")
    moved = given.withColumn("__hash", F.xxhash64("text")).join(
        more.withColumnRenamed("hash", "__hash"), ["doc_id", "__hash"], "left")
    return moved.withColumn("doc_id", F.coalesce("__own_id", "doc_id")).select(
        *[f"`{name}`" for name in docs.columns], GIVEN)


def given_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ids as they came, without ``GIVEN``."""
    return docs.withColumn("doc_id", F.col(GIVEN)).drop(GIVEN)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Within the block, actions send tasks at most ``most`` rows at a time: for wide rows."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_bytes(spark: SparkSession, most: int = 1 << 20) -> Iterator[None]:
    """Within the block, actions send tasks some ``most`` bytes of rows at a time: an executor holds
    a batch several times, in buffers outside its heap and in its Python workers."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


SLOTS = 1 << 20


def rows_of_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids``, without shuffling all others.

    A hash of the id is looked up first, in a broadcast table of at most ``SLOTS``
    numbers however many ids there are; the join is for what passes.
    """
    def slot() -> Column:
        return F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("int").alias("_slot")

    ids = staged(ids.select(column).distinct(), "ids")
    passing = df.withColumn("_slot", slot()).join(
        F.broadcast(ids.select(slot()).distinct()), "_slot", "left_semi").drop("_slot")
    return passing.join(ids, column, "left_semi")


def word_count(text: Column) -> Column:
    """Words (runs of anything but ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NON_SPACE)), F.lit(0)).cast("long")
