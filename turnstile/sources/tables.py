"""Stored tables: scans with a declared schema, appends and partition overwrites."""

from collections.abc import Collection, Iterator
from contextlib import contextmanager
from datetime import date
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import schemas
from turnstile.operators.batches import retain_after
from turnstile.session import shared_dir
from turnstile.sources import files


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(schema.names)


def scan_dates(
    spark: SparkSession, path: str, schema: T.StructType, column: str, dates: Collection[date]
) -> DataFrame:
    """The given date partitions only; the files of other dates are not even listed.

    Dates without a partition contribute no rows.
    """
    wanted = {f"{column}={day.isoformat()}" for day in dates}
    present = sorted(wanted & set(files.children(spark, path)))
    if not present:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", path)
    return reader.parquet(*[f"{path}/{name}" for name in present]).select(schema.names)


def replace_partitions(
    df: DataFrame, path: str, schema: T.StructType, *partition_by: str,
    replaced: Collection[tuple] | None = None,
) -> int:
    """Overwrite the partitions ``df`` has rows for; returns the row count.

    ``replaced`` lists partitions, as values of the first columns of
    ``partition_by``, that ``df`` stands for as a whole: what is stored below them
    and has no rows any more goes.  All other partitions stay.

    The rebalance step gathers each partition's rows into files of the advisory
    size: small partitions get one file, large ones are split over many tasks.
    The mode is set on the write itself, as the session default would drop
    every other partition of the table.
    """
    counted = Observation()
    key = F.struct(*[F.col(name).cast("string") for name in partition_by])
    (
        schemas.conform(df, schema)
        .hint("rebalance", *[F.col(name) for name in partition_by])
        .observe(counted, F.count(F.lit(1)).alias("row_count"),
                 F.collect_set(key).alias("written"))  # one entry per partition
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    if replaced:
        written = {tuple(row) for row in counted.get["written"]}
        for values in replaced:
            wanted = tuple(None if v is None else str(v) for v in values)
            for parts, folder in _folders(df.sparkSession, path, len(partition_by), wanted):
                if parts not in written:
                    files.delete(df.sparkSession, folder)
    return counted.get["row_count"]


def _folders(
    spark: SparkSession, path: str, depth: int, wanted: tuple[str | None, ...] = ()
) -> Iterator[tuple[tuple[str | None, ...], str]]:
    """Values and paths of the stored partitions that begin with ``wanted``."""
    found = [((), path)]
    for level in range(depth):
        found = [
            ((*values, partition_value(name)), f"{folder}/{name}")
            for values, folder in found for name in files.children(spark, folder) if "=" in name
        ]
        if level < len(wanted):
            found = [(values, folder) for values, folder in found if values[level] == wanted[level]]
    yield from found


def partition_value(folder: str) -> str | None:
    """The value Spark wrote a partition folder's name for."""
    value = unquote(folder.split("=", 1)[1])
    return None if value == "__HIVE_DEFAULT_PARTITION__" else value


def append_rows(df: DataFrame, path: str, schema: T.StructType, *partition_by: str) -> None:
    """Append by column name.  Not for retried work: see ``replace_partitions`` for that."""
    schemas.conform(df, schema).write.mode("append").partitionBy(*partition_by).parquet(path)


def store_sales(sales: DataFrame, table: str, buckets: int) -> None:
    """Sales as a catalog table bucketed by medium.

    Looking visits up in it shuffles the visits only: picking each medium's
    newest sale and joining by medium both follow the buckets.  Give it at
    least as many buckets as there are shuffle partitions.
    """
    sales.write.mode("overwrite").bucketBy(buckets, "rfid").sortBy("rfid").saveAsTable(table)


def purge_acknowledged(
    spark: SparkSession, path: str, schema: T.StructType, id_col: str, before_id: int,
    partition: str,
) -> None:
    """Drop rows up to ``before_id`` from a buffer partitioned by ``partition``.

    Partitions above the mark stay untouched.  What is left of the others is
    staged, so that no partition is read and replaced by the same job, and put in
    their place; those of which nothing is left go.  Rows without an id stay.
    """
    low = F.min(id_col) <= before_id
    reach = scan(spark, path, schema).groupBy(partition).agg(low.alias("reached")).filter("reached")
    values = [row[0] for row in reach.select(F.col(partition).cast("string")).collect()]
    if not values:
        return
    key = F.col(partition).cast("string")
    known = [value for value in values if value is not None]
    cut = key.isin(known) | key.isNull() if None in values else key.isin(known)
    left = retain_after(scan(spark, path, schema).filter(cut), id_col, before_id)
    with staged(spark, left, schema, "purge") as rows:
        replace_partitions(rows, path, schema, partition, replaced=[(value,) for value in values])


@contextmanager
def staged(spark: SparkSession, df: DataFrame, schema: T.StructType, purpose: str):
    """``df`` written to the shared folder and read back while the block runs: its lineage
    ends there."""
    path = shared_dir(spark, purpose)
    schemas.conform(df, schema).write.parquet(path)
    try:
        yield scan(spark, path, schema)
    finally:
        files.delete(spark, path)
