"""JSON files in a landing folder become typed tables, exactly once."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from turnstile.functions.timeparts import utc_instant
from turnstile.sources.payloads import BAD_LINE, parse_lines

EVERY_10_SECONDS = {"processingTime": "10 seconds"}
AVAILABLE_NOW = {"availableNow": True}
# What a batch takes at most, unless the caller counts files.
BATCH_BYTES = 1 << 30
REJECTED = "rejected"


def _bounded(reader: DataStreamReader, max_files: int | None) -> DataStreamReader:
    if max_files is None:
        return reader.option("maxBytesPerTrigger", BATCH_BYTES)
    return reader.option("maxFilesPerTrigger", max_files)


def lines_stream(
    spark: SparkSession, folder: str, max_files: int | None = None, archive: str | None = None
) -> DataFrame:
    """Lines of the files in ``folder``, bounded batches, read files archived on request.

    The checkpoint keeps the high-water mark, so files can go once read.  With
    ``archive``, give the lines to one query only: the first to commit moves the files.
    """
    reader = _bounded(spark.readStream, max_files)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.text(folder)


def rides_stream(
    spark: SparkSession, folder: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """Append-only change feed of a stored table; bounded batches, what is there comes first."""
    return _bounded(spark.readStream.schema(schema), max_files).parquet(folder).select(schema.names)


def landed_stream(
    spark: SparkSession, table: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """Change feed of the good rows that ``start_ingest`` lands in ``table``."""
    reader = _bounded(spark.readStream.schema(landed_schema(schema)), max_files)
    return reader.parquet(table).filter(~F.col(REJECTED)).select(schema.names)


def landed_rows(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    rows = spark.read.schema(landed_schema(schema)).parquet(table)
    return rows.filter(~F.col(REJECTED)).select(schema.names)


def rejected_lines(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """Lines of the feed that could not be read, as they came."""
    rows = spark.read.schema(landed_schema(schema)).parquet(table)
    return rows.filter(F.col(REJECTED)).select(F.col(BAD_LINE).alias("value"))


def landed_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType()),
                         T.StructField(REJECTED, T.BooleanType())])


def drop_repeats(rows: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """Drop rows a feed delivered again within a bounded delay, and all rows later than that.

    A stream operator for feeds with a known bound.  Ingest does not use it, as a
    ride may come any time later; the refresh job drops repeats exactly.
    Watermarks need a zoned time, hence the copy; the state holds one key per row
    for the delay and no longer.
    """
    clock = utc_instant(F.col(time))
    return (
        rows.withColumn("_clock", clock)
        .withWatermark("_clock", within)
        .dropDuplicatesWithinWatermark([key])
        .drop("_clock")
    )


def start_ingest(
    lines: DataFrame, schema: T.StructType, table: str, checkpoint: str,
    trigger: dict = EVERY_10_SECONDS,
) -> StreamingQuery:
    """Land every line in ``table``: good rows and unreadable lines are two partitions of it.

    One query reads the feed, so its files may be archived once a batch is
    committed.  Nothing is dropped, however late or often it comes.  The file
    sink keeps a log of committed files, so readers of the table never see the
    output of a batch that failed half-way or ran twice.
    """
    parsed = parse_lines(lines, schema)
    return (
        parsed.withColumn(REJECTED, F.col(BAD_LINE).isNotNull())
        .writeStream.format("parquet").partitionBy(REJECTED)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(table)
    )
