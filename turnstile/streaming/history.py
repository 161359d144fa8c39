"""What each refresh read and wrote, and when.

A batch's entries are one small file below the date it ran on, so that a batch that
runs again replaces them, and old dates can be put together or removed on their own.
"""

import json
from collections.abc import Iterable
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from turnstile import schemas
from turnstile.sources import files

_STORED = T.StructType([*schemas.REFRESH_HISTORY.fields, T.StructField("batch_id", T.LongType())])
INPUT_HISTORY = T.StructType([
    T.StructField("query_id", T.StringType()), T.StructField("batch_id", T.LongType()),
    T.StructField("batch_start_time", T.TimestampNTZType()), T.StructField("input_rows", T.LongType()),
    T.StructField("input_rows_per_second", T.DoubleType()),
    T.StructField("processed_rows_per_second", T.DoubleType()), T.StructField("duration_ms", T.LongType()),
    T.StructField("start_offset", T.StringType()), T.StructField("end_offset", T.StringType()),
])
_COMPACTED = "compacted.json"


class RefreshLog:
    """Collects the steps of one batch; a replayed batch replaces its entries."""

    def __init__(self, spark: SparkSession, path: str, batch_id: int, input_rows: int | None = None):
        self._spark, self._path, self._batch_id, self._input_rows = spark, path, batch_id, input_rows
        self._steps: list[dict] = []

    def step(self, target: str, partitions: int, write) -> None:
        start = _now()
        row_count = write()
        self._steps.append({
            "target": target, "partitions": partitions, "row_count": row_count, "input_rows": self._input_rows,
            "refresh_start_time": start, "refresh_end_time": _now(), "batch_id": self._batch_id})

    def save(self) -> None:
        _write(self._spark, self._path, f"batch-{self._batch_id:012d}.json", self._steps)


class InputLog(StreamingQueryListener):
    """Input rows, rates and offsets of every batch of all streams, as Spark reports them.

    Register it with ``spark.streams.addListener``; it sees batches that end after that.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        _write(self._spark, self._path, f"{progress.id}-{progress.batchId:012d}.json", [{
            "query_id": str(progress.id), "batch_id": progress.batchId,
            "batch_start_time": progress.timestamp.removesuffix("Z"), "input_rows": progress.numInputRows,
            "input_rows_per_second": _finite(progress.inputRowsPerSecond),
            "processed_rows_per_second": _finite(progress.processedRowsPerSecond),
            "duration_ms": progress.batchDuration,
            "start_offset": json.dumps([source.startOffset for source in progress.sources]),
            "end_offset": json.dumps([source.endOffset for source in progress.sources])}])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def refresh_history(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Refreshes of the targets whose name starts with ``prefix``, newest first."""
    return (
        _latest(spark, path, _STORED, ["batch_id", "target"], "refresh_end_time")
        .filter(F.col("target").startswith(prefix))
        .orderBy(F.col("refresh_start_time").desc_nulls_last(), F.col("target").asc())
    )


def input_history(spark: SparkSession, path: str) -> DataFrame:
    return _latest(spark, path, INPUT_HISTORY, ["query_id", "batch_id"], "batch_start_time")


def compact_history(spark: SparkSession, path: str, before: date) -> list[str]:
    """Put the files of each date before the given one together; returns the dates.

    The joined file is written first, and readers take an entry once, so a compaction
    that breaks off or runs again changes nothing.
    """
    done = []
    for folder in files.children(spark, path):
        names = [n for n in files.children(spark, f"{path}/{folder}") if n.endswith(".json")]
        if not folder.startswith("date=") or folder >= f"date={before.isoformat()}" or names in ([], [_COMPACTED]):
            continue
        # A day's batches, a few lines each.
        lines = [line for n in sorted(names) for line in files.read(spark, f"{path}/{folder}/{n}").splitlines()]
        files.write_over(spark, f"{path}/{folder}/{_COMPACTED}", "\n".join(lines) + "\n")
        for name in names:
            if name != _COMPACTED:
                files.delete(spark, f"{path}/{folder}/{name}")
        done.append(folder.removeprefix("date="))
    return sorted(done)


def _latest(spark: SparkSession, path: str, schema: T.StructType, key: list[str], by: str) -> DataFrame:
    """The last entry of each key: a batch may have run twice, also over midnight."""
    order = Window.partitionBy(*key).orderBy(F.col(by).desc_nulls_last())
    return spark.read.schema(schema).json(path).select(
        "*", F.row_number().over(order).alias("_n")).filter("_n = 1").select(schema.names)


def _write(spark: SparkSession, path: str, name: str, rows: Iterable[dict]) -> None:
    text = "".join(json.dumps(row) + "\n" for row in rows)
    files.write_over(spark, f"{path}/date={datetime.now(UTC).date().isoformat()}/{name}", text)


def _finite(rate: float) -> float | None:
    return rate if rate is not None and abs(rate) < float("inf") else None


def _now() -> str:
    return datetime.now(UTC).replace(tzinfo=None).isoformat(timespec="microseconds")
