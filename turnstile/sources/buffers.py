"""A buffer of numbered rows between a feed and its readers.

The manifest knows the smallest and largest id of every file, taken when the file is
written.  A bounded read and a purge look at those first and open only the files
that can matter to them.  Each append and each purge is one version, so a reader
sees a purge whole or not at all.  Appends sort their rows by id, so that files
overlap little.

Rows without an id were never delivered by one: bounded reads skip them, purges
leave them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import schemas
from turnstile.operators import batches
from turnstile.sources import versions
from turnstile.sources.versions import Change, snapshot

ATTEMPTS = 20


class FileRange(NamedTuple):
    """What the manifest keeps of a file; ids are null where no row has one."""

    low: int | None
    high: int | None
    rows: int
    without_id: int


class Buffer:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, id_col: str):
        self.spark, self.root, self.schema, self.id_col = spark, root, schema, id_col

    def files(self, version: int | None = None) -> dict[str, FileRange]:
        marks = snapshot(self.spark, self.root, version).marks
        return {name: FileRange(*held) for name, held in marks.get("files", {}).items()}

    def append(self, rows: DataFrame) -> int:
        """Add rows; returns their number.  Appends of several writers may overlap."""
        added = self._write(rows)
        self._commit(lambda files: ({**files, **added}, []))
        return sum(held.rows for held in added.values())

    def rows(self, version: int | None = None) -> DataFrame:
        return self._open(self.files(version))

    def read_after(self, after_id: int, batch_size: int = batches.BATCH_SIZE) -> DataFrame:
        """The next ``batch_size`` rows above ``after_id`` in id order."""
        files = {name: held for name, held in self.files().items()
                 if held.high is not None and held.high > after_id}
        # Files that lie above the mark as a whole hold the batch up to the id where they have
        # enough rows; no later file can add to it.
        enough, last = 0, None
        for held in sorted(files.values(), key=lambda held: held.high):
            if held.low > after_id:
                enough += held.rows - held.without_id
                if enough >= batch_size:
                    last = held.high
                    break
        needed = [name for name, held in files.items() if last is None or held.low <= last]
        return batches.read_after(self._open(needed), self.id_col, after_id, batch_size)

    def purge(self, before_id: int) -> int:
        """Drop rows up to and including ``before_id``; returns how many files had to be opened.

        Files that lie below the mark go unread.  What is left of those that it cuts is
        written anew, and all other files stay as they are.
        """
        files = self.files()
        below = [name for name, held in files.items() if held.low is not None and held.low <= before_id]
        cut = [name for name in below if files[name].high > before_id or files[name].without_id]
        left = self._write(batches.retain_after(self._open(cut), self.id_col, before_id)) if cut else {}

        def without(now: dict) -> tuple[dict, list[str]]:
            if not set(below) <= now.keys():
                raise RuntimeError(f"{self.root} was purged by another writer meanwhile")
            kept = {name: held for name, held in now.items() if name not in below}
            return {**kept, **left}, below

        if below:
            self._commit(without)
        return len(cut)

    def expire(self, keep: timedelta = timedelta(hours=1)) -> list[int]:
        """Remove the files of purged rows that no reader needs any more."""
        return versions.expire(self.spark, self.root, keep)

    def _open(self, names) -> DataFrame:
        paths = [f"{self.root}/rows/{name}" for name in names]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).select(self.schema.names)

    def _write(self, rows: DataFrame) -> dict[str, FileRange]:
        folder = uuid.uuid4().hex
        path = f"{self.root}/rows/{folder}"
        (
            schemas.conform(rows, self.schema)
            .repartitionByRange(F.col(self.id_col)).sortWithinPartitions(self.id_col)
            .write.parquet(path)
        )
        key = F.col(self.id_col)
        # One row per new file; only their ids are read.
        ranges = self.spark.read.schema(self.schema).parquet(path).groupBy("_metadata.file_name").agg(
            F.min(key), F.max(key), F.count(F.lit(1)), F.count_if(key.isNull())).collect()
        return {f"{folder}/{name}": FileRange(*held) for name, *held in ranges}

    def _commit(self, change_files: Callable[[dict], tuple[dict, list[str]]]) -> None:
        """Publish a change of the files; if another writer was first, upon its version."""
        for attempt in range(ATTEMPTS):
            change = Change(snapshot(self.spark, self.root))
            files, gone = change_files(change.marks.get("files", {}))
            change.marks["files"] = files
            change.drop(f"rows/{name}" for name in gone)
            try:
                change.publish()
                return
            except versions.TakenVersion:
                if attempt == ATTEMPTS - 1:
                    raise
