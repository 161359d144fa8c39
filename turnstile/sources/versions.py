"""Tables that change together: readers see all of a change or nothing of it.

A change writes each partition it replaces into a folder of its own version and
leaves what is stored alone.  A manifest lists, for every table and partition, the
versions whose folders hold its rows; it becomes the current one by a single
rename.  A reader works on the version it started with until that one expires.

    <root>/<table>/v=<version>/<partition>/part-….parquet
    <root>/_versions/<version>.json

A change that breaks off has published nothing; the next one writes over its
folders.  The manifest also keeps ``marks``: which batches are in the tables, so that a
batch that is delivered again is known, and whatever else must be true of just that
version.  Manifests grow with the number of partitions, not of rows or files.  One
change is made at a time; a second writer finds its version taken and fails.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Iterable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import schemas
from turnstile.sources import files
from turnstile.sources.tables import partition_value

MANIFESTS = "_versions"


class TakenVersion(RuntimeError):
    """Another writer published the version first."""


# Table to partition folder ("ride_date=2024-01-01/ride_block=2") to versions.
Tables = dict[str, dict[str, list[int]]]


class Snapshot:
    """The tables as one version has them."""

    def __init__(self, spark: SparkSession, root: str, version: int = 0, tables: Tables | None = None,
                 marks: dict | None = None):
        self.spark, self.root, self.version = spark, root, version
        self.tables, self.marks = tables or {}, marks or {}

    def scan(
        self, name: str, schema: T.StructType, keep: Callable[[tuple[str | None, ...]], bool] | None = None,
    ) -> DataFrame:
        """Rows of a table; with ``keep``, only of partitions whose values it accepts.

        The folders of other partitions, and of versions that replaced them, are not
        listed.
        """
        folders = [
            f"{self.root}/{name}/v={version}/{part}"
            for part, versions in self.tables.get(name, {}).items()
            if keep is None or keep(values_of(part)) for version in versions
        ]
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}")
        return reader.parquet(*folders).select(schema.names)


def values_of(part: str) -> tuple[str | None, ...]:
    """Partition values of a folder, as text."""
    return tuple(partition_value(name) for name in part.split("/"))


class Change(Snapshot):
    """A version in the making: reads see what it has written so far."""

    def __init__(self, base: Snapshot):
        tables = {name: dict(parts) for name, parts in base.tables.items()}
        super().__init__(base.spark, base.root, base.version + 1, tables, dict(base.marks))
        self._dropped: list[str] = []
        self._written: set[str] = set()

    def replace(
        self, name: str, df: DataFrame, schema: T.StructType, *partition_by: str,
        replaced: Collection[tuple] = (), options: dict[str, str] | None = None,
    ) -> int:
        """Put rows in place of the partitions they belong to; returns their number.

        ``replaced`` lists partitions, as first partition values, that ``df`` stands for as
        a whole: those it has no rows for become empty.
        """
        rows, written = self._write(name, df, schema, partition_by, options)
        parts = self.tables.setdefault(name, {})
        wanted = {tuple(None if v is None else str(v) for v in values) for values in replaced}
        depths = {len(values) for values in wanted}
        emptied = [part for part in parts if any(values_of(part)[:n] in wanted for n in depths)]
        for part in {*emptied, *written}:
            self._dropped += [f"{name}/v={v}/{part}" for v in parts.pop(part, []) if v != self.version]
        parts.update({part: [self.version] for part in written})
        return rows

    def append(self, name: str, df: DataFrame, schema: T.StructType, *partition_by: str,
               options: dict[str, str] | None = None) -> int:
        """Add rows to the partitions they belong to; returns their number."""
        rows, written = self._write(name, df, schema, partition_by, options)
        parts = self.tables.setdefault(name, {})
        for part in written:
            parts[part] = [*parts.get(part, []), self.version]
        return rows

    def added(self, name: str, schema: T.StructType) -> DataFrame:
        """Rows that this change has written to a table."""
        parts = {part: [self.version] for part, versions in self.tables.get(name, {}).items()
                 if self.version in versions}
        return Snapshot(self.spark, self.root, self.version, {name: parts}).scan(name, schema)

    def drop(self, paths: Iterable[str]) -> None:
        """Name files or folders, relative to the root, that this version does without."""
        self._dropped += paths

    def _write(
        self, name: str, df: DataFrame, schema: T.StructType, partition_by: tuple[str, ...],
        options: dict[str, str] | None,
    ) -> tuple[int, list[str]]:
        if name in self._written:
            raise ValueError(f"a change writes {name!r} once")
        self._written.add(name)
        path, counted = f"{self.root}/{name}/v={self.version}", Observation()
        (
            schemas.conform(df, schema)
            # Small partitions get one file, large ones are split over many tasks.
            .hint("rebalance", *[F.col(column) for column in partition_by])
            .observe(counted, F.count(F.lit(1)).alias("row_count"))
            .write.mode("overwrite").option("partitionOverwriteMode", "static").options(**(options or {}))
            .partitionBy(*partition_by).parquet(path)
        )
        written = [""]
        for _ in partition_by:
            written = [f"{part}/{child}".lstrip("/") for part in written
                       for child in files.children(self.spark, f"{path}/{part}".rstrip("/")) if "=" in child]
        return counted.get["row_count"], written

    def publish(self) -> Snapshot:
        """Make this the current version."""
        text = json.dumps({
            "version": self.version, "published": datetime.now(UTC).isoformat(), "marks": self.marks,
            "dropped": self._dropped, "tables": self.tables,
        })
        if not files.write_new(self.spark, manifest(self.root, self.version), text):
            raise TakenVersion(f"version {self.version} of {self.root} was published by another writer")
        return Snapshot(self.spark, self.root, self.version, self.tables, self.marks)


def manifest(root: str, version: int) -> str:
    return f"{root}/{MANIFESTS}/{version:012d}.json"


def published(spark: SparkSession, root: str) -> list[int]:
    """Versions that can be read, oldest first."""
    names = files.children(spark, f"{root}/{MANIFESTS}")
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The current version, or the given one; version 0 has no tables."""
    known = published(spark, root)
    if version is None:
        version = known[-1] if known else 0
    if not version:
        return Snapshot(spark, root)
    if version not in known:
        raise LookupError(f"{root} has no version {version}, or not any more")
    stored = json.loads(files.read(spark, manifest(root, version)))
    return Snapshot(spark, root, version, stored["tables"], stored["marks"])


def expire(spark: SparkSession, root: str, keep: timedelta = timedelta(hours=1)) -> list[int]:
    """Remove versions that were replaced longer than ``keep`` ago; returns them.

    Give it more than the longest report takes.  A version's manifest goes first; then
    the folders that its successor dropped, which none but older versions knew.  Only
    manifests of versions that go, and one more, are read.
    """
    known, gone = published(spark, root), []
    for version, successor in zip(known, known[1:]):
        after = json.loads(files.read(spark, manifest(root, successor)))
        if datetime.now(UTC) - datetime.fromisoformat(after["published"]) < keep:
            break
        files.delete(spark, manifest(root, version))
        for folder in after["dropped"]:
            files.delete(spark, f"{root}/{folder}")
        gone.append(version)
    return gone
