"""Small files and folders on any file system that Spark writes to."""

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    folder, system = _at(spark, path)
    if not system.exists(folder):
        return []
    return [status.getPath().getName() for status in system.listStatus(folder)]


def delete(spark: SparkSession, path: str) -> None:
    place, system = _at(spark, path)
    system.delete(place, True)


def read(spark: SparkSession, path: str) -> str:
    place, system = _at(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _draft(spark: SparkSession, path: str, text: str):
    folder, name = path.rsplit("/", 1)
    draft, system = _at(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return draft, system


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that appears whole, by one rename; False if it is there already."""
    draft, system = _draft(spark, path, text)
    place, _ = _at(spark, path)
    # A local file system would rename over a file that exists.
    if system.exists(place) or not system.rename(draft, place):
        system.delete(draft, False)
        return False
    return True


def write_over(spark: SparkSession, path: str, text: str) -> None:
    """Write a file in place of one that may be there."""
    draft, system = _draft(spark, path, text)
    place, _ = _at(spark, path)
    system.delete(place, False)
    system.rename(draft, place)
