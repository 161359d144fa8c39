"""Bounded reads above a high-water id, and the purge that follows them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: rows per feed batch.
BATCH_SIZE = 10_000


def read_after(df: DataFrame, id_col: str, after_id: int, batch_size: int = BATCH_SIZE) -> DataFrame:
    """The next ``batch_size`` rows above ``after_id`` in id order."""
    return df.filter(F.col(id_col) > after_id).orderBy(F.col(id_col).asc()).limit(batch_size)


def retain_after(df: DataFrame, id_col: str, before_id: int) -> DataFrame:
    """What is left once rows up to and including ``before_id`` are acknowledged.

    Rows without an id were never delivered by one and stay.
    """
    return df.filter((F.col(id_col) > before_id) | F.col(id_col).isNull())


def latest(df: DataFrame, *order: str, rows: int = 100, tie: str) -> DataFrame:
    """The newest rows, sorted and cut in one pass (each task keeps ``rows`` at most)."""
    keys = [F.col(name).desc_nulls_last() for name in order] + [F.col(tie).asc_nulls_last()]
    return df.orderBy(*keys).limit(rows)


def preview(df: DataFrame, id_col: str, rows: int = 20) -> DataFrame:
    return df.orderBy(F.col(id_col).asc_nulls_last()).limit(rows)
