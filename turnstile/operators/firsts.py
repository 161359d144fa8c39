"""Keeping one row per group."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group.  ``order`` must end in a unique column.

    The filter on the row number makes Spark keep one row per group and task
    *before* the shuffle, so a group holding a large part of the table sends
    one row per task and never meets in one place.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(window)).filter(F.col("_row") == 1).drop("_row")
    )


def latest_per(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """The newest row of each group, the smaller ``tie`` on equal times."""
    return first_per(df, keys, [F.col(time).desc_nulls_last(), F.col(tie).asc_nulls_last()])
