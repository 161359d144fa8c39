"""Distinct visitors of any period, from sketches that are stored with the hours.

Counts of distinct visitors cannot be added up: who comes on two days would count
twice in the week.  Sketches can be merged, so days, weeks and networks are unions of
the hours' sketches, and no ride or visitor hour is read again.

A sketch of ``LG_K`` has 2**LG_K registers, a few kilobytes at most; its estimate has a
standard error of ``ERROR``, and small sets are counted nearly exactly.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import schemas
from turnstile.functions.timeparts import week_start
from turnstile.operators.hourly import HOUR_KEY

LG_K = 12
# Relative standard error of an estimate: 1.04 / sqrt(2**LG_K).
ERROR = 0.01625


def hourly_sketches(visitor_hours: DataFrame) -> DataFrame:
    """A sketch of the visitors of each hour and resort; hours of nobody known have none."""
    rows = visitor_hours.filter("rfid IS NOT NULL").groupBy(*HOUR_KEY, "ride_block").agg(
        F.hll_sketch_agg("rfid", LG_K).alias("visitors"))
    return schemas.conform(rows, schemas.VISITOR_SKETCHES)


def unique_visitors(sketches: DataFrame, **keys: Column) -> DataFrame:
    """Estimated distinct visitors for each combination of ``keys``, over all hours they cover."""
    merged = sketches.groupBy(*[key.alias(name) for name, key in keys.items()]).agg(
        F.hll_union_agg("visitors").alias("visitors"))
    return merged.select(*keys, F.hll_sketch_estimate("visitors").alias("unique_visitors"))


def daily_unique_visitors(sketches: DataFrame) -> DataFrame:
    return unique_visitors(sketches, ride_date=F.col("ride_date"), resort=F.col("resort"))


def weekly_unique_visitors(sketches: DataFrame) -> DataFrame:
    return unique_visitors(sketches, week_start_date=week_start(F.col("ride_date")), resort=F.col("resort"))


def network_unique_visitors(sketches: DataFrame) -> DataFrame:
    """Per week over all resorts; a person at two of them counts once."""
    return unique_visitors(sketches, week_start_date=week_start(F.col("ride_date")))
