"""Reference tables: resort capacities and price profiles."""

from collections.abc import Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from turnstile import schemas

# Resort, most visitors, hourly capacity, base lifts, time zone.
RESORT_CAPACITY = (
    ("Vail", 7000, 1100, 34, "America/Denver"),
    ("Beaver Creek", 5500, 900, 25, "America/Denver"),
    ("Breckenridge", 6500, 1000, 35, "America/Denver"),
    ("Keystone", 4500, 700, 21, "America/Denver"),
    ("Heavenly", 5000, 800, 27, "America/Los_Angeles"),
)

# Resort, base price of a ticket day, weekend multiplier.
PRICE_PROFILES = (
    ("Vail", 120, "1.6"),
    ("Beaver Creek", 110, "1.5"),
    ("Breckenridge", 100, "1.7"),
    ("Keystone", 90, "1.6"),
    ("Heavenly", 110, "1.5"),
)


def resort_capacity(
    spark: SparkSession, rows: Sequence[tuple] = RESORT_CAPACITY
) -> DataFrame:
    return literal_table(spark, rows, schemas.RESORT_CAPACITY)


def price_profiles(spark: SparkSession, rows: Sequence[tuple] = PRICE_PROFILES) -> DataFrame:
    return literal_table(spark, rows, schemas.PRICE_PROFILE)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A table of literals.

    Handed over as an Arrow table it becomes a local relation whose exact size
    the planner knows, so joins with it turn into broadcasts by themselves; no
    join in this package needs a hint for it.
    """
    arrow = to_arrow_schema(schema)
    columns = [
        pa.array([_exact(row[i], field) for row in rows], type=arrow.field(i).type)
        for i, field in enumerate(schema)
    ]
    return spark.createDataFrame(pa.table(columns, schema=arrow), schema=schema)


def _exact(value, field: T.StructField):
    return Decimal(value) if isinstance(field.dataType, T.DecimalType) else value
