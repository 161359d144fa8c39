"""JSON payloads: one upper-case object per line, matched to columns by name."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import schemas
from turnstile.functions.timeparts import iso_text, iso_to_utc

BAD_LINE = "_bad_line"
_TIMES = {"purchase_time", "ride_time"}
_DATES = {"expiration_time"}


def _wire_type(field: T.StructField) -> T.DataType:
    """Type a value has in the payload: times travel as ISO text."""
    if field.name in _TIMES | _DATES:
        return T.StringType()
    if isinstance(field.dataType, T.StructType):
        return wire_schema(field.dataType)
    return field.dataType


def wire_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name.upper(), _wire_type(f)) for f in schema])


def parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows from a ``value`` column, plus the raw text of unreadable lines.

    Names match exactly (upper case); unknown keys are dropped, missing ones
    are null.  Works on batch and streaming frames alike.
    """
    wire = wire_schema(schema).add(BAD_LINE, T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    record = F.from_json(F.col("value"), wire, options)
    rows = lines.select(F.col("value"), record.alias("r")).select("*", *[_column(f) for f in schema])
    # A time that cannot be read makes the whole line unreadable.
    lost = [F.col(f"r.{f.name.upper()}").isNotNull() & F.col(f.name).isNull()
            for f in schema if f.name in _TIMES | _DATES]
    unreadable = reduce(Column.__or__, lost, F.col("r").isNull())
    bad = F.coalesce(f"r.{BAD_LINE}", F.when(unreadable, F.col("value")))
    return rows.select(*schema.names, bad.alias(BAD_LINE))


def _column(field: T.StructField):
    value = F.col(f"r.{field.name.upper()}")
    if field.name in _TIMES:
        value = iso_to_utc(value)
    elif field.name in _DATES:
        value = F.to_date(iso_to_utc(value))
    elif isinstance(field.dataType, T.StructType):
        parts = [value[p.name.upper()].alias(p.name) for p in field.dataType]
        value = F.when(value.isNotNull(), F.struct(*parts))
    return value.cast(field.dataType).alias(field.name)


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def bad_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(BAD_LINE).isNotNull()).select(F.col(BAD_LINE).alias("value"))


def to_payload(df: DataFrame, schema: T.StructType, keep_nulls: bool) -> DataFrame:
    """Rows as JSON lines.  Sales keep null fields, rides leave an unset counter out."""
    fields = []
    for field in schema:
        value = F.col(field.name)
        if field.name in _TIMES:
            value = F.concat(iso_text(value), F.lit("+00:00"))
        elif field.name in _DATES:
            value = F.concat(value.cast("string"), F.lit("T00:00:00+00:00"))
        elif isinstance(field.dataType, T.StructType):
            parts = [value[p.name].alias(p.name.upper()) for p in field.dataType]
            value = F.when(value.isNotNull(), F.struct(*parts))
        fields.append(value.alias(field.name.upper()))
    options = {"ignoreNullFields": "false" if keep_nulls else "true"}
    return df.select(F.to_json(F.struct(*fields), options).alias("value"))


def sale_payload(df: DataFrame, schema: T.StructType) -> DataFrame:
    return to_payload(df, schema, keep_nulls=True)


def ride_payload(df: DataFrame) -> DataFrame:
    return to_payload(df, schemas.LIFT_RIDE, keep_nulls=False)
