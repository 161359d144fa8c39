"""Running a registered query in both engines and comparing the rows."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain_value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, (date, Decimal, bool, int, str)) or value is None:
        return f"{type(value).__name__}:{value}"
    return repr(value)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain_value(row[i]) for i in order) for row in rows)


def differences(spark, con, build, sql, sf_dir):
    """Names differ, or the rows only one engine has; empty when all is equal."""
    frame = build(spark, sf_dir)
    names = frame.columns
    mine = sorted_rows(names, [tuple(row) for row in frame.collect()])
    result = con.sql(sql)
    theirs_names = result.columns
    if sorted(names) != sorted(theirs_names):
        return {"spark": sorted(names), "sql": sorted(theirs_names)}
    theirs = sorted_rows(theirs_names, result.fetchall())
    if mine == theirs:
        return {}
    only_mine = sorted(set(mine) - set(theirs))
    only_theirs = sorted(set(theirs) - set(mine))
    return {"rows": (len(mine), len(theirs)), "spark": only_mine[:3], "sql": only_theirs[:3]}
