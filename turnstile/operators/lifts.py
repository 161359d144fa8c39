"""Lift performance over a trailing window."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile import schemas
from turnstile.functions.bands import activity_icon, activity_level, rank_medal
from turnstile.functions.money import rounded_ratio
from turnstile.functions.timeparts import minutes_before, minutes_between

# Length of the trailing window, size of the top list.
WINDOW_MINUTES = 30
TOP_LIFTS = 10


def trailing_rides(
    rides: DataFrame,
    resort: str,
    minutes: int = WINDOW_MINUTES,
    as_of: datetime | None = None,
    hourly: DataFrame | None = None,
) -> DataFrame:
    """Rides of one resort later than ``minutes`` before its last ride (or ``as_of``).

    The start of the window is a scalar subquery: no join is needed and the
    main scan compares with a plain value.  Rides stored by ``ride_date`` are
    pruned to the days of the window; with the ``hourly`` table at hand the
    search for the last ride starts at the last reported day, instead of
    reading the resort's whole history.
    """
    own = rides.filter(F.col("resort") == resort)
    time, dated = F.col("ride_time"), "ride_date" in rides.columns
    if as_of is not None:
        end = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
        start = minutes_before(end, minutes)
        window = own.filter((time > start) & (time <= end))
        if dated:
            window = window.filter(F.col("ride_date").between(F.to_date(start), F.to_date(end)))
        return window
    recent = own
    if dated and hourly is not None:
        recent = own.filter(F.col("ride_date") >= last_reported_day(hourly, resort))
    start = minutes_before(F.max(time), minutes)
    window = own.filter(time > recent.agg(start).scalar())
    if dated:
        window = window.filter(F.col("ride_date") >= recent.agg(F.to_date(start)).scalar())
    return window


def last_reported_day(hourly: DataFrame, resort: str | None = None) -> Column:
    """A day no later than the last ride's, as a value: the last one with an
    hourly row, or the first of all days before any report."""
    own = hourly if resort is None else hourly.filter(F.col("resort") == resort)
    return own.agg(F.coalesce(F.max("ride_date"), F.lit("0001-01-01").cast("date"))).scalar()


def lift_performance(
    rides: DataFrame,
    resort: str,
    minutes: int = WINDOW_MINUTES,
    as_of: datetime | None = None,
    hourly: DataFrame | None = None,
) -> DataFrame:
    """Rides, visitors, activity span, ranks and hourly rate per lift.

    One resort is in the frame, so its ranking is the overall ranking too.
    Ranks sort one row per lift, not rides.
    """
    lifts = trailing_rides(rides, resort, minutes, as_of, hourly).groupBy("resort", "lift").agg(
        F.count(F.lit(1)).alias("rides"),
        F.count_distinct("rfid").alias("unique_visitors"),
        F.min("ride_time").alias("first_activity_time"),
        F.max("ride_time").alias("last_activity_time"),
    )
    busiest = Window.partitionBy("resort").orderBy(
        F.col("rides").desc_nulls_last(), F.col("lift").asc_nulls_last()
    )
    span = minutes_between(F.col("first_activity_time"), F.col("last_activity_time"))
    ranked = lifts.withColumn("usage_rank_in_resort", F.row_number().over(busiest))
    return schemas.conform(
        ranked,
        schemas.LIFT_PERFORMANCE,
        overall_usage_rank=F.col("usage_rank_in_resort"),
        rides_per_hour=rounded_ratio(F.col("rides") * 60, span, 1),
    )


def top_lifts(performance: DataFrame, n: int = TOP_LIFTS) -> DataFrame:
    rank = F.col("usage_rank_in_resort")
    return performance.filter(rank <= n).orderBy(rank.asc())


def share_of_max(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Each row's share of its group's largest value, 0 where that is 0.

    The maximum is aggregated and joined back, so groups of any size work.
    """
    most = df.groupBy(*keys).agg(F.max(value).alias("_most"))
    return (
        df.join(most, list(keys), "inner")
        .withColumn("share_of_max", _share(F.col(value), F.col("_most")))
        .drop("_most")
    )


def top_lifts_board(performance: DataFrame, n: int = TOP_LIFTS) -> DataFrame:
    """The top list as shown: medal, share of the busiest lift and activity level."""
    shown = Window.partitionBy("resort")  # at most n rows are left
    rank, level = F.col("usage_rank_in_resort"), activity_level(F.col("rides_per_hour"))
    return (
        performance.filter(rank <= n)
        .select(
            rank,
            rank_medal(rank).alias("medal"),
            "lift", "rides", "unique_visitors", "rides_per_hour",
            _share(F.col("rides"), F.max("rides").over(shown)).alias("share_of_max"),
            level.alias("activity_level"),
            activity_icon(level).alias("activity_icon"),
        )
        .orderBy(rank.asc())
    )


def _share(value: Column, most: Column) -> Column:
    share = value.cast("double") / most.cast("double")
    return F.when(most > 0, share).otherwise(F.lit(0.0))
