"""Audits and derivations over recorded rides and sales."""

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions.timeparts import (
    day_of, hour_start, seconds_between, to_local,
)
from turnstile.operators.visits import latest_sales

# Opening hours, ride and rest intervals in minutes, price
# profile of an unlisted resort, price variation in percent.
OPEN_HOUR, CLOSE_HOUR = 8, 16
MIN_RIDE_MINUTES, MIN_REST_MINUTES = 10, 30
DEFAULT_BASE_PRICE, DEFAULT_WEEKEND_MULTIPLIER = 100, "1.5"
PRICE_LOW_PCT, PRICE_HIGH_PCT = 90, 110
CONTACT_FIELDS = ("address", "phone", "email", "emergency_contact")


def activation_days(rides: DataFrame) -> DataFrame:
    """Number each ride with its medium's n-th distinct day of use.

    Days are numbered on one row per medium and day; the rides only join the
    result, so a medium with many rides is never sorted as one group.
    """
    dated = rides.drop("activation_day_count").withColumn("_day", day_of(F.col("ride_time")))
    by_day = Window.partitionBy("rfid").orderBy(F.col("_day").asc_nulls_last())
    numbered = (
        dated.select("rfid", "_day")
        .distinct()
        .withColumn("activation_day_count", F.row_number().over(by_day))
    )
    return dated.join(numbered, ["rfid", "_day"], "left").drop("_day")


def rides_after_expiry(rides: DataFrame, *sales: DataFrame) -> DataFrame:
    """Rides on a later day than their medium expires.

    Only the day of the expiration is stored, so rides on that day pass.
    """
    media = sales[0].select("rfid", "txid", "purchase_time", "expiration_time")
    for other in sales[1:]:
        media = media.unionByName(other.select(*media.columns))
    expiry = latest_sales(media).select("rfid", "expiration_time")
    late = day_of(F.col("ride_time")) > F.col("expiration_time")
    return rides.join(expiry, "rfid", "inner").filter(late)


def overused_tickets(rides: DataFrame, tickets: DataFrame) -> DataFrame:
    """Tickets used on more distinct days than they were sold for."""
    used = (
        rides.select("rfid", day_of(F.col("ride_time")).alias("day"))
        .distinct()
        .groupBy("rfid")
        .agg(F.count(F.lit(1)).alias("days_used"))
    )
    sold = latest_sales(tickets.select("rfid", "txid", "purchase_time", "days"))
    return (
        used.join(sold.select("rfid", "days"), "rfid", "inner")
        .filter(F.col("days_used") > F.col("days"))
        .select("rfid", "days", "days_used")
    )


def rides_outside_hours(
    rides: DataFrame, capacity: DataFrame, open_hour: int = OPEN_HOUR, close_hour: int = CLOSE_HOUR
) -> DataFrame:
    """Rides before opening or from closing time on, by the resort's own clock."""
    zones = capacity.select("resort", "iana_timezone")
    local = rides.join(zones, "resort", "inner").withColumn(
        "local_time", to_local(F.col("ride_time"), F.col("iana_timezone"))
    )
    hour = F.hour("local_time")
    return local.filter((hour < open_hour) | (hour >= close_hour)).drop("iana_timezone")


def ride_gaps(
    rides: DataFrame,
    min_ride_minutes: int = MIN_RIDE_MINUTES,
    min_rest_minutes: int = MIN_REST_MINUTES,
) -> DataFrame:
    """Time since the medium's previous ride, flagged when too short or a rest.

    A medium is split by hour: rides look back within their hour, and the
    first ride of an hour takes the last ride of the medium's previous active
    hour.  That keeps a medium with a large part of all rides off a single
    task; what is ordered per medium is one row per active hour.
    """
    order = [F.col("ride_time").asc_nulls_last(), F.col("txid").asc_nulls_last()]
    hour = hour_start(F.col("ride_time"))
    rows = rides.select("txid", "rfid", "ride_time", hour.alias("_hour"))
    hours = rows.groupBy("rfid", "_hour").agg(F.max("ride_time").alias("_last"))
    earlier = Window.partitionBy("rfid").orderBy(F.col("_hour").asc_nulls_last())
    carried = hours.select("rfid", "_hour", F.lag("_last").over(earlier).alias("_carried"))
    within = Window.partitionBy("rfid", "_hour").orderBy(*order)
    inner = rows.withColumn("_previous", F.lag("ride_time").over(within))
    joined = inner.join(carried, ["rfid", "_hour"], "left")
    previous = F.coalesce("_previous", "_carried")
    gap = seconds_between(previous, F.col("ride_time"))
    return joined.select(
        "txid", "rfid", "ride_time",
        previous.alias("previous_ride_time"),
        gap.alias("gap_seconds"),
        F.coalesce(gap < min_ride_minutes * 60, F.lit(False)).alias("too_fast"),
        F.coalesce(gap >= min_rest_minutes * 60, F.lit(False)).alias("rested"),
    )


def price_band(tickets: DataFrame, profiles: DataFrame) -> DataFrame:
    """Ticket prices against the band their resort, weekday and length allow.

    Prices are whole numbers cut off downwards, so the lower end is too.
    """
    base = F.coalesce("ticket_base_price", F.lit(DEFAULT_BASE_PRICE)).cast("decimal(7,0)")
    weekend = F.coalesce(
        "weekend_multiplier", F.lit(DEFAULT_WEEKEND_MULTIPLIER).cast("decimal(4,2)")
    )
    factor = F.when(F.weekday("purchase_time") >= 5, weekend).otherwise(F.lit(1))
    list_price = (base * factor * F.col("days").cast("decimal(6,0)")).cast("decimal(18,2)")
    low = F.floor(list_price * PRICE_LOW_PCT / 100).cast("decimal(18,2)")
    high = (list_price * PRICE_HIGH_PCT / 100).cast("decimal(18,2)")
    price = F.col("price_usd")
    return tickets.join(profiles, "resort", "left").select(
        "txid", "resort", "days", "price_usd",
        low.alias("lowest_price"),
        high.alias("highest_price"),
        price.between(low, high).alias("in_band"),
    )


def price_tier_share(sales: DataFrame) -> DataFrame:
    """Sales per price and their share of all sales in percent."""
    tiers = sales.groupBy("price_usd").agg(F.count(F.lit(1)).alias("sales"))
    every = sales.agg(F.count(F.lit(1))).scalar()
    return tiers.withColumn(
        "share_pct", F.col("sales").cast("double") * 100 / every.cast("double")
    )


def active_media(sales: DataFrame, as_of: datetime) -> DataFrame:
    """Sales whose medium has not expired at ``as_of``."""
    return sales.filter(F.col("expiration_time") >= F.lit(as_of.date()))


def ingest_throughput(rides: DataFrame, passes: DataFrame, tickets: DataFrame) -> DataFrame:
    """Rows per source and hour, with the rate per second.

    Each source is counted before the union, so one shuffle key never carries
    a whole source.
    """
    def hours(df: DataFrame, source: str, time: str) -> DataFrame:
        return (
            df.groupBy(hour_start(F.col(time)).alias("hour"))
            .agg(F.count(F.lit(1)).alias("row_count"))
            .withColumn("source", F.lit(source))
        )

    return (
        hours(rides, "lift_ride", "ride_time")
        .unionByName(hours(passes, "season_pass", "purchase_time"))
        .unionByName(hours(tickets, "resort_ticket", "purchase_time"))
        .select(
            "source", "hour", "row_count",
            (F.col("row_count").cast("double") / 3600).alias("rows_per_second"),
        )
    )


def null_profile(sales: DataFrame, fields: tuple[str, ...] = CONTACT_FIELDS) -> DataFrame:
    """Share of rows without a value, per field, in one pass."""
    return sales.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[
            (
                F.count_if(F.col(name).isNull()).cast("double") / F.count(F.lit(1)).cast("double")
            ).alias(f"{name}_null_share")
            for name in fields
        ],
    )
