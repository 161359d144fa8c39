"""Parameterised reports.  Each returns a frame; nothing is collected on the way.

``clock`` is the one-row frame of ``reporting_clock``.  Its values enter the
filters as scalar subqueries, evaluated before the scans they prune.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions import display
from turnstile.functions.bands import capacity_icon, resort_status, target_icon
from turnstile.functions.money import mean, pct_change, total
from turnstile.functions.timeparts import (
    clock_dates, current_period, day_of, previous_period, to_local,
)
from turnstile.operators.lifts import last_reported_day, lift_performance, top_lifts_board

# Fixed value: weeks shown per resort.
WEEKS_SHOWN = 4

# Column titles as shown.
WEEKLY_LABELS = {
    "week_start_date": "Week Starting",
    "max_daily_unique_visitors": "Max Daily Visitors",
    "avg_daily_unique_visitors": "Avg Daily Visitors",
    "week_total_revenue": "Total Revenue",
    "avg_daily_revenue": "Avg Daily Revenue",
    "week_peak_capacity_pct": "Peak Capacity",
}
STATUS_LABELS = {
    "resort": "Resort",
    "current_visitors": "Visitors",
    "capacity_pct": "Capacity",
    "revenue": "Revenue",
    "status": "Status",
}


# Clocks

def reporting_clock(
    rides: DataFrame, passes: DataFrame, tickets: DataFrame, hourly: DataFrame
) -> DataFrame:
    """Latest event of all sources, latest reporting hour and its period bounds.

    One row; the latest event is null as long as one of the sources is empty.
    Of rides stored by ``ride_date``, only those from the last reported day on
    are searched for the latest one.
    """
    if "ride_date" in rides.columns:
        rides = rides.filter(F.col("ride_date") >= last_reported_day(hourly))
    latest = {
        "ride": rides.agg(F.max("ride_time")).scalar(),
        "pass": passes.agg(F.max("purchase_time")).scalar(),
        "ticket": tickets.agg(F.max("purchase_time")).scalar(),
    }
    clock = hourly.agg(F.max("ride_hour_timestamp").alias("latest_reporting_timestamp"))
    known = F.col("ride").isNotNull() & F.col("pass").isNotNull() & F.col("ticket").isNotNull()
    reported = F.col("latest_reporting_timestamp")
    return clock.select("*", *[value.alias(name) for name, value in latest.items()]).select(
        F.when(known, F.greatest(*latest)).alias("latest_world_timestamp"),
        reported,
        *[value.alias(name) for name, value in clock_dates(reported).items()],
    )


def period_clock(hourly: DataFrame) -> DataFrame:
    """The part of the clock period filters need; reads the hourly table only."""
    clock = hourly.agg(F.max("ride_hour_timestamp").alias("latest_reporting_timestamp"))
    dates = clock_dates(F.col("latest_reporting_timestamp"))
    return clock.select("*", *[value.alias(name) for name, value in dates.items()])


def resort_clock(hourly: DataFrame, resort: str) -> DataFrame:
    """Latest reporting hour of one resort; one row, null for an unknown resort."""
    time = F.max("ride_hour_timestamp").alias("reporting_time")
    return hourly.filter(F.col("resort") == resort).agg(time).select(
        "reporting_time",
        day_of(F.col("reporting_time")).alias("reporting_date"),
        F.hour("reporting_time").alias("reporting_hour"),
    )


def clock_line(
    rides: DataFrame, passes: DataFrame, tickets: DataFrame, hourly: DataFrame,
    capacity: DataFrame, resort: str, reference_resort: bool = False,
) -> DataFrame:
    """Reporting time and latest event on the resort's own clock, as shown.

    With ``reference_resort`` the resort only lends its time zone and the
    reporting time is the network's.
    """
    world = reporting_clock(rides, passes, tickets, hourly)
    shown = world.select(
        F.col("latest_world_timestamp").alias("latest_event"),
        F.col("latest_reporting_timestamp").alias("reporting_time"),
        timezone_of(capacity, resort).alias("time_zone"),
    )
    if not reference_resort:
        own = resort_clock(hourly, resort).select("reporting_time").scalar()
        shown = shown.withColumn("reporting_time", own)
    zone = F.col("time_zone")
    return shown.select(
        F.lit(resort).alias("resort"),
        display.clock_text(to_local(F.col("reporting_time"), zone)).alias("reporting_time"),
        display.clock_text(to_local(F.col("latest_event"), zone)).alias("latest_event"),
        zone,
    )


def timezone_of(capacity: DataFrame, resort: str) -> Column:
    """Time zone of one resort as a value, null for an unknown resort."""
    own = capacity.filter(F.col("resort") == resort)
    return own.agg(F.max("iana_timezone")).scalar()


# Network reports

def network_kpis(network: DataFrame, clock: DataFrame, period: str) -> DataFrame:
    """Totals of the running and the previous period in one pass over both."""
    day = F.col("ride_date")
    now, before = current_period(day, clock, period), previous_period(day, clock, period)
    marked = (
        network.withColumn("_now", now)
        .withColumn("_before", before)
        .filter(F.col("_now") | F.col("_before"))
    )

    def over(flag: str, name: str) -> Column:
        return F.when(F.col(flag), F.col(name))

    return marked.agg(
        F.sum(over("_now", "total_network_visitors")).alias("total_visitors"),
        total(over("_now", "total_network_revenue")).alias("total_revenue"),
        mean(over("_now", "avg_network_capacity_pct")).alias("avg_capacity"),
        F.sum(over("_now", "total_network_rides")).alias("total_rides"),
        F.sum(over("_before", "total_network_visitors")).alias("prev_visitors"),
        total(over("_before", "total_network_revenue")).alias("prev_revenue"),
        F.sum(over("_before", "total_network_rides")).alias("prev_rides"),
    )


def kpi_changes(kpis: DataFrame) -> DataFrame:
    return kpis.select(
        "*",
        pct_change(F.col("total_visitors"), F.col("prev_visitors")).alias("visitor_change_pct"),
        pct_change(F.col("total_revenue"), F.col("prev_revenue")).alias("revenue_change_pct"),
        pct_change(F.col("total_rides"), F.col("prev_rides")).alias("rides_change_pct"),
    )


def kpi_cards(kpis: DataFrame) -> DataFrame:
    """The indicators as shown: number, change, capacity with its symbol."""
    changes = kpi_changes(kpis)
    capacity = F.coalesce("avg_capacity", F.lit(0.0))
    return changes.select(
        display.thousands(F.col("total_visitors")).alias("visitors"),
        display.signed_percent(F.col("visitor_change_pct")).alias("visitors_change"),
        display.currency(F.col("total_revenue")).alias("revenue"),
        display.signed_percent(F.col("revenue_change_pct")).alias("revenue_change"),
        F.concat(display.percent(capacity), F.lit(" "), capacity_icon(capacity)).alias("capacity"),
        display.thousands(F.col("total_rides")).alias("rides"),
        display.signed_percent(F.col("rides_change_pct")).alias("rides_change"),
    )


def resort_comparison(daily: DataFrame, clock: DataFrame, period: str) -> DataFrame:
    return (
        daily.filter(current_period(F.col("ride_date"), clock, period))
        .groupBy("resort")
        .agg(
            F.sum("total_visitors").alias("total_visitors"),
            total(F.col("total_revenue")).alias("total_revenue"),
            mean(F.col("avg_capacity_pct")).alias("avg_capacity"),
            F.sum("total_rides").alias("total_rides"),
        )
        .orderBy(F.col("resort").asc_nulls_last())
    )


def time_series(daily: DataFrame, clock: DataFrame, period: str) -> DataFrame:
    return (
        daily.filter(current_period(F.col("ride_date"), clock, period))
        .select(
            "ride_date", "resort",
            F.col("total_visitors").alias("visitors"),
            F.col("total_revenue").alias("revenue"),
            F.col("avg_capacity_pct").alias("capacity_pct"),
        )
        .orderBy(F.col("ride_date").asc_nulls_last(), F.col("resort").asc_nulls_last())
    )


def status_by_resort(daily: DataFrame, clock: DataFrame, period: str) -> DataFrame:
    return (
        daily.filter(current_period(F.col("ride_date"), clock, period))
        .groupBy("resort")
        .agg(
            F.sum("total_visitors").alias("current_visitors"),
            mean(F.col("avg_capacity_pct")).alias("capacity_pct"),
            total(F.col("total_revenue")).alias("revenue"),
        )
        .withColumn("status", resort_status(F.col("capacity_pct")))
        .orderBy(F.col("capacity_pct").desc_nulls_last(), F.col("resort").asc_nulls_last())
    )


def status_table(status: DataFrame) -> DataFrame:
    """Resort status as shown, under its column titles."""
    shown = status.select(
        "resort",
        display.thousands(F.col("current_visitors")).alias("current_visitors"),
        display.percent(F.col("capacity_pct")).alias("capacity_pct"),
        display.currency(F.col("revenue")).alias("revenue"),
        "status",
    )
    return relabel(shown, STATUS_LABELS)


def capacity_table(capacity: DataFrame) -> DataFrame:
    return capacity.select(
        "resort", "max_capacity", "hourly_capacity", "base_lift_count", "iana_timezone"
    ).orderBy(F.col("resort").asc_nulls_last())


def available_resorts(daily: DataFrame) -> DataFrame:
    return daily.select("resort").distinct().orderBy(F.col("resort").asc_nulls_last())


# Resort reports

def resort_operations(hourly: DataFrame, resort: str) -> DataFrame:
    """The resort's latest hour; no row for an unknown resort."""
    clock = resort_clock(hourly, resort)
    own = hourly.filter(
        (F.col("resort") == resort)
        & (F.col("ride_date") == clock.select("reporting_date").scalar())
        & (F.col("ride_hour") == clock.select("reporting_hour").scalar())
    )
    return own.select(
        F.col("visitor_count").alias("current_visitors"),
        F.col("capacity_pct").alias("current_capacity_pct"),
        F.col("total_rides").alias("current_hour_rides"),
        F.col("total_recognized_revenue").alias("current_hour_revenue"),
        "capacity_status",
    )


def resort_top_lifts(rides: DataFrame, resort: str, **window) -> DataFrame:
    return top_lifts_board(lift_performance(rides, resort, **window))


def hourly_pattern(hourly: DataFrame, capacity: DataFrame, resort: str) -> DataFrame:
    """Hours of the resort's last reporting day (a UTC day) on its own clock."""
    today = resort_clock(hourly, resort).select("reporting_date").scalar()
    zones = capacity.select("resort", "iana_timezone")
    own = hourly.filter((F.col("resort") == resort) & (F.col("ride_date") == today))
    local = to_local(F.col("ride_hour_timestamp"), F.col("iana_timezone"))
    return (
        own.join(zones, "resort", "left")
        .select(
            F.hour(local).alias("ride_hour"),
            day_of(local).alias("ride_date"),
            "ride_hour_timestamp", "visitor_count", "capacity_pct", "total_recognized_revenue",
        )
        .orderBy(F.col("ride_hour").asc_nulls_last(), F.col("ride_hour_timestamp").asc_nulls_last())
    )


def revenue_today(performance: DataFrame, hourly: DataFrame, resort: str) -> DataFrame:
    today = resort_clock(hourly, resort).select("reporting_date").scalar()
    return performance.filter(
        (F.col("resort") == resort) & (F.col("ride_date") == today)
    ).select("total_revenue", "revenue_target_usd", "revenue_target_pct", "performance_status")


def revenue_card(today: DataFrame) -> DataFrame:
    """Revenue against target as shown."""
    reached = F.coalesce("revenue_target_pct", F.lit(0).cast("decimal(9,1)"))
    icon = target_icon(F.col("performance_status"))
    return today.select(
        display.currency(F.col("total_revenue")).alias("revenue"),
        display.currency(F.col("revenue_target_usd")).alias("target"),
        F.concat(display.percent(reached), F.lit(" "), icon).alias("achievement"),
    )


def latest_weeks(weekly: DataFrame, resort: str, weeks: int = WEEKS_SHOWN) -> DataFrame:
    return (
        weekly.filter(F.col("resort") == resort)
        .select(
            "week_start_date", "max_daily_unique_visitors", "avg_daily_unique_visitors",
            "week_total_revenue", "avg_daily_revenue", "week_peak_capacity_pct",
        )
        .orderBy(F.col("week_start_date").desc_nulls_last())
        .limit(weeks)
    )


def weeks_table(weeks: DataFrame) -> DataFrame:
    """Latest weeks as shown, under their column titles."""
    shown = weeks.select(
        F.date_format("week_start_date", display.DATE_FORMAT).alias("week_start_date"),
        *[
            display.thousands(F.col(name)).alias(name)
            for name in ("max_daily_unique_visitors", "avg_daily_unique_visitors")
        ],
        *[
            display.currency(F.col(name)).alias(name)
            for name in ("week_total_revenue", "avg_daily_revenue")
        ],
        display.percent(F.col("week_peak_capacity_pct")).alias("week_peak_capacity_pct"),
    )
    return relabel(shown, WEEKLY_LABELS)


def relabel(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Columns in the order of ``labels`` under their titles; absent ones are skipped."""
    return df.select(
        [F.col(name).alias(title) for name, title in labels.items() if name in df.columns]
    )
