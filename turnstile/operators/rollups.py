"""Daily, weekly and network tables, each computed from the level below it."""

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile import schemas
from turnstile.functions.bands import target_status
from turnstile.functions.money import rounded_mean, total
from turnstile.functions.timeparts import week_start

# A day's revenue target is this share of capacity at this spend.
TARGET_SHARE = "0.7"
TARGET_SPEND = 100


# Daily columns and the hourly columns they add up; names and order are fixed by the tables' contract.
DAILY_SUMS = {
    "total_visitor_hours": "visitor_count",
    "total_rides": "total_rides",
    "total_pass_rides": "pass_rides",
    "total_ticket_rides": "ticket_rides",
    "total_ticket_revenue": "recognized_ticket_revenue",
    "total_pass_revenue": "recognized_pass_revenue",
    "total_revenue": "total_recognized_revenue",
    "total_ticket_activations": "ticket_activations",
    "total_pass_activations": "pass_activations",
}
# Daily columns a week adds up, under the same name with a prefix.
WEEKLY_SUMS = [name for name in (*DAILY_SUMS, "total_visitors") if name != "total_visitor_hours"]


def daily_summary(hourly: DataFrame) -> DataFrame:
    """``total_visitor_hours`` adds hourly visitors up, so a person counts once
    per hour; ``total_visitors`` counts first rides and is null when no hour
    of the day has any."""
    out = hourly.groupBy("ride_date", "resort").agg(
        *[F.sum(source).alias(name) for name, source in DAILY_SUMS.items()],
        F.count(F.lit(1)).alias("operation_hours"),
        F.max("visitor_count").alias("peak_hourly_visitors"),
        F.max("capacity_pct").alias("peak_capacity_pct"),
        rounded_mean(F.col("capacity_pct"), 1, scale=1).alias("avg_capacity_pct"),
    )
    visitors = F.col("total_ticket_activations") + F.col("total_pass_activations")
    return schemas.conform(out, schemas.DAILY_RESORT_SUMMARY, total_visitors=visitors)


def weekly_summary(daily: DataFrame) -> DataFrame:
    """Weeks start on Monday.  Capacity averages the daily averages, unweighted."""
    visitors, revenue = F.col("total_visitors"), F.col("total_revenue")
    days = F.count(revenue).cast("decimal(10,0)")
    out = daily.groupBy(week_start(F.col("ride_date")).alias("week_start_date"), "resort").agg(
        *[F.sum(name).alias(f"week_{name}") for name in WEEKLY_SUMS],
        F.count_distinct("ride_date").alias("operation_days"),
        F.max(visitors).alias("max_daily_unique_visitors"),
        rounded_mean(visitors, 0).alias("avg_daily_unique_visitors"),
        F.round(total(revenue) / days, 0).alias("avg_daily_revenue"),
        F.max("peak_capacity_pct").alias("week_peak_capacity_pct"),
        rounded_mean(F.col("avg_capacity_pct"), 1, scale=1).alias("avg_week_capacity_pct"),
    )
    return schemas.conform(out, schemas.WEEKLY_RESORT_SUMMARY)


WEEKLY_SQL = """
SELECT
    trunc(ride_date, 'week') AS week_start_date,
    resort,
    max(total_visitors) AS max_daily_unique_visitors,
    CAST(round(avg(total_visitors)) AS bigint) AS avg_daily_unique_visitors,
    sum(total_visitors) AS week_total_visitors,
    sum(total_rides) AS week_total_rides,
    sum(total_pass_rides) AS week_total_pass_rides,
    sum(total_ticket_rides) AS week_total_ticket_rides,
    CAST(sum(total_ticket_revenue) AS decimal(28, 8)) AS week_total_ticket_revenue,
    CAST(sum(total_pass_revenue) AS decimal(28, 8)) AS week_total_pass_revenue,
    CAST(sum(total_revenue) AS decimal(28, 8)) AS week_total_revenue,
    CAST(round(avg(total_revenue)) AS decimal(28, 0)) AS avg_daily_revenue,
    sum(total_ticket_activations) AS week_total_ticket_activations,
    sum(total_pass_activations) AS week_total_pass_activations,
    CAST(round(avg(avg_capacity_pct), 1) AS decimal(9, 1)) AS avg_week_capacity_pct,
    max(peak_capacity_pct) AS week_peak_capacity_pct,
    count(DISTINCT ride_date) AS operation_days
FROM {view}
GROUP BY trunc(ride_date, 'week'), resort
"""


def weekly_summary_sql(view: str = "daily_resort_summary") -> str:
    """The weekly table as SQL text over a published view, for SQL-only users."""
    return WEEKLY_SQL.format(view=view)


def revenue_performance(
    daily: DataFrame, capacity: DataFrame, share: str = TARGET_SHARE, spend: int = TARGET_SPEND
) -> DataFrame:
    """Each day's revenue against the resort's target; null percent without a target."""
    full_house = F.col("max_capacity").cast("decimal(10,0)") * F.lit(Decimal(share))
    targets = capacity.select(
        "resort", (full_house * F.lit(spend)).cast("decimal(18,2)").alias("revenue_target_usd")
    )
    revenue, target = F.col("total_revenue"), F.col("revenue_target_usd")
    reached = F.when(target > 0, F.round(revenue * 100 / target, 1))
    return schemas.conform(
        daily.join(targets, "resort", "inner"),
        schemas.DAILY_REVENUE_PERFORMANCE,
        revenue_target_pct=reached,
        performance_status=target_status(revenue, target),
    )


def network_daily(daily: DataFrame) -> DataFrame:
    """One row per day over all resorts; a person at two resorts counts twice."""
    out = daily.groupBy("ride_date").agg(
        F.sum("total_visitors").alias("total_network_visitors"),
        total(F.col("total_revenue")).alias("total_network_revenue"),
        rounded_mean(F.col("avg_capacity_pct"), 1, scale=1).alias("avg_network_capacity_pct"),
        F.sum("total_rides").alias("total_network_rides"),
        F.count_distinct("resort").alias("active_resorts"),
    )
    return schemas.conform(out, schemas.DAILY_NETWORK_METRICS)
