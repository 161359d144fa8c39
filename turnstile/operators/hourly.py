"""Hourly tables: activity, amortised revenue and the summary joining both.

Visits must hold one row per ``(visit_date, resort, rfid)``, as
``daily_visits`` produces them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile import schemas
from turnstile.functions.bands import capacity_status
from turnstile.functions.money import pass_share, rounded_ratio, ticket_share, total
from turnstile.functions.timeparts import day_of

HOUR_KEY = ["ride_date", "ride_hour", "resort"]
VISITOR_KEY = [*HOUR_KEY, "rfid"]
# Hours of one stored partition: few enough to recompute often, many enough to
# keep the number of folders low.
BLOCK_HOURS = 6
_FIRST = ["ride_time", "txid", "lift", "activation_day_count"]

# Fixed value: uses over which a pass price is recognised.
PASS_USES = 20


def rides_per_visitor(rides: DataFrame) -> DataFrame:
    """Rides per medium and hour.

    The count runs partly before the shuffle.  Afterwards a medium has at most
    24 rows per resort and day, however many rides it made, so nothing
    downstream can be skewed by one medium.
    """
    return _by_visitor(rides).agg(F.count(F.lit(1)).alias("rides"))


def visitor_hours(rides: DataFrame) -> DataFrame:
    """One row per medium and hour: its earliest ride there and the ride count.

    These rows replace the rides for everything downstream: the earliest of
    the hourly firsts is the first ride of the day, and the counts add up.
    Raw rides are read once for visits and activity together.
    """
    first = F.min(F.struct(*_FIRST)).alias("first")
    out = _by_visitor(rides).agg(F.count(F.lit(1)).alias("rides"), first)
    return out.select(
        *VISITOR_KEY, "rides", *[F.col(f"first.{name}") for name in _FIRST],
        block_of(F.col("ride_hour")).alias("ride_block"),
    )


def merge_visitor_hours(known: DataFrame, added: DataFrame) -> DataFrame:
    """Visitor hours of all rides from those of two parts of them.

    Counts add up and the earlier of two first rides is the first, in whatever order
    parts are merged, as long as no ride is in two of them.
    """
    first = F.min(F.struct(*_FIRST)).alias("first")
    rows = known.unionByName(added).groupBy(*VISITOR_KEY, "ride_block").agg(F.sum("rides").alias("rides"), first)
    return rows.select(*VISITOR_KEY, "rides", *[F.col(f"first.{name}") for name in _FIRST], "ride_block")


def block_of(hour: Column) -> Column:
    """Part of the day an hour lies in; stored rows are partitioned by it."""
    return F.floor(hour / BLOCK_HOURS).cast("int")


def _by_visitor(rides: DataFrame):
    time = F.col("ride_time")
    return rides.groupBy(
        day_of(time).alias("ride_date"), F.hour(time).alias("ride_hour"), "resort", "rfid"
    )


def with_pass_flag(visitor_hours: DataFrame, visits: DataFrame) -> DataFrame:
    """Visitor hours with the pass flag of their visit; unknown visits have none."""
    flags = visits.select(
        F.col("visit_date").alias("ride_date"), "resort", "rfid", "has_season_pass"
    )
    return visitor_hours.join(flags, ["ride_date", "resort", "rfid"], "left")


def hourly_activity(rides: DataFrame, visits: DataFrame) -> DataFrame:
    """Rides, distinct visitors, distinct pass holders and pass rides per hour.

    Visitors are distinct already, so the distinct counts become plain counts
    that combine before the shuffle, without expanding the rows.
    """
    rows = with_pass_flag(rides_per_visitor(rides), visits)
    out = rows.groupBy(*HOUR_KEY).agg(*_activity())
    return schemas.conform(_with_hour_start(out), schemas.HOURLY_LIFT_ACTIVITY)


def _activity() -> list[Column]:
    on_pass = F.col("has_season_pass")
    return [
        F.sum("rides").alias("total_rides"),
        F.count("rfid").alias("visitor_count"),
        F.count(F.when(on_pass, F.col("rfid"))).alias("active_passes"),
        F.sum(F.when(on_pass, F.col("rides")).otherwise(0)).alias("pass_rides"),
    ]


def hourly_revenue(visits: DataFrame, pass_uses: int = PASS_USES) -> DataFrame:
    """Revenue recognised in the hour of a visit's first ride.

    A ticket earns its price per day of validity on every visit; a pass earns
    an equal share on each of its first ``pass_uses`` uses.
    """
    out = visits.groupBy(
        F.col("visit_date").alias("ride_date"),
        F.hour("first_ride_time").alias("ride_hour"),
        "resort",
    ).agg(*_recognised(pass_uses, F.lit(True)))
    return schemas.conform(_with_hour_start(out), schemas.HOURLY_AMORTIZED_REVENUE)


def _recognised(pass_uses: int, arriving: Column) -> list[Column]:
    """Revenue and activations over the rows of arriving visitors."""
    on_pass, price = F.col("has_season_pass"), F.col("purchase_price_usd")
    ticket = F.when(~on_pass, ticket_share(price, F.col("ticket_original_duration"))).otherwise(0)
    share = F.when(
        on_pass & (F.col("activation_usage_count") <= pass_uses), pass_share(price, pass_uses)
    ).otherwise(0)
    return [
        total(F.when(arriving, ticket)).alias("recognized_ticket_revenue"),
        F.count(F.when(arriving & ~on_pass, F.col("rfid"))).alias("ticket_activations"),
        total(F.when(arriving, share)).alias("recognized_pass_revenue"),
        F.count(F.when(arriving & on_pass, F.col("rfid"))).alias("pass_activations"),
    ]


def with_revenue(activity: DataFrame, revenue: DataFrame) -> DataFrame:
    """Activity hours with their revenue; hours without a first ride have none."""
    return activity.join(revenue.drop("ride_hour_timestamp"), HOUR_KEY, "left")


def with_capacity(df: DataFrame, capacity: DataFrame) -> DataFrame:
    """Rows of resorts that have a capacity; rows of other resorts drop out."""
    return df.join(capacity, "resort", "inner")


def hourly_summary(activity: DataFrame, revenue: DataFrame, capacity: DataFrame) -> DataFrame:
    return _summary(with_revenue(activity, revenue), capacity)


def hourly_summary_of(
    visitor_hours: DataFrame, visits: DataFrame, capacity: DataFrame, pass_uses: int = PASS_USES
) -> DataFrame:
    """The hourly summary in one join and one aggregation.

    Equal to ``hourly_summary(hourly_activity, hourly_revenue)`` as every
    first ride is a ride: each visitor hour meets its visit once, counts for
    the activity, and carries the revenue in the hour the visitor arrived.
    Hours nobody arrived in have no activation counts, as with the join.
    """
    entered = visits.select(
        F.col("visit_date").alias("ride_date"), "resort", F.col("rfid").alias("visit_rfid"),
        "has_season_pass", "purchase_price_usd", "activation_usage_count",
        "ticket_original_duration", F.hour("first_ride_time").alias("arrival_hour"),
    )
    same = [
        visitor_hours["ride_date"] == entered["ride_date"],
        visitor_hours["resort"] == entered["resort"],
        visitor_hours["rfid"].eqNullSafe(entered["visit_rfid"]),
    ]
    rows = visitor_hours.join(entered, same, "left").drop(entered["ride_date"], entered["resort"])
    arriving = F.col("ride_hour") == F.col("arrival_hour")
    out = rows.groupBy(*HOUR_KEY).agg(
        *_activity(), *_recognised(pass_uses, arriving), F.count_if(arriving).alias("arrived")
    )
    activations = {
        name: F.when(F.col("arrived") > 0, F.col(name))
        for name in ("ticket_activations", "pass_activations")
    }
    return _summary(_with_hour_start(out).withColumns(activations), capacity)


def _summary(rows: DataFrame, capacity: DataFrame) -> DataFrame:
    rows = with_capacity(rows, capacity.select("resort", "max_capacity"))
    ticket = F.coalesce("recognized_ticket_revenue", F.lit(0))
    share = F.coalesce("recognized_pass_revenue", F.lit(0))
    visitors, most = F.col("visitor_count"), F.col("max_capacity")
    return schemas.conform(
        rows,
        schemas.HOURLY_RESORT_SUMMARY,
        active_tickets=visitors - F.col("active_passes"),
        ticket_rides=F.col("total_rides") - F.col("pass_rides"),
        recognized_ticket_revenue=ticket,
        recognized_pass_revenue=share,
        total_recognized_revenue=ticket + share,
        capacity_pct=rounded_ratio(visitors * 100, most, 1),
        capacity_status=capacity_status(visitors, most),
    )


def _with_hour_start(df: DataFrame) -> DataFrame:
    start = F.col("ride_date").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.col("ride_hour")
    )
    return df.withColumn("ride_hour_timestamp", start)
