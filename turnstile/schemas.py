"""Declared schemas of every stored table; nothing is ever inferred.

Event times are ``timestamp_ntz`` holding the UTC wall clock, so no result
depends on the session time zone.  Money is decimal throughout.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

PRICE = T.DecimalType(7, 2)
REVENUE = T.DecimalType(28, 8)
PERCENT = T.DecimalType(9, 1)

_STR, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_DATE, _TIME, _BOOL = T.DateType(), T.TimestampNTZType(), T.BooleanType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ADDRESS = _table(street_address=_STR, city=_STR, state=_STR, postalcode=_STR)
CONTACT = _table(name=_STR, phone=_STR)

LIFT_RIDE = _table(
    txid=_STR, rfid=_STR, resort=_STR, lift=_STR, ride_time=_TIME, activation_day_count=_INT
)
RESORT_TICKET = _table(
    txid=_STR, rfid=_STR, resort=_STR, purchase_time=_TIME, price_usd=PRICE,
    expiration_time=_DATE, days=_INT, name=_STR, address=ADDRESS, phone=_STR,
    email=_STR, emergency_contact=CONTACT,
)
SEASON_PASS = _table(
    txid=_STR, rfid=_STR, purchase_time=_TIME, price_usd=PRICE, expiration_time=_DATE,
    name=_STR, address=ADDRESS, phone=_STR, email=_STR, emergency_contact=CONTACT,
)
RESORT_CAPACITY = _table(
    resort=_STR, max_capacity=_INT, hourly_capacity=_INT, base_lift_count=_INT, iana_timezone=_STR
)
PRICE_PROFILE = _table(resort=_STR, ticket_base_price=_INT, weekend_multiplier=T.DecimalType(4, 2))

DAILY_VISITS = _table(
    visit_date=_DATE, resort=_STR, rfid=_STR, name=_STR, first_ride_time=_TIME,
    first_lift=_STR, has_season_pass=_BOOL, purchase_price_usd=PRICE,
    activation_usage_count=_INT, ticket_original_duration=_INT,
)
VISITOR_HOURS = _table(
    ride_date=_DATE, ride_block=_INT, ride_hour=_INT, resort=_STR, rfid=_STR, rides=_LONG,
    ride_time=_TIME, txid=_STR, lift=_STR, activation_day_count=_INT,
)
VISITOR_SKETCHES = _table(
    ride_date=_DATE, ride_block=_INT, ride_hour=_INT, resort=_STR, visitors=T.BinaryType(),
)
HOURLY_LIFT_ACTIVITY = _table(
    ride_date=_DATE, ride_hour=_INT, ride_hour_timestamp=_TIME, resort=_STR,
    total_rides=_LONG, visitor_count=_LONG, active_passes=_LONG, pass_rides=_LONG,
)
HOURLY_AMORTIZED_REVENUE = _table(
    ride_date=_DATE, ride_hour=_INT, ride_hour_timestamp=_TIME, resort=_STR,
    recognized_ticket_revenue=REVENUE, ticket_activations=_LONG,
    recognized_pass_revenue=REVENUE, pass_activations=_LONG,
)
HOURLY_RESORT_SUMMARY = _table(
    ride_date=_DATE, ride_hour=_INT, ride_hour_timestamp=_TIME, resort=_STR,
    visitor_count=_LONG, total_rides=_LONG, ticket_activations=_LONG, pass_activations=_LONG,
    active_passes=_LONG, pass_rides=_LONG, active_tickets=_LONG, ticket_rides=_LONG,
    recognized_ticket_revenue=REVENUE, recognized_pass_revenue=REVENUE,
    total_recognized_revenue=REVENUE, capacity_pct=PERCENT, capacity_status=_STR,
)
DAILY_RESORT_SUMMARY = _table(
    ride_date=_DATE, resort=_STR, peak_hourly_visitors=_LONG, total_visitor_hours=_LONG,
    total_rides=_LONG, total_ticket_revenue=REVENUE, total_pass_revenue=REVENUE,
    total_revenue=REVENUE, total_ticket_activations=_LONG, total_pass_activations=_LONG,
    total_pass_rides=_LONG, total_ticket_rides=_LONG, avg_capacity_pct=PERCENT,
    peak_capacity_pct=PERCENT, operation_hours=_LONG, total_visitors=_LONG,
)
WEEKLY_RESORT_SUMMARY = _table(
    week_start_date=_DATE, resort=_STR, max_daily_unique_visitors=_LONG,
    avg_daily_unique_visitors=_LONG, week_total_visitors=_LONG, week_total_rides=_LONG,
    week_total_pass_rides=_LONG, week_total_ticket_rides=_LONG,
    week_total_ticket_revenue=REVENUE, week_total_pass_revenue=REVENUE,
    week_total_revenue=REVENUE, avg_daily_revenue=T.DecimalType(28, 0),
    week_total_ticket_activations=_LONG, week_total_pass_activations=_LONG,
    avg_week_capacity_pct=PERCENT, week_peak_capacity_pct=PERCENT, operation_days=_LONG,
)
DAILY_REVENUE_PERFORMANCE = _table(
    ride_date=_DATE, resort=_STR, total_revenue=REVENUE, revenue_target_usd=T.DecimalType(18, 2),
    revenue_target_pct=PERCENT, performance_status=_STR,
)
DAILY_NETWORK_METRICS = _table(
    ride_date=_DATE, total_network_visitors=_LONG, total_network_revenue=REVENUE,
    avg_network_capacity_pct=PERCENT, total_network_rides=_LONG, active_resorts=_LONG,
)
LIFT_PERFORMANCE = _table(
    resort=_STR, lift=_STR, rides=_LONG, unique_visitors=_LONG, first_activity_time=_TIME,
    last_activity_time=_TIME, usage_rank_in_resort=_INT, overall_usage_rank=_INT,
    rides_per_hour=T.DoubleType(),
)
REFRESH_HISTORY = _table(
    target=_STR, partitions=_INT, row_count=_LONG, input_rows=_LONG,
    refresh_start_time=_TIME, refresh_end_time=_TIME,
)


def conform(df: DataFrame, schema: T.StructType, **overrides: Column) -> DataFrame:
    """Match columns to ``schema`` by name: its order, its types, extra columns dropped."""
    if overrides:
        df = df.withColumns(overrides)
    return df.selectExpr(
        *[f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema]
    )
