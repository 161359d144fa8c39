"""Lift performance as a function SQL can call."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from turnstile import schemas
from turnstile.operators.lifts import WINDOW_MINUTES, lift_performance

FUNCTION = "resort_lift_performance"


def resort_lift_performance(
    spark: SparkSession, resort: str, minutes: int = WINDOW_MINUTES, view: str = "lift_ride",
    as_of: datetime | None = None, hourly: str | None = None,
) -> DataFrame:
    """The procedure as a Python call on registered views.

    With the ``hourly`` view and rides that carry ``ride_date`` only the last days
    are read.
    """
    reported = None if hourly is None else spark.table(hourly)
    return lift_performance(spark.table(view), resort, minutes, as_of, reported)


def register_lift_function(
    spark: SparkSession, view: str = "lift_ride", name: str = FUNCTION, dated: bool = False
) -> None:
    """``SELECT * FROM resort_lift_performance('…', 30, as_of, first day)``, composable in SQL.

    Arguments cannot be used inside a nested subquery, so the resort's last ride
    comes from a join with one row per resort asked for, that is one; it is
    broadcast, so that no ride is shuffled by resort.  Where rides are stored by
    ``ride_date`` (``dated``), a first day spares the days before it.
    """
    returns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.LIFT_PERFORMANCE)
    since = "AND ride_date >= coalesce(in_first_day, DATE '0001-01-01')" if dated else ""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(
            in_resort STRING, in_minutes INT DEFAULT {WINDOW_MINUTES},
            in_as_of TIMESTAMP_NTZ DEFAULT NULL, in_first_day DATE DEFAULT NULL)
        RETURNS TABLE ({returns})
        RETURN
        WITH own AS (
            SELECT resort, lift, rfid, ride_time FROM {view}
            WHERE resort = in_resort AND ride_time <= coalesce(in_as_of, ride_time) {since}),
        ends AS (
            SELECT resort AS ended, coalesce(in_as_of, max(ride_time)) AS last_ride_time
            FROM own GROUP BY resort),
        recent AS (
            SELECT /*+ BROADCAST(ends) */ resort, lift, rfid, ride_time
            FROM own JOIN ends ON resort = ended
            WHERE ride_time > last_ride_time - make_dt_interval(0, 0, in_minutes)),
        lifts AS (
            SELECT resort, lift, count(*) AS rides, count(DISTINCT rfid) AS unique_visitors,
                   min(ride_time) AS first_activity_time, max(ride_time) AS last_activity_time
            FROM recent GROUP BY resort, lift),
        spans AS (
            SELECT *, datediff(last_activity_time, first_activity_time) * 1440L
                   + (hour(last_activity_time) - hour(first_activity_time)) * 60
                   + minute(last_activity_time) - minute(first_activity_time) AS span,
                   row_number() OVER (
                       PARTITION BY resort ORDER BY rides DESC NULLS LAST, lift NULLS LAST) AS place
            FROM lifts)
        SELECT resort, lift, rides, unique_visitors, first_activity_time, last_activity_time,
               place, place,
               CASE WHEN span > 0
                    THEN CAST(CAST((rides * 1200 + span) DIV (span * 2) AS DECIMAL(20, 0)) / 10
                              AS DOUBLE) END
        FROM spans
    """)
