"""Hourly activity on streams: estimated by an aggregation, or exact by keyed state."""

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnstile.functions.timeparts import hour_start, utc_clock, utc_instant

VISITOR_ERROR = 0.01


def hourly_activity_stream(rides: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Rides and (approximate) visitors per hour and resort.

    Exact distinct counts need the whole hour and are refused on streams; the
    refresh job has those.  The sketch has a standard error of ``VISITOR_ERROR`` and
    keeps the state at some kilobytes per hour and resort, however many visitors
    there are.

    In append mode an hour comes out once rides are ``lateness`` past it: later
    rides are dropped and the last hours stay open.  On a finite feed, or where all
    hours must be at hand, use complete mode, which keeps every hour and ride.
    """
    clock = utc_instant(F.col("ride_time"))
    return (
        rides.withColumn("_clock", clock)
        .withWatermark("_clock", lateness)
        .groupBy(F.window("_clock", "1 hour"), "resort")
        .agg(
            F.count(F.lit(1)).alias("total_rides"),
            F.approx_count_distinct("rfid", VISITOR_ERROR).alias("visitor_count"),
        )
        .select(
            utc_clock(F.col("window.start")).alias("ride_hour_timestamp"),
            "resort", "total_rides", "visitor_count",
        )
    )


HOUR_OF = ["ride_hour_timestamp", "resort", "rfid"]
CHANGES = "ride_hour_timestamp timestamp_ntz, resort string, rfid string, rides long, visitors long"
# How long a medium's state is kept after its first ride of the hour arrived.
KEPT = timedelta(hours=25)


def visitor_changes(rides: DataFrame, kept: timedelta = KEPT) -> DataFrame:
    """What each batch changes in the hours: a row for each ride that came, and one for each new visitor.

    Rows are corrections to be added up, so a ride may come any time later and none is
    dropped.  State is one key per medium, hour and resort, on disk, and expires
    ``kept`` after the first ride of these arrived, so it follows the arrivals of that
    time and not the history.  A medium that comes back to an hour after that is
    reported as new again, which ``exact_hours`` puts right.
    """
    keyed = rides.filter("ride_time IS NOT NULL").select(
        hour_start(F.col("ride_time")).alias("ride_hour_timestamp"), "resort", "rfid")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # The clock is the arrival, so no ride is behind it.  A key leaves once the watermark, which is
    # one delay behind the clock, has passed its arrival by another.
    delay = f"{int(kept / timedelta(microseconds=2))} microseconds"
    visitors = (
        keyed.filter("rfid IS NOT NULL")
        .withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", delay)
        .dropDuplicatesWithinWatermark(HOUR_OF)
    )
    return keyed.select(*HOUR_OF, one.alias("rides"), none.alias("visitors")).unionByName(
        visitors.select(*HOUR_OF, none.alias("rides"), one.alias("visitors")))


def start_changes(
    rides: DataFrame, table: str, checkpoint: str, trigger: dict, kept: timedelta = KEPT,
) -> StreamingQuery:
    """Write the changes of a feed of rides to ``table``."""
    return (
        visitor_changes(rides, kept).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**trigger).start(table)
    )


def stored_changes(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(CHANGES).parquet(table)


def live_hours(changes: DataFrame) -> DataFrame:
    """Hours as the changes add up, right away; media that came back late count twice."""
    return changes.groupBy("ride_hour_timestamp", "resort").agg(
        F.sum("rides").alias("total_rides"), F.sum("visitors").alias("visitor_count"))


def exact_hours(changes: DataFrame) -> DataFrame:
    """Hours with every visitor counted once, however late a ride came.

    A medium's changes are put together before it counts.  They hold three columns of each
    ride, and are summed per task before the shuffle.
    """
    media = changes.groupBy(*HOUR_OF).agg(F.sum("rides").alias("rides"))
    return media.groupBy("ride_hour_timestamp", "resort").agg(
        F.sum("rides").alias("total_rides"), F.count("rfid").alias("visitor_count"))
