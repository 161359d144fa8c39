"""The batch chain: rides and sales to visits, hours, days, weeks and views."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import schemas
from turnstile.functions.timeparts import day_of
from turnstile.operators import hourly as hours
from turnstile.operators import rollups, sketches
from turnstile.operators.visits import daily_visits
from turnstile.sources.tables import replace_partitions, scan
from turnstile.sources.versions import Snapshot

DATED_RIDE = T.StructType([*schemas.LIFT_RIDE.fields, T.StructField("ride_date", T.DateType())])


@dataclass
class Chain:
    """Base tables and, lazily, everything derived from them."""

    rides: DataFrame
    passes: DataFrame
    tickets: DataFrame
    capacity: DataFrame

    @cached_property
    def visits(self) -> DataFrame:
        return daily_visits(self.rides, self.passes, self.tickets)

    @cached_property
    def activity(self) -> DataFrame:
        return hours.hourly_activity(self.rides, self.visits)

    @cached_property
    def revenue(self) -> DataFrame:
        return hours.hourly_revenue(self.visits)

    @cached_property
    def hourly(self) -> DataFrame:
        visitors = hours.rides_per_visitor(self.rides)
        return hours.hourly_summary_of(visitors, self.visits, self.capacity)

    @cached_property
    def visitor_sketches(self) -> DataFrame:
        return sketches.hourly_sketches(hours.visitor_hours(self.rides))

    @cached_property
    def daily(self) -> DataFrame:
        return rollups.daily_summary(self.hourly)

    @cached_property
    def weekly(self) -> DataFrame:
        return rollups.weekly_summary(self.daily)

    @cached_property
    def network(self) -> DataFrame:
        return rollups.network_daily(self.daily)

    @cached_property
    def performance(self) -> DataFrame:
        return rollups.revenue_performance(self.daily, self.capacity)


class StoredChain(Chain):
    """A chain whose levels were written by ``materialize``."""

    def __init__(self, spark: SparkSession, root: str, base: Chain):
        super().__init__(base.rides, base.passes, base.tickets, base.capacity)
        self._spark, self._root = spark, root

    def _table(self, name: str, schema) -> DataFrame:
        return scan(self._spark, f"{self._root}/{name}", schema)

    @cached_property
    def visitor_hours(self) -> DataFrame:
        return self._table("visitor_hours", schemas.VISITOR_HOURS)

    @cached_property
    def visitor_sketches(self) -> DataFrame:
        return self._table("visitor_sketches", schemas.VISITOR_SKETCHES)

    @cached_property
    def visits(self) -> DataFrame:
        return self._table("daily_visits", schemas.DAILY_VISITS)

    @cached_property
    def hourly(self) -> DataFrame:
        return self._table("hourly_resort_summary", schemas.HOURLY_RESORT_SUMMARY)

    @cached_property
    def daily(self) -> DataFrame:
        return self._table("daily_resort_summary", schemas.DAILY_RESORT_SUMMARY)

    @cached_property
    def weekly(self) -> DataFrame:
        return self._table("weekly_resort_summary", schemas.WEEKLY_RESORT_SUMMARY)


class SnapshotChain(StoredChain):
    """A chain whose levels are one version of what the live refresh keeps."""

    def __init__(self, snapshot: Snapshot, base: Chain):
        rides = snapshot.scan("lift_ride", DATED_RIDE)
        super().__init__(
            snapshot.spark, snapshot.root, Chain(rides, base.passes, base.tickets, base.capacity))
        self.snapshot = snapshot

    def _table(self, name: str, schema) -> DataFrame:
        return self.snapshot.scan(name, schema)


def materialize(spark: SparkSession, base: Chain, root: str) -> StoredChain:
    """Write every level once and read it back for the next one.

    Raw rides are read once, to be stored by date, where reports and the trailing
    window find the days they need.  Visitor hours come from those rides, visits and
    activity from visitor hours.  A lost executor costs the level being written, not
    the chain.
    """
    dated = base.rides.withColumn("ride_date", day_of(F.col("ride_time")))
    replace_partitions(dated, f"{root}/lift_ride", DATED_RIDE, "ride_date")
    rides = scan(spark, f"{root}/lift_ride", DATED_RIDE)
    base = Chain(rides, base.passes, base.tickets, base.capacity)
    stored = StoredChain(spark, root, base)
    levels = [
        ("visitor_hours", schemas.VISITOR_HOURS, ["ride_date", "ride_block"],
         lambda: hours.visitor_hours(rides)),
        ("visitor_sketches", schemas.VISITOR_SKETCHES, ["ride_date", "ride_block"],
         lambda: sketches.hourly_sketches(stored.visitor_hours)),
        ("daily_visits", schemas.DAILY_VISITS, ["visit_date"],
         lambda: daily_visits(stored.visitor_hours, base.passes, base.tickets)),
        ("hourly_resort_summary", schemas.HOURLY_RESORT_SUMMARY, ["ride_date"],
         lambda: hours.hourly_summary_of(stored.visitor_hours, stored.visits, base.capacity)),
        ("daily_resort_summary", schemas.DAILY_RESORT_SUMMARY, ["ride_date"],
         lambda: rollups.daily_summary(stored.hourly)),
        ("weekly_resort_summary", schemas.WEEKLY_RESORT_SUMMARY, ["week_start_date"],
         lambda: rollups.weekly_summary(stored.daily)),
    ]
    for name, schema, partition_by, rows in levels:
        replace_partitions(rows(), f"{root}/{name}", schema, *partition_by)
    return stored
