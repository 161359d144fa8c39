"""Incremental maintenance: each micro-batch refreshes what its rides touch.

A batch becomes one version of all tables (``sources.versions``): readers see all of
it or nothing, and a batch that is delivered again after it was published is known
by its number.  What a batch costs follows its own rides and the days it touches:

* rides are new unless the key filter of their part of the day suspects them, and only
  then are stored rides of that part looked up; with distinct rides none are read,
* visitor hours are merged with those of the new rides, so no earlier ride is read,
* visits and hourly figures are recomputed for the touched days from one row
  per visitor and hour,
* weeks are recomputed from the stored days.
"""

from collections.abc import Callable, Collection
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date, timedelta
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from turnstile import schemas
from turnstile.functions.timeparts import day_of
from turnstile.operators import hourly as hours
from turnstile.operators import keyfilter, rollups, sketches
from turnstile.operators.visits import daily_visits, enrich_again, reenrich
from turnstile.plans.chain import DATED_RIDE, Chain, SnapshotChain
from turnstile.sources import versions
from turnstile.sources.versions import Change, Snapshot, snapshot
from turnstile.streaming.history import RefreshLog

EARLIEST, FIRST_WRITER = "earliest", "first_writer"
EVERY_MINUTE = {"processingTime": "1 minute"}
# Suspected rides up to which their ids are pushed down to the files.
LOOKED_UP = 1000
# Suspected rides up to which they are sent to the stored ones, and not these shuffled.
SENT = 50_000
# Folders by medium of the index of visit days.
BUCKETS = 16

_PART = ["ride_date", "ride_block"]
_STORED_RIDE = T.StructType([*DATED_RIDE.fields, T.StructField("ride_block", T.IntegerType())])
_KEYS = T.StructType([
    T.StructField("ride_date", T.DateType()), T.StructField("ride_block", T.IntegerType()),
    T.StructField("word", T.LongType()), T.StructField("bits", T.LongType()),
])
_SIZES = "ride_date date, ride_block int, words long"
_VISIT_DAY = T.StructType([
    T.StructField("rfid", T.StringType()), T.StructField("visit_date", T.DateType()),
    T.StructField("bucket", T.IntegerType()),
])
# Lets readers of single ids skip what cannot hold them.
_BLOOM = {"parquet.bloom.filter.enabled#txid": "true"}

# A part of a day: date and block.
Part = tuple[date, int]


@dataclass
class RefreshJob:
    """Keeps the tables below ``root`` equal to the batch chain over all rides so far.

    ``policy`` decides a visit whose earliest ride arrives late: ``earliest``
    corrects the recorded visit, ``first_writer`` keeps what was recorded
    first, with the sale known at that time.

    ``passes`` and ``tickets`` are called per batch, so new sales are seen; for visits
    recorded before their sale, start the sales feed, too.
    """

    spark: SparkSession
    rides: DataFrame
    passes: Callable[[], DataFrame]
    tickets: Callable[[], DataFrame]
    capacity: DataFrame
    root: str
    checkpoint: str
    policy: str = EARLIEST
    query: StreamingQuery | None = field(default=None, init=False)
    _one_at_a_time: RLock = field(default_factory=RLock, init=False, repr=False)

    def __post_init__(self):
        if self.policy not in (EARLIEST, FIRST_WRITER):
            raise ValueError(f"unknown policy {self.policy!r}")

    # Running the job

    def start(self, trigger: dict = EVERY_MINUTE) -> StreamingQuery:
        """Start or resume; batches follow each other and never overlap."""
        self.query = (
            self.rides.writeStream.foreachBatch(self.refresh)
            .option("checkpointLocation", self.checkpoint)
            .trigger(**trigger)
            .start()
        )
        return self.query

    def start_sales(self, sales: DataFrame, checkpoint: str, trigger: dict = EVERY_MINUTE) -> StreamingQuery:
        """Follow a feed of sales (rows with ``rfid``) and correct the visits they came too late for."""
        return (
            sales.select("rfid").writeStream.foreachBatch(self.refresh_sales)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )

    def pause(self) -> None:
        """Stop after the current step; ``start`` continues from the checkpoint."""
        if self.query is not None:
            self.query.stop()

    def describe(self) -> dict:
        if self.query is None:
            return {"state": "new"}
        last = self.query.lastProgress
        return {
            "state": "running" if self.query.isActive else "stopped",
            "message": self.query.status["message"],
            "last_batch": last["batchId"] if last else None,
            "last_input_rows": last["numInputRows"] if last else None,
        }

    # One batch

    def refresh(self, batch: DataFrame, batch_id: int) -> None:
        with self._one_at_a_time:
            change = self._change("batches", batch_id)
            if change is None:
                return
            time = F.col("ride_time")
            rows = batch.select(
                *schemas.LIFT_RIDE.names,
                day_of(time).alias("ride_date"), hours.block_of(F.hour(time)).alias("ride_block"),
            ).persist()
            try:
                # Bounded by the calendar: one row per part of a day that has new rides.
                parts = rows.groupBy(*_PART).count().collect()
                if not parts:
                    return
                # Rides without a time are kept, but belong to no hour.
                touched = {(part.ride_date, part.ride_block): part["count"] for part in parts
                           if part.ride_date is not None}
                log = RefreshLog(self.spark, self._path("refresh_history"), batch_id,
                                 input_rows=sum(part["count"] for part in parts))
                log.step("lift_ride", len(parts), lambda: change.append(
                    "lift_ride", self._unknown(rows, touched, change), _STORED_RIDE, *_PART, options=_BLOOM))
            finally:
                rows.unpersist()
            if touched:
                self._refresh_days(touched, change, log)
            # Before publication, so that a batch that breaks off here writes it again.
            log.save()
            change.publish()

    def _change(self, feed: str, batch_id: int) -> Change | None:
        """The next version, or None if this batch of this feed has been published."""
        current = snapshot(self.spark, self.root)
        query = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or feed
        done = current.marks.get("batches", {})
        if done.get(query, -1) >= batch_id:
            return None
        change = Change(current)
        change.marks["batches"] = {**done, query: batch_id}
        return change

    def _unknown(self, rows: DataFrame, touched: dict[Part, int], base: Snapshot) -> DataFrame:
        """Rides a feed has not delivered before, in this batch or an earlier one, however
        long ago: a ride delivered again has its time again and so meets the first one
        in the same part of a day.  Rides without a ``txid`` cannot be told apart and stay."""
        rows = _once(rows, "txid")
        sizes = base.marks.get("keys", {})
        known = [part for part in touched if _name(part) in sizes]
        if not known:
            return rows
        asked = keyfilter.suspected(
            rows, "txid", _PART, self._scan_parts(base, "ride_keys", _KEYS, known),
            self._sizes({part: sizes[_name(part)][0] for part in known})).persist()
        try:
            suspects = asked.filter("suspected")
            parts = [tuple(row) for row in suspects.select(*_PART).distinct().collect()]
            if not parts:
                return rows
            key = [*_PART, "txid"]
            stored = self._scan_parts(base, "lift_ride", _STORED_RIDE, parts).select(*key)
            few = suspects.select(*key).limit(SENT + 1).collect()
            if len(few) <= SENT:
                if len(few) <= LOOKED_UP:
                    stored = stored.filter(F.col("txid").isin([row.txid for row in few]))
                sent = self.spark.createDataFrame(few, stored.schema)
                stored = F.broadcast(stored.join(F.broadcast(sent), key, "left_semi").distinct())
            return rows.join(stored, key, "left_anti").select(rows.columns)
        finally:
            asked.unpersist()

    def _refresh_days(self, touched: dict[Part, int], change: Change, log: RefreshLog) -> None:
        added = change.added("lift_ride", _STORED_RIDE).filter("ride_date IS NOT NULL")
        dates = sorted({day for day, _ in touched})
        # Tables that no other level reads are written beside those that follow each other.
        with ThreadPoolExecutor(max_workers=3) as aside:
            keys = aside.submit(self._refresh_keys, touched, added, change)
            days = aside.submit(change.append, "visit_days", _visit_days(added), _VISIT_DAY, "bucket")
            self._refresh_blocks(list(touched), added, change, log)
            merged = self._scan_parts(change, "visitor_hours", schemas.VISITOR_HOURS, touched)
            unions = aside.submit(
                change.replace, "visitor_sketches", sketches.hourly_sketches(merged), schemas.VISITOR_SKETCHES,
                *_PART, replaced=list(touched))
            self._refresh_visits(added, dates, change, log)
            self._refresh_summaries(dates, change, log)
            for task in (keys, days, unions):
                task.result()

    def _refresh_keys(self, touched: dict[Part, int], added: DataFrame, change: Change) -> None:
        """Put the new rides into the filters of their parts; a filter that gets full is built
        anew with more room, so that each ride is read for that a bounded number of times."""
        sizes = dict(change.marks.get("keys", {}))
        grown, merged = {}, {}
        for part, more in touched.items():
            words, keys = sizes.get(_name(part), (0, 0))
            keys += more
            if keys > keyfilter.room(words):
                # The first filter of a part is as large as its first batch.
                words = keyfilter.words_for(keys * keyfilter.GROWTH if words else keys)
                grown[part] = words
            else:
                merged[part] = words
            sizes[_name(part)] = [words, keys]
        rows = []
        if grown:
            rides = self._scan_parts(change, "lift_ride", _STORED_RIDE, list(grown))
            rows.append(keyfilter.filter_rows(rides, "txid", _PART, self._sizes(grown)))
        if merged:
            rows += [self._scan_parts(change, "ride_keys", _KEYS, list(merged)),
                     keyfilter.filter_rows(added, "txid", _PART, self._sizes(merged))]
        whole = rows[0]
        for more in rows[1:]:
            whole = whole.unionByName(more)
        change.replace("ride_keys", keyfilter.merged(whole, _PART), _KEYS, *_PART, replaced=list(touched))
        change.marks["keys"] = sizes

    def _refresh_blocks(self, touched: list[Part], added: DataFrame, change: Change, log: RefreshLog) -> None:
        known = self._scan_parts(change, "visitor_hours", schemas.VISITOR_HOURS, touched)
        rows = hours.merge_visitor_hours(known, hours.visitor_hours(added))
        log.step("visitor_hours", len(touched), lambda: change.replace(
            "visitor_hours", rows, schemas.VISITOR_HOURS, *_PART, replaced=touched))

    def _refresh_visits(self, added: DataFrame, dates: list[date], change: Change, log: RefreshLog) -> None:
        passes, tickets = self.passes(), self.tickets()
        if self.policy == EARLIEST:
            rows = daily_visits(self._dated(change, "visitor_hours", schemas.VISITOR_HOURS, dates), passes, tickets)
            log.step("daily_visits", len(dates), lambda: change.replace(
                "daily_visits", rows, schemas.DAILY_VISITS, "visit_date", replaced=_each(dates)))
        else:
            rows = daily_visits(added, passes, tickets, self.visits(dates, change))
            log.step("daily_visits", len(dates), lambda: change.append(
                "daily_visits", rows, schemas.DAILY_VISITS, "visit_date"))

    def _refresh_summaries(self, dates: list[date], change: Change, log: RefreshLog) -> None:
        hourly = hours.hourly_summary_of(
            self._dated(change, "visitor_hours", schemas.VISITOR_HOURS, dates),
            self.visits(dates, change), self.capacity)
        log.step("hourly_resort_summary", len(dates), lambda: change.replace(
            "hourly_resort_summary", hourly, schemas.HOURLY_RESORT_SUMMARY, "ride_date",
            replaced=_each(dates)))
        stored = self._dated(change, "hourly_resort_summary", schemas.HOURLY_RESORT_SUMMARY, dates)
        log.step("daily_resort_summary", len(dates), lambda: change.replace(
            "daily_resort_summary", rollups.daily_summary(stored), schemas.DAILY_RESORT_SUMMARY,
            "ride_date", replaced=_each(dates)))
        mondays = {day - timedelta(days=day.weekday()) for day in dates}
        days = {monday + timedelta(days=n) for monday in mondays for n in range(7)}
        daily = self._dated(change, "daily_resort_summary", schemas.DAILY_RESORT_SUMMARY, days)
        log.step("weekly_resort_summary", len(mondays), lambda: change.replace(
            "weekly_resort_summary", rollups.weekly_summary(daily), schemas.WEEKLY_RESORT_SUMMARY,
            "week_start_date", replaced=_each(sorted(mondays))))

    # Late sales

    def refresh_sales(self, sales: DataFrame, batch_id: int) -> None:
        """Correct the visits of media that were sold only now, on just the days they visited.

        The index of visit days leads from a medium to its days, so nobody has to
        name dates and other days are not read.
        """
        with self._one_at_a_time:
            change = self._change("sales", batch_id)
            if change is None:
                return
            media = sales.filter("rfid IS NOT NULL").select("rfid").distinct().withColumn("bucket", _bucket())
            # At most one row per bucket, then one per day.
            buckets = {str(row.bucket) for row in media.select("bucket").distinct().collect()}
            index = change.scan("visit_days", _VISIT_DAY, lambda values: values[0] in buckets)
            visited = index.join(media, ["bucket", "rfid"], "left_semi").select("rfid", "visit_date").distinct()
            dates = sorted(row.visit_date for row in visited.select("visit_date").distinct().collect())
            log = RefreshLog(self.spark, self._path("sales_history"), batch_id)
            if dates:
                recorded = self.visits(dates, change)
                late = recorded.join(visited, ["rfid", "visit_date"], "left_semi").select(recorded.columns)
                others = recorded.join(visited, ["rfid", "visit_date"], "left_anti").select(recorded.columns)
                look_up = enrich_again if self.policy == EARLIEST else reenrich
                corrected = others.unionByName(look_up(late, self.passes(), self.tickets()))
                self._replace_visits(corrected, dates, change, log)
            log.save()
            change.publish()

    def repair(self, dates: list[date], repair_id: int) -> None:
        """Look sales up again for visits recorded without one, then redo their days."""
        with self._one_at_a_time:
            change = Change(snapshot(self.spark, self.root))
            log = RefreshLog(self.spark, self._path("repair_history"), repair_id)
            found = reenrich(self.visits(dates, change), self.passes(), self.tickets())
            self._replace_visits(found, dates, change, log)
            log.save()
            change.publish()

    def _replace_visits(self, rows: DataFrame, dates: list[date], change: Change, log: RefreshLog) -> None:
        log.step("daily_visits", len(dates), lambda: change.replace(
            "daily_visits", rows, schemas.DAILY_VISITS, "visit_date", replaced=_each(dates)))
        self._refresh_summaries(dates, change, log)

    # Closed days

    def compact(self, dates: list[date]) -> None:
        """Put what batches added to days that get few rides any more into one folder per part."""
        with self._one_at_a_time:
            change = Change(snapshot(self.spark, self.root))
            rides = self._dated(change, "lift_ride", _STORED_RIDE, dates)
            change.replace("lift_ride", rides, _STORED_RIDE, *_PART, replaced=_each(dates), options=_BLOOM)
            if self.policy == FIRST_WRITER:
                change.replace("daily_visits", self.visits(dates, change), schemas.DAILY_VISITS, "visit_date",
                               replaced=_each(dates))
            index = change.scan("visit_days", _VISIT_DAY).distinct()
            change.replace("visit_days", index, _VISIT_DAY, "bucket")
            change.publish()

    def expire(self, keep: timedelta = timedelta(hours=1)) -> list[int]:
        """Remove versions that no report reads any more."""
        with self._one_at_a_time:
            return versions.expire(self.spark, self.root, keep)

    # Stored tables

    def chain(self, version: int | None = None) -> SnapshotChain:
        """One version of the tables for reports, the current one unless told otherwise; rides
        carry ``ride_date`` for pruning."""
        base = Chain(None, self.passes(), self.tickets(), self.capacity)
        return SnapshotChain(snapshot(self.spark, self.root, version), base)

    def visits(self, dates: list[date], of: Snapshot | None = None) -> DataFrame:
        of = of or snapshot(self.spark, self.root)
        return self._dated(of, "daily_visits", schemas.DAILY_VISITS, dates)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _dated(self, of: Snapshot, name: str, schema: T.StructType, dates: Collection[date]) -> DataFrame:
        """Partitions of the given days; what a batch touches is a few of all."""
        wanted = {day.isoformat() for day in dates}
        return of.scan(name, schema, lambda values: values[0] in wanted)

    def _scan_parts(self, of: Snapshot, name: str, schema: T.StructType, parts: Collection[Part]) -> DataFrame:
        wanted = {(day.isoformat(), str(block)) for day, block in parts}
        return of.scan(name, schema, lambda values: values in wanted)

    def _sizes(self, words: dict[Part, int]) -> DataFrame:
        return self.spark.createDataFrame([(*part, n) for part, n in words.items()], _SIZES)


def _name(part: Part) -> str:
    return f"{part[0].isoformat()}/{part[1]}"


def _once(rows: DataFrame, *key: str) -> DataFrame:
    """One row for each key; rows without one cannot be told apart and stay."""
    known = F.col(key[0]).isNotNull()
    return rows.filter(known).dropDuplicates(list(key)).unionByName(rows.filter(~known))


def _bucket():
    return F.pmod(F.xxhash64("rfid"), F.lit(BUCKETS)).cast("int")


def _visit_days(rides: DataFrame) -> DataFrame:
    """Days on which each medium was used; rows of several batches may repeat."""
    days = rides.filter("rfid IS NOT NULL").select("rfid", F.col("ride_date").alias("visit_date")).distinct()
    return days.withColumn("bucket", _bucket())


def _each(values: list[date]) -> list[tuple[date]]:
    return [(value,) for value in values]
