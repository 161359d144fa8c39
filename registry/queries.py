"""One query per operator, over the whole test tables.

Every callable takes ``(spark, sf_dir)`` and returns a frame.  Resorts are the
event types; ``SITE`` is the one the single-resort reports ask for.  Decimals
leave as doubles so that both engines hand out the same type.
"""

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry import live
from turnstile import schemas
from turnstile.functions import bands, money, timeparts
from turnstile.operators import audits, batches, hourly, lifts, rollups, visits
from turnstile.plans import catalog, procedures, reports
from turnstile.plans.chain import Chain, StoredChain, materialize
from turnstile.session import shared_dir
from turnstile.sources import payloads, samples

SITE = "view"
MINUTES = 1440
SPEND = 900

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(spark, sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles; everything else as it is."""
    return df.select(
        [
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def chain(spark: SparkSession, sf_dir: str) -> Chain:
    return Chain(
        samples.rides(spark, sf_dir),
        samples.season_passes(spark, sf_dir),
        samples.resort_tickets(spark, sf_dir),
        samples.capacity(spark),
    )


_STORED: dict[tuple, StoredChain] = {}


def stored(spark: SparkSession, sf_dir: str) -> StoredChain:
    """The chain written once per session; reports read its tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = materialize(spark, chain(spark, sf_dir), shared_dir(spark, "chain"))
    return _STORED[key]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full was each resort in each hour, and what revenue did it earn?"""
    return chain(spark, sf_dir).hourly


# Feed buffer and scans

@query
def read_after(spark, sf_dir):
    rows = samples.events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    return batches.read_after(rows, "event_id", 1234)


@query
def retain_after(spark, sf_dir):
    rows = samples.events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    return batches.retain_after(rows, "event_id", 4999)


@query
def preview(spark, sf_dir):
    rows = samples.events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    return batches.preview(rows, "event_id")


@query
def site_capacity(spark, sf_dir):
    """Capacities of the resorts that have rides."""
    seen = samples.events(spark, sf_dir).select(F.col("event_type").alias("resort")).distinct()
    return reports.capacity_table(hourly.with_capacity(seen, samples.capacity(spark)))


@query
def json_payload(spark, sf_dir):
    passes = samples.season_passes(spark, sf_dir)
    tickets = samples.resort_tickets(spark, sf_dir)
    return (
        payloads.ride_payload(samples.rides(spark, sf_dir))
        .unionByName(payloads.sale_payload(passes, schemas.SEASON_PASS))
        .unionByName(payloads.sale_payload(tickets, schemas.RESORT_TICKET))
    )


@query
def json_rides(spark, sf_dir):
    """Rides written as JSON lines and read back."""
    lines = payloads.ride_payload(samples.rides(spark, sf_dir))
    return payloads.good_rows(payloads.parse_lines(lines, schemas.LIFT_RIDE))


@query
def json_tickets(spark, sf_dir):
    """Tickets written as JSON lines and read back, nested fields flattened."""
    lines = payloads.sale_payload(samples.resort_tickets(spark, sf_dir), schemas.RESORT_TICKET)
    rows = payloads.good_rows(payloads.parse_lines(lines, schemas.RESORT_TICKET))
    return rows.select(
        "txid", "rfid", "resort", "purchase_time", "price_usd", "expiration_time", "days",
        "name", "phone", "email",
        F.col("address.postalcode").alias("postalcode"),
        F.col("emergency_contact.name").alias("contact_name"),
    )


# Bands, periods and column functions

def _periods(spark, sf_dir, predicate) -> DataFrame:
    tables = stored(spark, sf_dir)
    clock = reports.period_clock(tables.hourly)
    rows = tables.daily.select("ride_date", "resort", "total_rides")
    parts = [
        rows.filter(predicate(F.col("ride_date"), clock, period)).withColumn("period", F.lit(period))
        for period in timeparts.PERIODS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def period_current(spark, sf_dir):
    return _periods(spark, sf_dir, timeparts.current_period)


@query
def period_previous(spark, sf_dir):
    return _periods(spark, sf_dir, timeparts.previous_period)


@query
def trailing_window(spark, sf_dir):
    rides = samples.rides(spark, sf_dir).drop("activation_day_count")
    return lifts.trailing_rides(rides, SITE, MINUTES)


@query
def capacity_band(spark, sf_dir):
    rides = samples.bare_rides(spark, sf_dir)
    visitors = hourly.rides_per_visitor(rides).groupBy(*hourly.HOUR_KEY).agg(
        F.count("rfid").alias("visitor_count")
    )
    rows = hourly.with_capacity(visitors, samples.capacity(spark))
    status = bands.capacity_status(F.col("visitor_count"), F.col("max_capacity"))
    return rows.select(*hourly.HOUR_KEY, "visitor_count", status.alias("capacity_status"))


@query
def target_status(spark, sf_dir):
    tables = chain(spark, sf_dir)
    rows = rollups.revenue_performance(tables.daily, tables.capacity, spend=SPEND)
    status = F.col("performance_status")
    return rows.groupBy("resort", status, bands.target_icon(status).alias("icon")).agg(
        F.count(F.lit(1)).alias("days")
    )


@query
def site_status(spark, sf_dir):
    pct = F.col("avg_capacity_pct")
    return chain(spark, sf_dir).daily.select(
        "ride_date", "resort", pct,
        bands.resort_status(pct).alias("status"),
        bands.capacity_icon(pct).alias("icon"),
    )


@query
def distinct_sites(spark, sf_dir):
    return reports.available_resorts(chain(spark, sf_dir).daily)


@query
def time_functions(spark, sf_dir):
    time = F.col("ride_time")
    day = timeparts.day_of(time)
    return samples.bare_rides(spark, sf_dir).select(
        "txid",
        day.alias("ride_date"),
        F.hour(time).alias("ride_hour"),
        timeparts.hour_start(time).alias("hour_start"),
        timeparts.week_start(day).alias("week_start"),
        timeparts.minutes_before(time, 30).alias("half_hour_earlier"),
        F.date_sub(day, 14).alias("two_weeks_ago"),
        *[
            timeparts.clock_dates(time)[name].alias(name)
            for name in ("month_start", "prev_month_start")
        ],
    )


@query
def local_time(spark, sf_dir):
    zones = samples.capacity(spark).select("resort", "iana_timezone")
    local = timeparts.to_local(F.col("ride_time"), F.col("iana_timezone"))
    return samples.bare_rides(spark, sf_dir).join(zones, "resort").select(
        "txid", "resort", local.alias("local_time"), F.hour(local).alias("local_hour")
    )


@query
def minutes_between(spark, sf_dir):
    rides = samples.bare_rides(spark, sf_dir)
    spans = rides.groupBy("rfid").agg(
        F.min("ride_time").alias("first_ride"), F.max("ride_time").alias("last_ride")
    )
    first, last = F.col("first_ride"), F.col("last_ride")
    return spans.select("rfid", timeparts.minutes_between(first, last).alias("minutes"))


@query
def pct_change(spark, sf_dir):
    """Change of each resort's rides against the day before."""
    rides = samples.bare_rides(spark, sf_dir)
    days = rides.groupBy(
        timeparts.day_of(F.col("ride_time")).alias("ride_date"), "resort"
    ).agg(F.count(F.lit(1)).alias("rides"))
    before = days.select(
        F.date_add("ride_date", 1).alias("ride_date"), "resort", F.col("rides").alias("prev_rides")
    )
    change = money.pct_change(F.col("rides"), F.col("prev_rides"))
    return days.join(before, ["ride_date", "resort"], "left").select(
        "ride_date", "resort", "rides", "prev_rides", change.alias("change_pct")
    )


# Joins

@query
def pass_enrich(spark, sf_dir):
    firsts = visits.first_rides(samples.rides(spark, sf_dir))
    return visits.enrich_from_pass(firsts, samples.season_passes(spark, sf_dir))


@query
def ticket_enrich(spark, sf_dir):
    firsts = visits.first_rides(samples.rides(spark, sf_dir))
    return visits.enrich_from_ticket(firsts, samples.resort_tickets(spark, sf_dir))


@query
def visit_anti_join(spark, sf_dir):
    """Visits that are new when those up to the middle of the month are known."""
    tables = chain(spark, sf_dir)
    known = tables.visits.filter(F.col("visit_date") < F.lit(date(2024, 1, 16)))
    return visits.new_visits(visits.first_rides(tables.rides), known).select(
        *visits.VISIT_KEY, "first_ride_time"
    )


@query
def ride_visit_join(spark, sf_dir):
    tables = chain(spark, sf_dir)
    return hourly.with_pass_flag(hourly.rides_per_visitor(tables.rides), tables.visits)


@query
def activity_revenue_join(spark, sf_dir):
    tables = chain(spark, sf_dir)
    return hourly.with_revenue(tables.activity, tables.revenue)


@query
def capacity_join(spark, sf_dir):
    tables = chain(spark, sf_dir)
    return hourly.with_capacity(tables.activity, tables.capacity)


@query
def scalar_max_join(spark, sf_dir):
    """Rides of one resort next to that resort's last ride."""
    rides = samples.bare_rides(spark, sf_dir).filter(F.col("resort") == SITE)
    last = rides.agg(F.max("ride_time").alias("last_ride_time"))
    return rides.select("txid", "ride_time", last.scalar().alias("last_ride_time"))


# Chain

@query
def first_per_day(spark, sf_dir):
    return visits.first_rides(samples.rides(spark, sf_dir))


@query
def daily_visits(spark, sf_dir):
    return chain(spark, sf_dir).visits


@query
def hourly_activity(spark, sf_dir):
    return chain(spark, sf_dir).activity


@query
def hourly_revenue(spark, sf_dir):
    return chain(spark, sf_dir).revenue


@query
def hourly_summary(spark, sf_dir):
    return flagship(spark, sf_dir)


@query
def hourly_summary_joined(spark, sf_dir):
    """The same table from separate activity and revenue tables."""
    t = chain(spark, sf_dir)
    return hourly.hourly_summary(t.activity, t.revenue, t.capacity)


@query
def visitor_hours(spark, sf_dir):
    return hourly.visitor_hours(samples.rides(spark, sf_dir))


@query
def daily_summary(spark, sf_dir):
    return chain(spark, sf_dir).daily


@query
def weekly_summary(spark, sf_dir):
    return chain(spark, sf_dir).weekly


@query
def weekly_summary_sql(spark, sf_dir):
    """The weekly table through SQL text on a published view."""
    chain(spark, sf_dir).daily.createOrReplaceTempView("daily_resort_summary")
    return spark.sql(rollups.weekly_summary_sql())


@query
def revenue_performance(spark, sf_dir):
    tables = chain(spark, sf_dir)
    return rollups.revenue_performance(tables.daily, tables.capacity, spend=SPEND)


@query
def network_daily(spark, sf_dir):
    return chain(spark, sf_dir).network


@query
def repaired_visits(spark, sf_dir):
    """Visits recorded before any sale was known, repaired afterwards."""
    tables = chain(spark, sf_dir)
    nothing = [spark.createDataFrame([], table.schema) for table in (tables.passes, tables.tickets)]
    early = visits.daily_visits(tables.rides, *nothing)
    return visits.reenrich(early, tables.passes, tables.tickets)


# Lifts

@query
def lift_performance(spark, sf_dir):
    tables = stored(spark, sf_dir)
    return lifts.lift_performance(tables.rides, SITE, MINUTES, hourly=tables.hourly)


@query
def lift_performance_as_of(spark, sf_dir):
    rides = stored(spark, sf_dir).rides
    return lifts.lift_performance(rides, SITE, MINUTES, as_of=datetime(2024, 1, 15, 12))


@query
def lift_function(spark, sf_dir):
    """Lift performance called from SQL."""
    stored(spark, sf_dir).rides.createOrReplaceTempView("lift_ride")
    procedures.register_lift_function(spark, dated=True)
    return spark.sql(f"SELECT * FROM {procedures.FUNCTION}('{SITE}', {MINUTES})")


@query
def lift_function_as_of(spark, sf_dir):
    """The same as of a time, reading the days of the window only."""
    stored(spark, sf_dir).rides.createOrReplaceTempView("lift_ride")
    procedures.register_lift_function(spark, dated=True)
    return spark.sql(
        f"SELECT * FROM {procedures.FUNCTION}('{SITE}', {MINUTES}, "
        "TIMESTAMP_NTZ '2024-01-15 12:00:00', DATE '2024-01-14')")


@query
def lift_top10(spark, sf_dir):
    tables = stored(spark, sf_dir)
    return lifts.top_lifts(lifts.lift_performance(tables.rides, SITE, MINUTES, hourly=tables.hourly))


@query
def lift_board(spark, sf_dir):
    tables = stored(spark, sf_dir)
    return reports.resort_top_lifts(tables.rides, SITE, minutes=MINUTES, hourly=tables.hourly)


@query
def share_of_max(spark, sf_dir):
    """Each lift's rides against the busiest lift of its resort."""
    rides = samples.bare_rides(spark, sf_dir).groupBy("resort", "lift").agg(
        F.count(F.lit(1)).alias("rides")
    )
    return lifts.share_of_max(rides, "rides", "resort")


# Reports

@query
def latest_hours(spark, sf_dir):
    return batches.latest(stored(spark, sf_dir).hourly, "ride_hour_timestamp", tie="resort")


@query
def latest_weeks(spark, sf_dir):
    return reports.latest_weeks(stored(spark, sf_dir).weekly, SITE)


@query
def weeks_table(spark, sf_dir):
    return reports.weeks_table(reports.latest_weeks(stored(spark, sf_dir).weekly, SITE))


@query
def reporting_clock(spark, sf_dir):
    t = stored(spark, sf_dir)
    return reports.reporting_clock(t.rides, t.passes, t.tickets, t.hourly)


@query
def site_clock(spark, sf_dir):
    return reports.resort_clock(stored(spark, sf_dir).hourly, SITE)


@query
def clock_line(spark, sf_dir):
    t = stored(spark, sf_dir)
    return reports.clock_line(t.rides, t.passes, t.tickets, t.hourly, t.capacity, "click")


def _kpis(spark, sf_dir, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    tables = stored(spark, sf_dir)
    clock = reports.period_clock(tables.hourly)
    parts = [
        shape(reports.network_kpis(tables.network, clock, period)).withColumn(
            "period", F.lit(period)
        )
        for period in timeparts.PERIODS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def network_kpis(spark, sf_dir):
    return _kpis(spark, sf_dir, reports.kpi_changes)


@query
def kpi_cards(spark, sf_dir):
    return _kpis(spark, sf_dir, reports.kpi_cards)


def _by_period(spark, sf_dir, report, period) -> DataFrame:
    tables = stored(spark, sf_dir)
    return report(tables.daily, reports.period_clock(tables.hourly), period)


def _all_periods(spark, sf_dir, report) -> DataFrame:
    """The report for every period, one after the other."""
    parts = [
        _by_period(spark, sf_dir, report, period).withColumn("period", F.lit(period))
        for period in timeparts.PERIODS
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def site_comparison(spark, sf_dir):
    return _all_periods(spark, sf_dir, reports.resort_comparison)


@query
def site_time_series(spark, sf_dir):
    return _all_periods(spark, sf_dir, reports.time_series)


@query
def site_status_report(spark, sf_dir):
    return _all_periods(spark, sf_dir, reports.status_by_resort)


@query
def display_status(spark, sf_dir):
    status = _by_period(spark, sf_dir, reports.status_by_resort, timeparts.LAST_7_DAYS)
    return reports.status_table(status)


@query
def site_operations(spark, sf_dir):
    return reports.resort_operations(stored(spark, sf_dir).hourly, SITE)


@query
def hourly_pattern_local(spark, sf_dir):
    tables = stored(spark, sf_dir)
    return reports.hourly_pattern(tables.hourly, tables.capacity, "click")


@query
def site_revenue_today(spark, sf_dir):
    t = stored(spark, sf_dir)
    performance = rollups.revenue_performance(t.daily, t.capacity, spend=SPEND)
    return reports.revenue_today(performance, t.hourly, SITE)


@query
def revenue_card(spark, sf_dir):
    t = stored(spark, sf_dir)
    return reports.revenue_card(reports.revenue_today(t.performance, t.hourly, SITE))


@query
def published_views(spark, sf_dir):
    """The views the chain registers, after one of them was queried by name."""
    catalog.publish(stored(spark, sf_dir))
    names = catalog.list_objects(spark, "view").filter(F.col("name").isin(*catalog.VIEWS))
    days = spark.sql("SELECT count(*) FROM v_daily_network_metrics")
    return names.withColumn("network_days", days.scalar())


# Audits

@query
def activation_day(spark, sf_dir):
    return samples.rides(spark, sf_dir).select("txid", "rfid", "activation_day_count")


@query
def rides_after_expiry(spark, sf_dir):
    return audits.rides_after_expiry(
        samples.bare_rides(spark, sf_dir).drop("activation_day_count"),
        samples.season_passes(spark, sf_dir),
        samples.resort_tickets(spark, sf_dir),
    )


@query
def overused_tickets(spark, sf_dir):
    return audits.overused_tickets(
        samples.bare_rides(spark, sf_dir), samples.resort_tickets(spark, sf_dir)
    )


@query
def rides_outside_hours(spark, sf_dir):
    rides = samples.bare_rides(spark, sf_dir).select("txid", "resort", "ride_time")
    return audits.rides_outside_hours(rides, samples.capacity(spark))


@query
def ride_gaps(spark, sf_dir):
    return audits.ride_gaps(samples.bare_rides(spark, sf_dir))


@query
def price_band(spark, sf_dir):
    return audits.price_band(samples.resort_tickets(spark, sf_dir), samples.profiles(spark))


@query
def price_tier_share(spark, sf_dir):
    return audits.price_tier_share(samples.season_passes(spark, sf_dir))


@query
def active_media(spark, sf_dir):
    media = [
        samples.resort_tickets(spark, sf_dir).select("txid", "rfid", "expiration_time"),
        samples.season_passes(spark, sf_dir).select("txid", "rfid", "expiration_time"),
    ]
    return audits.active_media(media[0].unionByName(media[1]), datetime(2024, 1, 15))


@query
def ingest_throughput(spark, sf_dir):
    return audits.ingest_throughput(
        samples.bare_rides(spark, sf_dir),
        samples.season_passes(spark, sf_dir),
        samples.resort_tickets(spark, sf_dir),
    )


@query
def null_profile(spark, sf_dir):
    passes = samples.season_passes(spark, sf_dir)
    tickets = samples.resort_tickets(spark, sf_dir)
    return audits.null_profile(passes).withColumn("source", F.lit("season_pass")).unionByName(
        audits.null_profile(tickets).withColumn("source", F.lit("resort_ticket"))
    )


# Streaming

@query
def stream_visits(spark, sf_dir):
    """Visits kept by the refresh job over several micro-batches."""
    return live.visits(spark, sf_dir)


@query
def stream_visits_first_writer(spark, sf_dir):
    """The same under the policy that never corrects a recorded visit."""
    return live.first_written_visits(spark, sf_dir)


@query
def stream_redelivered(spark, sf_dir):
    """Days of a feed that delivers rides again, counted once."""
    return live.redelivered(spark, sf_dir)


@query
def stream_paused(spark, sf_dir):
    """A job that is paused after every batch and resumed before the next."""
    return live.paused(spark, sf_dir)


@query
def ingest_archived(spark, sf_dir):
    """Every line of a feed whose files are moved away once read."""
    return live.archived(spark, sf_dir)


@query
def purged_buffer(spark, sf_dir):
    return live.purged(spark, sf_dir)


@query
def buffered_batch(spark, sf_dir):
    """A bounded read that opens only the files of a buffer that hold its ids."""
    return live.buffered_batch(spark, sf_dir)


@query
def stream_versions(spark, sf_dir):
    """What a reader of each published version sees."""
    return live.versions_read(spark, sf_dir)


@query
def stream_out_of_order(spark, sf_dir):
    """Hours merged from batches that each hold rides of every part of a day."""
    return live.out_of_order(spark, sf_dir)


@query
def stream_late_sales(spark, sf_dir):
    """Visits corrected by the sales that came after them."""
    return live.sold_late(spark, sf_dir)


@query
def key_filter(spark, sf_dir):
    """Repeated rides that the filters of the parts of a day find."""
    return live.suspects(spark, sf_dir)


@query
def appended_visits(spark, sf_dir):
    return live.appended(spark, sf_dir)


@query
def stream_hours(spark, sf_dir):
    return live.hourly(spark, sf_dir)


@query
def stream_refresh(spark, sf_dir):
    return live.weekly(spark, sf_dir)


@query
def refresh_log(spark, sf_dir):
    return live.history(spark, sf_dir)


@query
def stream_dedup(spark, sf_dir):
    return live.deduplicated(spark, sf_dir)


@query
def stream_hours_approx(spark, sf_dir):
    return live.approximate_hours(spark, sf_dir)


@query
def stream_hours_exact(spark, sf_dir):
    """Rides and visitors of every hour from keyed state, no ride too late to count."""
    return live.exact_visitors(spark, sf_dir)


@query
def unique_visitors(spark, sf_dir):
    """Distinct visitors of days, weeks and the network as unions of stored sketches."""
    return live.unique_visitors(spark, sf_dir)


@query
def input_log(spark, sf_dir):
    """Input rows and offsets of a stream's batches from the listener."""
    return live.reported_input(spark, sf_dir)
