from datetime import datetime
from decimal import Decimal

import pytest
from builders import at, day, rows_of
from pyspark.sql import functions as F

from turnstile import schemas
from turnstile.operators import audits, batches, hourly, lifts, rollups, visits
from turnstile.sources.reference import literal_table, price_profiles, resort_capacity

DENVER = "America/Denver"


@pytest.fixture(scope="module")
def sales(make):
    passes = make.passes(("pass", "783", "2024-01-01", "2024-12-31"))
    tickets = make.tickets(("ticket", "north", "100", 3, "2024-01-01", "2024-01-07"))
    return passes, tickets


# Visits

def test_visit_sources(make, sales):
    rides = make.rides(
        ("1", "pass", "north", "a", "2024-01-01 09:00:00", 1),
        ("2", "ticket", "south", "a", "2024-01-01 09:00:00", 1),
        ("3", "nobody", "north", "a", "2024-01-01 09:00:00", 1),
    )
    got = rows_of(
        visits.daily_visits(rides, *sales).fillna("-", ["name"]).fillna(-1, ["ticket_original_duration"]),
        "rfid", "name", "has_season_pass", "ticket_original_duration",
    )
    assert got == [
        ("nobody", "-", False, -1), ("pass", "holder pass", True, -1),
        ("ticket", "guest ticket", False, 3),
    ]


def test_first_ride_and_tie(make, sales):
    rides = make.rides(
        ("9", "pass", "north", "late", "2024-01-01 10:00:00", 1),
        ("2", "pass", "north", "b", "2024-01-01 09:00:00", 1),
        ("10", "pass", "north", "a", "2024-01-01 09:00:00", 1),
        ("3", "pass", "south", "c", "2024-01-01 11:00:00", 1),
        ("4", "pass", "north", "d", "2024-01-02 00:00:00", 2),
    )
    got = rows_of(visits.daily_visits(rides, *sales), "visit_date", "resort", "first_lift")
    assert got == [
        (day("2024-01-01"), "north", "a"), (day("2024-01-01"), "south", "c"),
        (day("2024-01-02"), "north", "d"),
    ]


def test_pass_wins_over_ticket_and_newest_sale_wins(make):
    rides = make.rides(("1", "x", "north", "a", "2024-02-01 09:00:00", 1))
    passes = make.passes(("x", "783", "2024-01-01", "2024-12-31"), ("x", "407", "2024-01-05", "2024-12-31"))
    tickets = make.tickets(("x", "north", "100", 3, "2024-01-01", "2024-01-07"))
    got = visits.daily_visits(rides, passes, tickets).collect()
    assert len(got) == 1
    assert got[0].has_season_pass and got[0].purchase_price_usd == Decimal("407.00")
    assert got[0].ticket_original_duration == 3


def test_known_visits_are_left_out(make, sales):
    rides = make.rides(
        ("1", "pass", "north", "a", "2024-01-01 09:00:00", 1),
        ("2", "pass", "north", "a", "2024-01-02 09:00:00", 2),
        ("3", "pass", "south", "a", "2024-01-01 09:00:00", 1),
    )
    known = visits.daily_visits(rides.filter("txid = '1'"), *sales)
    got = rows_of(visits.daily_visits(rides, *sales, known), "resort", "visit_date")
    assert got == [("north", day("2024-01-02")), ("south", day("2024-01-01"))]


def test_reenrich_repairs_only_rows_without_price(make, sales):
    passes, tickets = sales
    recorded = make.visits(
        ("north", "pass", "2024-01-01 09:00:00", False, None, 1, None),
        ("north", "ticket", "2024-01-01 09:00:00", False, "55", 1, 9),
        ("north", "nobody", "2024-01-01 09:00:00", False, None, 1, None),
    )
    got = {r.rfid: r for r in visits.reenrich(recorded, passes, tickets).collect()}
    assert got["pass"].has_season_pass and got["pass"].purchase_price_usd == Decimal("783.00")
    assert got["ticket"].purchase_price_usd == Decimal("55.00")
    assert got["ticket"].ticket_original_duration == 9
    assert got["nobody"].purchase_price_usd is None


def test_visits_from_visitor_hours_equal_visits_from_rides(make, sales):
    rides = make.rides(
        ("1", "pass", "north", "a", "2024-01-01 09:30:00", 1),
        ("2", "pass", "north", "b", "2024-01-01 09:10:00", 1),
        ("3", "pass", "north", "c", "2024-01-01 08:59:59", 1),
        ("4", "ticket", "north", "d", "2024-01-01 23:59:59", 1),
    )
    direct = visits.daily_visits(rides, *sales)
    short = visits.daily_visits(hourly.visitor_hours(rides), *sales)
    assert sorted(map(str, direct.collect())) == sorted(map(str, short.collect()))


# Hours

def test_revenue_rules(make):
    recorded = make.visits(
        ("north", "t1", "2024-01-01 09:00:00", False, "100", 1, 3),
        ("north", "t2", "2024-01-01 09:00:00", False, "100", 1, 0),
        ("north", "t3", "2024-01-01 09:00:00", False, "100", 1, None),
        ("north", "t4", "2024-01-01 09:00:00", False, None, 1, None),
        ("north", "p20", "2024-01-01 09:00:00", True, "783", 20, None),
        ("north", "p21", "2024-01-01 09:00:00", True, "783", 21, None),
        ("north", "p0", "2024-01-01 09:00:00", True, "783", None, None),
    )
    row = hourly.hourly_revenue(recorded).first()
    assert row.recognized_ticket_revenue == Decimal("133.33333333")
    assert row.recognized_pass_revenue == Decimal("39.15000000")
    assert (row.ticket_activations, row.pass_activations) == (4, 3)


def test_hours_without_arrivals_and_without_capacity(make, sales):
    rides = make.rides(
        ("1", "pass", "north", "a", "2024-01-01 09:00:00", 1),
        ("2", "pass", "north", "a", "2024-01-01 10:00:00", 1),
        ("3", "ticket", "elsewhere", "a", "2024-01-01 10:00:00", 1),
    )
    recorded = visits.daily_visits(rides, *sales)
    capacity = make.capacity(("north", 100, DENVER))
    joined = hourly.hourly_summary(
        hourly.hourly_activity(rides, recorded), hourly.hourly_revenue(recorded), capacity)
    short = hourly.hourly_summary_of(hourly.visitor_hours(rides), recorded, capacity)
    for summary in (joined, short):
        rows = {r.ride_hour: r for r in summary.collect()}
        assert set(rows) == {9, 10}
        assert (rows[9].pass_activations, rows[9].ticket_activations) == (1, 0)
        assert rows[9].total_recognized_revenue == Decimal("39.15000000")
        assert rows[10].pass_activations is None and rows[10].ticket_activations is None
        assert rows[10].total_recognized_revenue == 0


def test_unrecorded_visits_count_as_ticket_rides(make, sales):
    rides = make.rides(("1", "pass", "north", "a", "2024-01-01 09:00:00", 1))
    nothing = make.visits().limit(0)
    row = hourly.hourly_activity(rides, nothing).first()
    assert (row.total_rides, row.visitor_count, row.active_passes, row.pass_rides) == (1, 1, 0, 0)


def test_single_pass_hours_equal_joined_hours_with_null_keys(make, sales):
    rides = make.rides(
        ("1", None, "north", "a", "2024-01-01 09:00:00", None),
        ("2", None, "north", "a", "2024-01-01 09:30:00", None),
        ("3", "pass", "north", "a", "2024-01-01 09:00:00", 1),
        ("4", "ticket", "north", "a", "2024-01-01 11:00:00", 1),
        ("5", None, "north", "a", "2024-01-01 12:00:00", None),
    )
    recorded = visits.daily_visits(rides, *sales)
    capacity = make.capacity(("north", 2, DENVER))
    joined = hourly.hourly_summary(
        hourly.hourly_activity(rides, recorded), hourly.hourly_revenue(recorded), capacity)
    short = hourly.hourly_summary_of(hourly.rides_per_visitor(rides), recorded, capacity)
    assert sorted(map(str, joined.collect())) == sorted(map(str, short.collect()))


# Roll-ups

def _hours(make, *counts):
    rides = make.rides(*[
        (f"{h}-{i}", f"m{i}", "north", "a", f"2024-01-0{d} {h:02}:00:00", 1)
        for d, h, n in counts for i in range(n)
    ])
    recorded = visits.daily_visits(rides, make.passes().limit(0), make.tickets().limit(0))
    return hourly.hourly_summary_of(
        hourly.rides_per_visitor(rides), recorded, make.capacity(("north", 10, DENVER)))


def test_daily_and_weekly(make):
    hours = _hours(make, (7, 9, 7), (7, 10, 9), (8, 9, 10))
    daily = {str(r.ride_date): r for r in rollups.daily_summary(hours).collect()}
    sunday = daily["2024-01-07"]
    assert (sunday.peak_hourly_visitors, sunday.total_visitor_hours) == (9, 16)
    assert (sunday.avg_capacity_pct, sunday.operation_hours) == (Decimal("80.0"), 2)
    assert sunday.total_visitors == 9
    weeks = rows_of(rollups.weekly_summary(rollups.daily_summary(hours)),
                    "week_start_date", "operation_days", "week_total_visitors")
    assert weeks == [(day("2024-01-01"), 1, 9), (day("2024-01-08"), 1, 10)]


def test_weekly_sql_equals_weekly(make, spark):
    daily = rollups.daily_summary(_hours(make, (1, 9, 7), (2, 10, 9), (2, 11, 4), (8, 9, 10)))
    daily.createOrReplaceTempView("daily_resort_summary")
    by_text = spark.sql(rollups.weekly_summary_sql())
    assert sorted(map(str, by_text.collect())) == sorted(
        map(str, rollups.weekly_summary(daily).collect()))


def test_network_counts_a_person_per_resort(make, sales):
    rides = make.rides(
        ("1", "pass", "north", "a", "2024-01-01 09:00:00", 1),
        ("2", "pass", "south", "a", "2024-01-01 12:00:00", 1),
    )
    recorded = visits.daily_visits(rides, *sales)
    capacity = make.capacity(("north", 100, DENVER), ("south", 100, DENVER))
    hours = hourly.hourly_summary_of(hourly.rides_per_visitor(rides), recorded, capacity)
    row = rollups.network_daily(rollups.daily_summary(hours)).first()
    assert (row.total_network_visitors, row.active_resorts) == (2, 2)


def test_revenue_performance_edges(make, spark):
    days = [("near", "63.00"), ("above", "70.00"), ("none", "5.00"), ("below", "62.99")]
    blank = {f.name: None for f in schemas.DAILY_RESORT_SUMMARY}
    daily = spark.createDataFrame(
        [tuple({**blank, "ride_date": day("2024-01-01"), "resort": name,
                "total_revenue": Decimal(revenue)}.values()) for name, revenue in days],
        schemas.DAILY_RESORT_SUMMARY)
    capacity = make.capacity(("near", 1, DENVER), ("above", 1, DENVER), ("none", 0, DENVER),
                             ("below", 1, DENVER))
    got = {r.resort: (r.revenue_target_pct, r.performance_status)
           for r in rollups.revenue_performance(daily, capacity).collect()}
    assert got == {
        "near": (Decimal("90.0"), "NEAR_TARGET"), "above": (Decimal("100.0"), "ABOVE_TARGET"),
        "none": (None, "ABOVE_TARGET"), "below": (Decimal("90.0"), "BELOW_TARGET"),
    }


# Lifts

@pytest.fixture(scope="module")
def lift_rides(make):
    return make.rides(
        ("0", "m1", "north", "old", "2024-01-01 09:30:00", 1),
        ("1", "m1", "north", "a", "2024-01-01 09:30:01", 1),
        ("2", "m1", "north", "a", "2024-01-01 09:45:01", 1),
        ("3", "m2", "north", "b", "2024-01-01 09:50:00", 1),
        ("4", "m2", "north", "c", "2024-01-01 09:50:59", 1),
        ("5", "m2", "north", "c", "2024-01-01 09:51:01", 1),
        ("6", "m2", "north", "b", "2024-01-01 10:00:00", 1),
        ("7", "m2", "north", "d", "2024-01-01 09:55:00", 1),
        ("8", "m9", "south", "a", "2024-01-01 11:00:00", 1),
    )


def test_lift_performance(lift_rides):
    got = rows_of(lifts.lift_performance(lift_rides, "north").fillna(-1.0, ["rides_per_hour"]),
                  "usage_rank_in_resort", "overall_usage_rank", "lift", "rides",
                  "unique_visitors", "rides_per_hour")
    assert got == [
        (1, 1, "a", 2, 1, 8.0), (2, 2, "b", 2, 1, 12.0), (3, 3, "c", 2, 1, 120.0),
        (4, 4, "d", 1, 1, -1.0),
    ]


def test_lift_window_arguments(lift_rides):
    got = lifts.lift_performance(lift_rides, "north", 15, as_of=datetime(2024, 1, 1, 9, 45, 1))
    assert rows_of(got, "lift", "rides") == [("a", 1)]


def test_unknown_resort_has_no_lifts(lift_rides):
    assert lifts.lift_performance(lift_rides, "nowhere").count() == 0


def test_board(lift_rides):
    board = lifts.top_lifts_board(lifts.lift_performance(lift_rides, "north"), 2)
    assert [(r.medal, r.lift, r.share_of_max, r.activity_level) for r in board.collect()] == [
        ("🥇", "a", 1.0, "Normal"), ("🥈", "b", 1.0, "Normal")]


def test_share_of_max_of_zeros(spark):
    df = spark.createDataFrame([("x", 0), ("x", 0), ("y", 2), ("y", 1)], "k string, v int")
    got = rows_of(lifts.share_of_max(df, "v", "k"), "k", "v", "share_of_max")
    assert got == [("x", 0, 0.0), ("x", 0, 0.0), ("y", 1, 0.5), ("y", 2, 1.0)]


# Audits

def test_activation_days(make):
    rides = make.rides(
        ("1", "m", "north", "a", "2024-01-05 09:00:00", None),
        ("2", "m", "south", "a", "2024-01-01 09:00:00", None),
        ("3", "m", "north", "a", "2024-01-05 10:00:00", None),
        ("4", "n", "north", "a", "2024-01-09 10:00:00", None),
    )
    got = rows_of(audits.activation_days(rides), "txid", "activation_day_count")
    assert got == [("1", 2), ("2", 1), ("3", 2), ("4", 1)]


def test_expiry(make):
    rides = make.rides(
        ("1", "t", "north", "a", "2024-01-03 23:59:59", 1),
        ("2", "t", "north", "a", "2024-01-04 00:00:00", 1),
        ("3", "unsold", "north", "a", "2024-01-04 00:00:00", 1),
    )
    tickets = make.tickets(("t", "north", "10", 1, "2024-01-01", "2024-01-03"))
    assert rows_of(audits.rides_after_expiry(rides, tickets), "txid") == [("2",)]


def test_one_day_ticket_on_two_days(make):
    rides = make.rides(
        ("1", "t", "north", "a", "2024-01-01 09:00:00", 1),
        ("2", "t", "north", "a", "2024-01-02 09:00:00", 2),
        ("3", "u", "north", "a", "2024-01-01 09:00:00", 1),
        ("4", "u", "north", "a", "2024-01-01 10:00:00", 1),
    )
    tickets = make.tickets(
        ("t", "north", "10", 1, "2024-01-01", "2024-01-03"),
        ("u", "north", "10", 1, "2024-01-01", "2024-01-03"))
    assert rows_of(audits.overused_tickets(rides, tickets), "rfid", "days", "days_used") == [("t", 1, 2)]


def test_opening_hours(make):
    rides = make.rides(
        ("07:59", "m", "north", "a", "2024-01-01 14:59:59", 1),
        ("08:00", "m", "north", "a", "2024-01-01 15:00:00", 1),
        ("15:59", "m", "north", "a", "2024-01-01 22:59:59", 1),
        ("16:00", "m", "north", "a", "2024-01-01 23:00:00", 1),
        ("summer", "m", "north", "a", "2024-03-10 14:00:00", 1),
    )
    got = audits.rides_outside_hours(rides, make.capacity(("north", 1, DENVER)))
    assert rows_of(got, "txid") == [("07:59",), ("16:00",)]


def test_ride_gaps_across_hours(make):
    rides = make.rides(
        ("1", "m", "north", "a", "2024-01-01 09:55:00", 1),
        ("2", "m", "north", "a", "2024-01-01 10:04:59", 1),
        ("3", "m", "north", "a", "2024-01-01 10:14:59", 1),
        ("4", "m", "north", "a", "2024-01-03 10:14:59", 1),
        ("5", "n", "north", "a", "2024-01-01 10:00:00", 1),
        ("6", "n", "north", "a", "2024-01-01 10:00:00", 1),
    )
    got = {r.txid: (r.gap_seconds, r.too_fast, r.rested) for r in audits.ride_gaps(rides).collect()}
    assert got == {
        "1": (None, False, False), "2": (599, True, False), "3": (600, False, False),
        "4": (172800, False, True), "5": (None, False, False), "6": (0, True, False),
    }


def test_price_band(make, spark):
    profiles = literal_table(spark, [("north", 120, "1.6")], schemas.PRICE_PROFILE)
    tickets = make.tickets(
        ("low", "north", "107", 1, "2024-01-01", "2024-02-01"),
        ("floor", "north", "108", 1, "2024-01-01", "2024-02-01"),
        ("weekend", "north", "345", 2, "2024-01-06", "2024-02-01"),
        ("default", "other", "135", 1, "2024-01-07", "2024-02-01"),
        ("over", "other", "166", 1, "2024-01-07", "2024-02-01"),
    )
    got = {r.txid: r.in_band for r in audits.price_band(tickets, profiles).collect()}
    assert got == {"t0": False, "t1": True, "t2": True, "t3": True, "t4": False}


def test_price_tiers_and_active_media(make):
    passes = make.passes(
        ("a", "783", "2024-01-01", "2024-12-31"), ("b", "783", "2024-01-01", "2024-02-01"),
        ("c", "407", "2024-01-01", "2024-01-31"), ("d", "783", "2024-01-01", "2024-12-31"))
    tiers = rows_of(audits.price_tier_share(passes), "sales", "share_pct")
    assert tiers == [(1, 25.0), (3, 75.0)]
    alive = audits.active_media(passes, datetime(2024, 2, 1, 12))
    assert rows_of(alive, "rfid") == [("a",), ("b",), ("d",)]


def test_null_profile(make):
    row = audits.null_profile(make.passes(("a", "783", "2024-01-01", "2024-12-31"))).first()
    assert (row.row_count, row.phone_null_share) == (1, 1.0)


# Batches and reference tables

def test_batches(spark):
    df = spark.range(1, 31).withColumnRenamed("id", "n").orderBy(F.rand(1))
    assert [r.n for r in batches.read_after(df, "n", 10, 5).collect()] == [11, 12, 13, 14, 15]
    assert batches.retain_after(df, "n", 10).count() == 20
    assert [r.n for r in batches.preview(df, "n", 3).collect()] == [1, 2, 3]


def test_reference_tables(spark):
    capacity = {r.resort: r for r in resort_capacity(spark).collect()}
    assert len(capacity) == 5 and capacity["Vail"].max_capacity == 7000
    assert capacity["Heavenly"].iana_timezone == "America/Los_Angeles"
    assert price_profiles(spark).count() == 5


def test_all_results_have_declared_schemas(make, sales):
    rides = make.rides(("1", "pass", "north", "a", "2024-01-01 09:00:00", 1))
    recorded = visits.daily_visits(rides, *sales)
    hours = hourly.hourly_summary_of(
        hourly.rides_per_visitor(rides), recorded, make.capacity(("north", 5, DENVER)))
    daily = rollups.daily_summary(hours)
    expected = {
        schemas.DAILY_VISITS: recorded,
        schemas.HOURLY_RESORT_SUMMARY: hours,
        schemas.DAILY_RESORT_SUMMARY: daily,
        schemas.WEEKLY_RESORT_SUMMARY: rollups.weekly_summary(daily),
        schemas.DAILY_NETWORK_METRICS: rollups.network_daily(daily),
        schemas.LIFT_PERFORMANCE: lifts.lift_performance(rides, "north"),
    }
    for schema, frame in expected.items():
        assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in schema]
    assert at("2024-01-01 09:00:00") == hours.first().ride_hour_timestamp
