from decimal import Decimal

import pytest
from builders import day, rows_of

from turnstile import schemas
from turnstile.plans import catalog, procedures, reports
from turnstile.plans.chain import Chain, materialize
from turnstile.session import shared_dir

MOUNTAIN, PACIFIC = "America/Denver", "America/Los_Angeles"


@pytest.fixture(scope="module")
def tables(make):
    rides = make.rides(
        ("1", "pass", "north", "a", "2024-01-01 09:00:00", 1),
        ("2", "pass", "north", "a", "2024-01-09 09:00:00", 2),
        ("3", "ticket", "south", "a", "2024-01-09 10:10:00", 1),
        ("4", "pass", "north", "b", "2024-01-10 02:00:00", 3),
        ("5", "pass", "north", "b", "2024-01-10 02:20:00", 3),
    )
    return Chain(
        rides,
        make.passes(("pass", "800", "2024-01-01", "2024-12-31")),
        make.tickets(("ticket", "south", "90", 3, "2024-01-09", "2024-01-15")),
        make.capacity(("north", 2, MOUNTAIN), ("south", 4, PACIFIC)),
    )


@pytest.fixture(scope="module")
def clock(tables):
    return reports.period_clock(tables.hourly)


def test_clock(tables):
    row = reports.reporting_clock(
        tables.rides, tables.passes, tables.tickets, tables.hourly).first()
    assert str(row.latest_world_timestamp) == "2024-01-10 02:20:00"
    assert (row["current_date"], row.current_hour) == (day("2024-01-10"), 2)
    assert row.prev_month_start == day("2023-12-01")


def test_clock_needs_every_source(tables):
    row = reports.reporting_clock(
        tables.rides, tables.passes.limit(0), tables.tickets, tables.hourly).first()
    assert row.latest_world_timestamp is None and row.current_hour == 2


def test_unknown_resort(tables):
    assert reports.resort_clock(tables.hourly, "nowhere").first().reporting_time is None
    assert reports.resort_operations(tables.hourly, "nowhere").count() == 0
    assert reports.hourly_pattern(tables.hourly, tables.capacity, "nowhere").count() == 0
    line = reports.clock_line(
        tables.rides, tables.passes, tables.tickets, tables.hourly, tables.capacity, "nowhere")
    assert line.first().reporting_time == "--" and line.first().time_zone is None


@pytest.mark.parametrize(
    ("period", "now", "before"),
    [("Today", (1, 2), (2, 2)), ("Last 7 Days", (3, 4), (1, 1)), ("Month to Date", (4, 5), (None, None))],
)
def test_kpis(tables, clock, period, now, before):
    row = reports.network_kpis(tables.network, clock, period).first()
    assert (row.total_visitors, row.total_rides) == now
    assert (row.prev_visitors, row.prev_rides) == before


def test_kpi_changes_and_cards(tables, clock):
    kpis = reports.network_kpis(tables.network, clock, "Today")
    assert reports.kpi_changes(kpis).first().visitor_change_pct == -50.0
    card = reports.kpi_cards(kpis).first()
    assert (card.visitors, card.visitors_change, card.revenue) == ("1", "-50.0%", "$40")
    assert card.capacity == "50.0% 🟢"


def test_status_and_series(tables, clock):
    status = reports.status_by_resort(tables.daily, clock, "Last 7 Days")
    assert [(r.resort, r.capacity_pct) for r in status.collect()] == [("north", 50.0), ("south", 25.0)]
    shown = reports.status_table(status)
    assert shown.columns == ["Resort", "Visitors", "Capacity", "Revenue", "Status"]
    assert shown.first().Revenue == "$80"
    series = reports.time_series(tables.daily, clock, "Today")
    assert rows_of(series, "ride_date", "resort", "visitors") == [(day("2024-01-10"), "north", 1)]
    compared = reports.resort_comparison(tables.daily, clock, "Month to Date")
    assert rows_of(compared, "resort", "total_rides") == [("north", 4), ("south", 1)]


def test_hourly_pattern_is_local(tables):
    row = reports.hourly_pattern(tables.hourly, tables.capacity, "south").first()
    assert (row.ride_hour, row.ride_date) == (2, day("2024-01-09"))
    row = reports.hourly_pattern(tables.hourly, tables.capacity, "north").first()
    assert (row.ride_hour, row.ride_date) == (19, day("2024-01-09"))


def test_operations_and_revenue(tables):
    row = reports.resort_operations(tables.hourly, "north").first()
    assert (row.current_visitors, row.current_hour_rides) == (1, 2)
    assert row.current_hour_revenue == Decimal("40.00000000")
    today = reports.revenue_today(tables.performance, tables.hourly, "north")
    assert today.first().revenue_target_usd == Decimal("140.00")
    assert reports.revenue_card(today).first().achievement == "28.6% 🔴"


def test_weeks(tables):
    weeks = reports.latest_weeks(tables.weekly, "north")
    assert [str(r.week_start_date) for r in weeks.collect()] == ["2024-01-08", "2024-01-01"]
    assert reports.latest_weeks(tables.weekly, "north", 1).count() == 1
    shown = reports.weeks_table(weeks)
    assert shown.columns == list(reports.WEEKLY_LABELS.values())
    assert shown.first()["Week Starting"] == "2024-01-08"
    assert reports.relabel(weeks.select("week_start_date"), reports.WEEKLY_LABELS).columns == [
        "Week Starting"]


def test_network_clock_line(tables):
    line = reports.clock_line(
        tables.rides, tables.passes, tables.tickets, tables.hourly, tables.capacity, "south",
        reference_resort=True).first()
    assert line.reporting_time == "Tuesday, 01/09/24 06:00:00 PM"
    assert line.latest_event == "Tuesday, 01/09/24 06:20:00 PM"


def test_published_views_and_function(spark, tables):
    catalog.publish(tables)
    procedures.register_lift_function(spark)
    names = {r.name for r in catalog.list_objects(spark, "view").collect()}
    assert set(catalog.VIEWS) <= names
    functions = [r.name for r in catalog.list_objects(spark, "function").collect()]
    assert any(name.endswith(procedures.FUNCTION) for name in functions)
    by_text = spark.sql(f"SELECT * FROM {procedures.FUNCTION}('north')")
    by_call = procedures.resort_lift_performance(spark, "north")
    assert sorted(map(str, by_text.collect())) == sorted(map(str, by_call.collect()))
    assert by_call.count() == 1


def test_materialized_chain_equals_lazy_chain(spark, tables):
    stored = materialize(spark, tables, shared_dir(spark, "chain"))
    for name in ("visits", "hourly", "daily", "weekly", "network", "performance"):
        assert sorted(map(str, getattr(stored, name).collect())) == sorted(
            map(str, getattr(tables, name).collect())), name
    assert stored.visitor_hours.schema.names == schemas.VISITOR_HOURS.names
