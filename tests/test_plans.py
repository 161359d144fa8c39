"""The physical plans keep the properties the operators are built on."""

import re

import pytest
from builders import SF_SMALL

from registry import queries as q
from turnstile.operators import audits, hourly, lifts, visits
from turnstile.sources import samples
from turnstile.sources.tables import store_sales


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_first_ride_is_reduced_before_the_shuffle(spark):
    plan = plan_of(visits.first_rides(samples.bare_rides(spark, SF_SMALL)))
    assert re.search(r"row_number\(\), 1, Partial", plan)


def test_new_visits_use_an_anti_join(spark):
    firsts = visits.first_rides(samples.bare_rides(spark, SF_SMALL))
    assert "LeftAnti" in plan_of(visits.new_visits(firsts, firsts))


def test_hours_read_rides_once_for_activity_and_once_for_visits(spark, no_broadcast):
    plan = plan_of(q.chain(spark, SF_SMALL).hourly)
    assert "Expand" not in plan
    assert plan.count("WindowGroupLimit [resort") == 2


def test_enrichment_shuffles_visits_once(spark, no_broadcast):
    rides = samples.bare_rides(spark, SF_SMALL)
    firsts = visits.first_rides(rides)
    plan = plan_of(visits.enrich(
        firsts, samples.season_passes(spark, SF_SMALL), samples.resort_tickets(spark, SF_SMALL)))
    by_medium = re.findall(r"Exchange hashpartitioning\(rfid#\d+, \d+\)", plan)
    assert len(by_medium) == 3  # visits, passes and tickets, one each


def test_bucketed_sales_are_not_shuffled(spark, no_broadcast):
    firsts = visits.first_rides(samples.bare_rides(spark, SF_SMALL))
    passes, tickets = samples.season_passes(spark, SF_SMALL), samples.resort_tickets(spark, SF_SMALL)
    store_sales(passes, "season_pass_sold", 8)
    store_sales(tickets, "resort_ticket_sold", 8)
    sold = spark.table("season_pass_sold"), spark.table("resort_ticket_sold")
    looked_up = visits.enrich(firsts, *sold)
    plan = plan_of(looked_up)
    assert len(re.findall(r"Exchange hashpartitioning\(rfid#\d+, \d+\)", plan)) == 1
    assert sorted(map(str, looked_up.collect())) == sorted(
        map(str, visits.enrich(firsts, passes, tickets).collect()))


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_no_cartesian_products(spark, no_broadcast, name):
    if name.startswith(("stream_", "refresh_", "op", "pipeline")):
        pytest.skip("reads stored tables")
    assert "CartesianProduct" not in plan_of(q.QUERIES[name](spark, SF_SMALL))


def test_trailing_window_filters_in_the_scan(spark):
    plan = plan_of(lifts.trailing_rides(samples.bare_rides(spark, SF_SMALL), "view"))
    assert "Join" not in plan
    assert "EqualTo(event_type,view)" in plan
    assert re.search(r"DataFilters: \[[^\]]*Subquery", plan)


def test_stored_rides_are_pruned_by_date(spark, no_broadcast):
    for name in ("lift_performance", "lift_board", "reporting_clock"):
        plan = plan_of(q.QUERIES[name](spark, SF_SMALL))
        assert re.search(r"PartitionFilters: \[[^\]]*ride_date#\d+ >= ", plan), name


def test_lift_function_shuffles_no_ride_by_resort(spark, no_broadcast):
    plan = plan_of(q.QUERIES["lift_function"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lift_performance_reads_needed_columns(spark):
    plan = plan_of(lifts.lift_performance(samples.bare_rides(spark, SF_SMALL), "view"))
    assert not re.search(r"ReadSchema: struct<[^>]*event_id", plan)
    assert not re.search(r"ReadSchema: struct<[^>]*value", plan)


def test_gaps_never_order_all_rides_of_a_medium(spark, no_broadcast):
    plan = plan_of(audits.ride_gaps(samples.bare_rides(spark, SF_SMALL)))
    whole = re.findall(r"Window \[lag\((\w+)#\d+.*?windowspecdefinition\((rfid#\d+), (\S+)", plan)
    assert {(value, third.split("#")[0]) for value, _, third in whole} == {
        ("ride_time", "_hour"), ("_last", "_hour")}


def test_visitor_hours_count_before_the_shuffle(spark):
    plan = plan_of(hourly.rides_per_visitor(samples.bare_rides(spark, SF_SMALL)))
    assert "partial_count" in plan and plan.count("Exchange") == 1
