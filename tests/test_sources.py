import json
import os
from decimal import Decimal
from types import SimpleNamespace

import pytest
from builders import at, day
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from turnstile import schemas
from turnstile.session import shared_dir
from turnstile.functions.display import clock_text
from turnstile.sources import payloads
from turnstile.sources.payloads import ride_payload
from turnstile.sources.tables import (
    append_rows, purge_acknowledged, replace_partitions, scan, scan_dates, staged,
)


def parsed(spark, schema, *lines):
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    return payloads.parse_lines(frame, schema)


TICKET = {
    "TXID": "t1", "RFID": "0xabc", "RESORT": "north", "DAYS": 3, "PRICE_USD": 345, "NAME": "A. Guest",
    "PURCHASE_TIME": "2024-03-10T02:30:00.250000+00:00",
    "EXPIRATION_TIME": "2024-03-16T02:30:00.250000+00:00",
    "ADDRESS": {"STREET_ADDRESS": "1 Main", "CITY": "X", "STATE": "CO", "POSTALCODE": "80000"},
    "PHONE": None, "EMAIL": None, "EMERGENCY_CONTACT": None, "DAYS_USED": 2,
}


def test_ticket_payload(spark):
    row = payloads.good_rows(parsed(spark, schemas.RESORT_TICKET, json.dumps(TICKET))).first()
    assert row.purchase_time == at("2024-03-10 02:30:00.250000")
    assert row.expiration_time == day("2024-03-16")
    assert (row.price_usd, row.days, row.address.city) == (Decimal("345.00"), 3, "X")
    assert row.phone is None and row.emergency_contact is None
    assert "days_used" not in row.asDict()


def test_ride_without_counter(spark):
    ride = {"TXID": "1", "RFID": "r", "RIDE_TIME": "2024-01-01T10:00:00+00:00", "LIFT": "a",
            "RESORT": "north"}
    row = payloads.good_rows(parsed(spark, schemas.LIFT_RIDE, json.dumps(ride))).first()
    assert row.activation_day_count is None and row.ride_time == at("2024-01-01 10:00:00")


def test_names_match_exactly(spark):
    row = payloads.good_rows(parsed(spark, schemas.LIFT_RIDE, '{"txid": "1", "RFID": "r"}')).first()
    assert (row.txid, row.rfid) == (None, "r")


@pytest.mark.parametrize("line", ["{broken", "", "[1, 2]"])
def test_unreadable_lines_go_aside(spark, line):
    rows = parsed(spark, schemas.LIFT_RIDE, line, '{"TXID": "1"}')
    assert [r.value for r in payloads.bad_lines(rows).collect()] == [line]
    assert [r.txid for r in payloads.good_rows(rows).collect()] == ["1"]


def test_payload_nulls(spark, make):
    rides = make.rides(("1", "r", "north", "a", "2024-01-01 10:00:00", None))
    assert json.loads(payloads.ride_payload(rides).first().value) == {
        "TXID": "1", "RFID": "r", "RESORT": "north", "LIFT": "a",
        "RIDE_TIME": "2024-01-01T10:00:00.000000+00:00"}
    passes = make.passes(("r", "783", "2024-01-01", "2024-12-31"))
    sale = json.loads(payloads.sale_payload(passes, schemas.SEASON_PASS).first().value)
    assert sale["PHONE"] is None and sale["ADDRESS"] is None
    assert sale["EXPIRATION_TIME"] == "2024-12-31T00:00:00+00:00"


def test_only_named_partitions_are_replaced(spark, make):
    path = shared_dir(spark, "table")
    first = make.visits(("north", "a", "2024-01-01 09:00:00", True, "1", 1, None),
                        ("north", "a", "2024-01-02 09:00:00", True, "1", 1, None))
    again = make.visits(("north", "b", "2024-01-02 09:00:00", True, "1", 1, None),
                        ("north", "c", "2024-01-02 09:00:00", True, "1", 1, None))
    assert replace_partitions(first, path, schemas.DAILY_VISITS, "visit_date") == 2
    assert replace_partitions(again, path, schemas.DAILY_VISITS, "visit_date") == 2
    stored = scan(spark, path, schemas.DAILY_VISITS)
    assert sorted((str(r.visit_date), r.rfid) for r in stored.collect()) == [
        ("2024-01-01", "a"), ("2024-01-02", "b"), ("2024-01-02", "c")]
    some = scan_dates(spark, path, schemas.DAILY_VISITS, "visit_date",
                      [day("2024-01-01"), day("2030-01-01")])
    assert [r.rfid for r in some.collect()] == ["a"]
    assert len(some.inputFiles()) == 1
    none = scan_dates(spark, path, schemas.DAILY_VISITS, "visit_date", [day("2030-01-01")])
    assert none.count() == 0 and none.columns == schemas.DAILY_VISITS.names


def test_purge(spark):
    path = shared_dir(spark, "buffer")
    rows = spark.range(1, 31).select("id", F.col("id").cast("string").alias("data"),
                                     F.floor((F.col("id") - 1) / 10).cast("int").alias("part"))
    replace_partitions(rows, path, rows.schema, "part")
    untouched = set(os.listdir(f"{path}/part=2"))
    purge_acknowledged(spark, path, rows.schema, "id", 15, "part")
    left = spark.read.parquet(path)
    assert sorted(r.id for r in left.select("id").collect()) == list(range(16, 31))
    assert not os.path.exists(f"{path}/part=0")
    assert set(os.listdir(f"{path}/part=2")) == untouched


def test_purge_by_escaped_names(spark):
    path = shared_dir(spark, "buffer")
    rows = spark.createDataFrame(
        [(1, "a:b"), (2, "a:b"), (None, "a:b"), (3, "c d/e"), (9, "c d/e"), (4, "gone:1"), (5, None), (None, "n")],
        "id long, part string")
    replace_partitions(rows, path, rows.schema, "part")
    purge_acknowledged(spark, path, rows.schema, "id", 5, "part")
    left = spark.read.schema(rows.schema).parquet(path).collect()
    assert sorted((r.id or 0, r.part) for r in left) == [(0, "a:b"), (0, "n"), (9, "c d/e")]
    assert not [name for name in os.listdir(path) if "gone" in name]


def test_replaced_partitions_without_rows_go(spark):
    path = shared_dir(spark, "replaced")
    rows = spark.createDataFrame(
        [(1, "x", 1), (2, "x", 2), (3, "y", 1), (4, "z", 1)], "id long, a string, b int")
    replace_partitions(rows, path, rows.schema, "a", "b")
    replace_partitions(rows.filter("id = 2"), path, rows.schema, "a", "b", replaced=[("x",), ("y", 1)])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 4]


def test_staged_copies_are_removed(spark):
    rows = spark.range(3)
    with staged(spark, rows, rows.schema, "copy") as copy:
        folder = os.path.dirname(copy.inputFiles()[0].removeprefix("file:").removeprefix("//"))
        assert copy.count() == 3 and os.path.exists(folder)
    assert not os.path.exists(folder)


def test_times_in_hours_the_session_zone_skips(spark, make):
    rides = make.rides(("1", "r", "north", "a", "2024-03-10 02:30:00", 1))
    line = ride_payload(rides).first().value
    assert json.loads(line)["RIDE_TIME"] == "2024-03-10T02:30:00.000000+00:00"
    shown = rides.select(clock_text(F.col("ride_time"))).first()[0]
    assert shown == "Sunday, 03/10/24 02:30:00 AM"


def test_append_matches_columns_by_name(spark, make):
    path = shared_dir(spark, "appended")
    rows = make.visits(("north", "a", "2024-01-01 09:00:00", True, "1", 1, None))
    append_rows(rows, path, schemas.DAILY_VISITS, "visit_date")
    turned = rows.select(*reversed(rows.columns)).withColumn("unknown", F.lit(1))
    append_rows(turned, path, schemas.DAILY_VISITS, "visit_date")
    stored = scan(spark, path, schemas.DAILY_VISITS)
    assert stored.count() == 2 and stored.distinct().count() == 1
    with pytest.raises(AnalysisException):
        append_rows(rows.drop("resort"), path, schemas.DAILY_VISITS, "visit_date")


def test_cluster_needs_a_shared_folder():
    def session(master, folder):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda name, default: folder),
            sparkContext=SimpleNamespace(master=master))

    for cluster in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(cluster, None), "x")
    assert shared_dir(session("yarn", "hdfs:///shared"), "x").startswith("hdfs:///shared/x-")
    assert shared_dir(session("local[2]", None), "x") != shared_dir(session("local[2]", None), "x")


def test_times_are_parsed_once(spark):
    rows = payloads.parse_lines(spark.createDataFrame([("{}",)], "value string"), schemas.LIFT_RIDE)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("unix_micros") == 1
