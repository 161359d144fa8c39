import json
import os
from datetime import date, timedelta

from builders import at
from pyspark.sql import functions as F

from turnstile import schemas
from turnstile.operators import hourly, sketches
from turnstile.session import shared_dir
from turnstile.streaming import history
from turnstile.streaming.history import InputLog, RefreshLog, compact_history, input_history, refresh_history


def log(spark, path, batch, rows, target="weekly"):
    entry = RefreshLog(spark, path, batch, input_rows=rows)
    entry.step(target, 1, lambda: rows)
    entry.step("other", 2, lambda: 0)
    entry.save()


def test_replayed_batch_replaces_its_entries(spark):
    path = shared_dir(spark, "history")
    for batch, rows in ((0, 5), (1, 7), (1, 9)):
        log(spark, path, batch, rows)
    got = refresh_history(spark, path, "week").collect()
    assert [(r.target, r.row_count, r.input_rows) for r in got] == [("weekly", 9, 9), ("weekly", 5, 5)]
    assert all(r.refresh_start_time <= r.refresh_end_time for r in got)
    assert refresh_history(spark, path).count() == 4


def test_dates_are_compacted_and_counted_once(spark, monkeypatch):
    path = shared_dir(spark, "history")
    for batch in range(4):
        log(spark, path, batch, batch)
    today = os.listdir(path)[0].removeprefix("date=")
    before = refresh_history(spark, path).collect()
    assert compact_history(spark, path, date.fromisoformat(today)) == []
    with monkeypatch.context() as broken:
        # Stops after the joined file was written.
        broken.setattr(history.files, "delete", lambda *_: 1 / 0)
        try:
            compact_history(spark, path, date.fromisoformat(today) + timedelta(days=1))
        except ZeroDivisionError:
            pass
    assert refresh_history(spark, path).collect() == before
    assert compact_history(spark, path, date.fromisoformat(today) + timedelta(days=1)) == [today]
    assert compact_history(spark, path, date.fromisoformat(today) + timedelta(days=1)) == []
    assert [n for n in os.listdir(f"{path}/date={today}") if n.endswith(".json")] == ["compacted.json"]
    assert refresh_history(spark, path).collect() == before
    log(spark, path, 9, 1)
    assert refresh_history(spark, path).count() == 10


def test_batch_that_ran_twice_over_midnight_counts_once(spark):
    path = shared_dir(spark, "history")
    log(spark, path, 3, 5)
    folder = next(name for name in os.listdir(path))
    os.makedirs(f"{path}/date=2000-01-01")
    name = next(n for n in os.listdir(f"{path}/{folder}") if n.endswith(".json"))
    with open(f"{path}/{folder}/{name}") as lines, open(f"{path}/date=2000-01-01/{name}", "w") as old:
        for line in lines:
            old.write(json.dumps({**json.loads(line), "row_count": 1, "refresh_end_time": "2000-01-01T00:00:00"}) + "\n")
    assert [r.row_count for r in refresh_history(spark, path, "weekly").collect()] == [5]


def test_listener_keeps_input_rows_rates_and_offsets(spark):
    path = shared_dir(spark, "input")

    class Source:
        startOffset, endOffset = None, '{"logOffset":0}'

    class Progress:
        id, batchId, timestamp, numInputRows = "q", 0, "2024-01-01T10:00:00.500Z", 12
        inputRowsPerSecond, processedRowsPerSecond, batchDuration, sources = float("nan"), 3.5, 40, [Source]

    class Event:
        progress = Progress

    listener = InputLog(spark, path)
    for _ in range(2):
        listener.onQueryProgress(Event)
    row = input_history(spark, path).collect()
    assert len(row) == 1 and (row[0].input_rows, row[0].processed_rows_per_second) == (12, 3.5)
    assert row[0].batch_start_time == at("2024-01-01 10:00:00.500")
    assert row[0].end_offset == json.dumps(['{"logOffset":0}'])


def visitors(spark, make, *rows):
    rides = make.rides(*[(str(i), r, s, "a", t, 1) for i, (r, s, t) in enumerate(rows)])
    return sketches.hourly_sketches(hourly.visitor_hours(rides))


def test_sketches_count_a_person_once_in_every_union(spark, make):
    held = visitors(
        spark, make, ("a", "north", "2024-01-01 09:00:00"), ("a", "north", "2024-01-01 15:00:00"),
        ("a", "north", "2024-01-03 09:00:00"), ("a", "south", "2024-01-03 15:00:00"), ("b", "south", "2024-01-03 15:10:00"),
        ("a", "north", "2024-01-08 09:00:00"), (None, "north", "2024-01-01 10:00:00"))
    assert held.columns == schemas.VISITOR_SKETCHES.names and held.count() == 5
    days = {(str(r.ride_date)[8:], r.resort): r.unique_visitors for r in sketches.daily_unique_visitors(held).collect()}
    assert days == {("01", "north"): 1, ("03", "north"): 1, ("03", "south"): 2, ("08", "north"): 1}
    weeks = {(str(r.week_start_date)[8:], r.resort): r.unique_visitors for r in sketches.weekly_unique_visitors(held).collect()}
    assert weeks == {("01", "north"): 1, ("01", "south"): 2, ("08", "north"): 1}
    network = {str(r.week_start_date)[8:]: r.unique_visitors for r in sketches.network_unique_visitors(held).collect()}
    assert network == {"01": 2, "08": 1}
    assert sketches.daily_unique_visitors(held.limit(0)).count() == 0


def test_large_unions_keep_to_the_error(spark):
    many = spark.range(400_000).select(
        F.lit("2024-01-01").cast("date").alias("ride_date"), (F.col("id") % 24).cast("int").alias("ride_hour"),
        F.lit("north").alias("resort"), F.pmod(F.hash("id"), F.lit(90_000)).cast("string").alias("rfid"),
        F.lit(0).alias("ride_block"))
    held = sketches.hourly_sketches(many)
    exact = many.select("rfid").distinct().count()
    estimate = sketches.daily_unique_visitors(held).first().unique_visitors
    assert 0 < abs(estimate - exact) <= 4 * sketches.ERROR * exact
    assert held.agg(F.max(F.length("visitors"))).first()[0] < 8192
