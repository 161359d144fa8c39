import json
import os
import re
import time
from datetime import timedelta

import pytest
from builders import at, day
from pyspark.sql import functions as F

from turnstile import schemas
from turnstile.operators.lifts import lift_performance, trailing_rides
from turnstile.plans.chain import Chain
from turnstile.plans.reports import reporting_clock
from turnstile.session import shared_dir
from turnstile.sources import samples
from turnstile.sources.tables import scan
from turnstile.sources.versions import snapshot
from turnstile.streaming.history import refresh_history
from turnstile.streaming.landing import (
    AVAILABLE_NOW, drop_repeats, landed_rows, lines_stream, rejected_lines, rides_stream, start_ingest,
)
from turnstile.streaming.live import (
    exact_hours, hourly_activity_stream, live_hours, start_changes, stored_changes,
)
from turnstile.streaming.refresh import FIRST_WRITER, RefreshJob

SF = "/root/testdata/sf0.001"
TABLES = {
    "daily_visits": schemas.DAILY_VISITS,
    "hourly_resort_summary": schemas.HOURLY_RESORT_SUMMARY,
    "daily_resort_summary": schemas.DAILY_RESORT_SUMMARY,
    "weekly_resort_summary": schemas.WEEKLY_RESORT_SUMMARY,
}


def job_for(spark, base, feed=None, policy="earliest", root=None):
    root = root or shared_dir(spark, "job")
    return RefreshJob(
        spark, feed, lambda: base.passes, lambda: base.tickets, base.capacity,
        f"{root}/tables", f"{root}/checkpoint", policy)


def stored(spark, job, name):
    return sorted(map(str, snapshot(spark, job.root).scan(name, TABLES[name]).collect()))


def batch_result(base, name):
    attribute = {"daily_visits": "visits", "hourly_resort_summary": "hourly",
                 "daily_resort_summary": "daily", "weekly_resort_summary": "weekly"}[name]
    return sorted(map(str, getattr(base, attribute).collect()))


@pytest.fixture(scope="module")
def base(spark):
    rides = samples.rides(spark, SF).filter("ride_time < '2024-01-10'").cache()
    return Chain(rides, samples.season_passes(spark, SF), samples.resort_tickets(spark, SF),
                 samples.capacity(spark))


def split(base, parts, shuffled):
    """The rides in ``parts`` batches, by time or by a hash."""
    if shuffled:
        number = F.pmod(F.hash("txid"), F.lit(parts))
    else:
        hours = (F.unix_date(F.to_date("ride_time")) - 19723) * 24 + F.hour("ride_time")
        number = F.least(F.floor(hours / (9 * 24 / parts)), F.lit(parts - 1))
    return [base.rides.filter(number == i) for i in range(parts)]


@pytest.mark.parametrize(("parts", "shuffled"), [(1, False), (3, False), (3, True)])
def test_batches_add_up(spark, base, parts, shuffled):
    job = job_for(spark, base)
    batches = split(base, parts, shuffled)
    for i, rides in enumerate(batches):
        job.refresh(rides, i)
    if shuffled:
        job.refresh(batches[1], 1)  # replayed after a failure
    for name in TABLES:
        assert stored(spark, job, name) == batch_result(base, name), name
    log = refresh_history(spark, f"{job.root}/refresh_history", "weekly")
    assert [r.target for r in log.collect()] == ["weekly_resort_summary"] * parts


def test_first_writer_keeps_what_it_recorded(spark, make):
    base = Chain(
        None, make.passes(("m", "800", "2024-01-01", "2024-12-31")).limit(0),
        make.tickets().limit(0), make.capacity(("north", 5, "America/Denver")))
    late = make.rides(("1", "m", "north", "early", "2024-01-01 09:00:00", 1))
    first = make.rides(("2", "m", "north", "late", "2024-01-01 13:00:00", 1))
    for policy, lift in (("earliest", "early"), (FIRST_WRITER, "late")):
        job = job_for(spark, base, policy=policy)
        job.refresh(first, 0)
        job.refresh(late, 1)
        job.refresh(late, 1)
        visits = job.chain().visits.collect()
        assert [v.first_lift for v in visits] == [lift]


def test_first_writer_equals_batch_in_time_order(spark, base):
    job = job_for(spark, base, policy=FIRST_WRITER)
    for i, rides in enumerate(split(base, 3, shuffled=False)):
        job.refresh(rides, i)
    for name in TABLES:
        assert stored(spark, job, name) == batch_result(base, name), name


@pytest.mark.parametrize("policy", ["earliest", FIRST_WRITER])
def test_late_sale_is_repaired(spark, make, policy):
    sold = []
    nobody = make.passes(("x", "1", "2024-01-01", "2024-12-31")).limit(0)
    root = shared_dir(spark, "repair")
    job = RefreshJob(
        spark, None, lambda: sold[0] if sold else nobody, lambda: make.tickets().limit(0),
        make.capacity(("north", 5, "America/Denver")), f"{root}/tables", f"{root}/c", policy)
    job.refresh(make.rides(("1", "m", "north", "a", "2024-01-01 09:00:00", 1)), 0)
    before = job.chain().hourly.first()
    assert before.total_recognized_revenue == 0 and before.active_passes == 0
    sold.append(make.passes(("m", "800", "2024-01-01", "2024-12-31")))
    job.repair([day("2024-01-01")], 0)
    after = job.chain().hourly.first()
    assert after.total_recognized_revenue == 40 and after.active_passes == 1


def test_rides_without_time_are_kept(spark, make):
    base = Chain(None, make.passes(), make.tickets(),
                 make.capacity(("north", 5, "America/Denver")))
    job = job_for(spark, base)
    job.refresh(make.rides(("0", "m", "north", "a", None, 1)), 0)
    job.refresh(make.rides(("1", "m", "north", "a", None, 1),
                           ("2", "m", "north", "a", "2024-01-01 09:00:00", 1)), 1)
    tables = job.chain()
    assert sorted(r.txid for r in tables.rides.collect()) == ["0", "1", "2"]
    assert tables.daily.first().total_rides == 1


def test_reports_on_refreshed_tables(spark, base):
    job = job_for(spark, base)
    job.refresh(base.rides, 0)
    tables = job.chain()
    for resort in ("view", "nowhere"):
        for window in ({"minutes": 1440}, {"as_of": at("2024-01-05 12:00:00"), "minutes": 600}):
            direct = lift_performance(base.rides, resort, **window)
            pruned = lift_performance(tables.rides, resort, hourly=tables.hourly, **window)
            assert sorted(map(str, pruned.collect())) == sorted(map(str, direct.collect()))
    assert sorted(map(str, tables.network.collect())) == sorted(map(str, base.network.collect()))
    for hours in (tables.hourly, tables.hourly.limit(0)):
        clocks = [reporting_clock(t.rides, t.passes, t.tickets, hours) for t in (tables, base)]
        assert clocks[0].collect() == clocks[1].collect()
    window = trailing_rides(tables.rides, "view", 60, hourly=tables.hourly)
    window.collect()
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*ride_date#\d+ >= [^\]]*[Ss]ubquery", plan)
    unreported = tables.hourly.limit(0)
    assert lift_performance(tables.rides, "view", hourly=unreported).count() > 0


def test_unknown_policy(spark, base):
    with pytest.raises(ValueError):
        job_for(spark, base, policy="latest")


def test_pause_and_resume(spark, base):
    root = shared_dir(spark, "resume")
    inbox = f"{root}/inbox"
    early, late = split(base, 2, shuffled=False)
    early.coalesce(1).write.parquet(inbox)
    job = job_for(spark, base, rides_stream(spark, inbox, schemas.LIFT_RIDE, max_files=1), root=root)
    assert job.describe() == {"state": "new"}
    job.start(AVAILABLE_NOW).awaitTermination()
    late.coalesce(1).write.mode("append").parquet(inbox)
    resumed = job_for(spark, base, rides_stream(spark, inbox, schemas.LIFT_RIDE), root=root)
    resumed.start({"processingTime": "1 second"}).processAllAvailable()
    assert resumed.describe()["state"] == "running"
    assert resumed.describe()["last_batch"] == 1
    resumed.pause()
    assert resumed.describe()["state"] == "stopped"
    assert stored(spark, resumed, "weekly_resort_summary") == batch_result(
        base, "weekly_resort_summary")


RIDE = {"TXID": "1", "RFID": "r", "RESORT": "north", "LIFT": "a",
        "RIDE_TIME": "2024-01-01T10:00:00+00:00"}


def run_ingest(spark, folder, **options):
    query = start_ingest(
        lines_stream(spark, f"{folder}/inbox", **options), schemas.LIFT_RIDE,
        f"{folder}/rides", f"{folder}/state", AVAILABLE_NOW)
    query.awaitTermination()
    return landed_rows(spark, f"{folder}/rides", schemas.LIFT_RIDE)


def write_lines(folder, name, *lines):
    os.makedirs(f"{folder}/inbox", exist_ok=True)
    text = "".join((line if isinstance(line, str) else json.dumps(line)) + "\n" for line in lines)
    with open(f"{folder}/inbox/{name}", "w") as out:
        out.write(text)


def test_ingest_keeps_every_line(spark, tmp_path):
    write_lines(tmp_path, "1.json", RIDE, RIDE, "{broken")
    run_ingest(spark, tmp_path, max_files=1)
    write_lines(
        tmp_path, "2.json",
        {**RIDE, "TXID": "2", "RIDE_TIME": "2023-12-01T10:00:00+0000"},  # a month late
        {**RIDE, "TXID": "3", "RIDE_TIME": "2024-01-01T10:00:00.5+02"},
        {**RIDE, "TXID": "4", "RIDE_TIME": "not a time"},
        {**RIDE, "TXID": "5", "RIDE_TIME": None})
    rows = {r.txid: r.ride_time for r in run_ingest(spark, tmp_path, max_files=1).collect()}
    assert rows == {"1": at("2024-01-01 10:00:00"), "2": at("2023-12-01 10:00:00"),
                    "3": at("2024-01-01 08:00:00.5"), "5": None}
    assert landed_rows(spark, f"{tmp_path}/rides", schemas.LIFT_RIDE).count() == 5
    lost = rejected_lines(spark, f"{tmp_path}/rides", schemas.LIFT_RIDE).collect()
    assert sorted(r.value[-30:] for r in lost) == sorted(
        ["{broken", json.dumps({**RIDE, "RIDE_TIME": "not a time"})[-30:]])


def test_archived_files_are_landed_first(spark, tmp_path):
    for run in range(2):
        for i in range(15):
            rides = [{**RIDE, "TXID": f"{run}-{i}-{n}"} for n in range(3)]
            write_lines(tmp_path, f"{run}-{i}.json", *rides)
        rows = run_ingest(spark, tmp_path, max_files=1, archive=f"{tmp_path}/read")
        assert rows.select("txid").distinct().count() == 45 * (run + 1)


def test_redelivered_rides_count_once(spark, base):
    job = job_for(spark, base)
    for i, rides in enumerate([base.rides, base.rides.sample(0.3, 1), base.rides.sample(0.3, 2)]):
        job.refresh(rides, i)
    for name in TABLES:
        assert stored(spark, job, name) == batch_result(base, name), name
    assert job.chain().rides.count() == base.rides.count()


@pytest.mark.parametrize("policy", ["earliest", FIRST_WRITER])
def test_compaction_changes_no_table(spark, base, policy):
    job = job_for(spark, base, policy=policy)
    batches = split(base, 3, shuffled=policy == "earliest")
    for i, rides in enumerate(batches[:2]):
        job.refresh(rides, i)
    days = [day(f"2024-01-0{n}") for n in range(1, 6)]
    before = sorted(map(str, job.chain().rides.collect()))
    job.compact(days)
    job.compact(days)
    assert sorted(map(str, job.chain().rides.collect())) == before
    parts = snapshot(spark, job.root).tables["lift_ride"]
    assert len(parts["ride_date=2024-01-01/ride_block=1"]) == 1
    job.refresh(batches[1], 1)  # replayed
    job.refresh(batches[2], 2)
    for name in TABLES:
        assert stored(spark, job, name) == batch_result(base, name), name


def test_emptied_hours_leave_the_tables(spark, make):
    base = Chain(None, make.passes(), make.tickets(), make.capacity(("north", 5, "America/Denver")))
    job = job_for(spark, base)
    rides = make.rides(("1", "m", "north", "a", "2024-01-01 09:00:00", 1))
    job.refresh(rides, 0)
    assert job.chain().hourly.count() == 1
    job.capacity = base.capacity.limit(0)
    job.refresh(make.rides(("2", "m", "north", "a", "2024-01-01 09:10:00", 1)), 1)
    assert job.chain().hourly.count() == 0 and job.chain().daily.count() == 0


def test_repeats_are_dropped(spark, make):
    root = shared_dir(spark, "repeats")
    rides = make.rides(("1", "r", "north", "a", "2024-01-01 10:00:00", 1),
                       ("2", "r", "north", "a", "2024-01-01 10:10:00", 1))
    for _ in range(2):
        rides.coalesce(1).write.mode("append").parquet(f"{root}/inbox")
    feed = rides_stream(spark, f"{root}/inbox", schemas.LIFT_RIDE, max_files=1)
    query = (drop_repeats(feed, "txid", "ride_time", "1 hour").writeStream.format("parquet")
             .option("checkpointLocation", f"{root}/c").trigger(**AVAILABLE_NOW)
             .start(f"{root}/out"))
    query.awaitTermination()
    assert scan(spark, f"{root}/out", schemas.LIFT_RIDE).count() == 2


def test_streaming_hours(spark, make):
    root = shared_dir(spark, "hours")
    make.rides(
        ("1", "a", "north", "x", "2024-03-10 02:10:00", 1),
        ("2", "a", "north", "x", "2024-03-10 02:50:00", 1),
        ("3", "b", "north", "x", "2024-03-10 02:59:59", 1),
        ("4", "b", "north", "x", "2024-03-10 09:00:00", 1),
    ).coalesce(1).write.parquet(f"{root}/inbox")
    feed = rides_stream(spark, f"{root}/inbox", schemas.LIFT_RIDE)
    query = (hourly_activity_stream(feed).writeStream.format("memory").queryName("hours")
             .outputMode("complete").trigger(**AVAILABLE_NOW)
             .option("checkpointLocation", f"{root}/c").start())
    query.awaitTermination()
    got = {str(r.ride_hour_timestamp): (r.total_rides, r.visitor_count)
           for r in spark.table("hours").collect()}
    assert got == {"2024-03-10 02:00:00": (3, 2), "2024-03-10 09:00:00": (1, 1)}


def hours_after(spark, root, rides, **options):
    """(live, exact) hours once more rides came, as {hour: (rides, visitors)}."""
    rides.coalesce(1).write.mode("append").parquet(f"{root}/inbox")
    feed = rides_stream(spark, f"{root}/inbox", schemas.LIFT_RIDE)
    start_changes(feed, f"{root}/changes", f"{root}/c", AVAILABLE_NOW, **options).awaitTermination()
    changes = stored_changes(spark, f"{root}/changes")
    return [{str(r.ride_hour_timestamp)[11:13]: (r.total_rides, r.visitor_count) for r in hours(changes).collect()}
            for hours in (live_hours, exact_hours)]


def test_exact_hours_are_corrected_by_late_rides(spark, make):
    root = shared_dir(spark, "changes")
    first = make.rides(("1", "a", "north", "x", "2024-03-10 02:10:00", 1), ("2", "a", "north", "x", "2024-03-10 02:50:00", 1),
                       ("3", "b", "north", "x", "2024-03-10 09:00:00", 1), ("4", None, "north", "x", "2024-03-10 09:00:00", 1),
                       ("5", "a", "north", "x", None, 1))
    assert hours_after(spark, root, first) == [{"02": (2, 1), "09": (2, 1)}] * 2
    late = make.rides(("6", "a", "north", "x", "2024-03-10 02:59:59", 1), ("7", "c", "north", "x", "2024-03-10 02:00:00", 1),
                      ("8", "z", "north", "x", "2024-06-01 23:00:00", 1))
    assert hours_after(spark, root, late) == [{"02": (4, 2), "09": (2, 1), "23": (1, 1)}] * 2
    # Three months behind the feed, and still counted.
    later = make.rides(("9", "b", "north", "x", "2024-03-10 02:30:00", 1))
    assert hours_after(spark, root, later) == [{"02": (5, 3), "09": (2, 1), "23": (1, 1)}] * 2


def test_exact_hours_after_state_has_expired(spark, make):
    root, short = shared_dir(spark, "expired"), timedelta(milliseconds=1)
    ride = [("1", "a", "north", "x", "2024-03-10 02:10:00", 1)]
    hours_after(spark, root, make.rides(*ride), kept=short)
    time.sleep(0.1)
    hours_after(spark, root, make.rides(("2", "b", "north", "x", "2024-03-10 05:10:00", 1)), kept=short)
    live, exact = hours_after(spark, root, make.rides(("3", "a", "north", "x", "2024-03-10 02:20:00", 1)), kept=short)
    assert live == {"02": (2, 2), "05": (1, 1)}
    assert exact == {"02": (2, 1), "05": (1, 1)}


def test_exact_hours_keep_state_without_python(spark, make):
    root = shared_dir(spark, "native")
    rides = make.rides(("1", "a", "north", "x", "2024-03-10 02:10:00", 1))
    rides.coalesce(1).write.parquet(f"{root}/inbox")
    query = start_changes(
        rides_stream(spark, f"{root}/inbox", schemas.LIFT_RIDE), f"{root}/changes", f"{root}/c", AVAILABLE_NOW)
    query.awaitTermination()
    state = [operator["operatorName"] for progress in query.recentProgress for operator in progress["stateOperators"]]
    assert set(state) == {"dedupeWithinWatermark"}
    assert stored_changes(spark, f"{root}/changes").count() == 2
