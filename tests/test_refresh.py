"""What a batch reads and publishes, and sales that come after the rides."""

import shutil
from datetime import timedelta

import pytest
from builders import day
from pyspark.sql import functions as F
from test_streaming import TABLES, batch_result, job_for, stored

from registry import live
from turnstile import schemas
from turnstile.operators import keyfilter, rollups
from turnstile.operators.hourly import block_of
from turnstile.plans.chain import Chain
from turnstile.session import shared_dir
from turnstile.sources import samples
from turnstile.sources.versions import published, snapshot
from turnstile.streaming import refresh
from turnstile.streaming.landing import AVAILABLE_NOW
from turnstile.streaming.refresh import FIRST_WRITER, RefreshJob

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    rides = samples.rides(spark, SF).filter("ride_time < '2024-01-04'").cache()
    return Chain(rides, samples.season_passes(spark, SF), samples.resort_tickets(spark, SF),
                 samples.capacity(spark))


def part(base, number, of=3):
    return base.rides.filter(F.pmod(F.hash("txid"), F.lit(of)) == number)


def test_no_earlier_ride_is_read_when_none_is_repeated(spark, base):
    job = job_for(spark, base)
    for i in range(3):
        job.refresh(part(base, i), i)
        # Every part of every day is touched again, but its stored rides are gone.
        shutil.rmtree(f"{job.root}/lift_ride/v={i + 1}".removeprefix("file:"))
    for name in TABLES:
        assert stored(spark, job, name) == batch_result(base, name), name


def test_rides_are_looked_up_where_a_repeat_is_suspected(spark, base):
    job = job_for(spark, base)
    job.refresh(part(base, 0, 2), 0)
    again = part(base, 0, 2).filter("ride_time < '2024-01-02'").limit(3)
    job.refresh(part(base, 1, 2).unionByName(again), 1)
    assert job.chain().rides.count() == base.rides.count()
    for name in TABLES:
        assert stored(spark, job, name) == batch_result(base, name), name


def test_full_filters_are_built_anew(spark, make, monkeypatch):
    monkeypatch.setattr(keyfilter, "LEAST_WORDS", 1)
    base = Chain(None, make.passes(), make.tickets(), make.capacity(("north", 5, "America/Denver")))
    job = job_for(spark, base)
    words = []
    for i in range(4):
        job.refresh(make.rides(*[(f"{i}-{n}", "m", "north", "a", f"2024-01-01 09:{n:02}:00", 1) for n in range(9)]), i)
        words.append(snapshot(spark, job.root).marks["keys"]["2024-01-01/1"])
    assert [keys for _, keys in words] == [9, 18, 27, 36]
    assert words[0][0] < words[1][0] and all(keyfilter.room(w) >= keys for w, keys in words)
    job.refresh(make.rides(*[(f"{i}-8", "m", "north", "a", "2024-01-01 09:08:00", 1) for i in range(4)]), 9)
    assert job.chain().rides.count() == 36 and job.chain().daily.first().total_rides == 36


def test_reader_sees_one_version_while_a_refresh_replaces_and_empties(spark, make):
    base = Chain(None, make.passes(), make.tickets(), make.capacity(("north", 5, "America/Denver")))
    job = job_for(spark, base)
    job.refresh(make.rides(("1", "m", "north", "a", "2024-01-01 09:00:00", 1),
                           ("2", "m", "north", "a", "2024-01-09 09:00:00", 1)), 0)
    reader = job.chain()
    levels = [reader.rides, reader.visits, reader.hourly, reader.daily, reader.weekly]
    before = [sorted(map(str, level.collect())) for level in levels]
    job.capacity = base.capacity.limit(0)
    job.refresh(make.rides(("3", "k", "north", "a", "2024-01-01 09:10:00", 1)), 1)
    assert [sorted(map(str, level.collect())) for level in levels] == before
    now = job.chain()
    assert [d.ride_date for d in now.daily.collect()] == [day("2024-01-09")]
    assert now.rides.count() == 3 and job.chain(version=1).rides.count() == 2
    assert job.expire(timedelta(0)) == [1]
    assert sorted(map(str, job.chain().daily.collect())) == sorted(map(str, now.daily.collect()))


def test_batch_that_breaks_off_changes_nothing_and_counts_once(spark, base, monkeypatch):
    job = job_for(spark, base)
    job.refresh(part(base, 0), 0)
    before = {name: stored(spark, job, name) for name in TABLES}
    with monkeypatch.context() as broken:
        broken.setattr(rollups, "weekly_summary", lambda daily: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            job.refresh(part(base, 1), 1)
    assert {name: stored(spark, job, name) for name in TABLES} == before
    for i in (1, 2, 2):
        job.refresh(part(base, i), i)
    for name in TABLES:
        assert stored(spark, job, name) == batch_result(base, name), name
    assert published(spark, job.root) == [1, 2, 3]


def late_sales(spark, make, policy):
    sold = {"passes": make.passes(), "tickets": make.tickets(("t", "north", "90", 3, "2024-01-01", "2024-02-01"))}
    root = shared_dir(spark, "late")
    job = RefreshJob(spark, None, lambda: sold["passes"], lambda: sold["tickets"],
                     make.capacity(("north", 9, "America/Denver")), f"{root}/tables", f"{root}/c", policy)
    rides = [(f"{m}{d}", m, "north", "a", f"2024-01-0{d} 09:00:00", 1) for m in "abt" for d in (1, 3, 8)]
    rides += [("b5", "b", "north", "a", "2024-01-05 09:00:00", 1), ("none", None, "north", "a", "2024-01-05 10:00:00", 1)]
    job.refresh(make.rides(*rides), 0)
    return job, sold, rides


@pytest.mark.parametrize("policy", ["earliest", FIRST_WRITER])
def test_late_sale_corrects_just_its_days(spark, make, policy):
    job, sold, rides = late_sales(spark, make, policy)
    root = job.root
    sold["passes"] = make.passes(("a", "800", "2024-01-01", "2024-12-31"))
    inbox = f"{root}-sales"
    sold["passes"].select("rfid").write.parquet(inbox)
    feed = spark.readStream.schema("rfid string").parquet(inbox)
    for _ in range(2):  # resumed without anything new
        job.start_sales(feed, f"{root}-sales-state", AVAILABLE_NOW).awaitTermination()
    tables = snapshot(spark, root).tables["daily_visits"]
    assert {name: held for name, held in tables.items() if held != [1]} == {
        f"visit_date=2024-01-0{d}": [2] for d in (1, 3, 8)}
    passes = {(v.rfid, str(v.visit_date)) for v in job.chain().visits.filter("has_season_pass").collect()}
    assert passes == {("a", f"2024-01-0{d}") for d in (1, 3, 8)}
    whole = Chain(make.rides(*rides), sold["passes"], sold["tickets"], job.capacity)
    for name in TABLES:
        assert stored(spark, job, name) == batch_result(whole, name), name


def test_second_sale_follows_the_policy(spark, make):
    for policy, price in (("earliest", 120), (FIRST_WRITER, 90)):
        job, sold, _ = late_sales(spark, make, policy)
        sold["tickets"] = make.tickets(("t", "north", "90", 3, "2024-01-01", "2024-02-01"),
                                       ("t", "north", "120", 4, "2024-01-02", "2024-02-01"))
        job.refresh_sales(sold["tickets"], 0)
        job.refresh_sales(sold["tickets"], 0)  # delivered again
        assert {v.purchase_price_usd for v in job.chain().visits.filter("rfid = 't'").collect()} == {price}
        job.refresh_sales(make.passes(("unseen", "1", "2024-01-01", "2024-12-31")), 1)
        assert job.chain().visits.count() == 10 + 1


def test_index_of_visit_days_is_compacted(spark, make):
    job, sold, _ = late_sales(spark, make, "earliest")
    job.refresh(make.rides(("x", "a", "north", "a", "2024-01-01 11:00:00", 1)), 1)
    job.compact([day("2024-01-01")])
    index = snapshot(spark, job.root).tables["visit_days"]
    assert all(len(held) == 1 for held in index.values())
    sold["passes"] = make.passes(("a", "800", "2024-01-01", "2024-12-31"))
    job.refresh_sales(sold["passes"], 0)
    assert job.chain().visits.filter("has_season_pass").count() == 3


def test_new_feed_may_count_its_batches_from_zero(spark, make):
    base = Chain(None, make.passes(), make.tickets(), make.capacity(("north", 5, "America/Denver")))
    root = shared_dir(spark, "feeds")
    for n, txid in enumerate("12"):
        inbox = f"{root}/inbox{n}"
        make.rides((txid, "m", "north", "a", "2024-01-01 09:00:00", 1)).write.parquet(inbox)
        feed = spark.readStream.schema(schemas.LIFT_RIDE).parquet(inbox)
        job = RefreshJob(spark, feed, lambda: base.passes, lambda: base.tickets, base.capacity,
                         f"{root}/tables", f"{root}/state{n}")
        job.start(AVAILABLE_NOW).awaitTermination()
    assert job.chain().daily.first().total_rides == 2


def test_few_suspects_are_sent_to_the_stored_rides(spark, base, monkeypatch):
    monkeypatch.setattr(refresh, "LOOKED_UP", 0)
    root = shared_dir(spark, "suspects")
    job = RefreshJob(spark, None, lambda: base.passes, lambda: base.tickets, base.capacity, f"{root}/tables", "")
    job.refresh(base.rides, 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        time = F.col("ride_time")
        again = base.rides.withColumns({"ride_date": F.to_date(time), "ride_block": block_of(F.hour(time))})
        parts = {(r.ride_date, r.ride_block): r["count"] for r in again.groupBy("ride_date", "ride_block").count().collect()}
        new = again.limit(1).withColumn("txid", F.lit("new"))
        left = job._unknown(again.unionByName(new), parts, snapshot(spark, job.root))
        assert [r.txid for r in left.collect()] == ["new"]
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_batches_do_not_derive_the_rides_again(spark):
    for rides in live.batches(live.kept_rides(spark, SF, shared_dir(spark, "given"))):
        plan = rides._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan and "given/rides" in plan
