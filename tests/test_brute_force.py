"""Window operators against plain loops, on rides with many ties and hour edges."""

import random
from datetime import datetime, timedelta

import pytest

from turnstile import schemas
from turnstile.operators import audits, hourly, visits


@pytest.fixture(scope="module", params=[1, 2, 3])
def random_rides(request):
    dice = random.Random(request.param)
    start = datetime(2024, 3, 9, 22)
    rows = []
    for i in range(400):
        # Half of all rides belong to one medium; times fall on few minutes.
        rfid = "hot" if dice.random() < 0.5 else f"m{dice.randrange(12)}"
        time = start + timedelta(minutes=dice.choice([0, 1, 59, 60, 61, 119, 120]) + 60 * dice.randrange(60))
        rows.append((f"{dice.randrange(10**6):06}-{i}", rfid, dice.choice("ns"), dice.choice("abc"), time, 1))
    return rows


def test_first_rides(spark, random_rides):
    best = {}
    for txid, rfid, resort, lift, time, _ in random_rides:
        key = (resort, rfid, time.date())
        best[key] = min(best.get(key, (time, txid, lift)), (time, txid, lift))
    got = visits.first_rides(spark.createDataFrame(random_rides, schemas.LIFT_RIDE)).collect()
    assert {(r.resort, r.rfid, r.visit_date): (r.first_ride_time, r.first_lift) for r in got} == {
        key: (time, lift) for key, (time, _, lift) in best.items()}
    assert len(got) == len(best)


def test_ride_gaps(spark, random_rides):
    expected, last = {}, {}
    for txid, rfid, _, _, time, _ in sorted(random_rides, key=lambda r: (r[1], r[4], r[0])):
        expected[txid] = last.get(rfid)
        last[rfid] = time
    got = audits.ride_gaps(spark.createDataFrame(random_rides, schemas.LIFT_RIDE)).collect()
    assert {r.txid: r.previous_ride_time for r in got} == expected
    assert len(got) == len(random_rides)
    for r in got:
        gap = None if r.previous_ride_time is None else r.ride_time - r.previous_ride_time
        assert r.too_fast == (gap is not None and gap < timedelta(minutes=10))
        assert r.rested == (gap is not None and gap >= timedelta(minutes=30))


def test_activation_days(spark, random_rides):
    days = {}
    for _, rfid, _, _, time, _ in random_rides:
        days.setdefault(rfid, set()).add(time.date())
    got = audits.activation_days(spark.createDataFrame(random_rides, schemas.LIFT_RIDE)).collect()
    numbers = {r.txid: r.activation_day_count for r in got}
    assert numbers == {
        txid: sorted(days[rfid]).index(time.date()) + 1
        for txid, rfid, _, _, time, _ in random_rides}


def test_visitor_hours(spark, random_rides):
    groups = {}
    for txid, rfid, resort, lift, time, _ in random_rides:
        groups.setdefault((time.date(), time.hour, resort, rfid), []).append((time, txid, lift))
    got = hourly.visitor_hours(spark.createDataFrame(random_rides, schemas.LIFT_RIDE)).collect()
    assert {
        (r.ride_date, r.ride_hour, r.resort, r.rfid): (r.rides, r.ride_time, r.txid, r.lift)
        for r in got
    } == {key: (len(rides), *min(rides)) for key, rides in groups.items()}
