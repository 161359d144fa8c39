from datetime import date, datetime
from decimal import Decimal

import pytest
from builders import at
from pyspark.sql import functions as F

from turnstile.functions import bands, display, money, timeparts


def one(spark, expression, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])
    return frame.select(expression.alias("x")).first()[0]


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("start", "end", "minutes"),
    [
        ("2024-01-01 10:00:59", "2024-01-01 10:01:01", 1),
        ("2024-01-01 10:00:01", "2024-01-01 10:00:59", 0),
        ("2023-12-31 23:59:59.9", "2024-01-01 00:00:00", 1),
        ("2024-03-09 12:00:00", "2024-03-10 12:00:00", 1440),
    ],
)
def test_minutes_between(spark, start, end, minutes):
    assert one(spark, timeparts.minutes_between(ntz(start), ntz(end))) == minutes


@pytest.mark.parametrize("text", ["2024-03-10 02:30:15", "2024-11-03 01:59:59", "2024-01-01 00:00:00"])
def test_hour_start_keeps_wall_clock(spark, text):
    expected = at(text).replace(minute=0, second=0, microsecond=0)
    assert one(spark, timeparts.hour_start(ntz(text))) == expected


@pytest.mark.parametrize(
    ("text", "monday"),
    [("2024-01-07", "2024-01-01"), ("2024-01-08", "2024-01-08"), ("2024-01-01", "2024-01-01")],
)
def test_week_start(spark, text, monday):
    got = one(spark, timeparts.week_start(F.lit(text).cast("date")))
    assert got == date.fromisoformat(monday)


def test_previous_month_crosses_the_year(spark):
    dates = timeparts.clock_dates(ntz("2024-01-01 05:00:00"))
    assert one(spark, dates["prev_month_start"]) == date(2023, 12, 1)
    assert one(spark, dates["month_start"]) == date(2024, 1, 1)


@pytest.mark.parametrize(
    ("utc", "local"),
    [
        ("2024-03-10 08:59:00", "2024-03-10 01:59:00"),
        ("2024-03-10 09:00:00", "2024-03-10 03:00:00"),
        ("2024-11-03 07:30:00", "2024-11-03 01:30:00"),
        ("2024-11-03 08:30:00", "2024-11-03 01:30:00"),
    ],
)
def test_local_time_follows_the_zone(spark, utc, local):
    assert one(spark, timeparts.to_local(ntz(utc), F.lit("America/Denver"))) == at(local)


@pytest.mark.parametrize(
    ("text", "utc"),
    [
        ("2024-03-10T02:30:00+00:00", "2024-03-10 02:30:00"),
        ("2024-03-10T02:30:00.123456+00:00", "2024-03-10 02:30:00.123456"),
        ("2024-11-03T01:30:00-06:00", "2024-11-03 07:30:00"),
        ("2024-11-03T01:30:00-07:00", "2024-11-03 08:30:00"),
        ("2024-03-10T02:30:00", "2024-03-10 02:30:00"),
        ("1969-12-31T23:59:59.5+0530", "1969-12-31 18:29:59.5"),
        ("not a time", None),
    ],
)
def test_iso_to_utc(spark, text, utc):
    assert one(spark, timeparts.iso_to_utc(F.lit(text))) == at(utc)


@pytest.mark.parametrize("text", ["2024-03-10 02:30:00.123456", "2024-11-03 01:30:00", "1969-12-31 23:59:59.5"])
def test_utc_instant_and_back(spark, text):
    instant = timeparts.utc_instant(ntz(text))
    assert one(spark, timeparts.utc_clock(instant)) == at(text)


def test_seconds_between(spark):
    got = one(spark, timeparts.seconds_between(ntz("2024-01-01 23:59:59.5"), ntz("2024-01-02 00:00:00")))
    assert got == Decimal("0.500000")


def test_unknown_period_is_refused(spark):
    with pytest.raises(ValueError):
        timeparts.current_period(F.col("d"), spark.range(1), "Last Year")


@pytest.mark.parametrize(
    ("top", "bottom", "places", "value"),
    [(1, 7, 1, "0.1"), (100, 7, 1, "14.3"), (1, 20, 1, "0.1"), (1, 8, 2, "0.13"),
     (5, 2, 0, "3"), (3, 0, 1, None), (0, 4, 1, "0.0")],
)
def test_rounded_ratio(spark, top, bottom, places, value):
    got = one(spark, money.rounded_ratio(F.lit(top), F.lit(bottom), places))
    assert got == (None if value is None else Decimal(value))


@pytest.mark.parametrize(
    ("days", "share"), [(3, "33.33333333"), (0, "100.00000000"), (1, "100.00000000"), (None, None)]
)
def test_ticket_share(spark, days, share):
    price = F.lit("100").cast("decimal(7,2)")
    got = one(spark, money.ticket_share(price, F.lit(days).cast("int")))
    assert got == (None if share is None else Decimal(share))


@pytest.mark.parametrize(
    ("now", "before", "change"), [(110, 100, 10.0), (5, 0, 0.0), (5, None, 0.0), (None, 10, None)]
)
def test_pct_change(spark, now, before, change):
    got = one(spark, money.pct_change(F.lit(now).cast("int"), F.lit(before).cast("int")))
    assert got is None and change is None or got == pytest.approx(change)


@pytest.mark.parametrize(
    ("visitors", "status"),
    [(70, "NORMAL"), (71, "MODERATE"), (90, "MODERATE"), (91, "HIGH"), (0, "NORMAL")],
)
def test_capacity_status(spark, visitors, status):
    assert one(spark, bands.capacity_status(F.lit(visitors), F.lit(100))) == status


@pytest.mark.parametrize(
    ("pct", "status", "icon"),
    [(69.9, "🟢 Normal", "🟢"), (70.0, "🟡 Busy", "🟡"), (90.0, "🔴 At Capacity", "🔴"),
     (None, "🔴 At Capacity", "⚪")],
)
def test_resort_status(spark, pct, status, icon):
    value = F.lit(pct).cast("double")
    assert one(spark, bands.resort_status(value)) == status
    assert one(spark, bands.capacity_icon(value)) == icon


@pytest.mark.parametrize(
    ("revenue", "target", "status"),
    [("90", "100", "NEAR_TARGET"), ("100", "100", "ABOVE_TARGET"), ("89.99", "100", "BELOW_TARGET"),
     ("0", "0", "ABOVE_TARGET")],
)
def test_target_status(spark, revenue, target, status):
    got = one(spark, bands.target_status(
        F.lit(revenue).cast("decimal(28,8)"), F.lit(target).cast("decimal(18,2)")))
    assert got == status


@pytest.mark.parametrize(
    ("rate", "level"), [(200.0, "Active"), (200.1, "Hot"), (100.0, "Normal"), (None, "Normal")]
)
def test_activity_level(spark, rate, level):
    assert one(spark, bands.activity_level(F.lit(rate).cast("double"))) == level


@pytest.mark.parametrize(("rank", "medal"), [(1, "🥇"), (2, "🥈"), (3, "🥉"), (4, "4")])
def test_rank_medal(spark, rank, medal):
    assert one(spark, bands.rank_medal(F.lit(rank))) == medal


@pytest.mark.parametrize("value", [0.0, 0.5, 1.5, 2.5, 1234567.5, 999.49, None])
def test_currency(spark, value):
    expected = "$0" if value is None else f"${value:,.0f}"
    assert one(spark, display.currency(F.lit(value).cast("double"))) == expected


@pytest.mark.parametrize("value", [0.0, 46.25, 46.75, 12.34, 1234.5])
def test_percent(spark, value):
    assert one(spark, display.percent(F.lit(value))) == f"{value:.1f}%"
    assert one(spark, display.signed_percent(F.lit(value))) == f"{value:+.1f}%"
    assert one(spark, display.signed_percent(F.lit(-value))) == f"{-value:+.1f}%"


def test_missing_values_are_shown(spark):
    assert one(spark, display.percent(F.lit(None).cast("double"))) == "0%"
    assert one(spark, display.clock_text(F.lit(None).cast("timestamp_ntz"))) == "--"


def test_clock_text(spark):
    moment = datetime(2024, 1, 30, 15, 57, 12)
    shown = one(spark, display.clock_text(ntz(str(moment))))
    assert shown == moment.strftime("%A, %m/%d/%y %I:%M:%S %p")
