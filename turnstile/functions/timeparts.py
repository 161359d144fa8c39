"""Date and hour arithmetic on zone-free timestamps."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TODAY, LAST_7_DAYS, MONTH_TO_DATE = "Today", "Last 7 Days", "Month to Date"
PERIODS = (TODAY, LAST_7_DAYS, MONTH_TO_DATE)


def day_of(time: Column) -> Column:
    return F.to_date(time)


def hour_start(time: Column) -> Column:
    """Start of the hour, still zone-free.

    ``date_trunc`` would return a zoned timestamp and shift hours that a
    daylight-saving change skips in the session time zone.
    """
    hours = F.make_dt_interval(F.lit(0), F.hour(time))
    return F.to_date(time).cast("timestamp_ntz") + hours


def week_start(day: Column) -> Column:
    """Monday of the week."""
    return F.trunc(day, "week").cast("date")


def minutes_before(time: Column, minutes: int | Column) -> Column:
    length = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return time - F.make_dt_interval(F.lit(0), F.lit(0), length)


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed between two times (10:00:59 to 10:01:01 is one)."""
    return _clock_minutes(end) - _clock_minutes(start)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with fractions, as decimal."""
    minutes = (_clock_minutes(end) - _clock_minutes(start)).cast("decimal(14,0)")
    return (
        minutes * 60 + (F.extract(F.lit("SECOND"), end) - F.extract(F.lit("SECOND"), start))
    ).cast("decimal(18,6)")


def _clock_minutes(time: Column) -> Column:
    return F.unix_date(F.to_date(time)).cast("bigint") * 1440 + F.hour(time) * 60 + F.minute(time)


def to_local(time: Column, zone: Column) -> Column:
    """UTC wall clock to the wall clock of ``zone``; null where the zone is unknown."""
    return F.convert_timezone(F.lit("UTC"), zone, time)


def utc_clock(instant: Column) -> Column:
    """Zoned timestamp to the UTC wall clock, whatever the session time zone."""
    step = F.unix_micros(instant) * F.expr("INTERVAL '0.000001' SECOND")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + step


def utc_instant(time: Column) -> Column:
    """UTC wall clock to the zoned timestamp it means; a plain cast would read
    it in the session time zone, where some hours do not exist."""
    minutes = _clock_minutes(time) * 60_000_000
    rest = (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")
    return F.timestamp_micros(minutes + rest)


def iso_to_utc(text: Column) -> Column:
    """ISO 8601 text to the UTC wall clock; text without an offset already is UTC.

    Offsets may be ``Z``, ``+hh:mm``, ``+hhmm`` or ``+hh`` after a time.
    """
    time = r"(\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)"
    zone = r"(Z|[+-]\d{2}:\d{2})$"
    mended = F.regexp_replace(text, time + r"([+-]\d{2})(\d{2})$", "$1$2:$3")
    mended = F.regexp_replace(mended, time + r"([+-]\d{2})$", "$1$2:00")
    # The usual forms need no mending.
    zoned = F.when(text.rlike(zone), text).when(mended.rlike(zone), mended).otherwise(F.concat(mended, F.lit("Z")))
    return utc_clock(zoned.try_cast("timestamp"))


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def iso_text(time: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSSSS``.  Formatting functions would read the time in the session
    time zone, where some hours do not exist."""
    seconds = F.lpad(F.extract(F.lit("SECOND"), time).cast("decimal(8,6)").cast("string"), 9, "0")
    clock = F.concat_ws(":", two_digits(F.hour(time)), two_digits(F.minute(time)), seconds)
    return F.when(time.isNotNull(), F.concat(F.to_date(time).cast("string"), F.lit("T"), clock))


def clock_dates(reporting_time: Column) -> dict[str, Column]:
    """The dates every period report hangs on, from the latest reporting hour."""
    today = F.to_date(reporting_time)
    month = F.trunc(today, "month").cast("date")
    return {
        "current_date": today,
        "current_hour": F.hour(reporting_time),
        "yesterday": F.date_sub(today, 1),
        "week_ago": F.date_sub(today, 7),
        "two_weeks_ago": F.date_sub(today, 14),
        "month_start": month,
        "prev_month_start": F.add_months(month, -1),
    }


def current_period(day: Column, clock: DataFrame, period: str) -> Column:
    """Predicate for the running period.

    ``clock`` has one row; it enters as a scalar subquery, so on a table
    partitioned by date the predicate still prunes partitions.
    """
    if period == TODAY:
        return day == _value(clock, "current_date")
    if period == LAST_7_DAYS:
        return day >= _value(clock, "week_ago")
    if period == MONTH_TO_DATE:
        return day >= _value(clock, "month_start")
    raise ValueError(f"unknown period {period!r}, expected one of {PERIODS}")


def previous_period(day: Column, clock: DataFrame, period: str) -> Column:
    """Predicate for the period the running one is compared with."""
    if period == TODAY:
        return day == _value(clock, "yesterday")
    if period == LAST_7_DAYS:
        return (day >= _value(clock, "two_weeks_ago")) & (day < _value(clock, "week_ago"))
    if period == MONTH_TO_DATE:
        return (day >= _value(clock, "prev_month_start")) & (day < _value(clock, "month_start"))
    raise ValueError(f"unknown period {period!r}, expected one of {PERIODS}")


def _value(clock: DataFrame, name: str) -> Column:
    return clock.select(name).scalar()
