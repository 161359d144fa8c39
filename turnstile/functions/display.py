"""Text forms for report tables."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstile.functions.timeparts import two_digits

DATE_FORMAT = "yyyy-MM-dd"
DAY_FORMAT = "EEEE, MM/dd/yy"
MISSING_TIME = "--"


def thousands(amount: Column) -> Column:
    """Whole number with separators; nothing known shows as 0."""
    return F.format_number(F.coalesce(amount.cast("decimal(38,8)"), F.lit(0)), 0)


def currency(amount: Column) -> Column:
    return F.concat(F.lit("$"), thousands(amount))


def percent(value: Column, missing: str = "0%") -> Column:
    """One decimal, ties to even."""
    shown = F.concat(_pattern(value, "0.0"), F.lit("%"))
    return F.when(value.isNull(), F.lit(missing)).otherwise(shown)


def signed_percent(value: Column) -> Column:
    return F.concat(_pattern(value, "+0.0;-0.0"), F.lit("%"))


def _pattern(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def clock_text(time: Column) -> Column:
    """Weekday, date and 12-hour time; a dash when there is no time."""
    hour = F.hour(time)
    parts = F.concat_ws(":", two_digits((hour + 11) % 12 + 1), two_digits(F.minute(time)),
                        two_digits(F.second(time)))
    text = F.concat(F.date_format(F.to_date(time), DAY_FORMAT), F.lit(" "), parts,
                    F.when(hour < 12, F.lit(" AM")).otherwise(F.lit(" PM")))
    return F.coalesce(text, F.lit(MISSING_TIME))
