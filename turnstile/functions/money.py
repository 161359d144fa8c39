"""Revenue shares, exact rounding and comparisons between periods."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstile.schemas import REVENUE


def ticket_share(price: Column, days: Column) -> Column:
    """Price of one day of a ticket.  A duration below one day counts as one;
    an unknown duration gives null rather than the whole price."""
    divisor = F.when(days.isNotNull(), F.greatest(days, F.lit(1)))
    return (price / divisor).cast("decimal(18,8)")


def pass_share(price: Column, uses: int) -> Column:
    """Price of one use of a pass that is written off over ``uses`` uses."""
    return (price / F.lit(uses)).cast("decimal(18,8)")


def total(amount: Column) -> Column:
    return F.sum(amount).cast(REVENUE)


def rounded_ratio(top: Column, bottom: Column, places: int) -> Column:
    """``top / bottom`` of two non-negative whole numbers, rounded half up, exactly.

    Whole-number arithmetic: neither binary fractions nor an intermediate
    decimal scale can move a value across a rounding edge.  Null when the
    divisor is not positive.
    """
    top, bottom = top.cast("bigint"), bottom.cast("bigint")
    units = F.call_function("div", top * (2 * 10**places) + bottom, bottom * 2)
    return F.when(
        bottom > 0, (units.cast("decimal(20,0)") / F.lit(10**places)).cast(f"decimal(20,{places})")
    )


def rounded_mean(value: Column, places: int, scale: int = 0) -> Column:
    """Mean of non-negative values with ``scale`` decimals, rounded half up, exactly."""
    units = F.sum((value * F.lit(10**scale)).cast("bigint"))
    return rounded_ratio(units, F.count(value) * 10**scale, places)


def mean(value: Column) -> Column:
    """Average as an exact decimal sum over a count; null without values."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def pct_change(current: Column, previous: Column) -> Column:
    """Change in percent; 0 when there is nothing to compare with."""
    now, before = current.cast("double"), previous.cast("double")
    return F.when(before > 0, (now - before) / before * 100).otherwise(F.lit(0.0))
