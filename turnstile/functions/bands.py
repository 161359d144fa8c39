"""Status bands.  Thresholds on ratios compare whole numbers, never quotients."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and labels of the status bands.
CAPACITY_BANDS = ((90, "HIGH"), (70, "MODERATE"))
CAPACITY_DEFAULT = "NORMAL"
NEAR_TARGET_PCT = 90
RESORT_STATUS = ((70, "🟢 Normal"), (90, "🟡 Busy"))
RESORT_STATUS_DEFAULT = "🔴 At Capacity"
CAPACITY_ICONS = ((70, "🟢"), (90, "🟡"))
CAPACITY_ICON_DEFAULT = "🔴"
UNKNOWN_ICON = "⚪"
TARGET_ICONS = (("ABOVE_TARGET", "🟢"), ("NEAR_TARGET", "🟡"), ("BELOW_TARGET", "🔴"))
ACTIVITY_LEVELS = ((200, "Hot"), (100, "Active"))
ACTIVITY_DEFAULT = "Normal"
ACTIVITY_ICONS = (("Hot", "🔥"), ("Active", "⚡"), ("Normal", "🟢"))
RANK_MEDALS = ((1, "🥇"), (2, "🥈"), (3, "🥉"))


def first_match(cases: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first condition that holds; a null condition does not hold."""
    chain = F
    for condition, label in cases:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(default))


def above(value: Column, cuts: Sequence[tuple[float, str]], default: str) -> Column:
    """Bands from the highest cut down, strictly above the cut."""
    return first_match([(value > cut, label) for cut, label in cuts], default)


def below(value: Column, cuts: Sequence[tuple[float, str]], default: str) -> Column:
    """Bands from the lowest cut up, strictly below the cut."""
    return first_match([(value < cut, label) for cut, label in cuts], default)


def capacity_status(visitors: Column, capacity: Column) -> Column:
    filled = visitors.cast("bigint") * 100
    return first_match(
        [(filled > capacity.cast("bigint") * cut, label) for cut, label in CAPACITY_BANDS],
        CAPACITY_DEFAULT,
    )


def target_status(revenue: Column, target: Column) -> Column:
    return first_match(
        [
            (revenue >= target, "ABOVE_TARGET"),
            (revenue * 100 >= target * NEAR_TARGET_PCT, "NEAR_TARGET"),
        ],
        "BELOW_TARGET",
    )


def resort_status(capacity_pct: Column) -> Column:
    """A resort without a percentage falls through to the last band."""
    return below(capacity_pct, RESORT_STATUS, RESORT_STATUS_DEFAULT)


def capacity_icon(capacity_pct: Column) -> Column:
    known = below(capacity_pct, CAPACITY_ICONS, CAPACITY_ICON_DEFAULT)
    return F.when(capacity_pct.isNull(), F.lit(UNKNOWN_ICON)).otherwise(known)


def target_icon(status: Column) -> Column:
    return first_match([(status == name, icon) for name, icon in TARGET_ICONS], UNKNOWN_ICON)


def activity_level(rides_per_hour: Column) -> Column:
    return above(rides_per_hour, ACTIVITY_LEVELS, ACTIVITY_DEFAULT)


def activity_icon(level: Column) -> Column:
    return first_match([(level == name, icon) for name, icon in ACTIVITY_ICONS], UNKNOWN_ICON)


def rank_medal(rank: Column) -> Column:
    """Medal for the first three ranks, the number itself for the others."""
    chain = F
    for place, medal in RANK_MEDALS:
        chain = chain.when(rank == place, F.lit(medal))
    return chain.otherwise(rank.cast("string"))
