"""Daily visits: one row per medium, resort and UTC day, enriched from its sale."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import schemas
from turnstile.functions.timeparts import day_of
from turnstile.operators.firsts import first_per, latest_per

VISIT_KEY = ["visit_date", "resort", "rfid"]


def first_rides(rides: DataFrame) -> DataFrame:
    """Earliest ride per resort, medium and day; ``txid`` decides equal times."""
    dated = rides.select(
        "resort", "rfid", "txid",
        F.col("lift").alias("first_lift"),
        F.col("ride_time").alias("first_ride_time"),
        day_of(F.col("ride_time")).alias("visit_date"),
        F.col("activation_day_count").alias("activation_usage_count"),
    )
    order = [F.col("first_ride_time").asc_nulls_last(), F.col("txid").asc_nulls_last()]
    return first_per(dated, ["resort", "rfid", "visit_date"], order).drop("txid")


def new_visits(firsts: DataFrame, known: DataFrame) -> DataFrame:
    """First rides whose visit is not recorded yet."""
    return firsts.join(known.select(*VISIT_KEY), VISIT_KEY, "left_anti")


def latest_sales(sales: DataFrame) -> DataFrame:
    """One sale per medium, the newest.  Nothing forbids a medium to be sold
    twice, and a second sale must not duplicate its visits."""
    return latest_per(sales, ["rfid"], "purchase_time", "txid")


def enrich_from_pass(firsts: DataFrame, passes: DataFrame) -> DataFrame:
    sold = latest_sales(passes.select("rfid", "txid", "purchase_time", "name", "price_usd"))
    sold = sold.select(
        "rfid",
        F.col("name").alias("pass_name"),
        F.col("price_usd").alias("pass_price"),
        F.lit(True).alias("is_pass"),
    )
    return firsts.join(sold, "rfid", "left")


def enrich_from_ticket(firsts: DataFrame, tickets: DataFrame) -> DataFrame:
    """By medium alone: a ticket sold for another resort still counts."""
    sold = latest_sales(tickets.select("rfid", "txid", "purchase_time", "name", "price_usd", "days"))
    sold = sold.select(
        "rfid",
        F.col("name").alias("ticket_name"),
        F.col("price_usd").alias("ticket_price"),
        F.col("days").alias("ticket_days"),
    )
    return firsts.join(sold, "rfid", "left")


def enrich(
    firsts: DataFrame, passes: DataFrame, tickets: DataFrame,
    schema: T.StructType = schemas.DAILY_VISITS,
) -> DataFrame:
    """Name and price from the pass, else from the ticket; nulls without a sale.

    Both joins use the medium as key, so the visits are shuffled once for the
    two of them (or not at all where the sales fit a broadcast).
    """
    sold = enrich_from_ticket(enrich_from_pass(firsts, passes), tickets)
    return schemas.conform(
        sold,
        schema,
        name=F.coalesce("pass_name", "ticket_name"),
        has_season_pass=F.coalesce("is_pass", F.lit(False)),
        purchase_price_usd=F.coalesce("pass_price", "ticket_price"),
        ticket_original_duration=F.col("ticket_days"),
    )


def daily_visits(
    rides: DataFrame, passes: DataFrame, tickets: DataFrame, known: DataFrame | None = None
) -> DataFrame:
    """Visits in ``rides`` that are not in ``known``.

    Known visits are removed before the sales are looked up, so a refresh
    enriches only what is new.
    """
    firsts = first_rides(rides)
    if known is not None:
        firsts = new_visits(firsts, known)
    return enrich(firsts, passes, tickets)


_FROM_SALE = ["name", "has_season_pass", "purchase_price_usd", "ticket_original_duration"]


def enrich_again(visits: DataFrame, passes: DataFrame, tickets: DataFrame) -> DataFrame:
    """Visits with their sale looked up anew, whatever was recorded of it."""
    return enrich(visits.drop(*_FROM_SALE), passes, tickets, visits.schema)


def reenrich(visits: DataFrame, passes: DataFrame, tickets: DataFrame) -> DataFrame:
    """Repair visits recorded before their sale arrived: rows without a price
    are looked up again, all others stay as they are."""
    unsold = visits.filter(F.col("purchase_price_usd").isNull())
    sold = visits.filter(F.col("purchase_price_usd").isNotNull())
    return sold.unionByName(enrich_again(unsold, passes, tickets))
