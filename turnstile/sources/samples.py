"""The test tables seen as rides, passes and tickets (see FIXTURES.md)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import schemas
from turnstile.operators.audits import activation_days
from turnstile.sources.reference import literal_table

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()),
    T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()),
    T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType()),
])
ORDERS = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
    T.StructField("o_orderpriority", T.StringType()),
])

SITES = ("purchase", "signup", "view", "error", "click")
PASS_SEGMENTS = ("HOUSEHOLD", "MACHINERY")
PASS_PRICES = (1051, 783, 537, 407)
CAPACITY = (
    ("purchase", 7, 2, 34, "America/Denver"),
    ("signup", 5, 2, 25, "America/Denver"),
    ("view", 6, 2, 35, "America/Denver"),
    ("error", 4, 1, 21, "America/Denver"),
    ("click", 5, 1, 27, "America/Los_Angeles"),
)
PROFILES = (
    ("purchase", 60, "1.6"),
    ("signup", 55, "1.5"),
    ("view", 50, "1.7"),
    ("error", 45, "1.6"),
)
_EPOCH = "2024-01-01"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def rides_from_events(rows: DataFrame) -> DataFrame:
    """Rides without their activation day."""
    return rows.select(
        F.col("event_id").cast("string").alias("txid"),
        F.col("user_id").cast("string").alias("rfid"),
        F.col("event_type").alias("resort"),
        F.get_json_object("props", "$.k").alias("lift"),
        F.col("ts").alias("ride_time"),
    )


def bare_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides of a feed that leaves the activation day unset."""
    unset = F.lit(None).cast("int")
    return rides_from_events(events(spark, sf_dir)).withColumn("activation_day_count", unset)


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = activation_days(rides_from_events(events(spark, sf_dir)))
    return schemas.conform(numbered, schemas.LIFT_RIDE)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(CUSTOMER).parquet(f"{sf_dir}/customer.parquet")


def _contact_columns() -> dict:
    """Contact fields with gaps at different strides of the customer key."""
    key = F.col("c_custkey")
    text = key.cast("string")
    address = F.struct(
        F.concat(text, F.lit(" Main Street")).alias("street_address"),
        F.lit("Springfield").alias("city"),
        F.lit("CO").alias("state"),
        F.lpad(text, 5, "0").alias("postalcode"),
    )
    contact = F.struct(
        F.concat(F.lit("Contact "), text).alias("name"),
        F.concat(F.lit("555-1"), text).alias("phone"),
    )
    return {
        "address": F.when(key % 3 != 0, address),
        "phone": F.when(key % 5 != 0, F.concat(F.lit("555-0"), text)),
        "email": F.when(key % 7 != 0, F.concat(F.lit("c"), text, F.lit("@example.com"))),
        "emergency_contact": F.when(key % 11 != 0, contact),
    }


def season_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    prices = F.array(*[F.lit(price) for price in PASS_PRICES])
    sold = F.date_add(F.lit(_EPOCH).cast("date"), (key % 10).cast("int"))
    holders = _customers(spark, sf_dir).filter(F.col("c_mktsegment").isin(*PASS_SEGMENTS))
    return schemas.conform(
        holders,
        schemas.SEASON_PASS,
        txid=F.concat(F.lit("P"), key.cast("string")),
        rfid=key,
        purchase_time=sold,
        price_usd=F.element_at(prices, (key % 4 + 1).cast("int")),
        expiration_time=F.date_add(sold, 365),
        name=F.col("c_name"),
        **_contact_columns(),
    )


def resort_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    buyers = _customers(spark, sf_dir).filter(
        F.col("c_mktsegment").isNull() | ~F.col("c_mktsegment").isin(*PASS_SEGMENTS)
    )
    orders = spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")
    last = _last_orders(orders)
    days = (order % 7 + 1).cast("int")
    sold = F.date_add(F.lit(_EPOCH).cast("date"), (order % 20).cast("int"))
    sites = F.array(*[F.lit(site) for site in SITES])
    return schemas.conform(
        buyers.join(last, buyers["c_custkey"] == last["o_custkey"], "inner"),
        schemas.RESORT_TICKET,
        txid=F.concat(F.lit("T"), order.cast("string")),
        rfid=F.col("c_custkey"),
        resort=F.element_at(sites, (order % 5 + 1).cast("int")),
        purchase_time=sold,
        price_usd=_thousandth(F.col("o_totalprice")),
        expiration_time=F.date_add(sold, days * 2),
        days=days,
        name=F.col("c_name"),
        **_contact_columns(),
    )


def _thousandth(price: Column) -> Column:
    """A thousandth of a price in whole cents, half up; whole numbers leave no
    doubt on which side of a cent a binary fraction lies."""
    cents = F.round(price * 100).cast("bigint")
    return F.floor((cents + 500) / 1000).cast("decimal(9,0)") / 100


def _last_orders(orders: DataFrame) -> DataFrame:
    """Each customer's newest order, the larger key on equal dates."""
    keyed = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    newest = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("o")
    return keyed.groupBy("o_custkey").agg(newest).select(
        "o_custkey", "o.o_orderkey", "o.o_totalprice"
    )


def capacity(spark: SparkSession, factor: int = 1) -> DataFrame:
    rows = [(site, most * factor, hourly * factor, *rest) for site, most, hourly, *rest in CAPACITY]
    return literal_table(spark, rows, schemas.RESORT_CAPACITY)


def profiles(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PROFILES, schemas.PRICE_PROFILE)
