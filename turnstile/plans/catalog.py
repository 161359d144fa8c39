"""Publishing the chain as views, and listing what a session offers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.plans.chain import Chain

VIEWS = {
    "lift_ride": "rides",
    "season_pass": "passes",
    "resort_ticket": "tickets",
    "resort_capacity": "capacity",
    "daily_visits": "visits",
    "hourly_lift_activity": "activity",
    "hourly_amortized_revenue": "revenue",
    "hourly_resort_summary": "hourly",
    "daily_resort_summary": "daily",
    "weekly_resort_summary": "weekly",
    "v_daily_network_metrics": "network",
    "v_daily_revenue_performance": "performance",
}


def publish(chain: Chain) -> None:
    """Register every table of the chain, so plain SQL can query it by name."""
    for view, attribute in VIEWS.items():
        getattr(chain, attribute).createOrReplaceTempView(view)


def list_objects(spark: SparkSession, kind: str | None = None, prefix: str = "") -> DataFrame:
    """Tables, views and functions of the session, filtered by kind and name."""
    rows = [(t.name, "view" if t.isTemporary or t.tableType == "VIEW" else "table")
            for t in spark.catalog.listTables()]
    rows += [(f.function, "function") for f in spark.sql("SHOW USER FUNCTIONS").collect()]
    listing = spark.createDataFrame(rows, "name string, kind string")
    if kind is not None:
        listing = listing.filter(F.col("kind") == kind)
    return listing.filter(F.col("name").startswith(prefix)).orderBy("name")
