"""Wall time of the headline queries, one JSON line on stdout.

    BENCH_SF_DIR   table folder, default /root/testdata/sf0.1
    BENCH_CPUS     local cores, default 8

Each query runs to a sink that discards rows, so every column is computed.
``refresh_micro_batch`` is one more hour of rides arriving at tables that hold
all earlier ones.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from registry.queries import QUERIES, chain, stored  # noqa: E402
from turnstile.session import configure, shared_dir  # noqa: E402
from turnstile.streaming.refresh import RefreshJob  # noqa: E402

HEADLINE = [
    "daily_visits", "hourly_activity", "hourly_revenue", "hourly_summary", "daily_summary",
    "weekly_summary", "revenue_performance", "network_daily", "lift_performance", "lift_board",
    "reporting_clock", "network_kpis", "site_comparison", "site_time_series",
    "site_status_report", "site_operations", "hourly_pattern_local", "site_revenue_today",
    "latest_weeks", "activation_day", "rides_after_expiry", "overused_tickets",
    "rides_outside_hours", "ride_gaps", "ingest_throughput",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    spark = configure(
        builder,
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            # A few megabytes of input: keep all cores in work.
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
        },
    ).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    discard(QUERIES["hourly_summary"](spark, sf_dir))  # warm the JVM up

    # Reports read the stored tables, so writing those is timed on its own.
    seconds = {"materialize_chain": timed(lambda: stored(spark, sf_dir))}
    for name in HEADLINE:
        seconds[name] = timed(lambda n=name: discard(QUERIES[n](spark, sf_dir)))
    seconds["refresh_micro_batch"] = micro_batch(spark, chain(spark, sf_dir))
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()},
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


def discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def micro_batch(spark, base) -> float:
    job = RefreshJob(
        spark, None, lambda: base.passes, lambda: base.tickets, base.capacity,
        shared_dir(spark, "bench"), "",
    )
    rides = base.rides.cache()
    last = rides.agg(F.date_trunc("hour", F.max("ride_time")).cast("timestamp_ntz")).scalar()
    job.refresh(rides.filter(F.col("ride_time") < last), 0)
    return timed(lambda: job.refresh(rides.filter(F.col("ride_time") >= last), 1))


if __name__ == "__main__":
    main()
