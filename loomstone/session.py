"""Session defaults shared by the command line, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "loomstone", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; `conf` overrides any default.

    Under spark-submit the master, the memory and the number of shuffle partitions are the cluster's; only where `cpus`
    is given, or nothing else has begun a session, is the session a local one.
    """
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if cpus or "PYSPARK_GATEWAY_PORT" not in os.environ:
        cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
        defaults |= {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.appName(app).config(map=defaults | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
