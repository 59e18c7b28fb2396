"""Edge tables that the driver tables give, each as a DataFrame and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.tables import load, union_all

NAT_SQL = """E AS (
  SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem)"""


def natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> region, customer -> nation, supplier -> nation, order -> customer, order -> supplier: acyclic."""

    def pair(table: str, a: str, b: str, x: str, y: str, distinct: bool = False) -> DataFrame:
        df = load(spark, sf_dir, table).select(F.concat(F.lit(x), F.col(a)).alias("src"), F.concat(F.lit(y), F.col(b)).alias("dst"))
        return df.distinct() if distinct else df

    return union_all([
        pair("nation", "n_nationkey", "n_regionkey", "n", "r"), pair("customer", "c_custkey", "c_nationkey", "c", "n"),
        pair("supplier", "s_suppkey", "s_nationkey", "s", "n"), pair("orders", "o_orderkey", "o_custkey", "o", "c"),
        pair("lineitem", "l_orderkey", "l_suppkey", "o", "s", True),
    ])


#: On all part keys modulo their number: one edge triples, one halves. Cyclic, of out-degree two, growing with the table.
SYNTHETIC_SQL = """N AS (SELECT count(*) AS n FROM part), K AS (SELECT DISTINCT p_partkey % n AS src, n FROM part, N),
E AS (SELECT src, (src * 3 + 1) % n AS dst FROM K UNION ALL SELECT src, src // 2 FROM K)"""


def part_count(spark: SparkSession, sf_dir: str) -> int:
    return load(spark, sf_dir, "part").count()


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = part_count(spark, sf_dir)
    k = load(spark, sf_dir, "part").select((F.col("p_partkey") % n).alias("src")).distinct()
    return k.select("src", ((F.col("src") * 3 + 1) % n).alias("dst")).union(k.selectExpr("src", "src DIV 2 AS dst"))


EVENT_SQL = """E AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"""


def event_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event type -> the user's next event type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst IS NOT NULL").distinct()
