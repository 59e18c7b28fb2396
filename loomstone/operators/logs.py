"""Append-only logs: retention, priorities, offenders, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(rows: DataFrame, path: str, content: str) -> DataFrame:
    """(path, sha256)."""
    return rows.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256).alias("sha256"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): changed (new or other content), deleted or unchanged."""
    a, b = old.select("path", F.col("sha256").alias("old")), new.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull() | (F.col("old") != F.col("new")), "changed").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def retain_last(log: DataFrame, order: list[str], keep: int, by: list[str] | None = None) -> DataFrame:
    """The latest `keep` rows, of each group if grouped; a plain tail is a top-k, not one sorted partition."""
    desc = [F.col(c).desc() for c in order]
    if not by:
        return log.orderBy(*desc).limit(keep)
    return log.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*desc))).where(F.col("_rn") <= keep).drop("_rn")


def repeat_offenders(log: DataFrame, by: list[str], condition, least: int = 2) -> DataFrame:
    return log.where(condition).groupBy(*by).agg(F.count("*").alias("times")).where(F.col("times") >= least)


def decision_of_pair(log: DataFrame, a: str, b: str, decision: str, order: list[str]) -> DataFrame:
    """(first, second, decision) per unordered pair: rejected beats approved beats the rest, else the last entry."""
    rank = F.when(F.col(decision) == "rejected", 2).when(F.col(decision) == "approved", 1).otherwise(0)
    pairs = log.select(F.least(a, b).alias("first"), F.greatest(a, b).alias("second"), F.col(decision).alias("decision"), F.struct(rank.alias("rank"), *order).alias("_by"))
    return pairs.groupBy("first", "second").agg(F.max_by("decision", "_by").alias("decision"))


def summary(log: DataFrame, decision: str) -> DataFrame:
    """One row of counts by decision."""
    n = lambda *v: F.count_if(F.col(decision).isin(*v))
    return log.agg(n("APPROVED").alias("approved"), n("REJECTED").alias("rejected"), n("REVIEW", "PENDING_REVIEW").alias("review"), n("BLOCK").alias("block"), F.count("*").alias("total"))
