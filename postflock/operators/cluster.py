"""What clusters are made of: features chosen by a report, and top users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_report(report: DataFrame, line: str = "line", place: str = "place") -> DataFrame:
    """(cluster_id, kind, col) of a clustering report: after a line "Cluster <id>,"
    the next line names descriptive features and the one after it discriminating
    ones, as "col<N> ", N from 1. A report is small: one row for each line of it."""
    order = Window.orderBy(place)
    rows = report.select(F.col(place).alias("place"), F.col(line).alias("line"), F.lag(line, 1).over(order).alias("one"), F.lag(line, 2).over(order).alias("two"))
    head = r"^Cluster[ \t]*(\d+),"
    kinds = [("one", "descriptive"), ("two", "discriminating")]
    parts = [rows.where(F.col(c).rlike(head)).select(F.regexp_extract(c, head, 1).cast("int").alias("cluster_id"), F.lit(kind).alias("kind"), F.explode(F.transform(F.regexp_extract_all("line", F.lit(r"col(\d+) "), 1), lambda x: x.cast("int"))).alias("col")) for c, kind in kinds]
    return parts[0].unionByName(parts[1]).distinct()


def feature_stats(assigned: DataFrame, features: str = "features", cluster: str = "cluster_id") -> DataFrame:
    """(cluster_id, col, n, low, high, mean, var) of each feature, counted from 1,
    in each cluster; the variance is the population's."""
    each = assigned.select(F.col(cluster).alias("cluster_id"), F.posexplode(features).alias("at", "v"))
    v = F.col("v").cast("double")
    return each.groupBy("cluster_id", (F.col("at") + 1).alias("col")).agg(F.count("v").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"))


def selected_stats(stats: DataFrame, report: DataFrame, kind: str = "descriptive") -> DataFrame:
    """The statistics of the features that a parsed report names for a cluster."""
    return stats.join(report.where(F.col("kind") == kind).select("cluster_id", "col"), ["cluster_id", "col"], "left_semi")


def top_users(scores: DataFrame, n: int) -> DataFrame:
    """(cluster_id, place, user_name, pr): the n users of each cluster with the
    highest score, equal ones by name."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("pr"), "user_name"))
    return scores.withColumn("place", place).where(F.col("place") <= n).select("cluster_id", F.col("place").cast("bigint").alias("place"), "user_name", "pr")
