"""Exact quantiles without holding a group's values together.

``percentile`` keeps every distinct value of a group in one task.  Here bounded-memory
approximate percentiles bracket each wanted rank, a counting pass says how many values lie
below the bracket, and only values inside it are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exclusive_quantile(rows: DataFrame, group: str, value: str, p: float, out: str = "quantile") -> DataFrame:
    """Quantile at position ``(n + 1) * p`` with linear interpolation, ends clamped."""
    slack = 2.0 / ACCURACY
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull()).select(group, v.alias("v"))
    marks = rows.groupBy(group).agg(
        F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.percentile_approx("v", [max(p - slack, 0.0), min(p + slack, 1.0)], ACCURACY).alias("m"))
    position = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), (F.col("n") + 1) * F.lit(p)))
    # a short group is bracketed by its ends: interpolation may reach one value past the marks
    small = F.col("n") * slack < 2
    marks = marks.select(group, "n", F.floor(position).alias("lower"), (position - F.floor(position)).alias("part"),
                         F.when(small, F.col("least")).otherwise(F.col("m")[0]).alias("low"),
                         F.when(small, F.col("most")).otherwise(F.col("m")[1]).alias("high"))
    joined = rows.join(marks, group)   # one row per group; adaptive execution broadcasts it when small
    below = joined.groupBy(group).agg(F.count_if(F.col("v") < F.col("low")).alias("below"))
    inside = joined.where(F.col("v").between(F.col("low"), F.col("high"))).groupBy(
        group, "v", "n", "lower", "part").agg(F.count("*").alias("copies"))
    run = Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.join(below, group).withColumn("upto", F.col("below") + F.sum("copies").over(run))
    upper = F.least(F.col("lower") + 1, F.col("n"))
    return ranked.groupBy(group).agg(
        F.min(F.when(F.col("upto") >= F.col("lower"), F.col("v"))).alias("a"),
        F.min(F.when(F.col("upto") >= upper, F.col("v"))).alias("b"), F.first("part").alias("part"),
    ).select(group, (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias(out))
