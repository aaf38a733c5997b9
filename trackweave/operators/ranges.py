"""Range joins as equi-joins on buckets: no Cartesian product, and the work follows the matches.

Right rows are put into the buckets that their reach touches, left rows into the one they lie in; Spark then joins on
(keys, bucket), splits skewed ones, and the exact condition is checked on each candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucketed(left: DataFrame, right: DataFrame, left_time: str, right_low: Column, right_high: Column, width: float) -> tuple[DataFrame, DataFrame]:
    bucket = lambda c: F.floor(c.cast("double") / width)
    l = left.withColumn("_bucket", bucket(F.col(left_time)))
    r = right.withColumn("_low", right_low).withColumn("_high", right_high).where("_low <= _high")
    return l, r.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_low")), bucket(F.col("_high")))))


def range_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_low: Column, right_high: Column, width: float, how: str = "inner") -> DataFrame:
    """Left rows with right_low <= left_time <= right_high and equal `on`; `how` is inner, left_semi or left_anti.
    `width` is the bucket size, best about the usual reach. For inner, right columns must have other names."""
    l, r = _bucketed(left, right, left_time, right_low, right_high, width)
    if how != "inner":
        r = r.select(*on, "_bucket", "_low", "_high")
    r = r.select(*(F.col(c).alias(f"_r_{c}") for c in on), *(c for c in r.columns if c not in on and c != "_bucket"), F.col("_bucket").alias("_r_bucket"))
    same = F.col("_bucket") == F.col("_r_bucket")
    for c in on:
        same = same & (F.col(c) == F.col(f"_r_{c}"))
    out = l.join(r, same & F.col(left_time).between(F.col("_low"), F.col("_high")), how)
    return out.drop("_bucket", "_r_bucket", "_low", "_high", *(f"_r_{c}" for c in on))


def nearest_in_range(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, reach: float, cost: Column, row: list[str], take: list[str], tie: str) -> DataFrame:
    """Of the right rows within `reach` of each left row (identified by `row`), the columns `take` of the cheapest."""
    found = range_join(left, right, on, left_time, F.col(right_time) - reach, F.col(right_time) + reach, max(reach, 1.0))
    return found.groupBy(*row).agg(*(F.min_by(c, F.struct(cost, F.col(tie))).alias(c) for c in take), F.min(cost).alias("cost"))
