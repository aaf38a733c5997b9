"""Exact quantiles without a group's values in one buffer.

A sketch bounds the quantile from both sides; values outside of the bounds are only counted, and the few between are
ranked by a window, which sorts on disk if it must. The sketch's error is proportional to the rows, so the part that is
ranked is 1/1000 or so of a group. Bounds are checked by the counts, and groups that they miss are ranked whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative distance of the sketched bounds from the middle, and accuracy of the sketch (1 / its error in ranks).
REACH, ACCURACY = 0.0005, 10_000


def medians(df: DataFrame, keys: list[str], value: Column, name: str = "median") -> DataFrame:
    """keys and the exact median of the values that are not null; keys without any have null. Without keys one row."""
    if not keys:
        found = medians(df.select(F.lit(0).alias("_all"), value.alias("_value")), ["_all"], F.col("_value"), name)
        return found.drop("_all")
    rows = df.select(*keys, value.cast("double").alias("_v"))
    near = F.percentile_approx("_v", F.array(F.lit(0.5 - REACH), F.lit(0.5 + REACH)), ACCURACY)
    bounds = rows.groupBy(*keys).agg(near.alias("_b"), F.count("_v").alias("_n"))
    bounds = bounds.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high"), "_n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    bounded = rows.join(bounds, same)
    below = bounded.groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_low")).alias("_below"), F.count_if(F.col("_v") <= F.col("_high")).alias("_upto"), F.first("_n").alias("_n"), F.first("_low").alias("_low"), F.first("_high").alias("_high"))
    # the middle ranks, from 1, and whether the bounds hold them
    a, b = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    holds = (F.col("_below") < a) & (b <= F.col("_upto"))
    below = below.select(*(F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)), a.alias("_a"), b.alias("_z"), F.when(holds, F.col("_below")).otherwise(0).alias("_skip"), F.when(holds, F.col("_low")).alias("_from"), F.when(holds, F.col("_high")).alias("_to"))
    again = F.lit(True)
    for i, k in enumerate(keys):
        again = again & F.col(k).eqNullSafe(F.col(f"_m{i}"))
    middle = rows.where("_v IS NOT NULL")
    middle = middle.join(below, again)
    middle = middle.where("(_from IS NULL OR _v >= _from) AND (_to IS NULL OR _v <= _to)")
    # equal values are one row with their number, so a value that half of a group has is no burden
    counted = middle.groupBy(*keys, "_v", "_a", "_z", "_skip").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_skip")
    ranked = counted.withColumn("_upto", upto)
    at = lambda r: F.min(F.when(F.col("_upto") >= F.col(r), F.col("_v")))
    found = ranked.groupBy(*keys).agg(((at("_a") + at("_z")) / 2).alias(name))
    whole = bounds.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)))
    found = found.select(*(F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)), name)
    last = F.lit(True)
    for i, k in enumerate(keys):
        last = last & F.col(k).eqNullSafe(F.col(f"_f{i}"))
    return whole.join(found, last, "left").select(*keys, name)
