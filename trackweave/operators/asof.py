"""As-of joins: each left row takes the nearest right row in order, by one shuffle on the keys and one sort.

Both sides are united and the last (or first) right row seen so far is carried over. The keys partition the work; for a
single long key, `chunk` cuts time into pieces and carries each piece's last row into the next by a small window over
the pieces, so one key never has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, take: dict[str, str], tie: str | None = None, direction: str = "backward", tolerance: float | None = None, chunk: float | None = None) -> DataFrame:
    """All rows and columns of `left`, and for each entry right column -> new name of `take` the value in the nearest
    right row: the last one at or before the left time ("backward") or the first at or after it ("forward"), null if
    there is none or it is more than `tolerance` away. Of right rows at one time, the one largest in `tie` (smallest
    for "forward"). Rows with a null time match nothing."""
    back = direction == "backward"
    value = F.struct(F.col(right_time).alias("t"), *(F.col(c).alias(n) for c, n in take.items()))
    side = F.lit(1 if back else 0)  # a right row at the same time comes first in reading direction
    kind = "string" if tie is None else right.schema[tie].dataType
    l = left.select(F.struct(*left.columns).alias("row"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(on)), F.col(left_time).alias("at"), side.alias("side"), F.lit(None).cast(kind).alias("order"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("found"))
    order = F.lit(None).cast("string") if tie is None else F.col(tie)
    r = right.where(F.col(right_time).isNotNull()).select(F.lit(None).cast(l.schema["row"].dataType).alias("row"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(on)), F.col(right_time).alias("at"), (1 - side).alias("side"), order.alias("order"), value.alias("found"))
    both = l.union(r)
    keys = [f"k{i}" for i in range(len(on))]
    # forward reads from the end: a frame that begins at each row is computed anew for each row
    way = lambda *names: [F.col(n) if back else F.col(n).desc() for n in names]
    reach = (Window.unboundedPreceding, 0)
    if chunk is None:
        spec = Window.partitionBy(*keys).orderBy(*way("at", "side", "order")).rowsBetween(*reach)
        out = both.withColumn("found", F.last("found", ignorenulls=True).over(spec))
    else:
        both = both.withColumn("piece", F.floor(F.col("at").cast("double") / chunk))
        spec = Window.partitionBy(*keys, "piece").orderBy(*way("at", "side", "order")).rowsBetween(*reach)
        both = both.withColumn("found", F.last("found", ignorenulls=True).over(spec))
        edge = both.groupBy(*keys, "piece").agg((F.max_by if back else F.min_by)(F.col("found"), F.struct("at", "side", "order")).alias("edge"))
        step = Window.partitionBy(*keys).orderBy(*way("piece")).rowsBetween(Window.unboundedPreceding, -1)
        edge = edge.withColumn("edge", F.last("edge", ignorenulls=True).over(step))
        out = both.join(edge, [*keys, "piece"], "left").withColumn("found", F.coalesce("found", "edge"))
    out = out.where(F.col("row").isNotNull())
    if tolerance is not None:
        gap = F.abs(F.col("at").cast("double") - F.col("found.t").cast("double"))
        out = out.withColumn("found", F.when(gap <= tolerance, F.col("found")))
    out = out.withColumn("found", F.when(F.col("at").isNotNull(), F.col("found")))
    return out.select("row.*", *(F.col(f"found.{n}").alias(n) for n in take.values()))


def nearest_in_group(left: DataFrame, right: DataFrame, on: str, at: str, right_on: str, right_at: str, take: str, name: str) -> DataFrame:
    """`left` with the `take` of the right row of its group whose value is nearest: least |at - right_at| in double
    arithmetic, NaN after all numbers and null after NaN, then least `take`; its distance is in name + "_away". Left rows
    without a right one are left out.

    A group's different values are sorted once, and a left row looks at the next one on either side, not at the whole
    group. What is no finite number has few kinds, so a group's rows of each kind are one. Only left rows for which
    rounding makes the next value but one just as near are compared with their group."""
    finite = F.col("_value").isNotNull() & (F.abs("_value") < float("inf"))  # NaN is greater than infinity
    rows = right.select(F.col(right_on).alias("_on"), F.col(right_at).cast("double").alias("_value"), F.col(take).alias("_take")).where("_on IS NOT NULL")
    values = rows.where(finite).groupBy("_on", "_value").agg(F.min("_take").alias("_take"))
    w = Window.partitionBy("_on").orderBy("_value")
    values = values.select(F.col("_on").alias("_n"), "_value", "_take", F.lag("_value").over(w).alias("_less"), F.lead("_value").over(w).alias("_more"))
    kinds = rows.groupBy("_on", F.when(~finite, F.col("_value")).alias("_kind"), finite.alias("_finite")).agg(F.struct(F.min_by("_value", "_take").alias("v"), F.min("_take").alias("take")).alias("_one"))
    kinds = kinds.groupBy("_on").agg(F.collect_list("_one").alias("_kinds"))  # at most five
    out = left.withColumns({"_n": F.col(on), "_at": F.col(at).cast("double")})
    for direction, beyond, end in (("backward", "_less", "_a"), ("forward", "_more", "_b")):
        out = asof_join(out, values, ["_n"], "_at", "_value", {"_value": f"{end}v", "_take": f"{end}take", beyond: f"{end}next"}, direction=direction)
    out = out.join(kinds, F.col("_n") == F.col("_on"))
    away = lambda v: F.abs(F.col("_at") - v)
    cost = lambda v, t: F.struct(away(v).isNull().alias("gone"), away(v).alias("away"), t.alias("take"))
    ends = F.array(*(F.when(F.col(f"{e}take").isNotNull(), cost(F.col(f"{e}v"), F.col(f"{e}take"))) for e in ("_a", "_b")))
    best = F.array_min(F.filter(F.concat(ends, F.transform("_kinds", lambda k: cost(k["v"], k["take"]))), lambda c: c.isNotNull()))
    tied = F.coalesce((away(F.col("_av")) == away(F.col("_anext"))) | (away(F.col("_bv")) == away(F.col("_bnext"))), F.lit(False))
    out = out.withColumn("_tied", tied)
    sure = out.where(~F.col("_tied")).select(*left.columns, best.alias("_best"))
    tied_rows = out.where("_tied").select(*left.columns, "_n", "_at", F.monotonically_increasing_id().alias("_id"))
    each = tied_rows.join(rows, F.col("_n") == F.col("_on")).groupBy("_id", *left.columns).agg(F.min(cost(F.col("_value"), F.col("_take"))).alias("_best"))
    return sure.unionByName(each.drop("_id")).select(*left.columns, F.col("_best.take").alias(name), F.col("_best.away").alias(f"{name}_away"))
