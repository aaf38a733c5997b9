"""Ordered analytics: gaps and islands, greedy suppression, sliding arrays, gap filling, running state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by `keys`, or evenly, over all partitions. For steps whose work is more than their bytes tell: Spark puts
    small partitions together, up to 64 MB, and some MB of numbers are minutes of a row-by-row function in one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows of each key; `starts` says of a row that it begins one (it may use lag over `order`)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_starts", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(name, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def gap_islands(df: DataFrame, keys: list[str], time: str, tie: str, gap: float, name: str = "island") -> DataFrame:
    """Islands of rows at most `gap` apart."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time, tie))
    return islands(df, keys, [time, tie], F.col(time) - before > gap, name)


def greedy_suppress(df: DataFrame, keys: list[str], time: str, tie: str, cooldown: float) -> DataFrame:
    """Rows at least `cooldown` after the last row kept, the first of each key kept. A row that far after its
    predecessor is kept whatever came before, so the rows between two such gaps are decided apart from all others:
    only those go into one array, and a long key is many small groups."""
    rows = gap_islands(df, keys, time, tie, cooldown, "_run")
    # a gap of exactly the cooldown keeps too, but costs nothing to be decided inside the run
    other = [c for c in df.columns if c not in keys]
    runs = rows.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("_t"), F.col(tie).alias("_i"), F.struct(*other).alias("_row")))).alias("_all"))
    kept = F.aggregate(
        F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))),
        F.slice("_all", 1, 1),
        lambda acc, x: F.when(x["_t"] - F.element_at(acc, -1)["_t"] >= cooldown, F.concat(acc, F.array(x))).otherwise(acc),
    )
    return runs.select(*keys, F.explode(kept).alias("_kept")).select(*keys, "_kept._row.*").select(*df.columns)


def last_rows(keys: list[str], order: list[str], n: int, value: Column) -> Column:
    """The values of the last n rows up to this one, oldest first."""
    return F.collect_list(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0))


def sliding_windows(df: DataFrame, keys: list[str], order: list, size: int, stride: int, value: Column) -> DataFrame:
    """Per key the full windows of `size` rows, `stride` apart: keys, window_start (from 0) and items. Where the size is
    a multiple of the stride, rows are gathered in blocks of `stride` first, so an item is copied size / stride times."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if size % stride:
        rows = df.select(*keys, F.row_number().over(w).alias("_n"), last_rows(keys, order, size, value).alias("items"))
        full = rows.where((F.col("_n") >= size) & ((F.col("_n") - size) % stride == 0))
        return full.select(*keys, (F.col("_n") - size).alias("window_start"), "items")
    rows = df.select(*keys, (F.row_number().over(w) - 1).alias("_n"), value.alias("_v"))
    blocks = rows.groupBy(*keys, F.floor(F.col("_n") / stride).alias("_b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_v"))), lambda x: x["_v"]).alias("_items"))
    many = size // stride
    last = Window.partitionBy(*keys).orderBy("_b").rowsBetween(-(many - 1), 0)
    found = blocks.where(F.size("_items") == stride).withColumn("items", F.flatten(F.collect_list("_items").over(last)))
    return found.where(F.col("_b") >= many - 1).select(*keys, ((F.col("_b") - (many - 1)) * stride).cast("int").alias("window_start"), "items")


def fill_linear(df: DataFrame, keys: list[str], frame: str, values: list[str], max_gap: int) -> DataFrame:
    """Rows for the missing whole frames between two rows at most max_gap missing frames apart, linear between them,
    with `filled` true; together with the rows themselves."""
    w = Window.partitionBy(*keys).orderBy(frame)
    nxt = F.lead(F.struct(frame, *values)).over(w)
    rows = df.select(*keys, frame, *values, nxt.alias("_next"))
    gap = F.col(f"_next.{frame}") - F.col(frame)
    span = F.when((gap > 1) & (gap <= max_gap + 1), F.sequence(F.lit(1).cast("long"), (gap - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    fill = rows.select(*keys, frame, *values, "_next", gap.alias("_gap"), F.explode(span).alias("_k"))
    at = F.col("_k") / F.col("_gap")
    made = fill.select(*keys, (F.col(frame) + F.col("_k")).alias(frame), *((F.col(v) + (F.col(f"_next.{v}") - F.col(v)) * at).alias(v) for v in values), F.lit(True).alias("filled"))
    return rows.select(*keys, frame, *values, F.lit(False).alias("filled")).unionByName(made)


def running_max(column: Column, keys: list[str], order: list[str]) -> Column:
    """Forward fill, zero fill and cumulative maximum in one: right for values that are not negative."""
    return F.max(F.coalesce(column, F.lit(0.0))).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def backfill(column: Column, keys: list[str], order: list[str], default: float = 0.0) -> Column:
    """The next value that is not null, else the default."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.first(column, ignorenulls=True).over(w), F.lit(default))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark prunes before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def dense_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Codes 0, 1, ... of the different values in order: (column, code). The values are a vocabulary, so few."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return distinct.withColumn(code, F.dense_rank().over(Window.orderBy(column)) - 1)


def snapshots(events: DataFrame, keys: DataFrame, key: str, time: str, step: float, kinds: dict[str, Column]) -> DataFrame:
    """Counts since the start at every tick of `step` up to the last event: per key and tick, one column per kind.
    Events are first counted per (key, tick), so the running sum sees at most one row for each."""
    tick = F.ceil(F.col(time) / step).cast("long")
    per = events.groupBy(F.col(key), F.greatest(tick, F.lit(1)).alias("tick")).agg(*(F.count_if(c).alias(n) for n, c in kinds.items()))
    last = events.agg(F.max(tick)).first()[0]  # one number
    ticks = F.array().cast("array<bigint>") if last is None else F.sequence(F.lit(1).cast("long"), F.lit(max(last, 1)).cast("long"))
    grid = keys.select(key).distinct().withColumn("tick", F.explode(ticks))
    w = Window.partitionBy(key).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(per, [key, "tick"], "left")
    return filled.select(key, (F.col("tick") * step).alias("until"), *(F.sum(F.coalesce(n, F.lit(0))).over(w).alias(n) for n in kinds))
