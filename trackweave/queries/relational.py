"""Operators of joins, aggregations, windows and sets over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import asof, quantiles, ranges, sequences
from ..sources.tables import load
from .registry import query

CUST = ["o_orderdate", "o_orderkey"]
#: Seconds since the first day of the events table.
SECONDS = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e6"
SECONDS_SQL = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6"


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def timed(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("t", F.expr(SECONDS))


# aggregations


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share_pct FROM events GROUP BY event_type")
def value_share(spark, sf_dir):
    per = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return per.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("SELECT l_returnflag, count(l_quantity) AS n, count(DISTINCT l_suppkey) AS n_suppliers, round(avg(l_discount), 6) AS avg_discount FROM lineitem GROUP BY l_returnflag")
def group_count_nunique_mean(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("l_quantity").alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.round(F.avg("l_discount"), 6).alias("avg_discount"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def count_mean_ordered(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value")).orderBy(F.desc("n"), "event_type")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(100.0 * count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 4) AS coverage_pct, min(event_id) AS first_id, max(event_id) AS last_id, round(avg(coalesce(value, 0)), 4) AS mean_value, round(median(coalesce(value, 0)), 4) AS median_value, min(value) AS least, max(value) AS most, count(*) FILTER (WHERE value > 0) AS n_positive FROM events GROUP BY event_type")
def class_summary(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    v = F.coalesce("value", F.lit(0.0))
    users = e.agg(F.count_distinct("user_id")).first()[0]  # one number
    per = e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.round(F.avg(v), 4).alias("mean_value"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.count_if(F.col("value") > 0).alias("n_positive"),
    )
    per = per.join(quantiles.medians(e, ["event_type"], v, "median_value"), "event_type").withColumn("median_value", F.round("median_value", 4))
    return per.withColumn("coverage_pct", F.round(100.0 * F.col("n_users") / F.lit(users), 4))


@query("SELECT count(*) AS n_rows, round(100.0 * count(*) FILTER (WHERE value > 50) / count(*), 4) AS reliable_pct, max(value) AS max_value, count(*) FILTER (WHERE value > 120) AS n_over_120, count(*) FILTER (WHERE value > 180) AS n_over_180, count(*) FILTER (WHERE event_type = 'click') AS status_click, count(*) FILTER (WHERE event_type = 'view') AS status_view, count(*) FILTER (WHERE event_type = 'error') AS status_error FROM events")
def quality_report(spark, sf_dir):
    n = F.count("*")
    return load(spark, sf_dir, "events").agg(
        n.alias("n_rows"), F.round(100.0 * F.count_if(F.col("value") > 50) / n, 4).alias("reliable_pct"), F.max("value").alias("max_value"), F.count_if(F.col("value") > 120).alias("n_over_120"),
        F.count_if(F.col("value") > 180).alias("n_over_180"), *(F.count_if(F.col("event_type") == s).alias(f"status_{s}") for s in ("click", "view", "error")),
    )


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, coalesce(round(100.0 * count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 2), 0) AS success_pct FROM events GROUP BY user_id")
def conditional_counts(spark, sf_dir):
    kinds = ["view", "click", "purchase"]
    per = load(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds))
    return per.withColumn("success_pct", F.coalesce(F.round(100.0 * F.col("n_purchase") / F.nullif("n_view", F.lit(0)), 2), F.lit(0.0)))


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))")
def grouping_sets_summary(spark, sf_dir):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    per = load(spark, sf_dir, "orders").groupingSets([[], [s], [p], [s, p]], s, p).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return per.select(F.coalesce(s, F.lit("all")).alias("status"), F.coalesce(p, F.lit("all")).alias("priority"), "n", "total")


@query("SELECT user_id, event_type AS mode_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1")
def mode_per_group(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.mode("event_type", deterministic=True).alias("mode_type"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS last_value, round(median(value), 4) AS median_value FROM events GROUP BY user_id")
def group_last_median(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))
    return last.join(quantiles.medians(e, ["user_id"], F.col("value")), "user_id").select("user_id", "last_value", F.round("median", 4).alias("median_value"))


@query("SELECT user_id, event_type AS winner, n AS votes FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_id) AS r FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS start FROM events) WHERE ts <= start + INTERVAL 5 DAY GROUP BY ALL)) WHERE r = 1")
def majority_vote(spark, sf_dir):
    """The most frequent type of each user's first five days, the first seen of equals."""
    e = load(spark, sf_dir, "events").withColumn("start", F.min("ts").over(Window.partitionBy("user_id"))).where("ts <= start + INTERVAL 5 DAY")
    votes = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return votes.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first_id"))).alias("winner"), F.max("n").alias("votes"))


@query("SELECT round(avg(abs(l_discount - l_tax)), 8) AS mae, round(median(abs(l_discount - l_tax)), 8) AS median_ae, round(avg(CASE WHEN abs(l_quantity - 25) < 1 THEN 0.5 * (l_quantity - 25) * (l_quantity - 25) ELSE abs(l_quantity - 25) - 0.5 END), 6) AS smooth_l1 FROM lineitem")
def mae_smoothl1(spark, sf_dir):
    d = F.abs(F.col("l_discount") - F.col("l_tax"))
    rows = load(spark, sf_dir, "lineitem")
    middle = quantiles.medians(rows, [], d).first()[0]  # one number
    return rows.agg(F.round(F.avg(d), 8).alias("mae"), F.round(F.lit(middle), 8).alias("median_ae"), F.round(F.avg(scalars.smooth_l1(F.col("l_quantity") - 25)), 6).alias("smooth_l1"))


@query("SELECT user_id, list_aggregate(list(event_type || '=' || n ORDER BY event_type), 'string_agg', ',') AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def counts_as_map(spark, sf_dir):
    per = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    return per.groupBy("user_id").agg(F.array_join(F.transform(pairs, lambda p: F.concat(p["event_type"], F.lit("="), p["n"].cast("string"))), ",").alias("counts"))


@query(f"WITH e AS (SELECT *, {SECONDS_SQL} AS t FROM events), g AS (SELECT user_id, tick * 86400.0 AS until FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(generate_series(1, (SELECT ceil(max(t) / 86400.0)::BIGINT FROM e))) AS tick)) SELECT g.user_id, g.until, count(e.t) FILTER (WHERE event_type = 'view') AS n_view, count(e.t) FILTER (WHERE event_type = 'purchase') AS n_purchase FROM g LEFT JOIN e ON e.user_id = g.user_id AND e.t <= g.until GROUP BY ALL")
def cumulative_snapshots(spark, sf_dir):
    e = timed(spark, sf_dir)
    return sequences.snapshots(e, e, "user_id", "t", 86400.0, {"n_view": F.col("event_type") == "view", "n_purchase": F.col("event_type") == "purchase"})


# windows


@query("SELECT event_id, user_id, from_type, event_type AS to_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_type FROM events) WHERE from_type <> event_type")
def owner_change(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.lag("event_type").over(by_user()).alias("from_type"), F.col("event_type").alias("to_type"))
    return e.where("from_type <> to_type")


@query("SELECT event_id, round(value - lag(value) OVER w, 4) AS delta, least(coalesce(abs(value - lag(value) OVER w), 0) * 30, 12.0) AS speed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def step_delta_speed(spark, sf_dir):
    d = F.col("value") - F.lag("value").over(by_user())
    return load(spark, sf_dir, "events").select("event_id", F.round(d, 4).alias("delta"), scalars.capped_speed(F.coalesce(F.abs(d), F.lit(0.0))).alias("speed"))


@query("SELECT o_orderkey, max(coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 0)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS score FROM orders")
def ffill_cummax(spark, sf_dir):
    seen = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return load(spark, sf_dir, "orders").select("o_orderkey", sequences.running_max(seen, ["o_custkey"], CUST).alias("score"))


@query("SELECT o_orderkey, coalesce(first_value(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS next_score FROM orders")
def bfill_first(spark, sf_dir):
    seen = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return load(spark, sf_dir, "orders").select("o_orderkey", sequences.backfill(seen, ["o_custkey"], CUST).alias("next_score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, cur, last_value(cur) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - cur AS remaining FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS cur FROM lineitem)")
def remaining_to_final(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = load(spark, sf_dir, "lineitem").withColumn("cur", F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    final = F.last("cur").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "cur", (final - F.col("cur")).alias("remaining"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS smooth FROM events")
def rolling_mean_centered(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(by_user().rowsBetween(-1, 1)), 4).alias("smooth"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS nth FROM events")
def cumcount(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return load(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) - 1).alias("nth"))


@query("SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING), ',') AS seen FROM events")
def last_n_events(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.array_join(sequences.last_rows(["user_id"], ["ts", "event_id"], 20, F.col("event_type")), ",").alias("seen"))


@query("SELECT user_id, n - 20 AS window_start, array_to_string(items, ',') AS items FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING) AS items FROM events) WHERE n >= 20 AND (n - 20) % 5 = 0")
def sliding_windows_w20_s5(spark, sf_dir):
    w = sequences.sliding_windows(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 20, 5, F.col("event_id"))
    return w.select("user_id", "window_start", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


ISLANDS_SQL = f"SELECT *, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 7200 THEN 0 ELSE 1 END AS starts FROM (SELECT *, {SECONDS_SQL} AS t FROM events))"


@query(f"SELECT user_id, island, min(event_id) AS first_id, count(*) AS n, round(max(t) - min(t), 3) AS seconds FROM ({ISLANDS_SQL}) GROUP BY user_id, island")
def islands_gap(spark, sf_dir):
    runs = sequences.gap_islands(timed(spark, sf_dir), ["user_id"], "t", "event_id", 7200.0)
    return runs.groupBy("user_id", "island").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("seconds"))


@query("SELECT user_id, min(event_id) AS first_id, arg_min(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS starts FROM events)) GROUP BY user_id, run HAVING count(*) >= 2")
def islands_value_change(spark, sf_dir):
    runs = sequences.islands(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.lag("event_type").over(by_user()) != F.col("event_type"), "run")
    return runs.groupBy("user_id", "run").agg(F.min("event_id").alias("first_id"), F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("n")).where("n >= 2").drop("run")


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, {SECONDS_SQL} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), k AS (SELECT event_id, user_id, t, n FROM e WHERE n = 1 UNION ALL (SELECT x.event_id, x.user_id, x.t, x.n FROM k, LATERAL (SELECT * FROM e WHERE e.user_id = k.user_id AND e.n > k.n AND e.t - k.t >= 36000 ORDER BY e.n LIMIT 1) x)) SELECT event_id, user_id FROM k")
def greedy_suppress(spark, sf_dir):
    return sequences.greedy_suppress(timed(spark, sf_dir).select("event_id", "user_id", "t"), ["user_id"], "t", "event_id", 36000.0).select("event_id", "user_id")


@query("SELECT event_id, user_id, round(value - lag(value) OVER w - (lag(value) OVER w - lag(value, 2) OVER w), 4) AS second_difference FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def second_difference(spark, sf_dir):
    one = F.col("value") - F.lag("value").over(by_user())
    two = F.lag("value").over(by_user()) - F.lag("value", 2).over(by_user())
    return load(spark, sf_dir, "events").select("event_id", "user_id", F.round(one - two, 4).alias("second_difference"))


@query("SELECT s_suppkey, CASE WHEN r <= greatest(1, n // 2) THEN 1 ELSE 2 END AS team FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)")
def rank_split(spark, sf_dir):
    w = Window.partitionBy("s_nationkey")
    s = load(spark, sf_dir, "supplier").withColumn("r", F.row_number().over(w.orderBy("s_acctbal", "s_suppkey"))).withColumn("n", F.count("*").over(w))
    return s.select("s_suppkey", F.when(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 2)), 1).otherwise(2).alias("team"))


@query("SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)")
def vocab_dense(spark, sf_dir):
    return sequences.dense_codes(load(spark, sf_dir, "part"), "p_type", "code")


@query("SELECT count(*) FILTER (WHERE l_quantity IS NULL) AS n_null, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')) AS n_domain, count(*) FILTER (WHERE l_discount < 0) AS n_negative, count(*) FILTER (WHERE l_shipdate < before) AS n_backward FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS before FROM lineitem)")
def dq_violations(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = load(spark, sf_dir, "lineitem").withColumn("before", F.lag("l_shipdate").over(w))
    return rows.agg(F.count_if(F.col("l_quantity").isNull()).alias("n_null"), F.count_if(~F.col("l_returnflag").isin("A", "N", "R")).alias("n_domain"), F.count_if(F.col("l_discount") < 0).alias("n_negative"), F.count_if(F.col("l_shipdate") < F.col("before")).alias("n_backward"))


# joins


@query("SELECT o_orderkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 WHEN c_mktsegment = 'MACHINERY' THEN 0.0 ELSE 0.5 END AS team_side FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def dim_lookup_side(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    side = F.when(F.col("c_mktsegment") == "BUILDING", 1.0).when(F.col("c_mktsegment") == "MACHINERY", 0.0).otherwise(0.5)
    return load(spark, sf_dir, "orders").join(c, "o_custkey", "left").select("o_orderkey", "c_name", side.alias("team_side"))


def _asof_sides(spark, sf_dir):
    e = timed(spark, sf_dir)
    return e.where("event_type = 'click'").select("event_id", "user_id", "t"), e.where("event_type = 'purchase'").select(F.col("event_id").alias("r_id"), "user_id", F.col("t").alias("rt"), "value")


ASOF_SQL = f"WITH e AS (SELECT *, {SECONDS_SQL} AS t FROM events), l AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'click'), r AS (SELECT event_id AS r_id, user_id, t AS rt, value FROM e WHERE event_type = 'purchase')"


@query(f"{ASOF_SQL} SELECT event_id, r_id AS before_id, value AS before_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.rt")
def asof_backward(spark, sf_dir):
    l, r = _asof_sides(spark, sf_dir)
    return asof.asof_join(l, r, ["user_id"], "t", "rt", {"r_id": "before_id", "value": "before_value"}, tie="r_id").select("event_id", "before_id", "before_value")


@query(f"{ASOF_SQL} SELECT event_id, r_id AS before_id, value AS before_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.rt")
def asof_backward_chunked(spark, sf_dir):
    l, r = _asof_sides(spark, sf_dir)
    return asof.asof_join(l, r, ["user_id"], "t", "rt", {"r_id": "before_id", "value": "before_value"}, tie="r_id", chunk=200_000.0).select("event_id", "before_id", "before_value")


@query(f"{ASOF_SQL} SELECT event_id, CASE WHEN t - rt <= 40000 THEN r_id END AS before_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.rt")
def asof_tolerance(spark, sf_dir):
    l, r = _asof_sides(spark, sf_dir)
    return asof.asof_join(l, r, ["user_id"], "t", "rt", {"r_id": "before_id"}, tie="r_id", tolerance=40000.0).select("event_id", "before_id")


@query(f"{ASOF_SQL} SELECT event_id, CASE WHEN rt - t <= 60000 THEN r_id END AS after_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t <= r.rt")
def asof_forward(spark, sf_dir):
    l, r = _asof_sides(spark, sf_dir)
    return asof.asof_join(l, r, ["user_id"], "t", "rt", {"r_id": "after_id"}, tie="r_id", direction="forward", tolerance=60000.0).select("event_id", "after_id")


@query(f"{ASOF_SQL} SELECT event_id, (SELECT count(*) FROM r WHERE r.user_id = l.user_id AND r.rt <= l.t) AS n_before FROM l")
def cumulative_event_count(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    e = timed(spark, sf_dir).withColumn("n_before", F.count_if(F.col("event_type") == "purchase").over(w))
    return e.where("event_type = 'click'").select("event_id", "n_before")


@query(f"{ASOF_SQL} SELECT event_id FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND l.t BETWEEN r.rt - 20000 AND r.rt + 20000)")
def range_exists(spark, sf_dir):
    l, r = _asof_sides(spark, sf_dir)
    return ranges.range_join(l, r, ["user_id"], "t", F.col("rt") - 20000, F.col("rt") + 20000, 40000.0, "left_semi").select("event_id")


@query(f"{ASOF_SQL} SELECT event_id FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND l.t BETWEEN r.rt AND r.rt + 25000)")
def range_anti(spark, sf_dir):
    l, r = _asof_sides(spark, sf_dir)
    return ranges.range_join(l, r, ["user_id"], "t", F.col("rt"), F.col("rt") + 25000, 25000.0, "left_anti").select("event_id")


@query(f"{ASOF_SQL} SELECT event_id, arg_min(r_id, (abs(l.t - rt) + value, r_id)) AS nearest_id FROM l JOIN r ON l.user_id = r.user_id AND abs(l.t - rt) <= 30000 GROUP BY event_id")
def nearest_in_range(spark, sf_dir):
    l, r = _asof_sides(spark, sf_dir)
    return ranges.nearest_in_range(l, r, ["user_id"], "t", "rt", 30000.0, F.abs(F.col("t") - F.col("rt")) + F.col("value"), ["event_id"], ["r_id"], "r_id").select("event_id", F.col("r_id").alias("nearest_id"))


@query("SELECT c_custkey, arg_min(s_suppkey, (abs(c_acctbal - s_acctbal), s_suppkey)) AS nearest FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY c_custkey")
def nearest_in_group(spark, sf_dir):
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    near = asof.nearest_in_group(c.select("c_custkey", "c_nationkey", "c_acctbal"), s, "c_nationkey", "c_acctbal", "s_nationkey", "s_acctbal", "s_suppkey", "nearest")
    return near.groupBy("c_custkey").agg(F.min_by("nearest", F.struct(F.col("nearest_away").isNull(), "nearest_away", "nearest")).alias("nearest"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 1000")
def theta_self_pairs(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    a, b = (s.select(F.col("s_suppkey").alias(n), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias(f"{n}_bal")) for n in "ab")
    return a.join(b, "k").where("a < b AND abs(a_bal - b_bal) < 1000").select("a", "b")


@query("SELECT event_id, lead(event_id) OVER w AS next_id, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def adjacent_rows(spark, sf_dir):
    nxt = F.lead(F.struct("event_id", "event_type")).over(by_user())
    return load(spark, sf_dir, "events").select("event_id", nxt["event_id"].alias("next_id"), nxt["event_type"].alias("next_type"))


# gap filling, top-k, sets

GAPS_SQL = "SELECT p_size AS k, p_partkey // 100 * 4 + p_partkey % 3 AS frame, max(p_retailprice) AS v FROM part GROUP BY ALL"


@query(f"WITH d AS ({GAPS_SQL}), n AS (SELECT *, lead(frame) OVER w AS nf, lead(v) OVER w AS nv FROM d WINDOW w AS (PARTITION BY k ORDER BY frame)) SELECT k, frame, v, false AS filled FROM n UNION ALL SELECT k, frame + i, round(v + (nv - v) * i / (nf - frame), 6), true FROM (SELECT *, unnest(range(1, nf - frame)) AS i FROM n WHERE nf - frame BETWEEN 2 AND 6)")
def gap_fill_linear(spark, sf_dir):
    d = load(spark, sf_dir, "part").selectExpr("p_size AS k", "p_partkey div 100 * 4 + p_partkey % 3 AS frame", "p_retailprice").groupBy("k", "frame").agg(F.max("p_retailprice").alias("v"))
    return sequences.fill_linear(d, ["k"], "frame", ["v"], 5).withColumn("v", F.when(F.col("filled"), F.round("v", 6)).otherwise(F.col("v")))


@query("WITH s AS (SELECT unnest(range(0, (SELECT max(p_size) FROM part) + 10)) AS frame), b AS (SELECT p_size AS frame, arg_max(p_partkey, (p_retailprice, p_partkey)) AS best FROM part GROUP BY 1) SELECT frame, best, best IS NOT NULL AS detected FROM s LEFT JOIN b USING (frame)")
def dense_spine(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    spine = p.agg(F.max("p_size").alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n") + 9)).alias("frame"))
    best = p.groupBy(F.col("p_size").alias("frame")).agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best"))
    return spine.join(best, "frame", "left").withColumn("detected", F.col("best").isNotNull())


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 12")
def topk_per_group(spark, sf_dir):
    return sequences.top_k(load(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 12).select("event_type", "event_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_per_group(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def first_per_key(spark, sf_dir):
    return sequences.top_k(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def global_topk(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("WITH u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM u) SELECT user_id, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS part FROM r")
def split_80_10_10(spark, sf_dir):
    from ..plans.play_by_play import split_games

    return split_games(load(spark, sf_dir, "events").select("user_id").distinct(), "user_id")


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier")
def union_missing_cols(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("SELECT event_id, event_type, value FROM events WHERE event_type <> 'click' UNION ALL SELECT event_id, event_type, round(value / 2, 4) FROM events WHERE event_type = 'click'")
def replace_subset(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return e.where("event_type <> 'click'").unionByName(e.where("event_type = 'click'").withColumn("value", F.round(F.col("value") / 2, 4)))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def key_difference(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(load(spark, sf_dir, "supplier").select("s_suppkey"))



@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def key_intersection(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(load(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT l_suppkey AS k FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier")
def bag_difference(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).exceptAll(load(spark, sf_dir, "supplier").select("s_suppkey"))


@query("SELECT l_suppkey AS k FROM lineitem INTERSECT ALL SELECT o_custkey FROM orders")
def bag_intersection(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).intersectAll(load(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT o_orderkey, coalesce(try_cast(o_orderpriority AS BIGINT), 999999) AS rank FROM orders WHERE o_orderkey % 100 = 0 AND o_totalprice BETWEEN 1000 AND 200000")
def sampled_scan(spark, sf_dir):
    """Every 100th frame in a range: the sampling operator itself."""
    o = load(spark, sf_dir, "orders").where("o_orderkey % 100 = 0 AND o_totalprice BETWEEN 1000 AND 200000")
    return o.select("o_orderkey", F.coalesce(F.col("o_orderpriority").try_cast("long"), F.lit(999999)).alias("rank"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_property(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    w = F.window("ts", "1 day")
    return load(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query(f"SELECT user_id, min(ts) AS start, count(*) AS n FROM ({ISLANDS_SQL.replace('<= 7200', '< 7200')}) GROUP BY user_id, island")
def sessions(spark, sf_dir):
    s = F.session_window("ts", "2 hours")
    return load(spark, sf_dir, "events").groupBy("user_id", s.alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")
