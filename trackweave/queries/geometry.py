"""Boxes, polygons and suppression over points made of keys of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.tables import load
from .registry import query

COURT = [(10.0, 10.0), (90.0, 20.0), (80.0, 80.0), (20.0, 70.0)]


def _edge_sql(i: int) -> tuple[str, str]:
    (ax, ay), (bx, by) = COURT[i], COURT[(i + 1) % 4]
    cross = f"(({ay} > y) <> ({by} > y) AND x < {ax} + (y - {ay}) * ({bx} - {ax}) / ({by} - {ay}))"
    t = f"least(greatest(((x - {ax}) * ({bx} - {ax}) + (y - {ay}) * ({by} - {ay})) / {(bx - ax) ** 2 + (by - ay) ** 2}, 0), 1)"
    near = f"sqrt(pow(x - ({ax} + {t} * ({bx} - {ax})), 2) + pow(y - ({ay} + {t} * ({by} - {ay})), 2))"
    return cross, near


_CROSS = " + ".join(f"{_edge_sql(i)[0]}::INT" for i in range(4))
_NEAR = f"least({', '.join(_edge_sql(i)[1] for i in range(4))})"


@query(f"SELECT p_partkey, ({_CROSS}) % 2 = 1 OR {_NEAR} <= 3 AS inside, round({_NEAR}, 6) AS edge_distance FROM (SELECT p_partkey, (p_partkey * 37 % 1000) / 10.0 AS x, (p_partkey * 91 % 1000) / 10.0 AS y FROM part)")
def point_in_polygon(spark, sf_dir):
    x, y = F.col("p_partkey") * 37 % 1000 / 10.0, F.col("p_partkey") * 91 % 1000 / 10.0
    poly = g.polygon(COURT)
    p = load(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"))
    return p.select("p_partkey", g.in_polygon(F.col("x"), F.col("y"), poly, 3.0).alias("inside"), F.round(g.polygon_distance(F.col("x"), F.col("y"), poly), 6).alias("edge_distance"))


@query("WITH b AS (SELECT s_suppkey AS id, s_nationkey AS f, (s_suppkey * 13 % 60)::DOUBLE AS l, (s_suppkey * 7 % 60)::DOUBLE AS t FROM supplier), p AS (SELECT x.id AS a, y.id AS b, greatest(least(x.l, y.l) + 30 - greatest(x.l, y.l), 0) * greatest(least(x.t, y.t) + 40 - greatest(x.t, y.t), 0) AS i FROM b x JOIN b y ON x.f = y.f AND x.id < y.id) SELECT a, b, round(i / (2400 - i), 6) AS iou, round(i / 1200, 6) AS share FROM p")
def iou_pairs(spark, sf_dir):
    rows = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("f"), (F.col("s_suppkey") * 13 % 60).cast("double").alias("l"), (F.col("s_suppkey") * 7 % 60).cast("double").alias("t"))
    x, y = rows.select("f", *(F.col(c).alias(f"x_{c}") for c in ("id", "l", "t"))), rows.select("f", *(F.col(c).alias(f"y_{c}") for c in ("id", "l", "t")))
    pairs = x.join(y, "f").where("x_id < y_id")
    box = lambda n: (F.col(f"{n}_l"), F.col(f"{n}_t"), F.col(f"{n}_l") + 30, F.col(f"{n}_t") + 40)
    return pairs.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.round(g.iou(box("x"), box("y")), 6).alias("iou"), F.round(g.overlap_share(box("x"), box("y")), 6).alias("share"))


@query("SELECT p_partkey, round(sqrt(pow(greatest(20 - x, 0, x - 70), 2) + pow(greatest(30 - y, 0, y - 60), 2)), 6) AS distance FROM (SELECT p_partkey, (p_partkey * 37 % 1000) / 10.0 AS x, (p_partkey * 91 % 1000) / 10.0 AS y FROM part)")
def bbox_distance(spark, sf_dir):
    x, y = F.col("p_partkey") * 37 % 1000 / 10.0, F.col("p_partkey") * 91 % 1000 / 10.0
    box = tuple(F.lit(float(v)) for v in (20, 30, 70, 60))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(g.box_distance(x, y, box), 6).alias("distance"))


@query("SELECT p_partkey, k AS class, round(x - s / 2, 2) AS x1, round(y + s / 2, 2) AS y2, least(greatest(s, 8), 40) AS ball_size FROM (SELECT p_partkey, x, y, k, CASE k WHEN 'ball' THEN 18.0 WHEN 'player' THEN 70.0 WHEN 'hoop' THEN 80.0 ELSE 40.0 END::DOUBLE AS s FROM (SELECT p_partkey, (p_partkey * 37 % 1000)::DOUBLE AS x, (p_partkey * 91 % 1000)::DOUBLE AS y, ['ball', 'player', 'hoop', 'cup'][1 + p_partkey % 4] AS k FROM part))")
def default_boxes(spark, sf_dir):
    n = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("ball", "player", "hoop", "cup"))), (n % 4 + 1).cast("int"))
    box = g.centred_box(kind, (n * 37 % 1000).cast("double"), (n * 91 % 1000).cast("double"))
    return load(spark, sf_dir, "part").select("p_partkey", kind.alias("class"), box[0].alias("x1"), box[3].alias("y2"), g.ball_size(box).alias("ball_size"))
