"""Choice of candidates, over boxes made of order lines: an order is a frame, its lines are detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import candidates as cand
from ..sources.tables import load
from .registry import query

PICTURE = cand.Picture(1280, 720)
BALL, PLAYER = "l_linenumber IN (1, 4, 6)", "l_linenumber IN (2, 7)"
#: The same expressions make the rows in both engines.
MADE = [
    "l_orderkey % 7 AS video", "l_orderkey AS frame", "l_orderkey * 10 + l_linenumber AS row_id", f"CASE WHEN {BALL} THEN 'ball' WHEN {PLAYER} THEN 'player' ELSE 'hoop' END AS class", "l_discount * l_quantity / 6 AS confidence",
    "l_partkey % 5 - 1 AS track_id", "CAST(300 + l_partkey * 7 % 80 AS DOUBLE) AS x_center", "CAST(200 + l_suppkey * 11 % 60 AS DOUBLE) AS y_center",
    f"CAST(CASE WHEN {BALL} THEN 6 + l_quantity / 2 WHEN {PLAYER} THEN 20 + l_quantity ELSE 10 + l_quantity * 2 END AS DOUBLE) AS w",
    f"CAST(CASE WHEN {BALL} THEN 6 + l_partkey % 30 WHEN {PLAYER} THEN 50 + l_partkey % 90 ELSE 12 + l_suppkey % 50 END AS DOUBLE) AS h",
    "1 + l_linenumber % 2 AS agreement", "l_tax / 2 AS bonus", "l_linenumber % 3 AS model",
]
BOXED = ["*", "x_center - w / 2 AS x1", "y_center - h / 2 AS y1", "x_center + w / 2 AS x2", "y_center + h / 2 AS y2"]
ROWS_SQL = f"r AS MATERIALIZED (SELECT {', '.join(BOXED)} FROM (SELECT {', '.join(MADE)} FROM lineitem))"

ASPECT = "(x2 - x1) / greatest(y2 - y1, 1)"
BALL_FITS = f"class = 'ball' AND x2 - x1 > 3 AND y2 - y1 > 3 AND (x2 - x1) * (y2 - y1) <= least(921600 * 0.0032, 5200) AND greatest(x2 - x1, y2 - y1) <= 95 AND {ASPECT} BETWEEN 0.45 AND 2.2"
HOOP_FITS = f"class = 'hoop' AND x2 - x1 > 4 AND y2 - y1 > 4 AND (x2 - x1) * (y2 - y1) <= 921600 * 0.035 AND greatest(x2 - x1, y2 - y1) <= 1280 * 0.23 AND {ASPECT} BETWEEN 0.25 AND 4.5 AND y_center <= 720 * 0.78 AND x_center BETWEEN -38.4 AND 1318.4"
PLAYER_FITS = f"class = 'player' AND x2 - x1 > 10 AND y2 - y1 > 22 AND x2 - x1 <= 1280 * 0.38 AND y2 - y1 <= 720 * 0.95 AND (x2 - x1) * (y2 - y1) BETWEEN 921600 * 0.00018 AND 921600 * 0.22 AND {ASPECT} BETWEEN 0.12 AND 1.35"


def ball_quality_sql(p: str = "") -> str:
    w, h = f"({p}x2 - {p}x1)", f"({p}y2 - {p}y1)"
    return f"({p}confidence + 0.035 * greatest({p}agreement - 1, 0) + {p}bonus - abs(1 - {w} / greatest({h}, 1)) * 0.08 - greatest(greatest({w} * {h}, 1) - 1600, 0) / 8000)"


def iou_sql(a: str, b: str) -> str:
    both = f"(greatest(least({a}x2, {b}x2) - greatest({a}x1, {b}x1), 0) * greatest(least({a}y2, {b}y2) - greatest({a}y1, {b}y1), 0))"
    return f"{both} / (({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - {both})"


def apart_sql(a: str, b: str) -> str:
    return f"sqrt(pow({a}x_center - {b}x_center, 2) + pow({a}y_center - {b}y_center, 2))"


HOOP_QUALITY = "confidence + greatest((720 * 0.65 - y_center) / 720, 0) * 0.04 - abs(1.25 - greatest(x2 - x1, 1) / greatest(y2 - y1, 1)) * 0.025 - greatest(greatest(x2 - x1, 1) * greatest(y2 - y1, 1) / 921600 - 0.006, 0) * 6"
PLAYER_QUALITY = "confidence + CASE WHEN track_id > 0 THEN 0.1 ELSE 0 END - abs(0.42 - greatest(x2 - x1, 1) / greatest(y2 - y1, 1)) * 0.035"


def rows(spark, sf_dir) -> DataFrame:
    made = load(spark, sf_dir, "lineitem").selectExpr(*MADE).selectExpr(*BOXED)
    return made.withColumn("sources", F.array(F.concat(F.lit("m"), F.col("model").cast("string")))).drop("w", "h", "model")


@query(f"WITH {ROWS_SQL} SELECT row_id, round({ball_quality_sql()}, 6) + 0 AS quality FROM r WHERE {BALL_FITS}")
def ball_shapes(spark, sf_dir):
    return rows(spark, sf_dir).where((F.col("class") == "ball") & cand.ball_shaped(PICTURE)).select("row_id", (F.round(cand.ball_quality(), 6) + 0).alias("quality"))


@query(f"WITH {ROWS_SQL} SELECT row_id, round({HOOP_QUALITY}, 6) + 0 AS quality FROM r WHERE {HOOP_FITS}")
def hoop_shapes(spark, sf_dir):
    return rows(spark, sf_dir).where((F.col("class") == "hoop") & cand.hoop_shaped(PICTURE)).select("row_id", (F.round(cand.hoop_quality(PICTURE), 6) + 0).alias("quality"))


@query(f"WITH {ROWS_SQL} SELECT row_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY {PLAYER_QUALITY} DESC, row_id) AS n FROM r WHERE {PLAYER_FITS}) WHERE n <= 18")
def player_candidates(spark, sf_dir):
    return cand.player_candidates(rows(spark, sf_dir), PICTURE).select("row_id", "frame")


CORE = "b.x_center BETWEEN c.x1 - 4 AND c.x2 + 4 AND b.y_center BETWEEN c.y1 - 4 AND c.y2 + 4 AND (b.x_center - c.x1) / greatest(c.x2 - c.x1, 1) BETWEEN 0.12 AND 0.88 AND (b.y_center - c.y1) / greatest(c.y2 - c.y1, 1) BETWEEN 0.1 AND 0.7"
SHARE = "(greatest(least(b.x2, c.x2) - greatest(b.x1, c.x1), 0) * greatest(least(b.y2, c.y2) - greatest(b.y1, c.y1), 0)) / ((b.x2 - b.x1) * (b.y2 - b.y1))"
IN_RIM = f"""c.x2 - c.x1 > 6 AND c.y2 - c.y1 > 6 AND b.y_center >= c.y_center - greatest(8, (c.y2 - c.y1) * 0.2) AND (
(b.confidence < 0.06 AND b.x_center BETWEEN c.x1 - 3 AND c.x2 + 3 AND b.y_center BETWEEN c.y1 - 3 AND c.y2 + 3 AND {SHARE} >= 0.7 AND greatest(b.x2 - b.x1, b.y2 - b.y1) <= greatest(42, greatest(c.x2 - c.x1, c.y2 - c.y1) * 0.48))
OR (b.confidence < 0.1 AND {apart_sql('b.', 'c.')} <= greatest(18, greatest(c.x2 - c.x1, c.y2 - c.y1) * 0.28) AND {SHARE} >= 0.88 AND greatest(b.x2 - b.x1, b.y2 - b.y1) <= greatest(54, greatest(c.x2 - c.x1, c.y2 - c.y1) * 0.62)))"""
FALSE_SQL = f"""fb AS MATERIALIZED (SELECT DISTINCT b.row_id, CASE c.class WHEN 'hoop' THEN 'hoop' ELSE 'body' END AS reason FROM r b JOIN r c USING (video, frame)
WHERE b.class = 'ball' AND ((c.class = 'hoop' AND {IN_RIM}) OR (c.class = 'player' AND {CORE} AND NOT (b.confidence >= 0.62 OR (b.agreement >= 2 AND b.confidence >= 0.25)))))"""


@query(f"WITH {ROWS_SQL}, {FALSE_SQL} SELECT row_id, reason FROM fb")
def false_balls(spark, sf_dir):
    return cand.false_balls(rows(spark, sf_dir), PICTURE).select("row_id", "reason").distinct()


@query(f"WITH {ROWS_SQL} SELECT DISTINCT b.row_id FROM r b JOIN r c USING (video, frame) WHERE b.class = 'ball' AND b.y_center >= 57.6 AND c.class IN ('hoop', 'player') AND b.x_center BETWEEN c.x1 - CASE c.class WHEN 'hoop' THEN 25 ELSE 18.5 END AND c.x2 + CASE c.class WHEN 'hoop' THEN 25 ELSE 18.5 END AND b.y_center BETWEEN c.y1 - CASE c.class WHEN 'hoop' THEN 25 ELSE 18.5 END AND c.y2 + CASE c.class WHEN 'hoop' THEN 25 ELSE 18.5 END")
def rescue_near_context(spark, sf_dir):
    """With margins a tenth of the usual ones, as the boxes of an order lie close together."""
    r = rows(spark, sf_dir)
    return cand.near_context(r.where("class = 'ball'"), r, PICTURE, 0.1).select("row_id").distinct()


FOLD = "STRUCT_PACK(row_id := row_id, confidence := confidence, x_center := x_center, y_center := y_center, x1 := x1, y1 := y1, x2 := x2, y2 := y2, agreement := agreement, bonus := bonus, sources := sources)"
_SAME = f"({iou_sql('c.s.', 'k.')} > 0.45 OR {apart_sql('c.s.', 'k.')} <= greatest(10, greatest(c.s.x2 - c.s.x1, c.s.y2 - c.s.y1) * 0.65, greatest(k.x2 - k.x1, k.y2 - k.y1) * 0.65))"
_SOURCES = "list_sort(list_distinct(list_concat(c.s.sources, k.sources)))"
_BEST = lambda f: f"CASE WHEN {ball_quality_sql('c.s.')} >= {ball_quality_sql('k.')} THEN c.s.{f} ELSE k.{f} END"
_MERGED = f"""STRUCT_PACK(row_id := {_BEST('row_id')}, confidence := round(least(0.99, greatest(c.s.confidence, k.confidence) + 0.04 * greatest(len({_SOURCES}) - 1, 0)), 3), {', '.join(f'{f} := {_BEST(f)}' for f in ('x_center', 'y_center', 'x1', 'y1', 'x2', 'y2'))},
agreement := len({_SOURCES})::BIGINT, bonus := greatest(c.s.bonus, k.bonus), sources := {_SOURCES})"""


@query(f"""WITH RECURSIVE {ROWS_SQL}, {FALSE_SQL},
b AS (SELECT * REPLACE (agreement::BIGINT AS agreement), ['m' || model] AS sources FROM r WHERE {BALL_FITS} AND row_id NOT IN (SELECT row_id FROM fb)),
c AS MATERIALIZED (SELECT video, frame, row_number() OVER (PARTITION BY video, frame ORDER BY {ball_quality_sql()} DESC, row_id) AS n, {FOLD} AS s FROM b),
f AS (SELECT video, frame, n, [s] AS kept FROM c WHERE n = 1 UNION ALL
SELECT f.video, f.frame, c.n, CASE WHEN coalesce(list_position(list_transform(kept, lambda k: {_SAME}), true), 0) = 0 THEN list_append(kept, c.s)
ELSE list_transform(kept, lambda k, i: CASE WHEN i = list_position(list_transform(kept, lambda k: {_SAME}), true) THEN {_MERGED} ELSE k END) END
FROM f JOIN c ON c.video = f.video AND c.frame = f.frame AND c.n = f.n + 1),
d AS (SELECT video, frame, unnest(arg_max(kept, n)) AS k FROM f GROUP BY video, frame)
SELECT video, frame, k.row_id AS row_id, round(k.confidence, 3) AS confidence, k.agreement AS agreement, array_to_string(k.sources, '|') AS sources, round(k.bonus, 6) AS bonus FROM d""")
def ball_candidates(spark, sf_dir):
    found = cand.ball_candidates(rows(spark, sf_dir), PICTURE)
    return found.select("video", "frame", "row_id", F.round("confidence", 3).alias("confidence"), F.col("agreement").cast("long").alias("agreement"), F.concat_ws("|", "sources").alias("sources"), F.round("bonus", 6).alias("bonus"))


def _greedy_sql(fits: str, quality: str, most_iou: float, least: float, top: int) -> str:
    same = f"({iou_sql('c.s.', 'k.')} > {most_iou} OR {apart_sql('c.s.', 'k.')} <= {least})"
    return f"""c AS MATERIALIZED (SELECT video, frame, row_number() OVER (PARTITION BY video, frame ORDER BY {quality} DESC, row_id) AS n, STRUCT_PACK(row_id := row_id, x_center := x_center, y_center := y_center, x1 := x1, y1 := y1, x2 := x2, y2 := y2) AS s FROM r WHERE {fits}),
f AS (SELECT video, frame, n, [s] AS kept FROM c WHERE n = 1 UNION ALL SELECT f.video, f.frame, c.n, CASE WHEN len(list_filter(kept, lambda k: {same})) = 0 THEN list_append(kept, c.s) ELSE kept END FROM f JOIN c ON c.video = f.video AND c.frame = f.frame AND c.n = f.n + 1)
SELECT video, frame, k.row_id AS row_id FROM (SELECT video, frame, unnest(arg_max(kept, n)[1:{top}]) AS k FROM f GROUP BY video, frame)"""


@query(f"WITH RECURSIVE {ROWS_SQL}, {_greedy_sql(HOOP_FITS, HOOP_QUALITY, 0.35, 28, 4)}")
def hoop_candidates(spark, sf_dir):
    return cand.hoop_candidates(rows(spark, sf_dir), PICTURE).select("video", "frame", "row_id")


@query(f"""WITH RECURSIVE {ROWS_SQL}, g AS (SELECT * FROM ({_greedy_sql(PLAYER_FITS, PLAYER_QUALITY, 0.42, 32, 14).replace("c AS", "WITH RECURSIVE c AS", 1)}))
SELECT row_id, class FROM r WHERE class <> 'player' AND l_part = 0 UNION ALL SELECT row_id, 'player' FROM g""".replace(" AND l_part = 0", " AND row_id % 10 < 4"))
def rescued_players(spark, sf_dir):
    """Players of first lines and of later ones together, the other classes from first lines only."""
    r = rows(spark, sf_dir)
    base, rescue = r.where("row_id % 10 < 4"), r.where("row_id % 10 >= 4")
    return cand.replace_class(base, rescue, "player", lambda both: cand.distinct_players(cand.player_candidates(both, PICTURE), PICTURE)).select("row_id", "class")


@query(f"WITH {ROWS_SQL} SELECT row_id, floor((x1 + 12.345) * 100 + 0.5) / 100 AS x1, floor((y_center - 7.005) * 100 + 0.5) / 100 AS y_center, round(least(0.07, confidence * 0.35), 3) AS confidence, 'ball_b' AS source, 1 AS agreement, 0.03 AS bonus FROM r WHERE class = 'ball'")
def rescue_records(spark, sf_dir):
    """Balls of a crop: moved to the whole picture, of little confidence, with their model."""
    moved = cand.annotate(cand.attenuated(cand.shifted(rows(spark, sf_dir).where("class = 'ball'"), 12.345, -7.005)), "ball_b", 0.03)
    return moved.select("row_id", "x1", "y_center", "confidence", "source", F.col("agreement").cast("int").alias("agreement"), "bonus")
