"""False balls, over videos whose ball moves in cycles: it comes near a hoop by arcs, by jumps, or lies there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import candidates as cand
from ..plans import ball_path, pipeline, rims
from ..sources.tables import load
from .registry import query

PICTURE, FPS = cand.Picture(1280, 720), 30.0
#: The same expressions in both engines (DIV stands for the whole quotient).
NUMBERED = ["user_id AS video", "event_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n"]
PLACED = [
    "video", "event_id", "n", "n + 9 * (n DIV 24) AS frame", "n % 24 AS ph", "(n DIV 24 + video) % 5 AS kind", "CAST(event_id * 7 % 50 AS DOUBLE) / 100 AS confidence",
]
BALL = [
    "video", "frame", "event_id * 10 AS row_id", "'ball' AS class", "0 AS track_id", "confidence", "n DIV 12 AS ball_segment",
    "CAST(CASE WHEN ph >= 12 AND ph < 20 THEN 632 + event_id % 9 WHEN kind = 0 THEN 200 + ph * 36 WHEN kind = 1 THEN 300 + ph * 3 WHEN kind = 2 THEN 620 + ph WHEN kind = 3 THEN 10 + event_id % 5 ELSE 150 + event_id * 13 % 900 END AS DOUBLE) AS x_center",
    "CAST(CASE WHEN ph >= 12 AND ph < 20 THEN 124 + event_id % 7 WHEN kind = 0 THEN 420 - ph * 32 WHEN kind = 1 THEN 500 WHEN kind = 2 THEN 118 + event_id % 3 WHEN kind = 3 THEN 300 + event_id % 6 ELSE 200 + event_id * 11 % 400 END AS DOUBLE) AS y_center", "18.0 AS w", "18.0 AS h",
]
HOOP = ["video", "frame", "event_id * 10 + 1 AS row_id", "'hoop' AS class", "-1 AS track_id", "0.5 + confidence AS confidence", "NULL AS ball_segment", "CAST(640 + event_id % 4 AS DOUBLE) AS x_center", "CAST(126 AS DOUBLE) AS y_center", "52.0 AS w", "44.0 AS h"]
PLAYER = ["video", "frame", "event_id * 10 + 2 AS row_id", "'player' AS class", "event_id % 6 AS track_id", "0.8 AS confidence", "NULL AS ball_segment", "CAST(300 + event_id * 17 % 700 AS DOUBLE) AS x_center", "CAST(420 + event_id % 90 AS DOUBLE) AS y_center", "50.0 AS w", "120.0 AS h"]
TYPED = ["CAST(video AS BIGINT) AS video", "CAST(frame AS BIGINT) AS frame", "CAST(row_id AS BIGINT) AS row_id", "class", "CAST(track_id AS BIGINT) AS track_id", "CAST(confidence AS DOUBLE) AS confidence", "CAST(ball_segment AS BIGINT) AS ball_segment", "x_center", "y_center"]
BOXED = ["x_center - w / 2 AS x1", "y_center - h / 2 AS y1", "x_center + w / 2 AS x2", "y_center + h / 2 AS y2"]
KINDS = ((BALL, "true"), (HOOP, "event_id % 3 < 2"), (PLAYER, "event_id % 5 < 2"))


def _duck(exprs: list[str]) -> str:
    return ", ".join(exprs).replace(" DIV ", " // ")


_EACH = " UNION ALL ".join(f"SELECT {_duck(k)} FROM pl WHERE {c}" for k, c in KINDS)
ROWS_SQL = f"""pl AS (SELECT {_duck(PLACED)} FROM (SELECT {_duck(NUMBERED)} FROM events)),
r AS MATERIALIZED (SELECT {', '.join(TYPED)}, {', '.join(e.replace('w / 2', 'w / 2.0').replace('h / 2', 'h / 2.0') for e in BOXED)} FROM ({_EACH})),
b AS MATERIALIZED (SELECT * FROM r WHERE class = 'ball'), ho AS MATERIALIZED (SELECT * FROM r WHERE class = 'hoop')"""


def rows(spark, sf_dir) -> DataFrame:
    placed = load(spark, sf_dir, "events").selectExpr(*NUMBERED).selectExpr(*PLACED)
    parts = [placed.where(c).selectExpr(*k).selectExpr(*TYPED, "CAST(w AS DOUBLE) AS w", "CAST(h AS DOUBLE) AS h").selectExpr("*", *BOXED).drop("w", "h") for k, c in KINDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _dist(a: str, b: str) -> str:
    return f"sqrt(pow({a}x_center - {b}x_center, 2) + pow({a}y_center - {b}y_center, 2))"


def _nearest_sql(name: str, reach: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT video, row_id, arg_min(hoop, (cost, hf, hi)) AS c FROM (SELECT b.video, b.row_id, ho.frame AS hf, ho.row_id AS hi, {_dist('b.', 'ho.')} + abs(ho.frame - b.frame) * 18.0 AS cost,
{{'x1': ho.x1, 'y1': ho.y1, 'x2': ho.x2, 'y2': ho.y2, 'x_center': ho.x_center, 'y_center': ho.y_center}} AS hoop FROM b JOIN ho ON b.video = ho.video AND ho.frame BETWEEN b.frame - {reach} AND b.frame + {reach}) GROUP BY video, row_id)"""


_SHARE = "(greatest(least(b.x2, c.x2) - greatest(b.x1, c.x1), 0) * greatest(least(b.y2, c.y2) - greatest(b.y1, c.y1), 0)) / ((b.x2 - b.x1) * (b.y2 - b.y1))"
_SIZE = "greatest(c.x2 - c.x1, c.y2 - c.y1, 1)"
_IN = "(b.x_center BETWEEN c.x1 - 5 AND c.x2 + 5 AND b.y_center BETWEEN c.y1 - 5 AND c.y2 + 5)"
_MID = f"{_dist('b.', 'c.')} <= greatest(22, {_SIZE} * 0.34)"
_LOW = f"(b.y_center >= c.y_center - greatest(8, (c.y2 - c.y1) * 0.2) AND greatest(b.x2 - b.x1, b.y2 - b.y1) <= greatest(52, {_SIZE} * 0.62))"
MARKS_SQL = f"""{ROWS_SQL}, {_nearest_sql('n3', 3)}, m AS MATERIALIZED (SELECT b.*, {_dist('b.', 'c.')} AS rim_distance, {_LOW} AND ({_IN} OR {_MID}) AND {_SHARE} >= 0.25 AS near_rim,
{_LOW} AND b.confidence < 0.16 AND (({_IN} AND {_SHARE} >= 0.65) OR ({_MID} AND {_SHARE} >= 0.5)) AS remove_now FROM b JOIN n3 USING (video, row_id))"""
CLUSTERS_SQL = f"""{MARKS_SQL}, k AS MATERIALIZED (SELECT *, sum(turn) OVER (PARTITION BY video ORDER BY frame, row_id) AS cluster FROM (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY video ORDER BY frame, row_id) > 14, true)::INT AS turn FROM m WHERE near_rim)),
kc AS MATERIALIZED (SELECT *, n >= 3 AND ((last - start + 1 >= 5 AND spread <= 20) OR (last - start + 1 >= 13 AND spread <= 38)) AS static FROM (SELECT video, cluster, count(*) AS n, min(frame) AS start, max(frame) AS last, avg(x_center) AS x, avg(y_center) AS y, min(rim_distance) AS least, sqrt(pow(max(x_center) - min(x_center), 2) + pow(max(y_center) - min(y_center), 2)) AS spread, arg_min(x_center, (frame, row_id)) AS fx, arg_min(y_center, (frame, row_id)) AS fy FROM k GROUP BY ALL))"""


@query(f"WITH {MARKS_SQL} SELECT row_id, round(rim_distance, 4) AS rim_distance, near_rim, remove_now FROM m")
def rim_marks(spark, sf_dir):
    r = rows(spark, sf_dir)
    return rims.rim_marks(r.where("class = 'ball'"), r, PICTURE).select("row_id", F.round("rim_distance", 4).alias("rim_distance"), "near_rim", "remove_now")


@query(f"WITH {CLUSTERS_SQL} SELECT video, cluster::BIGINT AS cluster, n, start, last, round(x, 4) AS x, round(spread, 4) AS spread, static FROM kc")
def rim_clusters(spark, sf_dir):
    r = rows(spark, sf_dir)
    found = rims.rim_clusters(rims.rim_marks(r.where("class = 'ball'"), r, PICTURE), PICTURE, FPS)
    return found.select("video", "cluster", "n", "start", F.col("end").alias("last"), F.round("x", 4).alias("x"), F.round("spread", 4).alias("spread"), "static")


_TOP = "(len({w}) >= 3 AND start - t{n}.frame <= 48 AND y - t{n}.y >= 30 AND (sqrt(pow(x - t{n}.x, 2) + pow(y - t{n}.y, 2)) >= 45 OR (y - t{n}.y) / greatest(start - t{n}.frame, 1) >= 0.55))"
JUDGED_SQL = f"""{CLUSTERS_SQL}, {_nearest_sql('n5', 5)}, wy AS MATERIALIZED (SELECT b.video, b.row_id, b.frame, b.x_center AS x, b.y_center AS y, CASE WHEN c IS NOT NULL THEN {_dist('b.', 'c.')} END AS away FROM b LEFT JOIN n5 USING (video, row_id)),
pw AS (SELECT kc.video, kc.cluster, list({{'frame': wy.frame, 'row_id': wy.row_id, 'x': wy.x, 'y': wy.y, 'away': wy.away}} ORDER BY wy.frame, wy.row_id) AS way FROM kc JOIN wy ON wy.video = kc.video AND wy.frame < kc.start AND wy.frame >= kc.start - 66 GROUP BY ALL),
j0 AS (SELECT kc.*, coalesce(way, []) AS way, list_filter(coalesce(way, []), lambda w: w.away IS NOT NULL) AS hw, list_filter(coalesce(way, []), lambda w: w.frame >= start - 26) AS rw FROM kc LEFT JOIN pw USING (video, cluster)),
j1 AS (SELECT *, list_filter(rw, lambda w: w.away IS NOT NULL) AS sw, list_filter(hw, lambda w: w.away >= least + 55)[1] AS f1, hw[-1] AS hl, rw[-1] AS rl FROM j0),
j2 AS (SELECT *, sw[-1] AS sl, list_filter(hw, lambda w: w.y = list_min(list_transform(hw, lambda v: v.y)))[1] AS t1, list_filter(sw, lambda w: w.y = list_min(list_transform(sw, lambda v: v.y)))[1] AS t2 FROM j1),
j3 AS (SELECT *, (f1.away - least) / greatest(start - f1.frame, 1) AS speed, coalesce({_TOP.format(w='hw', n=1)}, false) AS arc, coalesce({_TOP.format(w='sw', n=2)}, false) AS arc2 FROM j2),
jd AS MATERIALIZED (SELECT *, coalesce(len(way) >= 3 AND len(hw) >= 3 AND (arc OR (f1.away - least >= 65 AND hl.away - least >= 24 AND (speed >= 1.35 OR sqrt(pow(fx - f1.x, 2) + pow(fy - f1.y, 2)) >= 85) AND (last - start + 1 <= 42 OR speed >= 2))), false) AS shot_like,
coalesce(len(rw) > 0 AND NOT arc2 AND greatest(start - rl.frame, 1) <= 8 AND sqrt(pow(x - rl.x, 2) + pow(y - rl.y, 2)) >= greatest(95, 34 * greatest(start - rl.frame, 1)) AND y - rl.y < 25 AND (len(sw) = 0 OR sl.away > least + 55), false) AS sudden FROM j3)"""


@query(f"WITH {JUDGED_SQL} SELECT video, cluster::BIGINT AS cluster, static, shot_like, sudden FROM jd")
def judged_clusters(spark, sf_dir):
    r = rows(spark, sf_dir)
    balls = r.where("class = 'ball'")
    return rims.judged_clusters(rims.rim_marks(balls, r, PICTURE), balls, r, PICTURE, FPS).select("video", "cluster", "static", "shot_like", "sudden")


def _runs_sql(name: str, source: str, gap: int) -> str:
    return f"{name} AS MATERIALIZED (SELECT *, sum(turn) OVER (PARTITION BY video ORDER BY frame, row_id) AS run FROM (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY video ORDER BY frame, row_id) > {gap}, true)::INT AS turn FROM {source}))"


EDGE_SQL = f"""eb AS (SELECT * FROM b WHERE x_center <= 36 OR x_center >= 1244 OR y_center <= 36 OR y_center >= 684), {_runs_sql('er', 'eb', 6)},
ep AS (SELECT video, run, count(*) AS n, avg(confidence) AS mean, list_sort(list(confidence))[count(*) // 2 + 1] AS mid, max(x_center) - min(x_center) AS wide, max(y_center) - min(y_center) AS high FROM er GROUP BY ALL),
es AS MATERIALIZED (SELECT video, row_id FROM er JOIN ep USING (video, run) WHERE n >= 4 AND ((sqrt(wide * wide + high * high) <= 18 AND (mean <= 0.24 OR mid <= 0.08)) OR (n >= 6 AND wide <= 18 AND (mean <= 0.2 OR mid <= 0.06)) OR (n >= 5 AND high <= 29.7 AND mid <= 0.1)))"""


@query(f"WITH {ROWS_SQL}, {EDGE_SQL} SELECT video, row_id FROM es")
def static_edge_balls(spark, sf_dir):
    return rims.static_edge_rows(rows(spark, sf_dir).where("class = 'ball'"), PICTURE, FPS)


ALONE_SQL = f"""{_runs_sql('ar', 'b', 6)}, an AS (SELECT DISTINCT b.video, b.row_id FROM b JOIN r p ON p.class = 'player' AND p.video = b.video AND p.frame BETWEEN b.frame - 2 AND b.frame + 2 AND b.x_center BETWEEN p.x1 - 95 AND p.x2 + 95 AND b.y_center BETWEEN p.y1 - 95 AND p.y2 + 95),
ap AS (SELECT video, run FROM ar LEFT JOIN (SELECT *, 1 AS near FROM an) USING (video, row_id) GROUP BY video, run HAVING count(*) >= 8 AND sqrt(pow(max(x_center) - min(x_center), 2) + pow(max(y_center) - min(y_center), 2)) <= 24 AND count(near) / count(*) < 0.3),
al AS MATERIALIZED (SELECT video, row_id, ball_segment FROM ar JOIN ap USING (video, run))"""


@query(f"""WITH {JUDGED_SQL}, {EDGE_SQL}, {ALONE_SQL}, bad AS (SELECT k.video, k.row_id, k.ball_segment, jd.static FROM k JOIN jd USING (video, cluster) WHERE NOT shot_like AND (static OR sudden)),
wh AS (SELECT video, ball_segment FROM bad WHERE static UNION SELECT video, ball_segment FROM al),
out AS (SELECT video, row_id FROM m WHERE remove_now UNION SELECT video, row_id FROM bad UNION SELECT video, row_id FROM es UNION SELECT video, row_id FROM al UNION SELECT video, row_id FROM b JOIN wh USING (video, ball_segment))
SELECT row_id, class FROM r ANTI JOIN out USING (video, row_id)""")
def without_false_balls(spark, sf_dir):
    return rims.without_false_balls(rows(spark, sf_dir), PICTURE, FPS).select("row_id", "class")


@query(f"""WITH {ROWS_SQL}, p AS (SELECT b.video, b.row_id, pl.track_id, pl.row_id AS i, sqrt(pow(greatest(pl.x1 - b.x_center, 0, b.x_center - pl.x2), 2) + pow(greatest(pl.y1 - b.y_center, 0, b.y_center - pl.y2), 2)) AS away FROM b JOIN r pl ON pl.class = 'player' AND pl.video = b.video AND pl.frame = b.frame),
o AS (SELECT video, row_id, arg_min(track_id, (away, i)) AS t, min(away) AS away FROM p WHERE away <= 35 GROUP BY ALL) SELECT b.row_id, t AS occluded_by_track_id, round(away, 2) AS occlusion_distance, t IS NOT NULL AS occluded FROM b LEFT JOIN o USING (video, row_id)""")
def occlusions(spark, sf_dir):
    r = rows(spark, sf_dir)
    return rims.occlusion(r.where("class = 'ball'"), r.where("class = 'player'")).select("row_id", "occluded_by_track_id", "occlusion_distance", "occluded")


@query(f"""WITH {ROWS_SQL}, q AS (SELECT *, lead(frame) OVER w AS nf, lead(x_center) OVER w AS nx, lead(confidence) OVER w AS nc, lead(y_center) OVER w AS ny FROM ho WINDOW w AS (PARTITION BY video ORDER BY frame)),
g AS (SELECT *, unnest(range(0, CASE WHEN nf - frame <= 18 AND sqrt(pow(nx - x_center, 2) + pow(ny - y_center, 2)) <= greatest(130, 9 * (nf - frame)) THEN nf - frame ELSE 1 END)) AS k FROM q)
SELECT video, frame + k AS frame, CASE WHEN k > 0 THEN floor((x_center + (nx - x_center) * k / (nf - frame)) * 100 + 0.5 + 1e-7) / 100 ELSE x_center END AS x_center, CASE WHEN k > 0 THEN 'Interpolated' ELSE 'Detected' END AS hoop_status FROM g""")
def stable_hoops(spark, sf_dir):
    found = rims.stable_hoops(rows(spark, sf_dir), lambda r: cand.hoop_candidates(r, PICTURE), PICTURE, FPS)
    return found.select("video", "frame", "x_center", "hoop_status")


def _candidates(spark, sf_dir) -> DataFrame:
    return rows(spark, sf_dir).drop("ball_segment").withColumns({"agreement": F.lit(1), "bonus": F.lit(0.0), "sources": F.array(F.lit("a"))})


@query()
def tracking_pipeline(spark, sf_dir):
    """Detections through all cleaning steps."""
    found = pipeline.run(_candidates(spark, sf_dir), PICTURE.width, PICTURE.height, FPS)
    return found.select("video", "frame", "class", "track_id", "x_center", "y_center", "ball_status", "is_reliable", "team_name")


@query()
def tracked_ball(spark, sf_dir):
    return pipeline.tracked_ball(_candidates(spark, sf_dir))


@query()
def parabolic_path(spark, sf_dir):
    b = rows(spark, sf_dir).where("class = 'ball' AND row_id % 7 <> 0")
    return ball_path.parabolic(b)
