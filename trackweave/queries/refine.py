"""Refinement of the ball's track, over frames made of events: a user is a video, an event a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import refiner
from ..sources.tables import load
from .registry import query

LIMITS = refiner.Limits()
#: The same expressions make the sightings in both engines: a slow walk with far jumps, weak and repeated stretches.
NUMBERED = ["user_id AS video", "event_id AS row_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n"]
SEEN = [
    "video", "row_id", "n + 2 * (n // 5) + 4 * (n // 11) AS frame", "CAST(row_id * 7 % 100 AS DOUBLE) / 100 AS confidence",
    "CAST(400 + n * 23 % 1100 + row_id % 3 * 60 + CASE WHEN row_id % 9 = 0 THEN 700 ELSE 0 END AS DOUBLE) AS x_center", "CAST(15 + n * 17 % 900 + row_id % 4 * 20 AS DOUBLE) AS y_center",
]
SEEN_SQL = f"s AS MATERIALIZED (SELECT {', '.join(SEEN)} FROM (SELECT {', '.join(NUMBERED)} FROM events))"


def seen(spark, sf_dir) -> DataFrame:
    made = load(spark, sf_dir, "events").selectExpr(*NUMBERED)
    return made.selectExpr(*(e.replace("//", "DIV") for e in SEEN))


#: Players and hoops round the sightings of a video.
AROUND = [
    "video", "frame", "row_id * 10 + k AS row_id", "CASE k WHEN 2 THEN 'hoop' ELSE 'player' END AS class", "k + row_id % 5 AS track_id", "0.9 AS confidence",
    "x_center + k * 30 - 20 - 25 + row_id % 40 AS x1", "y_center - 40 - k * 20 + row_id % 30 AS y1", "x_center + k * 30 - 20 + 25 + row_id % 40 AS x2", "y_center + 60 - k * 20 + row_id % 30 AS y2",
]
AROUND_SQL = f"a AS MATERIALIZED (SELECT *, (x1 + x2) / 2 AS x_center, (y1 + y2) / 2 AS y_center FROM (SELECT {', '.join(AROUND)} FROM s, (SELECT unnest([0, 1, 2]) AS k) WHERE row_id % 4 < 3))"


def around(spark, sf_dir) -> DataFrame:
    s = seen(spark, sf_dir).where("row_id % 4 < 3").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return s.selectExpr(*AROUND).withColumns({"x_center": (F.col("x1") + F.col("x2")) / 2, "y_center": (F.col("y1") + F.col("y2")) / 2})


CONTEXT_SQL = "SELECT s.video, s.row_id, min(sqrt(pow(s.x_center - a.x_center, 2) + pow(s.y_center - a.y_center, 2))) AS context_distance FROM s JOIN a ON a.video = s.video AND a.frame BETWEEN s.frame - 1 AND s.frame + 1 GROUP BY ALL"


@query(f"WITH {SEEN_SQL}, {AROUND_SQL}, c AS ({CONTEXT_SQL}) SELECT s.row_id, round(context_distance, 4) AS context_distance FROM s LEFT JOIN c USING (video, row_id)")
def context_distances(spark, sf_dir):
    return refiner.with_context(seen(spark, sf_dir), around(spark, sf_dir)).select("row_id", F.round("context_distance", 4).alias("context_distance"))


BODY_SQL = """SELECT video, row_id, arg_min(b, (away, i)) AS body FROM (SELECT s.video, s.row_id, a.row_id AS i, sqrt(pow(s.x_center - a.x_center, 2) + pow(s.y_center - a.y_center, 2)) AS away,
{'track_id': a.track_id, 'rx': (s.x_center - a.x1) / greatest(a.x2 - a.x1, 1), 'ry': (s.y_center - a.y1) / greatest(a.y2 - a.y1, 1)} AS b
FROM s JOIN a ON a.video = s.video AND a.frame = s.frame AND a.class = 'player' AND s.x_center BETWEEN a.x1 AND a.x2 AND s.y_center BETWEEN a.y1 AND a.y2) GROUP BY ALL"""
IN_CORE, IN_TORSO = "(body.rx BETWEEN 0.12 AND 0.88 AND body.ry BETWEEN 0.12 AND 0.68)", "(body.ry BETWEEN 0.08 AND 0.72)"


@query(f"WITH {SEEN_SQL}, {AROUND_SQL}, b AS ({BODY_SQL}) SELECT s.row_id, body.track_id AS body_track_id, round(body.rx, 3) AS body_rel_x, CASE WHEN {IN_CORE} THEN 'core' WHEN body.ry > 0.68 THEN 'lower' WHEN body IS NOT NULL THEN 'edge' END AS body_region, coalesce({IN_TORSO}, false) AS body_torso FROM s LEFT JOIN b USING (video, row_id)")
def body_overlaps(spark, sf_dir):
    return refiner.with_body(seen(spark, sf_dir), around(spark, sf_dir)).select("row_id", "body_track_id", "body_rel_x", "body_region", "body_torso")


def weighed(spark, sf_dir) -> DataFrame:
    """Sightings with flags by arithmetic instead of joins, so that all branches of the gate are taken."""
    return seen(spark, sf_dir).withColumns({
        "context_distance": F.when(F.col("row_id") % 6 < 5, (F.col("row_id") * 37 % 700).cast("double")), "body_core": F.col("row_id") % 13 == 0, "body_torso": (F.col("row_id") % 13).isin(0, 5, 6), "bbox_size": (F.col("row_id") % 30 + 8).cast("double"),
        "x1": F.col("x_center"), "x2": F.col("x_center"), "y1": F.col("y_center"), "y2": F.col("y_center"),
    })


WEIGHED_SQL = """f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame, row_id) AS k, x_center <= 24 OR y_center <= 24 OR x_center >= 1896 OR y_center >= 1056 AS edge, row_id % 13 = 0 AS core, row_id % 13 IN (0, 5, 6) AS torso,
CASE WHEN row_id % 6 < 5 THEN (row_id * 37 % 700)::DOUBLE END AS context_distance FROM s),
w AS MATERIALIZED (SELECT *, coalesce(context_distance > 420, false) AS far, (core AND confidence < 0.56) OR (NOT core AND torso AND confidence < 0.2) AS weak FROM f)"""
GATE_SQL = f"""{SEEN_SQL}, {WEIGHED_SQL},
t AS (SELECT video, 0 AS k, 0::BIGINT AS row_id, NULL::BIGINT AS lf, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly, 0 AS seg, '' AS note FROM w GROUP BY video
UNION ALL SELECT video, k, row_id, CASE WHEN note LIKE 'accepted%' THEN frame ELSE lf END, CASE WHEN note LIKE 'accepted%' THEN x ELSE lx END, CASE WHEN note LIKE 'accepted%' THEN y ELSE ly END, seg + (note = 'accepted_new_segment')::INT, note FROM (
SELECT w.video, w.k, w.row_id, w.frame, w.x_center AS x, w.y_center AS y, t.lf, t.lx, t.ly, t.seg, CASE
WHEN t.lf IS NULL AND edge AND confidence < 0.55 THEN 'removed_edge_low_confidence' WHEN far AND confidence < 0.18 THEN 'removed_far_from_context' WHEN weak THEN 'removed_player_body_false_positive' WHEN t.lf IS NULL THEN 'accepted'
WHEN w.frame <= t.lf THEN 'removed_same_frame' WHEN sqrt(pow(w.x_center - t.lx, 2) + pow(w.y_center - t.ly, 2)) <= 160 * least(w.frame - t.lf, 3) THEN 'accepted' WHEN w.frame - t.lf = 1 THEN 'removed_impossible_speed' WHEN w.frame - t.lf <= 6 THEN 'removed_short_gap_jump'
WHEN confidence < 0.25 THEN 'removed_far_low_confidence' WHEN edge THEN 'removed_edge_restart' WHEN far AND confidence < 0.65 THEN 'removed_far_restart_without_context' WHEN confidence < 0.65 THEN 'removed_weak_new_segment' ELSE 'accepted_new_segment' END AS note
FROM t JOIN w ON w.video = t.video AND w.k = t.k + 1)),
g AS MATERIALIZED (SELECT w.*, note, CASE WHEN note LIKE 'accepted%' THEN seg END AS seg FROM t JOIN w USING (video, k) WHERE t.k > 0)"""


@query(f"WITH RECURSIVE {GATE_SQL} SELECT row_id, note AS cleaning_note, seg AS ball_segment FROM g")
def motion_gate(spark, sf_dir):
    return refiner.gated(weighed(spark, sf_dir), LIMITS).select("row_id", "cleaning_note", "ball_segment")


POINTS_SQL = f"""{GATE_SQL}, l0 AS (SELECT *, coalesce(torso AND lag(torso) OVER o AND seg = lag(seg) OVER o AND frame - lag(frame) OVER o BETWEEN 1 AND 6, false) AS goes_on FROM g WHERE seg IS NOT NULL WINDOW o AS (PARTITION BY video ORDER BY frame)),
l1 AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY video ORDER BY frame) AS run FROM l0),
l2 AS (SELECT *, count(*) OVER r AS n, median(confidence) OVER r AS med, max(confidence) OVER r AS most FROM l1 WINDOW r AS (PARTITION BY video, run, torso)),
l3 AS MATERIALIZED (SELECT * FROM l2 WHERE NOT torso OR (NOT (n >= 6 AND (med < 0.56 OR most < 0.82)) AND NOT weak))"""


@query(f"WITH RECURSIVE {POINTS_SQL} SELECT row_id, frame FROM l3")
def locked_runs(spark, sf_dir):
    points = refiner.gated(weighed(spark, sf_dir), LIMITS).where("ball_segment IS NOT NULL")
    return refiner.without_locked_runs(points, LIMITS).select("row_id", "frame")


STRONG_SQL = f"{POINTS_SQL}, p AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER v AS rows_, max(confidence) OVER v AS best, min(context_distance) OVER v AS near FROM l3 WINDOW v AS (PARTITION BY video, seg)) WHERE rows_ >= 3 OR best >= 0.65 OR near <= 420)"
LINE_SQL = f"""{STRONG_SQL}, q AS (SELECT video, row_id, frame, seg, confidence AS c, x_center AS x, y_center AS y, (x_center - lag(x_center) OVER v) / (frame - lag(frame) OVER v) AS vx, (y_center - lag(y_center) OVER v) / (frame - lag(frame) OVER v) AS vy,
lead(frame) OVER o AS nf, lead(x_center) OVER o AS nx, lead(y_center) OVER o AS ny, lead(confidence) OVER o AS nc, lead(seg) OVER o AS ns FROM p WINDOW v AS (PARTITION BY video, seg ORDER BY frame), o AS (PARTITION BY video ORDER BY frame)),
u AS MATERIALIZED (SELECT video, row_id, frame, seg, x, y, c, 'Detected' AS status FROM q
UNION ALL SELECT video, row_id, frame + i, seg, x + (nx - x) * i / (nf - frame), y + (ny - y) * i / (nf - frame), greatest(0.05, least(c, nc) * 0.8), 'Interpolated' FROM (SELECT *, unnest(range(1, nf - frame)) AS i FROM q WHERE ns = seg AND nf - frame BETWEEN 2 AND 6)
UNION ALL SELECT video, row_id, frame + i, seg, x + vx * i, y + vy * i, greatest(0.01, c * pow(0.75, i)), 'Predicted' FROM (SELECT *, unnest(range(1, 4)) AS i FROM q WHERE ns = seg AND nf - frame > 6 AND vx IS NOT NULL))"""


@query(f"WITH RECURSIVE {LINE_SQL} SELECT video, frame, status AS ball_status, round(x, 1) AS x_center, round(y, 1) AS y_center, c < 0.1 AS weak FROM u")
def ball_timeline(spark, sf_dir):
    points = refiner.gated(weighed(spark, sf_dir), LIMITS).where("ball_segment IS NOT NULL")
    line = refiner.timeline(refiner.without_weak_segments(refiner.without_locked_runs(points, LIMITS), LIMITS), LIMITS)
    return line.select("video", "frame", "ball_status", F.round("x_center", 1).alias("x_center"), F.round("y_center", 1).alias("y_center"), (F.col("confidence") < 0.1).alias("weak"))


JUMP_SQL = f"""{SEEN_SQL}, k AS MATERIALIZED (SELECT video, frame, x_center AS x, y_center AS y, row_number() OVER (PARTITION BY video ORDER BY frame) AS k FROM s),
t AS (SELECT video, frame, k, frame AS lf, x AS lx, y AS ly, true AS keep FROM k WHERE k = 1
UNION ALL SELECT video, frame, k, CASE WHEN keep THEN frame ELSE lf END, CASE WHEN keep THEN x ELSE lx END, CASE WHEN keep THEN y ELSE ly END, keep FROM (SELECT k.video, k.frame, k.k, x, y, lf, lx, ly, k.frame - lf > 6 OR (k.frame > lf AND sqrt(pow(x - lx, 2) + pow(y - ly, 2)) <= 135 * least(k.frame - lf, 2)) AS keep FROM t JOIN k ON k.video = t.video AND k.k = t.k + 1))"""


@query(f"WITH RECURSIVE {JUMP_SQL} SELECT video, frame FROM t WHERE keep")
def final_jump_gate(spark, sf_dir):
    return refiner.without_jumps(seen(spark, sf_dir), LIMITS).select("video", "frame")


@query(f"""WITH {SEEN_SQL}, m AS (SELECT video, frame, avg(x_center) OVER w AS x, avg(y_center) OVER w AS y, row_id % 30 + 8 AS size FROM s WINDOW w AS (PARTITION BY video ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT video, frame, floor(x * 100 + 0.5) / 100 AS x_center, floor((x - size / 2) * 100 + 0.5) / 100 AS x1, floor((y + size / 2) * 100 + 0.5) / 100 AS y2 FROM m""")
def smoothed_boxes(spark, sf_dir):
    rows = weighed(spark, sf_dir).withColumn("ball_segment", F.lit(0))
    return refiner.smoothed(rows, LIMITS).select("video", "frame", "x_center", "x1", "y2")


@query(f"""WITH {SEEN_SQL}, j AS (SELECT *, CASE WHEN frame - lag(frame) OVER o BETWEEN 1 AND 6 THEN sqrt(pow(x_center - lag(x_center) OVER o, 2) + pow(y_center - lag(y_center) OVER o, 2)) END AS jump, 135 * least(frame - lag(frame) OVER o, 2) AS step FROM s WINDOW o AS (PARTITION BY video ORDER BY frame))
SELECT video, frame, round(jump, 3) AS jump_distance, NOT (confidence < 0.01 OR coalesce(jump > step, false)) AS is_reliable, CASE WHEN confidence < 0.01 THEN 'warning_very_low_confidence_detection' WHEN jump > step THEN 'warning_large_clean_jump' ELSE 'accepted' END AS reliability_reason FROM j""")
def reliability_reasons(spark, sf_dir):
    rows = seen(spark, sf_dir).withColumns({"ball_segment": F.lit(0), "ball_status": F.lit("Detected"), "cleaning_note": F.lit("accepted")})
    return refiner.reliability(rows, LIMITS).select("video", "frame", "jump_distance", "is_reliable", "reliability_reason")


@query()
def cleaned_tracking(spark, sf_dir):
    """The whole refinement: players and hoops as they are, the ball's rows cleaned."""
    balls = weighed(spark, sf_dir).select("video", "frame", "row_id", F.lit("ball").alias("class"), F.lit(-1).cast("long").alias("track_id"), "confidence", "x_center", "y_center", *((F.col(c[0] + "_center") + d).alias(c) for c, d in (("x1", -9), ("y1", -9), ("x2", 9), ("y2", 9))))
    other = around(spark, sf_dir).withColumns({"track_id": F.col("track_id").cast("long"), "confidence": F.col("confidence").cast("double")})
    return refiner.cleaned_tracking(balls.unionByName(other.select(*balls.columns)), LIMITS)
