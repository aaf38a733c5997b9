"""Events and tracking clean-up over detections made of the events table: a user is a video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import events as ev
from ..plans import association, scoreboard, tracking
from ..sources.tables import load
from .registry import query


def detections(spark, sf_dir) -> DataFrame:
    """Frames of one ball, one hoop and four players of two teams, placed by arithmetic on ids."""
    e = load(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    f = e.select(F.col("user_id").alias("video"), (n * 5).cast("long").alias("frame"), "event_id", "event_type", "value")
    at = lambda k, m, c: (F.col("event_id") * k + c) % m
    near_hoop = F.col("event_type") == "click"
    bx, by = F.when(near_hoop, 620.0 + at(3, 40, 0)).otherwise(at(7, 1200, 30).cast("double")), F.when(near_hoop, 90.0 + at(5, 90, 0)).otherwise(at(11, 600, 40).cast("double"))
    f = f.withColumns({"bx": bx.cast("double"), "by": by.cast("double")})

    def row(kind, track, x, y, w, h, team):
        named = zip(("class", "track_id", "x", "y", "w", "h", "team_id"), (F.lit(kind), track.cast("long"), x.cast("double"), y.cast("double"), F.lit(w), F.lit(h), F.lit(team)), strict=True)
        return F.struct(*(c.alias(n) for n, c in named))

    rows = [row("ball", F.lit(0), F.col("bx"), F.col("by"), 9.0, 9.0, ""), row("hoop", F.lit(-1), F.lit(640.0), F.lit(120.0), 30.0, 20.0, "")]
    for k in range(4):
        # the player nearest to the ball changes with the event type
        x = F.col("bx") + F.when(at(1, 5, k) < 2, 20.0 + 15 * k).otherwise(300.0 + 40 * k)
        rows.append(row("player", F.pmod(F.hash("event_type"), F.lit(3)) + 4 * k + 1, x, F.col("by") + 30.0 + k, 25.0, 60.0, "1" if k % 2 else "2"))
    d = f.select("video", "frame", F.posexplode(F.array(*rows)).alias("i", "r"))
    return d.select(
        "video", "frame", (F.col("frame") * 10 + F.col("i")).alias("row_id"), "r.class", F.lit(0.9).alias("confidence"), "r.track_id", (F.col("r.x") - F.col("r.w")).alias("x1"), (F.col("r.y") - F.col("r.h")).alias("y1"),
        (F.col("r.x") + F.col("r.w")).alias("x2"), (F.col("r.y") + F.col("r.h")).alias("y2"), F.col("r.team_id").alias("team_id"), F.when(F.col("r.team_id") != "", F.concat(F.lit("team_"), "r.team_id")).otherwise("").alias("team_name"),
    )


PROFILE = ev.Profile(30.0, 1280, 720)


@query()
def game_events(spark, sf_dir):
    return ev.measure(detections(spark, sf_dir), PROFILE)["events"]


@query()
def game_summary(spark, sf_dir):
    found = ev.measure(detections(spark, sf_dir), PROFILE)
    return ev.summary(found["rows"], found)


@query()
def game_cumulative(spark, sf_dir):
    found = ev.measure(detections(spark, sf_dir), PROFILE)
    return ev.cumulative(found["rows"], found, PROFILE)


@query()
def possession_segments(spark, sf_dir):
    return ev.measure(detections(spark, sf_dir), PROFILE)["segments"]


def ball_path(spark, sf_dir) -> DataFrame:
    """Ball rows of every fifth frame, with places and a segment number."""
    d = detections(spark, sf_dir).where("class = 'ball'")
    d = d.withColumns({"x_center": (F.col("x1") + F.col("x2")) / 2, "y_center": (F.col("y1") + F.col("y2")) / 2, "confidence": (F.col("frame") % 97) / 100})
    return tracking.segment_ids(d, 20, 700.0)


PATH_SQL = """p AS MATERIALIZED (SELECT user_id AS video, 5 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, CASE WHEN event_type = 'click' THEN 620.0 + event_id * 3 % 40 ELSE event_id * 7 + 30 - (event_id * 7 + 30) // 1200 * 1200 END::DOUBLE AS x,
CASE WHEN event_type = 'click' THEN 90.0 + event_id * 5 % 90 ELSE event_id * 11 + 40 - (event_id * 11 + 40) // 600 * 600 END::DOUBLE AS y FROM events),
q AS MATERIALIZED (SELECT *, (frame % 97) / 100 AS confidence, frame - lag(frame) OVER w > 20 OR sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) > 700 AS turn FROM p WINDOW w AS (PARTITION BY video ORDER BY frame)),
s AS MATERIALIZED (SELECT *, CAST(sum(CASE WHEN coalesce(turn, true) THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM q)"""


@query(f"WITH {PATH_SQL} SELECT video, frame, seg AS ball_segment FROM s")
def ball_segments(spark, sf_dir):
    return ball_path(spark, sf_dir).select("video", "frame", "ball_segment")


@query(f"WITH {PATH_SQL} SELECT video, frame, round(x - lag(x) OVER w, 2) AS dx, round((y - lag(y) OVER w) / (frame - lag(frame) OVER w), 6) AS velocity_y FROM s WINDOW w AS (PARTITION BY video, seg ORDER BY frame)")
def ball_velocities(spark, sf_dir):
    return tracking.velocities(ball_path(spark, sf_dir)).select("video", "frame", "dx", F.round("velocity_y", 6).alias("velocity_y"))


@query(f"WITH {PATH_SQL}, g AS (SELECT *, count(*) OVER (PARTITION BY video, seg) AS n, max(confidence) OVER (PARTITION BY video, seg) AS c FROM s) SELECT video, frame FROM g WHERE n >= 3 OR c >= 0.62")
def pruned_segments(spark, sf_dir):
    return tracking.prune_segments(ball_path(spark, sf_dir)).select("video", "frame")


@query(f"WITH {PATH_SQL}, n AS (SELECT *, lead(frame) OVER w AS nf, lead(x) OVER w AS nx FROM s WINDOW w AS (PARTITION BY video, seg ORDER BY frame)) SELECT video, frame, round(x, 6) AS x_center, 'Detected' AS ball_status FROM s UNION ALL SELECT video, frame + i, round(x + (nx - x) * i / (nf - frame), 6), 'Interpolated' FROM (SELECT *, unnest(range(1, nf - frame)) AS i FROM n WHERE nf - frame BETWEEN 2 AND 6)")
def filled_path(spark, sf_dir):
    return tracking.fill_path(ball_path(spark, sf_dir)).select("video", "frame", F.round("x_center", 6).alias("x_center"), "ball_status")


@query()
def ball_filter(spark, sf_dir):
    """The Kalman filter over every frame of each video, empty frames predicted."""
    p = ball_path(spark, sf_dir).select("video", "frame", "x_center", "y_center", "confidence")
    spine = p.groupBy("video").agg(F.max("frame").alias("n")).select("video", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("frame"))
    return tracking.kalman(spine.join(p, ["video", "frame"], "left"), gravity=0.8)


@query()
def ball_association(spark, sf_dir):
    d = detections(spark, sf_dir).where("class IN ('ball', 'hoop')")
    d = d.withColumns({"x_center": (F.col("x1") + F.col("x2")) / 2, "y_center": (F.col("y1") + F.col("y2")) / 2, "confidence": (F.col("row_id") % 89) / 100})
    return association.associate(d).select("video", "frame", "row_id", "ball_segment")


@query("SELECT s_suppkey % 7 AS video, s_suppkey AS track_id, CASE WHEN row_number() OVER (PARTITION BY s_suppkey % 7 ORDER BY s_acctbal, s_suppkey) <= greatest(1, count(*) OVER (PARTITION BY s_suppkey % 7) // 2) THEN '1' ELSE '2' END AS team_id FROM supplier")
def teams_by_place(spark, sf_dir):
    rows = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("video"), F.col("s_suppkey").alias("track_id"), F.lit("player").alias("class"), F.col("s_acctbal").alias("x_center"))
    return tracking.teams_by_place(rows)


@query()
def teams_by_colour(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return tracking.two_teams(e.select((F.col("vec_id") % 9).alias("video"), F.col("vec_id").alias("track_id"), *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("lab"))))


def score_reads(spark, sf_dir) -> DataFrame:
    """Two sides read once a second; scores rise with time and some readings are wrong or missing."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(w)
    side = F.explode(F.array(F.lit(1), F.lit(2))).alias("side")
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("video"), n.cast("long").alias("frame"), "event_id", side)
    value = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 7 == 0, 99).otherwise(F.floor(F.col("frame") / (2 + F.col("side"))))
    return e.select("video", "side", "frame", value.cast("int").alias("observed"))


@query()
def confirmed_scores(spark, sf_dir):
    return scoreboard.confirmed_scores(score_reads(spark, sf_dir))


@query()
def score_timeline(spark, sf_dir):
    return scoreboard.timeline(score_reads(spark, sf_dir))


@query("SELECT event_id, (d1 = 0 AND d2 = 0) OR (d1 = 0 AND d2 BETWEEN 1 AND 3) OR (d2 = 0 AND d1 BETWEEN 1 AND 3) AS valid, d1 BETWEEN 0 AND 12 AND d2 BETWEEN 0 AND 12 AND (d1 > 0 OR d2 > 0) AS resync FROM (SELECT event_id, event_id % 5 - 1 AS d1, event_id % 17 - 2 AS d2 FROM events)")
def score_transitions(spark, sf_dir):
    e = load(spark, sf_dir, "events").selectExpr("event_id", "50 + event_id % 5 - 1 AS a", "50 + event_id % 17 - 2 AS b")
    old = F.lit(50)
    return e.select("event_id", scoreboard.valid_transition(F.col("a"), F.col("b"), old, old).alias("valid"), scoreboard.plausible_resync(F.col("a"), F.col("b"), old, old).alias("resync"))


@query()
def board_timeline(spark, sf_dir):
    """Confirmed scores, quarters and clocks from noisy readings of both sides."""
    from ..plans.board import board_timeline as follow_board

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("video"), (F.row_number().over(w) - 1).alias("k"), "event_id")
    gone, wrong = F.col("event_id") % 13 == 0, F.col("event_id") % 9 == 0
    a, b = 40 + F.floor(F.col("k") / 4) + F.when(wrong, 10).otherwise(0), 38 + F.floor((F.col("k") + 2) / 4)
    clock = F.format_string("%02d:%02d", F.floor((720 - F.col("k")) / 60).cast("int"), ((720 - F.col("k")) % 60).cast("int"))
    reads = e.select("video", F.col("k").cast("double").alias("time_sec"), F.when(~gone, a).cast("int").alias("team1_score"), F.when(~gone, b).cast("int").alias("team2_score"), F.lit("1ST").alias("quarter"), clock.alias("game_clock"))
    return follow_board(reads)


@query()
def fallback_tracks(spark, sf_dir):
    """Track numbers for players that the detector did not follow."""
    d = detections(spark, sf_dir).withColumns({"x_center": (F.col("x1") + F.col("x2")) / 2, "y_center": (F.col("y1") + F.col("y2")) / 2})
    return tracking.fallback_tracks(d.withColumn("track_id", F.lit(-1).cast("long")))
