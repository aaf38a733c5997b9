"""Possession from detections: the nearest player to the ball, owner changes and shares, and frame features.

`video` is the unit of work and of ordering; every join is an equi-join on (video, frame).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, scalars

COURT = (28.0, 15.0)  # metres
IMAGE = (1920.0, 1080.0)
#: Codes of events as labels; events that are not named leave a frame as it is.
LABELS = {"normal": 0, "pass": 1, "shot_made": 2, "shot_missed": 3, "rebound": 4, "steal_or_block": 5}


def owners(detections: DataFrame, ball: str = "ball", player: str = "player") -> DataFrame:
    """(video, frame, ball_x, ball_y, owner_track_id, distance): the first ball of a frame and the player nearest to
    it, the first one of equals; frames that lack either are left out."""
    d = detections.where(F.col("class").isin(ball, player))
    balls = d.where(F.col("class") == ball).groupBy("video", "frame").agg(F.min_by(F.struct("x_center", "y_center"), "row_id").alias("b"))
    near = d.where(F.col("class") == player).join(balls, ["video", "frame"])
    gap = geometry.distance(F.col("x_center"), F.col("y_center"), F.col("b.x_center"), F.col("b.y_center"))
    near = near.withColumn("gap", gap).groupBy("video", "frame").agg(F.first("b").alias("b"), F.min_by("track_id", F.struct("gap", "row_id")).alias("owner_track_id"), F.bround(F.min("gap"), 2).alias("distance"))
    return near.select("video", "frame", F.col("b.x_center").alias("ball_x"), F.col("b.y_center").alias("ball_y"), "owner_track_id", "distance")


def shares(owned: DataFrame) -> DataFrame:
    """Frames and percentage of each owner within a video."""
    per = owned.groupBy("video", "owner_track_id").agg(F.count("*").alias("frames"))
    return per.withColumn("possession_pct", 100.0 * F.col("frames") / F.sum("frames").over(Window.partitionBy("video")))


def owner_changes(owned: DataFrame) -> DataFrame:
    """(video, frame, from, to) where the owner differs from that of the frame before."""
    before = F.lag("owner_track_id").over(Window.partitionBy("video").orderBy("frame"))
    return owned.select("video", "frame", before.alias("from"), F.col("owner_track_id").alias("to")).where(F.col("from") != F.col("to"))


def speeds(detections: DataFrame) -> DataFrame:
    """Normalised places and speed in m/s from the row before of the same track, at most 12."""
    w = Window.partitionBy("video", "track_id").orderBy("frame", "row_id")
    d = detections.withColumns({"x_norm": F.col("x_center") / IMAGE[0], "y_norm": F.col("y_center") / IMAGE[1]})
    step = F.hypot((F.col("x_norm") - F.lag("x_norm").over(w)) * COURT[0], (F.col("y_norm") - F.lag("y_norm").over(w)) * COURT[1])
    return d.withColumn("speed_ms", scalars.capped_speed(F.coalesce(step, F.lit(0.0))))


def frame_features(detections: DataFrame, ball: str = "ball", player: str = "player") -> DataFrame:
    """(video, frame, ball_x, ball_y, ball_speed, min_dist, player_speed) of frames with a player; a frame without a
    ball has it in the middle at rest."""
    d = speeds(detections)
    balls = d.where(F.col("class") == ball).groupBy("video", "frame").agg(F.min_by(F.struct("x_norm", "y_norm", "speed_ms"), "row_id").alias("b"))
    rows = d.where(F.col("class") == player).join(balls, ["video", "frame"], "left")
    bx, by = F.coalesce("b.x_norm", F.lit(0.5)), F.coalesce("b.y_norm", F.lit(0.5))
    rows = rows.withColumns({"bx": bx, "by": by, "bs": F.coalesce("b.speed_ms", F.lit(0.0)), "gap": F.hypot((F.col("x_norm") - bx) * COURT[0], (F.col("y_norm") - by) * COURT[1])})
    nearest = F.min_by("speed_ms", F.struct("gap", "row_id")).alias("player_speed")
    return rows.groupBy("video", "frame").agg(F.first("bx").alias("ball_x"), F.first("by").alias("ball_y"), F.first("bs").alias("ball_speed"), F.min("gap").alias("min_dist"), nearest)


def feature_windows(frames: DataFrame, size: int = 30) -> DataFrame:
    """Every run of `size` rows: video, the last frame, and the rows as arrays."""
    w = Window.partitionBy("video").orderBy("frame")
    item = F.array(*(F.col(c).cast("float") for c in ("ball_x", "ball_y", "ball_speed", "min_dist", "player_speed")))
    rows = frames.select("video", "frame", F.row_number().over(w).alias("n"), F.collect_list(item).over(w.rowsBetween(-(size - 1), 0)).alias("items"))
    return rows.where(F.col("n") >= size).drop("n")


def frame_labels(videos: DataFrame, events: DataFrame) -> DataFrame:
    """videos(video, total) and events(video, frame, event_type, row_id) -> a label for every frame; the last named
    event of a frame counts."""
    codes = F.create_map(*(F.lit(v) for kv in LABELS.items() for v in kv))
    named = events.withColumn("code", F.try_element_at(codes, F.col("event_type"))).where(F.col("code").isNotNull())
    named = named.groupBy("video", "frame").agg(F.max_by("code", "row_id").alias("code"))
    spine = videos.where("total > 0").select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total").cast("long") - 1)).alias("frame"))
    return spine.join(named, ["video", "frame"], "left").select("video", "frame", F.coalesce("code", F.lit(0)).alias("label"))


def window_labels(labels: DataFrame, size: int = 30) -> DataFrame:
    """The label of a window is that of its last frame."""
    return labels.where(F.col("frame") >= size - 1).select("video", (F.col("frame") - (size - 1)).alias("window_start"), "label")
