"""Thresholds that follow from a video's size and frames per second, as columns and as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import geometry as g


def _longest(width: Column, height: Column) -> Column:
    return F.greatest(width.cast("double"), height.cast("double"), F.lit(1.0))


def resolution_scale(width: Column, height: Column) -> Column:
    return g.clip(_longest(width, height) / 1280.0, 0.85, 1.45)


def motion_scale(width: Column, height: Column, fps: Column) -> Column:
    return resolution_scale(width, height) * g.clip(30.0 / fps, 0.72, 1.25)


def to_stride(size: Column, stride: int = 32) -> Column:
    """The nearest multiple, ties to the even one."""
    return (F.bround(size / stride) * stride).cast("int")


def adaptive(width: Column, height: Column, fps: Column) -> dict[str, Column]:
    """Limits of the tracking steps, by resolution and speed of the video."""
    longest, scale, motion, fast = _longest(width, height), resolution_scale(width, height), motion_scale(width, height, fps), fps >= 45
    return {
        "imgsz": to_stride(g.clip(longest * 1.05, 1280, 1600)), "ball_imgsz": to_stride(g.clip(longest * 1.25, 1536, 1920)), "rim_rescue_margin_px": scale * 220, "court_ball_margin_px": scale * 320, "court_hoop_margin_px": scale * 360,
        "rim_proximity_px": scale * 190, "association_max_distance_px": motion * 280, "association_gap_growth_px": motion * 55, "association_restart_after_frames": F.when(fast, 8).otherwise(7),
        "max_gap": F.when(fast, 16).otherwise(12), "max_prediction_frames": F.when(fast, 12).otherwise(9),
    }


def scaled_step(step: float, width: Column, height: Column) -> Column:
    """Pixels a frame that a ball may move in a picture of this size."""
    return F.greatest(_longest(width, height) / 1920.0, F.lit(0.75)) * step


def frame_limit(fps: Column, seconds: Column, test_mode: Column, test_frames: Column) -> Column:
    """How many frames to read: the least of the asked duration and the test limit; null for all."""
    by_time = F.when(seconds > 0, F.greatest(F.lit(1), F.bround(seconds * fps).cast("int")))
    return F.least(by_time, F.when(test_mode, F.greatest(F.lit(1), test_frames.cast("int"))))


#: Functions for SQL users, in SQL themselves, so that the optimizer sees through them.
SQL_FUNCTIONS = {
    "clock_seconds": ("clock STRING", "DOUBLE", r"try_cast(regexp_extract(clock, '^(\\d{1,2}):(\\d{2})$', 1) AS DOUBLE) * 60 + try_cast(regexp_extract(clock, '^(\\d{1,2}):(\\d{2})$', 2) AS DOUBLE)"),
    "win_probability": ("margin DOUBLE", "DOUBLE", "1 / (1 + exp(-margin / 6))"),
    "box_iou": (
        "ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE", "DOUBLE",
        "try_divide(greatest(least(ax2, bx2) - greatest(ax1, bx1), 0D) * greatest(least(ay2, by2) - greatest(ay1, by1), 0D), (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - greatest(least(ax2, bx2) - greatest(ax1, bx1), 0D) * greatest(least(ay2, by2) - greatest(ay1, by1), 0D))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Make SQL_FUNCTIONS known to the session's SQL; returns their names."""
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)
