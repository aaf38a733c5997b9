"""The ball's path through short gaps: straight in x, a throw's parabola in y.

The pull of gravity of a gap is estimated from the points around it, those filled just before too, so the gaps of a
piece of path are filled one after the other in Python; pieces further apart than the longest gap are independent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import sequences
from . import tracking

# The longest gap, points looked at on both sides, and bounds of gravity in pixels per frame and frame.
MAX_GAP, SUPPORT, LEAST_PULL, MOST_PULL, USUAL_PULL, FLOOR = 18, 4, 0.05, 3.0, 0.8, 0.75


def _bounded(pull: float) -> float:
    return 0.0 if abs(pull) <= 1e-9 else float(np.sign(pull) * np.clip(abs(pull), LEAST_PULL, MOST_PULL))


def pull_of(frames: np.ndarray, y: np.ndarray) -> float | None:
    """Median second derivative over neighbouring points; of those that point down if there are any."""
    if len(frames) < 3:
        return None
    step = np.diff(frames).astype(float)
    bend = 2 * np.diff(np.diff(y) / step) / (step[:-1] + step[1:])
    down = bend[bend > 0]
    return float(np.median(down if len(down) else bend))


def global_pull(points: DataFrame) -> DataFrame:
    """(video, pull): of all points of a video, by windows and an exact median."""
    w = Window.partitionBy("video").orderBy("frame")
    t0, t1 = F.lag("frame", 2).over(w), F.lag("frame").over(w)
    y0, y1 = F.lag("y_center", 2).over(w), F.lag("y_center").over(w)
    bend = 2 * ((F.col("y_center") - y1) / (F.col("frame") - t1) - (y1 - y0) / (t1 - t0)) / ((F.col("frame") - t1) + (t1 - t0))
    per = points.withColumn("_bend", bend).groupBy("video").agg(F.median(F.when(F.col("_bend") > 0, F.col("_bend"))).alias("_down"), F.median("_bend").alias("_any"))
    found = F.coalesce("_down", "_any")
    clipped = F.signum(found) * g.clip(F.abs(found), LEAST_PULL, MOST_PULL)
    return per.select("video", F.when(F.abs(found) > 1e-9, clipped).otherwise(F.lit(USUAL_PULL)).alias("pull"))


def fill(frames: np.ndarray, x: np.ndarray, y: np.ndarray, sure: np.ndarray, segment: np.ndarray, pull: float, max_gap: int = MAX_GAP) -> list[tuple]:
    """(frame, x, y, confidence, gravity) of the frames in gaps, from points in order of frame."""
    at, ys, out = list(frames[:1]), list(y[:1]), []
    for i in range(1, len(frames)):
        left, right = int(frames[i - 1]), int(frames[i])
        if 1 < right - left <= max_gap + 1 and segment[i] == segment[i - 1]:
            # earlier points, filled ones too, and the seen points after the gap
            known = [k for k in range(len(at)) if at[k] >= left - SUPPORT]
            later = slice(i, i + int(np.searchsorted(frames[i:], right + SUPPORT, "right")))
            local = pull_of(np.array([*(at[k] for k in known), *frames[later]]), np.array([*(ys[k] for k in known), *y[later]]))
            a = _bounded(local) if local is not None and abs(local) > 1e-9 else _bounded(pull)
            n, t = right - left, np.arange(1, right - left)
            fall = y[i - 1] + ((y[i] - y[i - 1] - 0.5 * a * n * n) / n) * t + 0.5 * a * t * t
            if abs(a) <= 1e-9:
                fall = y[i - 1] + (y[i] - y[i - 1]) * t / n
            c = max(0.05, min(1.0, max(FLOOR, min(sure[i - 1], sure[i]) * 0.8)))
            out += [(left + int(k), float(x[i - 1] + (x[i] - x[i - 1]) * k / n), float(v), c, round(a, 4)) for k, v in zip(t, fall, strict=True)]
            at += [left + int(k) for k in t]
            ys += list(fall)
        at.append(right)
        ys.append(y[i])
        at, ys = at[-2 * (max_gap + SUPPORT) :], ys[-2 * (max_gap + SUPPORT) :]
    return out


def parabolic(points: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """points(video, frame, row_id, x_center, y_center, confidence, ball_segment), one a frame -> the same with rows for
    gaps of at most max_gap frames within a segment; `interpolated` and estimated_gravity tell them."""
    pieces = sequences.gap_islands(points, ["video"], "frame", "row_id", max_gap + 1, "_piece").join(global_pull(points), "video")
    video = points.schema["video"].dataType.simpleString()

    def run(group: dict) -> list[tuple]:
        made = fill(*(group[c] for c in ("frame", "x_center", "y_center", "confidence", "ball_segment")), float(group["pull"][0]), max_gap)
        name = None if pd.isna(group["video"][0]) else group["video"][0]
        return [(name, *m) for m in made]

    slim = pieces.select("video", "_piece", F.col("frame").cast("long").alias("frame"), "x_center", "y_center", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce(F.col("ball_segment").cast("long"), F.lit(-1)).alias("ball_segment"), "pull")
    made = tracking.per_group(slim, ["video", "_piece"], ["frame"], run, f"video {video}, frame long, x_center double, y_center double, confidence double, estimated_gravity double")
    seen = points.select("video", F.col("frame").cast("long").alias("frame"), "x_center", "y_center", "confidence", F.lit(None).cast("double").alias("estimated_gravity"), F.lit(False).alias("interpolated"))
    return seen.unionByName(made.withColumn("interpolated", F.lit(True)))
