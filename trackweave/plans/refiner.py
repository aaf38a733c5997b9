"""Refinement of a ball's track: which sightings count, a timeline without short gaps, and how far to trust it.

Sightings are weighed against what surrounds them (players, referees, hoops, the picture's edge) by joins and
projections. Only the two gates, which compare with the last row that was accepted, run row after row in Python, on a
few numbers per row of one video; everything before and after them is joins and windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import sequences
from ..sources.tables import written
from . import tracking

BALLS = ("ball", "sports ball", "basketball", "frisbee")
CONTEXT = ("player", "referee", "hoop")


@dataclass(frozen=True)
class Limits:
    """The defaults of the refiner for a 1920 pixel picture at 30 frames a second."""

    width: int = 1920
    height: int = 1080
    step: float = 160.0
    strict_step: float = 135.0
    fill: int = 5
    predict: int = 3
    smooth: int = 3
    restart: float = 0.25
    sure: float = 0.65
    edge: float = 24.0
    edge_confidence: float = 0.55
    context: float = 420.0
    context_confidence: float = 0.18
    body_confidence: float = 0.56
    torso_confidence: float = 0.20
    locked_sure: float = 0.82
    locked_rows: int = 6
    ball: float = 18.0

    @classmethod
    def adaptive(cls, width: int, height: int, fps: float) -> Limits:
        longest, fps = max(float(width), float(height), 1.0), fps if fps and fps > 0 else 30.0
        slower, larger = max(0.75, min(1.25, 30.0 / fps)), max(0.85, min(1.35, longest / 1280.0))
        return cls(
            width, height, 165.0 * slower, 138.0 * slower, predict=5 if fps >= 45 else 3, restart=0.24, sure=0.62, edge=max(20.0, min(42.0, longest * 0.018)), context=420.0 * larger,
            locked_rows=max(5, round(fps * 0.2)), ball=max(12.0, min(26.0, longest * 0.012)),
        )

    @property
    def scale(self) -> float:
        return max(0.75, max(self.width, self.height) / 1920.0)


# sightings and what surrounds them


def sightings(rows: DataFrame, limits: Limits) -> DataFrame:
    """The surest ball of each frame, with the size of its box; rows without a place do not count."""
    balls = rows.where(F.col("class").isin(*BALLS) & F.col("frame").isNotNull() & F.col("x_center").isNotNull() & F.col("y_center").isNotNull())
    best = sequences.top_k(balls, ["video", "frame"], [F.desc_nulls_last("confidence"), F.col("row_id")], 1)
    size = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    return best.withColumn("bbox_size", g.clip(F.coalesce(size, F.lit(limits.ball)), 8, 40))


def near_edge(limits: Limits) -> Column:
    x, y, m = F.col("x_center"), F.col("y_center"), limits.edge
    return (x <= m) | (y <= m) | (x >= limits.width - m) | (y >= limits.height - m)


def with_context(balls: DataFrame, rows: DataFrame) -> DataFrame:
    """context_distance: to the nearest player, referee or hoop of the frame, the one before or the one after."""
    around = rows.where(F.col("class").isin(*CONTEXT)).select(F.col("video").alias("_v"), F.explode(F.array(F.col("frame") - 1, F.col("frame"), F.col("frame") + 1)).alias("_f"), F.col("x_center").alias("_x"), F.col("y_center").alias("_y"))
    pairs = balls.select("video", "frame", "row_id", "x_center", "y_center").join(around, (F.col("video") == F.col("_v")) & (F.col("frame") == F.col("_f")))
    nearest = pairs.groupBy("video", "row_id").agg(F.min(g.distance(F.col("x_center"), F.col("y_center"), F.col("_x"), F.col("_y"))).alias("context_distance"))
    return balls.join(nearest, ["video", "row_id"], "left")


def with_body(balls: DataFrame, rows: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The player of the frame in whose box the ball lies (of several the one of nearest centre): body_track_id, region
    (core, lower or edge), the place in the box, and whether that is the core or the torso. `places` has the places of
    the same balls where `balls` itself is costly to read twice."""
    l, t, r, b = (F.least("_x1", "_x2"), F.least("_y1", "_y2"), F.greatest("_x1", "_x2"), F.greatest("_y1", "_y2"))
    players = rows.where(F.col("class").isin("player", "person")).select(F.col("video").alias("_v"), F.col("frame").alias("_f"), F.col("row_id").alias("_i"), F.col("track_id").alias("_t"), *(F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")))
    players = players.select("_v", "_f", "_i", "_t", l.alias("_l"), t.alias("_u"), r.alias("_r"), b.alias("_b"))
    pairs = (balls if places is None else places).select("video", "frame", "row_id", "x_center", "y_center").join(players, (F.col("video") == F.col("_v")) & (F.col("frame") == F.col("_f")) & F.col("x_center").between(F.col("_l"), F.col("_r")) & F.col("y_center").between(F.col("_u"), F.col("_b")))
    rel_x = (F.col("x_center") - F.col("_l")) / F.greatest(F.col("_r") - F.col("_l"), F.lit(1.0))
    rel_y = (F.col("y_center") - F.col("_u")) / F.greatest(F.col("_b") - F.col("_u"), F.lit(1.0))
    core, torso = rel_x.between(0.12, 0.88) & rel_y.between(0.12, 0.68), rel_y.between(0.08, 0.72)
    region = F.when(core, "core").when(rel_y > 0.68, "lower").otherwise("edge")
    found = F.struct(F.col("_t").alias("body_track_id"), region.alias("body_region"), F.round(rel_x, 3).alias("body_rel_x"), F.round(rel_y, 3).alias("body_rel_y"), core.alias("body_core"), torso.alias("body_torso"))
    away = g.distance(F.col("x_center"), F.col("y_center"), (F.col("_l") + F.col("_r")) / 2, (F.col("_u") + F.col("_b")) / 2)
    best = pairs.groupBy("video", "row_id").agg(F.min_by(found, F.struct(away, F.col("_i"))).alias("_body"))
    out = balls.join(best, ["video", "row_id"], "left").withColumn("body_overlap", F.col("_body").isNotNull())
    flags = [F.coalesce(F.col(f"_body.{c}"), F.lit(False)).alias(c) for c in ("body_core", "body_torso")]
    return out.select(*balls.columns, "body_overlap", *(F.col(f"_body.{c}") for c in ("body_track_id", "body_region", "body_rel_x", "body_rel_y")), *flags)


def weak_on_body(limits: Limits) -> Column:
    """Too little confidence for a ball in front of a body's core or torso."""
    return (F.col("body_core") & (F.col("confidence") < limits.body_confidence)) | (~F.col("body_core") & F.col("body_torso") & (F.col("confidence") < limits.torso_confidence))


# the gate of motion


def gate(frames: np.ndarray, x: np.ndarray, y: np.ndarray, sure: np.ndarray, edge: np.ndarray, far: np.ndarray, weak: np.ndarray, limits: Limits) -> list[tuple]:
    """(note, segment, distance, gap) for rows in order of frame; segment is None for rows that do not count. `far` and
    `weak` tell rows far from any context and weak ones on a body."""
    step, out, last, segment = limits.step * limits.scale, [], None, 0
    for i in range(len(frames)):
        if last is None and edge[i] and sure[i] < limits.edge_confidence:
            out.append(("removed_edge_low_confidence", None, None, None))
        elif far[i] and sure[i] < limits.context_confidence:
            out.append(("removed_far_from_context", None, None, None))
        elif weak[i]:
            out.append(("removed_player_body_false_positive", None, None, None))
        elif last is None:
            last = i
            out.append(("accepted", segment, None, None))
        elif frames[i] <= frames[last]:
            out.append(("removed_same_frame", None, None, None))
        else:
            gap = int(frames[i] - frames[last])
            away = float(np.hypot(x[i] - x[last], y[i] - y[last]))
            reason = "accepted"
            if away > step * min(gap, 3):
                reason = _refused(gap, sure[i], edge[i], far[i], limits)
                if reason is None:
                    segment, reason = segment + 1, "accepted_new_segment"
            if reason.startswith("accepted"):
                last = i
                out.append((reason, segment, round(away, 3), gap))
            else:
                out.append((reason, None, None, None))
    return out


def _refused(gap: int, sure: float, edge: bool, far: bool, limits: Limits) -> str | None:
    """Why a row too far from the last accepted one does not begin a new segment; None if it does."""
    rules = (
        ("removed_impossible_speed", gap == 1), ("removed_short_gap_jump", gap <= limits.fill + 1), ("removed_far_low_confidence", sure < limits.restart), ("removed_edge_restart", edge),
        ("removed_far_restart_without_context", far and sure < limits.sure), ("removed_weak_new_segment", sure < limits.sure),
    )
    return next((name for name, holds in rules if holds), None)


def gated(balls: DataFrame, limits: Limits) -> DataFrame:
    """balls of sightings, with_context and with_body -> cleaning_note for all rows; ball_segment, motion_distance and
    frame_gap for those that count, null for the others."""
    sure = F.coalesce("confidence", F.lit(0.0))
    flags = {"_sure": sure, "_edge": near_edge(limits), "_far": F.coalesce(F.col("context_distance") > limits.context, F.lit(False)), "_weak": weak_on_body(limits)}

    columns = ("frame", "x_center", "y_center", *flags)

    def run(group: dict[str, np.ndarray]) -> list[tuple]:
        video = None if pd.isna(group["video"][0]) else group["video"][0]
        found = gate(*(group[c].tolist() for c in columns), limits)
        return [(video, row, *f) for row, f in zip(group["row_id"].tolist(), found, strict=True)]

    video = balls.schema["video"].dataType.simpleString()
    slim = balls.withColumns(flags).select("video", "row_id", "frame", "x_center", "y_center", *flags)
    notes = tracking.per_group(slim, ["video"], ["frame", "row_id"], run, f"video {video}, row_id long, cleaning_note string, ball_segment int, motion_distance double, frame_gap int")
    return balls.join(notes, ["video", "row_id"])


# runs on a body, weak segments, timeline


def without_locked_runs(points: DataFrame, limits: Limits) -> DataFrame:
    """Without runs of points that stay on a torso: long ones that are not sure go whole, of others the weak points."""
    w = Window.partitionBy("video").orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(w)
    goes_on = F.lag("body_torso").over(w) & F.col("body_torso") & (F.col("ball_segment") == F.lag("ball_segment").over(w)) & gap.between(1, limits.fill + 1)
    runs = sequences.islands(points, ["video"], ["frame"], ~F.coalesce(goes_on, F.lit(False)), "_run")
    sure = F.coalesce("confidence", F.lit(0.0))
    # a run of more than one row has only rows on a torso, and rows off it stay whatever their run
    own = Window.partitionBy("video", "_run")
    out = runs.withColumns({"_n": F.count("*").over(own), "_median": F.median(sure).over(own), "_most": F.max(sure).over(own)})
    locked = (F.col("_n") >= max(3, limits.locked_rows)) & ((F.col("_median") < limits.body_confidence) | (F.col("_most") < limits.locked_sure))
    stays = ~F.col("body_torso") | (~F.coalesce(locked, F.lit(False)) & ~weak_on_body(limits))
    return out.where(stays).select(*points.columns)


def without_weak_segments(points: DataFrame, limits: Limits) -> DataFrame:
    w = Window.partitionBy("video", "ball_segment")
    marked = points.withColumns({"_n": F.count("*").over(w), "_most": F.max(F.coalesce("confidence", F.lit(0.0))).over(w), "_near": F.min(F.round("context_distance", 2)).over(w)})
    return marked.where((F.col("_n") >= 3) | (F.col("_most") >= limits.sure) | F.coalesce(F.col("_near") <= limits.context, F.lit(False))).select(*points.columns)


def timeline(points: DataFrame, limits: Limits, total: DataFrame | None = None) -> DataFrame:
    """Points and what lies between them: straight lines over at most `fill` missing frames of a segment, else up to
    `predict` frames at the last velocity, also after the last point if total(video, frames) is given."""
    w = Window.partitionBy("video").orderBy("frame")
    own = Window.partitionBy("video", "ball_segment").orderBy("frame")
    step = F.col("frame") - F.lag("frame").over(own)
    later = F.struct("frame", "x_center", "y_center", "confidence", "ball_segment")
    p = points.withColumns({"_vx": (F.col("x_center") - F.lag("x_center").over(own)) / step, "_vy": (F.col("y_center") - F.lag("y_center").over(own)) / step, "_next": F.lead(later).over(w)})
    p = p.join(total.select("video", F.col("frames").alias("_frames")), "video", "left") if total is not None else p.withColumn("_frames", F.lit(None).cast("long"))
    missing = F.col("_next.frame") - F.col("frame") - 1
    same = F.col("_next.ball_segment") == F.col("ball_segment")
    filled = F.when(same & missing.between(1, limits.fill), missing).otherwise(0)
    open_ = F.when(F.col("_next").isNull(), F.col("_frames") - F.col("frame") - 1).when(same & (missing > limits.fill), missing)
    ahead = F.when(F.col("_vx").isNotNull(), F.least(F.greatest(F.coalesce(open_, F.lit(0)), F.lit(0)), F.lit(limits.predict))).otherwise(0)
    count = F.greatest(filled, ahead).cast("int")
    rows = p.withColumns({"_filled": filled > 0, "_missing": missing, "_k": F.explode(F.sequence(F.lit(0), count))})
    at = F.col("_k") / (F.col("_missing") + 1)
    sure = F.coalesce("confidence", F.lit(0.0))
    line = lambda c: F.col(c) + (F.col(f"_next.{c}") - F.col(c)) * at
    real, drawn = F.col("_k") == 0, F.col("_filled")
    new = {
        "x_center": F.when(real, F.col("x_center")).when(drawn, line("x_center")).otherwise(F.col("x_center") + F.col("_vx") * F.col("_k")),
        "y_center": F.when(real, F.col("y_center")).when(drawn, line("y_center")).otherwise(F.col("y_center") + F.col("_vy") * F.col("_k")),
        "confidence": F.when(real, sure).when(drawn, F.greatest(F.lit(0.05), F.least(sure, F.coalesce("_next.confidence", F.lit(0.0))) * 0.8)).otherwise(F.greatest(F.lit(0.01), sure * F.pow(F.lit(0.75), F.col("_k")))),
    }
    status = F.when(real, "Detected").when(drawn, "Interpolated").otherwise("Predicted")
    note = F.when(real, F.col("cleaning_note")).when(drawn, F.concat(F.lit("linear_interpolation_gap_"), F.col("_missing").cast("string"))).otherwise("linear_prediction_occlusion")
    made = {"frame": F.col("frame") + F.col("_k"), "x_center": F.round(new["x_center"], 2), "y_center": F.round(new["y_center"], 2), "confidence": F.round(new["confidence"], 3), "cleaning_note": note, "ball_status": status}
    return rows.withColumns({"raw_x_center": F.col("x_center"), "raw_y_center": F.col("y_center")}).withColumns(made).select(*points.columns, "ball_status", "raw_x_center", "raw_y_center")


def smoothed(rows: DataFrame, limits: Limits) -> DataFrame:
    """Centred mean of `smooth` rows of a segment, and the box round the new centre; two decimals."""
    half = max(1, limits.smooth) // 2
    w = Window.partitionBy("video", "ball_segment").orderBy("frame").rowsBetween(-half, half)
    mean = rows.withColumns({c: F.avg(c).over(w) for c in ("x_center", "y_center")})
    side = F.coalesce("bbox_size", F.lit(limits.ball)) / 2
    box = {"x1": F.col("x_center") - side, "y1": F.col("y_center") - side, "x2": F.col("x_center") + side, "y2": F.col("y_center") + side, "x_center": F.col("x_center"), "y_center": F.col("y_center")}
    return mean.withColumns({c: F.round(v, 2) for c, v in box.items()})


def jump_gate(frames: np.ndarray, x: np.ndarray, y: np.ndarray, step: float, near: int) -> np.ndarray:
    """Which rows, in order of frame, are not a jump from the last one kept; beyond `near` frames nothing is a jump."""
    keep, last = np.ones(len(frames), bool), 0
    for i in range(1, len(frames)):
        gap = frames[i] - frames[last]
        keep[i] = gap > near or (gap > 0 and np.hypot(x[i] - x[last], y[i] - y[last]) <= step * min(gap, 2))
        last = i if keep[i] else last
    return keep


def without_jumps(rows: DataFrame, limits: Limits) -> DataFrame:
    """Rows that the jump gate keeps. After more than fill + 1 frames without a row the gate forgets, so the pieces of a
    video between such gaps are independent groups."""
    pieces = sequences.gap_islands(rows, ["video"], "frame", "row_id", limits.fill + 1, "_piece")
    step, near = limits.strict_step * limits.scale, limits.fill + 1

    def run(group: dict[str, np.ndarray]) -> list[tuple]:
        video = None if pd.isna(group["video"][0]) else group["video"][0]
        keep = jump_gate(*(group[c].tolist() for c in ("frame", "x_center", "y_center")), step, near)
        return [(video, frame) for frame in group["frame"][keep].tolist()]

    video = rows.schema["video"].dataType.simpleString()
    slim = pieces.select("video", "_piece", F.col("frame").cast("long").alias("frame"), "x_center", "y_center")
    kept = tracking.per_group(slim, ["video", "_piece"], ["frame"], run, f"video {video}, frame long")
    return rows.join(kept, ["video", "frame"], "left_semi")


def reliability(rows: DataFrame, limits: Limits) -> DataFrame:
    """jump_distance to the row before in the segment, is_reliable, and the reason."""
    w = Window.partitionBy("video").orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(w)
    near = (gap > 0) & (gap <= limits.fill + 1) & (F.col("ball_segment") == F.lag("ball_segment").over(w))
    jump = F.when(near, g.distance(F.col("x_center"), F.col("y_center"), F.lag("x_center").over(w), F.lag("y_center").over(w)))
    marked = rows.withColumns({"_jump": jump, "_step": F.least(gap, F.lit(2)) * limits.strict_step * limits.scale})
    reason = F.when((F.col("ball_status") == "Detected") & (F.col("confidence") < 0.01), "warning_very_low_confidence_detection").when((F.col("ball_status") == "Predicted") & (F.col("confidence") < 0.02), "warning_low_confidence_prediction").when(F.col("_jump") > F.col("_step"), "warning_large_clean_jump")
    marked = marked.withColumns({"jump_distance": F.round("_jump", 3), "is_reliable": reason.isNull(), "reliability_reason": F.coalesce(reason, F.col("cleaning_note"))})
    return marked.drop("_jump", "_step")


def refined(rows: DataFrame, limits: Limits, total: DataFrame | None = None) -> DataFrame:
    """The ball's clean rows, from rows of all classes."""
    # each is read twice below, and what is read twice is worked out twice unless it is written
    seen = written(sightings(rows, limits))
    balls = written(with_body(with_context(seen, rows), rows, seen))
    points = gated(balls, limits).where(F.col("ball_segment").isNotNull())
    points = without_weak_segments(without_locked_runs(points, limits), limits)
    line = written(smoothed(without_locked_runs(timeline(points, limits, total), limits), limits))
    return reliability(without_jumps(line, limits), limits)


def clean_rows(rows: DataFrame, limits: Limits, total: DataFrame | None = None) -> DataFrame:
    """All rows with the ball's replaced by its clean ones, in any order."""
    rows = written(rows)
    ball = refined(rows, limits, total).withColumns({"class": F.lit("ball"), "track_id": F.lit(0).cast(rows.schema["track_id"].dataType)})
    other = rows.where(~F.col("class").isin(*BALLS))
    return other.unionByName(ball, allowMissingColumns=True)


def cleaned_tracking(rows: DataFrame, limits: Limits, total: DataFrame | None = None) -> DataFrame:
    """clean_rows in order of frame, class and track."""
    return clean_rows(rows, limits, total).orderBy("video", "frame", "class", "track_id")
