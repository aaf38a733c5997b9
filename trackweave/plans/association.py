"""Which candidate of each frame is the ball: a beam search over paths through the candidates.

A path's score adds up how good its candidates are and how well each one follows from the two before it (distance from
the place that their velocity leads to, and change of velocity). All paths of the beam meet all candidates of a frame as
arrays. Pieces of a video between long gaps without candidates are searched apart, so a long video is many groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import sequences
from ..sources.tables import written
from . import tracking


@dataclass(frozen=True)
class Links:
    """Limits and weights of the search."""

    distance: float = 220.0
    growth: float = 35.0
    weight: float = 45.0
    restart_after: int = 18
    least: float = 0.03
    width: int = 18
    candidates: int = 12
    linked_frames: int = 12
    kept_frames: int = 90

    @property
    def restart_gap(self) -> int:
        return max(3, min(self.restart_after, 8))


def quality() -> Column:
    """Of a candidate by its confidence and box: round and neither tiny nor large."""
    w, h = (F.greatest(F.col(f"{c}2") - F.col(f"{c}1"), F.lit(0.0)) for c in "xy")
    long = F.greatest(w / F.nullif(h, F.lit(0.0)), h / F.nullif(w, F.lit(0.0)))
    box = -F.greatest(long - 1.35, F.lit(0.0)) * 0.65 - F.greatest(w * h - 2800, F.lit(0.0)) / 2200 - F.greatest(18 - w * h, F.lit(0.0)) / 60
    return F.coalesce("confidence", F.lit(0.0)) * 4 + F.when((w > 0) & (h > 0), box).when(w.isNull() | h.isNull(), -0.25).otherwise(-0.75)


class Beam:
    """The best paths so far, one entry of each array a path; `node` is its last step in the list of all steps."""

    FIELDS = ("score", "hits", "restarts", "segment", "node", "frame", "x", "y", "before", "bx", "by")

    def __init__(self, links: Links):
        self.links, self.steps = links, []  # (step before, row, segment)
        self.at = {f: np.zeros(0) for f in self.FIELDS}

    def rank(self, p: dict) -> np.ndarray:
        return p["score"] + 1.15 * p["hits"] - 0.55 * p["restarts"]

    def _kept(self, frame: int) -> dict:
        """Paths that may still go on, a little worse for each frame without the ball."""
        gap = frame - self.at["frame"]
        use = (gap > 0) & (gap <= max(self.links.restart_after, 1, self.links.kept_frames))
        out = {f: v[use] for f, v in self.at.items()}
        out["score"] = out["score"] - np.minimum(1.5, np.maximum(gap[use] - 1, 0) * 0.08)
        return out

    def see(self, frame: int, rows: np.ndarray, x: np.ndarray, y: np.ndarray, sure: np.ndarray, good: np.ndarray) -> None:
        k, p = self.links, self._kept(frame)
        use = sure >= k.least
        rows, x, y, sure, good = (v[use][:, None] for v in (rows, x, y, sure, good))
        gap, moving = frame - p["frame"], ~np.isnan(p["before"])
        since = np.where(moving, p["frame"] - p["before"], 1)
        vx, vy = (np.where(moving, (p[a] - p[b]) / since, 0.0) for a, b in (("x", "bx"), ("y", "by")))
        away = np.hypot(x - (p["x"] + vx * gap), y - (p["y"] + vy * gap))
        reach = k.distance + k.growth * np.minimum(np.maximum(gap - 1, 0), 4) + np.minimum(k.distance * 0.45, np.hypot(vx, vy) * gap * 0.22)
        linked = (gap <= k.linked_frames) & (away <= np.minimum(reach, k.distance * 1.45 + k.growth * 4))
        turn = np.where(moving, np.minimum(3.0, np.hypot((x - p["x"]) / gap - vx, (y - p["y"]) / gap - vy) / 75), 0.0)
        follow = 1.35 + good + sure * max(0.0, k.weight) / 45 - away / max(45.0, k.distance * 0.45) - np.maximum(gap - 1, 0) * 0.28 - turn
        anew = ~linked & (gap >= k.restart_gap) & (sure >= max(k.least, 0.08))
        again = good + 0.45 - 2 - np.minimum(2.0, np.maximum(gap - k.restart_gap, 0) * 0.12)
        # in front of each candidate's paths the one that begins with it
        n, m = len(rows), len(gap)
        wide = lambda first, rest: np.concatenate([np.broadcast_to(first, (n, 1)), np.broadcast_to(rest, (n, m))], 1)
        valid = wide(True, linked | anew)
        made = {
            "score": wide(good + 0.8, p["score"] + np.where(linked, follow, again)), "hits": wide(1, p["hits"] + 1), "restarts": wide(0, p["restarts"] + anew), "segment": wide(0, p["segment"] + anew), "node": wide(-1, p["node"]),
            "frame": wide(frame, frame), "x": wide(x, x), "y": wide(y, y), "before": wide(np.nan, np.where(linked, p["frame"], np.nan)), "bx": wide(np.nan, p["x"]), "by": wide(np.nan, p["y"]),
        }
        both = {f: np.concatenate([made[f][valid], p[f]]) for f in self.FIELDS}
        fresh = np.concatenate([np.broadcast_to(rows, valid.shape)[valid], np.full(m, -1)])
        best = np.argsort(-self.rank(both), kind="stable")[: k.width]
        self.at = {f: v[best] for f, v in both.items()}
        for i, row in enumerate(fresh[best]):
            if row >= 0:
                self.steps.append((int(self.at["node"][i]), int(row), int(self.at["segment"][i])))
                self.at["node"][i] = len(self.steps) - 1

    def path(self) -> list[tuple[int, int]]:
        """(row, segment) of the best path, in order."""
        if not len(self.at["score"]):
            return []
        node, out = int(self.at["node"][int(np.argmax(self.rank(self.at)))]), []
        while node >= 0:
            node, row, segment = self.steps[node]
            out.append((row, segment))
        return out[::-1]


def best_path(frames: np.ndarray, x: np.ndarray, y: np.ndarray, sure: np.ndarray, good: np.ndarray, links: Links = Links()) -> list[tuple[int, int]]:
    """(row, segment) of the ball's rows; rows in order of frame, the better ones of a frame first."""
    beam = Beam(links)
    turns = np.flatnonzero(np.diff(frames, prepend=frames[:1] - 1)) if len(frames) else []
    for a, b in zip(turns, [*turns[1:], len(frames)][: len(turns)], strict=True):
        b = min(b, a + links.candidates)
        beam.see(int(frames[a]), np.arange(a, b), x[a:b], y[a:b], sure[a:b], good[a:b])
    return beam.path()


def associate(candidates: DataFrame, links: Links = Links()) -> DataFrame:
    """At most one ball a frame from candidates(video, frame, row_id, x_center, y_center, confidence, x1..y2), with
    ball_segment: it rises where the path starts anew and from piece to piece."""
    placed = candidates.where("x_center IS NOT NULL AND y_center IS NOT NULL AND frame IS NOT NULL")
    pieces = sequences.gap_islands(placed, ["video"], "frame", "row_id", max(1, links.restart_after), "_piece")

    def run(group: dict) -> list[tuple]:
        found = best_path(*(group[c] for c in ("frame", "x_center", "y_center", "sure", "good")), links)
        name, piece, ids = None if pd.isna(group["video"][0]) else group["video"][0], group["piece"][0], group["row_id"]
        return [(name, piece, ids[i], s) for i, s in found]

    video = candidates.schema["video"].dataType.simpleString()
    slim = pieces.select("video", F.col("_piece").alias("piece"), F.col("frame").cast("long").alias("frame"), "row_id", "x_center", "y_center", F.coalesce("confidence", F.lit(0.0)).alias("sure"), quality().alias("good"))
    # read twice below, and the search is the work
    found = written(tracking.per_group(slim, ["video", "piece"], ["frame", F.nanvl("good", F.lit(float("-inf"))).desc(), "row_id"], run, f"video {video}, piece long, row_id long, segment long"))
    w = Window.partitionBy("video").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = found.groupBy("video", "piece").agg((F.max("segment") + 1).alias("n")).select("video", "piece", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    named = found.join(before, ["video", "piece"]).select("video", "row_id", (F.col("segment") + F.col("before")).alias("ball_segment"))
    return candidates.drop("ball_segment").join(named, ["video", "row_id"]).select(*(c for c in candidates.columns if c != "ball_segment"), "ball_segment")
