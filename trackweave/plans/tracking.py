"""Following the ball and the players: filter, velocities, segments, quality, teams.

Set-based steps are windows and joins by (video, frame). Steps that carry a state from row to row of a video (filter,
gates, association) run as one Python function per independent chunk: `chunked` cuts a video where nothing that far
back can matter, so long videos are many groups.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import sequences

BOX = ("x1", "y1", "x2", "y2")


def box() -> g.Box:
    return tuple(F.col(c) for c in BOX)


def chunked(rows: DataFrame, gap: int, name: str = "chunk") -> DataFrame:
    """Number the runs of frames of a video that are not more than `gap` apart."""
    return sequences.gap_islands(rows, ["video"], "frame", "row_id", gap, name)


# stateful steps


class BallFilter:
    """A Kalman filter of place and velocity; gravity is a known acceleration of y. Both axes begin with the same
    uncertainty and get the same noise and trust, so one 2 x 2 matrix (place, both, velocity) serves them, in plain numbers."""

    def __init__(self, process: float = 30.0, measurement: float = 12.0, gravity: float = 0.0, max_missing: int = 30):
        self.process, self.measurement, self.gravity, self.max_missing = process, measurement, gravity, max_missing
        self.now: tuple[float, float, float, float] | None = None
        self.spread, self.missing = (0.0, 0.0, 0.0), 0

    @property
    def state(self) -> np.ndarray | None:
        """Place and velocity."""
        return None if self.now is None else np.array(self.now)

    def start(self, x: float, y: float) -> None:
        self.now, self.spread, self.missing = (x, y, 0.0, 0.0), (400.0, 0.0, 250.0), 0

    def advance(self) -> bool:
        """One frame on; False if there is nothing to follow, or no more."""
        if self.now is None:
            return False
        x, y, vx, vy = self.now
        p, b, v = self.spread
        self.now = (x + vx, y + vy + self.gravity / 2, vx, vy + self.gravity)
        self.spread = (p + 2 * b + v + self.process / 4, b + v + self.process / 2, v + self.process)
        self.missing += 1
        if self.missing > self.max_missing:
            self.now = None
        return self.now is not None

    def see(self, x: float, y: float, confidence: float | None) -> None:
        """A measurement; little confidence makes it count less."""
        if not self.advance():
            self.start(x, y)
            return
        trust = 1.0 if confidence is None or confidence != confidence else min(1.0, max(0.05, confidence))
        p, b, v = self.spread
        of_all = p + self.measurement**2 / trust
        place, speed = p / of_all, b / of_all
        px, py, vx, vy = self.now
        dx, dy = x - px, y - py
        self.now = (px + place * dx, py + place * dy, vx + speed * dx, vy + speed * dy)
        self.spread = (p - place * p, b - place * b, v - speed * b)
        self.missing = 0


def follow(frames: pd.DataFrame, ball: BallFilter, starts: np.ndarray | None = None) -> pd.DataFrame:
    """Run the filter over the frames in order; rows without x_center are predicted, and it begins anew at `starts`."""
    out = []
    x, y, c = (frames[n].to_numpy(float, na_value=np.nan).tolist() for n in ("x_center", "y_center", "confidence"))
    anew = [False] * len(x) if starts is None else starts.tolist()
    for x, y, c, new in zip(x, y, c, anew, strict=True):
        if new:
            ball.now = None
        seen = x == x and y == y
        if seen:
            ball.see(x, y, c)
        elif not ball.advance():
            out.append((None, None, None, None, None, 0))
            continue
        out.append((*ball.now, "kalman_update" if seen else "kalman_prediction", ball.missing))
    return pd.DataFrame(out, columns=["fx", "fy", "vx", "vy", "source", "missing_frames"], index=frames.index)


def turns(pdf: pd.DataFrame, keys: list[str], before: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """Which rows have other keys than the row before them (`before` for the first), and the last row's keys; nulls are
    equal. For rows of sorted partitions, which come in batches."""
    if not len(pdf):
        return np.zeros(0, bool), before
    new = np.zeros(len(pdf), bool)
    for k in keys:
        v, gone = pdf[k].to_numpy(), pd.isna(pdf[k]).to_numpy()
        new[1:] |= (v[1:] != v[:-1]) & ~(gone[1:] & gone[:-1])
    at = lambda i: tuple(None if pd.isna(v) else v for v in (pdf[k].iloc[i] for k in keys))
    new[0] = before is None or at(0) != before
    return new, at(-1)


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The runs of rows with equal keys in the batches of a sorted partition, as arrays by column."""
    held, before = [], None
    joined = lambda: {c: np.concatenate([h[c] for h in held]) if len(held) > 1 else held[0][c] for c in held[0]}
    for pdf in batches:
        new, before = turns(pdf, keys, before)
        arrays = {c: pdf[c].to_numpy() for c in pdf.columns}
        cuts = sorted({0, *np.flatnonzero(new).tolist(), len(pdf)})
        for a, b in zip(cuts, cuts[1:]):
            if new[a] and held:
                yield joined()
                held = []
            held.append({c: v[a:b] for c, v in arrays.items()})
    if held:
        yield joined()


def per_group(rows: DataFrame, keys: list[str], order: list, run, schema: str) -> DataFrame:
    """What `run` gives, as a list of tuples, for the arrays of each group, in `order`. Groups are read from sorted
    partitions and results are put together in batches, so many small groups cost what their rows cost."""
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for group in groups(batches, keys):
            out += run(group)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return sequences.dealt(rows, *keys).sortWithinPartitions(*keys, *order).mapInPandas(each, schema)


def kalman(frames: DataFrame, process: float = 30.0, measurement: float = 12.0, gravity: float = 0.0, max_missing: int = 30) -> DataFrame:
    """frames(video, frame, x_center, y_center, confidence), one row a frame, null where nothing was seen. A video is
    cut after more than max_missing empty frames, where the filter starts anew anyway."""
    w = Window.partitionBy("video").orderBy("frame")
    seen = F.when(F.col("x_center").isNotNull(), F.col("frame"))
    before = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("x_center").isNotNull() & ((F.col("frame") - before > max_missing + 1) | before.isNull())
    rows = sequences.islands(frames, ["video"], ["frame"], starts, "chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ball, before = BallFilter(process, measurement, gravity, max_missing), None
        for pdf in batches:
            starts, before = turns(pdf, ["video", "chunk"], before)
            yield pd.concat([pdf[["video", "frame", "x_center", "y_center", "confidence"]], follow(pdf, ball, starts)], axis=1)

    schema = f"video {frames.schema['video'].dataType.simpleString()}, frame long, x_center double, y_center double, confidence double, fx double, fy double, vx double, vy double, source string, missing_frames int"
    slim = rows.select("video", "chunk", F.col("frame").cast("long").alias("frame"), "x_center", "y_center", "confidence")
    return sequences.dealt(slim, "video", "chunk").sortWithinPartitions("video", "chunk", "frame").mapInPandas(run, schema)


# windows


def velocities(rows: DataFrame) -> DataFrame:
    """dx, dy to the row before in the segment, and velocity per frame."""
    w = Window.partitionBy("video", "ball_segment").orderBy("frame", "row_id")
    gap = F.nullif(F.col("frame") - F.lag("frame").over(w), F.lit(0))
    rows = rows.withColumns({"dx": F.bround(F.col("x_center") - F.lag("x_center").over(w), 2), "dy": F.bround(F.col("y_center") - F.lag("y_center").over(w), 2)})
    return rows.withColumns({"velocity_x": F.col("dx") / gap, "velocity_y": F.col("dy") / gap})


def gravity(rows: DataFrame, fallback: float = 0.8, least: float = 0.05, most: float = 3.0) -> DataFrame:
    """(video, gravity): the median of positive second differences of y over consecutive frames, within bounds."""
    w = Window.partitionBy("video").orderBy("frame")
    bend = F.col("y_center") - 2 * F.lag("y_center").over(w) + F.lag("y_center", 2).over(w)
    near = F.col("frame") - F.lag("frame", 2).over(w) == 2
    bends = rows.withColumn("bend", F.when(near & (bend > 0), bend))
    return bends.groupBy("video").agg(g.clip(F.coalesce(F.median("bend"), F.lit(fallback)), least, most).alias("gravity"))


def quality(rows: DataFrame, statuses: tuple[str, ...] = ("Detected", "Interpolated", "Predicted")) -> DataFrame:
    """One row a video: coverage, reliable share, largest jump, and how many rows have each status."""
    n = F.count("*")
    return rows.groupBy("video").agg(
        n.alias("rows"), F.bround(100.0 * F.count_distinct("frame") / (F.max("frame") + 1), 2).alias("coverage_pct"), F.bround(100.0 * F.count_if("is_reliable") / n, 2).alias("reliable_pct"), F.max("jump_distance").alias("max_jump"),
        F.count_if(F.col("jump_distance") > 120).alias("jumps_over_120"), F.count_if(F.col("jump_distance") > 180).alias("jumps_over_180"), *(F.count_if(F.col("ball_status") == s).alias(f"status_{s.lower()}") for s in statuses),
    )


def segment_ids(rows: DataFrame, gap: int, jump: float) -> DataFrame:
    """ball_segment: runs without long gaps or jumps."""
    w = Window.partitionBy("video").orderBy("frame", "row_id")
    turn = (F.col("frame") - F.lag("frame").over(w) > gap) | (F.hypot(F.col("x_center") - F.lag("x_center").over(w), F.col("y_center") - F.lag("y_center").over(w)) > jump)
    return sequences.islands(rows, ["video"], ["frame", "row_id"], turn, "ball_segment")


def prune_segments(rows: DataFrame, least_rows: int = 3, sure: float = 0.62) -> DataFrame:
    """Without short segments that have no row of much confidence."""
    w = Window.partitionBy("video", "ball_segment")
    return rows.withColumns({"_n": F.count("*").over(w), "_c": F.max("confidence").over(w)}).where(f"_n >= {least_rows} OR _c >= {sure}").drop("_n", "_c")


def fill_path(rows: DataFrame, max_gap: int = 5) -> DataFrame:
    """Straight lines over short gaps of a segment; ball_status tells filled rows."""
    filled = sequences.fill_linear(rows, ["video", "ball_segment"], "frame", ["x_center", "y_center", "confidence"], max_gap)
    return filled.withColumn("ball_status", F.when(F.col("filled"), "Interpolated").otherwise("Detected")).drop("filled")


# teams and tracks


def farthest_pair(x: np.ndarray, block: int = 1 << 20) -> tuple[int, int]:
    """Rows of the two points of greatest squared distance, of several pairs the first in order of rows. Copies count once,
    and only points so far from the middle that they can be in such a pair are compared, in blocks of `block` pairs."""
    finite = bool(np.isfinite(x).all())
    at = np.arange(len(x))
    if finite and len(x) > 2:
        at = np.sort(np.unique(x, axis=0, return_index=True)[1])
        out = np.sqrt(((x[at] - x[at].mean(0)) ** 2).sum(1))
        end = x[at[out.argmax()]]
        for _ in range(3):  # some far pair
            away = np.sqrt(((x[at] - end) ** 2).sum(1))
            least, end = away.max(), x[at[away.argmax()]]
        # 1e-9: more than rounding can be
        at = at[out + out.max() >= least * (1 - 1e-9)] if np.isfinite(least) else at
    best, most, step = (0, 0), -1.0, max(1, block // max(1, len(at)))
    for a in range(0, len(at), step):
        apart = ((x[at[a : a + step], None] - x[None, at]) ** 2).sum(2)
        i, j = np.unravel_index(apart.argmax(), apart.shape)
        if apart[i, j] > most or np.isnan(apart[i, j]):
            best, most = (int(at[a + i]), int(at[j])), apart[i, j]
        if np.isnan(most):
            break
    return best


def two_teams(features: DataFrame) -> DataFrame:
    """features(video, track_id, l, a, b) -> team_id: two clusters of colours from the farthest pair, the lighter one
    is team 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("track_id").reset_index(drop=True)
        x = pdf[["l", "a", "b"]].to_numpy(float)
        centres = x[list(farthest_pair(x))]
        for _ in range(30):
            label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            moved = np.stack([x[label == k].mean(0) if (label == k).any() else centres[k] for k in (0, 1)])
            if np.allclose(moved, centres):
                break
            centres = moved
        lighter = int(centres[:, 0].argmax())
        return pdf[["video", "track_id"]].assign(team_id=np.where(label == lighter, "1", "2"))

    kind = features.schema["video"].dataType.simpleString()
    return sequences.dealt(features, "video").groupBy("video").applyInPandas(run, f"video {kind}, track_id long, team_id string")


def teams_by_place(rows: DataFrame) -> DataFrame:
    """(video, track_id, team_id): the left half of the tracks by median x is team 1."""
    tracks = rows.where("class = 'player' AND track_id >= 0").groupBy("video", "track_id").agg(F.median("x_center").alias("x"))
    w = Window.partitionBy("video")
    ranked = tracks.withColumns({"r": F.row_number().over(w.orderBy("x", "track_id")), "n": F.count("*").over(w)})
    return ranked.select("video", "track_id", F.when(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 2)), "1").otherwise("2").alias("team_id"))


def fallback_tracks(rows: DataFrame, reach: float = 80.0, forget: int = 12) -> DataFrame:
    """Track ids for untracked players: greedy one-to-one matching by distance to tracks seen in the last frames, else
    a new id. (video, row_id, track_id)"""

    def run(group: dict[str, np.ndarray]) -> list[tuple]:
        tracks: dict[int, tuple[int, float, float]] = {}
        fresh, out, video = 100_000, [], group["video"][0]
        video = None if pd.isna(video) else video
        # fresh within a chunk; its number makes ids so within a video
        above = int(group["chunk"][0]) * 1_000_000
        rows_ = zip(*(group[c].tolist() for c in ("frame", "row_id", "x_center", "y_center")), strict=True)
        for frame, now in itertools.groupby(rows_, key=lambda r: r[0]):
            tracks = {t: v for t, v in tracks.items() if frame - v[0] <= forget}
            now = list(now)
            near = ((math.hypot(x - v[1], y - v[2]), n, t) for n, (_, _, x, y) in enumerate(now) for t, v in tracks.items())
            taken: dict[int, int] = {}
            used: set[int] = set()
            for _, n, t in sorted(p for p in near if p[0] <= reach):
                if n not in taken and t not in used:
                    taken[n] = t
                    used.add(t)
            for n, (_, row, x, y) in enumerate(now):
                if n not in taken:
                    taken[n], fresh = fresh, fresh + 1
                tracks[taken[n]] = (frame, x, y)
                out.append((video, row, taken[n] + above))
        return out

    lost = chunked(rows.where("class = 'player' AND track_id < 0"), forget)
    kind = rows.schema["video"].dataType.simpleString()
    slim = lost.select("video", "chunk", "frame", "row_id", "x_center", "y_center")
    return per_group(slim, ["video", "chunk"], ["frame", "row_id"], run, f"video {kind}, row_id long, track_id long")
