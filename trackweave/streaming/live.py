"""Streams of readings and events: score confirmation, ball filtering and counts, with state kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.scoreboard import ScoreState
from ..plans.tracking import BallFilter, follow


def confirm_scores(reads: DataFrame) -> DataFrame:
    """Streaming reads(video string, side int, frame long, observed int) -> (video, side, frame, score)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score = ScoreState(*(None if v is None or v < 0 else v for v in state.get[:2]), state.get[2]) if state.exists else ScoreState()
        out, rows = [], pd.concat(list(batches)).sort_values("frame")
        for frame, value in zip(rows["frame"], rows["observed"], strict=True):
            if score.read(None if pd.isna(value) else int(value)):
                out.append((*key, int(frame), score.confirmed))
        state.update((-1 if score.confirmed is None else score.confirmed, -1 if score.candidate is None else score.candidate, score.count))
        yield pd.DataFrame(out, columns=["video", "side", "frame", "score"])

    return reads.groupBy("video", "side").applyInPandasWithState(run, "video string, side int, frame long, score int", "confirmed int, candidate int, count int", "append", GroupStateTimeout.NoTimeout)


def filter_ball(frames: DataFrame, process: float = 30.0, measurement: float = 12.0, gravity: float = 0.0, max_missing: int = 30) -> DataFrame:
    """Streaming frames(video string, frame long, x_center, y_center, confidence double) -> filtered places."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ball = BallFilter(process, measurement, gravity, max_missing)
        if state.exists:
            place, spread, missing = state.get
            if place:
                ball.now, ball.spread, ball.missing = tuple(map(float, place)), tuple(map(float, spread)), missing
        pdf = pd.concat(list(batches)).sort_values("frame").reset_index(drop=True)
        found = follow(pdf, ball)
        state.update(([] if ball.now is None else list(ball.now), list(ball.spread), ball.missing))
        yield pd.DataFrame({"video": key[0], "frame": pdf["frame"], "x": found["fx"].astype(float), "y": found["fy"].astype(float), "source": found["source"]})

    return frames.groupBy("video").applyInPandasWithState(run, "video string, frame long, x double, y double, source string", "place array<double>, spread array<double>, missing int", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, time: str = "ts", window: str = "30 seconds", late: str = "10 seconds", keys: tuple[str, ...] = ("team_id", "event_type")) -> DataFrame:
    """Counts by window of event time; rows later than `late` behind the newest are dropped with their window's state."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Runs of events of a key with no gap as long as `gap`."""
    s = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(s.alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
