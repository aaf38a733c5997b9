"""Scores from repeated readings: a state that follows one side of a scoreboard, and rules on pairs of scores."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import sequences

#: How often a new score has to be read in a row, and the most it may rise by at once.
CONFIRM, MAX_STEP = 2, 9


@dataclass
class ScoreState:
    confirmed: int | None = None
    candidate: int | None = None
    count: int = 0

    def read(self, value: int | None) -> bool:
        """One reading; True if it confirms a new score."""
        if value is None:
            return False
        if self.confirmed is not None:
            if not self.confirmed <= value <= self.confirmed + MAX_STEP:
                return False
            if value == self.confirmed:
                self.candidate, self.count = None, 0
                return False
        self.count = self.count + 1 if value == self.candidate else 1
        self.candidate = value
        if self.count < CONFIRM:
            return False
        self.confirmed, self.candidate, self.count = value, None, 0
        return True


def confirmed_scores(reads: DataFrame) -> DataFrame:
    """reads(video, side, frame, observed) -> (video, side, frame, score): where a score is confirmed. A side of a video
    has a reading a second, some thousands of rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out, pdf = ScoreState(), [], pdf.sort_values("frame")
        for frame, value in zip(pdf["frame"], pdf["observed"], strict=True):
            if state.read(None if pd.isna(value) else int(value)):
                out.append((pdf["video"].iloc[0], pdf["side"].iloc[0], int(frame), state.confirmed))
        return pd.DataFrame(out, columns=["video", "side", "frame", "score"])

    kinds = {c: reads.schema[c].dataType.simpleString() for c in ("video", "side")}
    return sequences.dealt(reads.select("video", "side", "frame", "observed"), "video", "side").groupBy("video", "side").applyInPandas(run, f"video {kinds['video']}, side {kinds['side']}, frame long, score int")


def timeline(reads: DataFrame) -> DataFrame:
    """(video, frame, team1_score, team2_score) at every change once both sides are known."""
    found = confirmed_scores(reads).groupBy("video", "frame").agg(*(F.max(F.when(F.col("side") == k, F.col("score"))).alias(f"team{k}_score") for k in (1, 2)))
    w = Window.partitionBy("video").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("team1_score", "team2_score")}).where("team1_score IS NOT NULL AND team2_score IS NOT NULL")


def valid_transition(new1: Column, new2: Column, old1: Column, old2: Column) -> Column:
    """Nothing falls, and nothing changes or one side rises by 1, 2 or 3."""
    d1, d2 = new1 - old1, new2 - old2
    return ((d1 == 0) & (d2 == 0)) | ((d1 == 0) & d2.between(1, 3)) | ((d2 == 0) & d1.between(1, 3))


def plausible_resync(new1: Column, new2: Column, old1: Column, old2: Column) -> Column:
    """After missed samples: no side falls or rises by more than 12, and one rises."""
    d1, d2 = new1 - old1, new2 - old2
    return d1.between(0, 12) & d2.between(0, 12) & ((d1 > 0) | (d2 > 0))


def misread_target(read: Column, old: Column) -> Column:
    """The score one to three above the old one that a reading of as many digits differs from in one digit and by at
    most 10, else null."""
    text = read.cast("string")

    def fits(step: Column) -> Column:
        goal = (old + step).cast("string")
        wrong = F.size(F.filter(F.zip_with(F.split(text, ""), F.split(goal, ""), lambda a, b: a != b), lambda x: x))
        return (F.length(text) == F.length(goal)) & (wrong == 1) & (F.abs(read - (old + step)) <= 10)

    return old + F.try_element_at(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), fits), F.lit(1))


def majority_start(reads: DataFrame, seconds: float = 5.0) -> DataFrame:
    """(video, team1_score, team2_score): the pair read most often in the first seconds, the first seen of equals."""
    votes = reads.where((F.col("time_sec") <= seconds) & F.col("team1_score").isNotNull() & F.col("team2_score").isNotNull()).groupBy("video", "team1_score", "team2_score").agg(F.count("*").alias("n"), F.min("time_sec").alias("t"))
    return votes.groupBy("video").agg(F.max_by(F.struct("team1_score", "team2_score"), F.struct("n", -F.col("t"))).alias("s")).select("video", "s.*")


def score_changes(timeline_: DataFrame) -> DataFrame:
    """(video, time_sec, team1_score, team2_score) of each change of the score: rows that are no valid transition from
    the last row accepted are passed over. The first row of a video is where it starts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out, pdf = None, [], pdf.sort_values("time_sec")
        for t, a, b in zip(pdf["time_sec"], pdf["team1_score"], pdf["team2_score"], strict=True):
            rises = (0, 0) if last is None else (a - last[0], b - last[1])
            if last is not None and min(rises) == 0 and 1 <= max(rises) <= 3:
                out.append((pdf["video"].iloc[0], float(t), int(a), int(b)))
                last = (a, b)
            last = last or (a, b)
        return pd.DataFrame(out, columns=["video", "time_sec", "team1_score", "team2_score"])

    kind = timeline_.schema["video"].dataType.simpleString()
    return sequences.dealt(timeline_.select("video", "time_sec", "team1_score", "team2_score"), "video").groupBy("video").applyInPandas(run, f"video {kind}, time_sec double, team1_score int, team2_score int")
