"""The state that follows a scoreboard through noisy readings: quarter, clock and score, each with its own memory.

A Board takes one sample at a time, a reading or None, and yields records (time, score, quarter, clock) when a score is
confirmed. Everything it remembers is in small dataclasses, so the same code runs over a video in batch
(board_timeline) and over a stream with the state kept between batches (as_dict, from_dict).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import sequences

#: Fixed values of the rules: samples, seconds, points.
CONFIRM, RESYNC, GONE_AFTER, CUT_AFTER = 2, 3, 3, 10
START_SECONDS, MAX_CLOCK_DROP, MAX_RISE, MAX_SCORE = 5.0, 60, 12, 200
UNKNOWN = "UNKNOWN"
Score = tuple[int, int]


@dataclass
class Reading:
    score: Score
    quarter: int | None = None  # 1 to 4, 5 for overtime
    clock: int | None = None  # seconds left


def odd_pair(score: Score) -> bool:
    """A very low beside a high number is no score."""
    return min(score) <= 4 and max(score) >= 20


def follows(new: Score, old: Score) -> bool:
    """The same score, or one side up by one to three."""
    rise = sorted(n - o for n, o in zip(new, old, strict=True))
    return not odd_pair(new) and rise[0] == 0 and rise[1] <= 3


def misread(new: Score, old: Score) -> Score | None:
    """The score that was meant if one side rose too much and differs in one digit from a possible one."""
    if follows(new, old):
        return None
    for side in (0, 1):
        if new[1 - side] != old[1 - side] or new[side] <= old[side] + 3:
            continue
        for goal in range(old[side] + 1, old[side] + 4):
            a, b = str(new[side]), str(goal)
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 and abs(new[side] - goal) <= 10:
                return (goal, old[1]) if side == 0 else (old[0], goal)
    return None


def resyncs(new: Score, old: Score) -> bool:
    rise = [n - o for n, o in zip(new, old, strict=True)]
    return not follows(new, old) and not odd_pair(new) and min(rise) >= 0 and 0 < max(rise) <= MAX_RISE


@dataclass
class Quarter:
    now: int | None = None
    next: int | None = None
    votes: int = 0

    def read(self, value: int | None, clock: int | None) -> int | None:
        """Only the quarter after this one counts, read twice with a clock near its start."""
        if value is None:
            return self.now
        if self.now is None or value == self.now:
            self.now, self.next, self.votes = value, None, 0
        elif value == self.now + 1 and clock is not None and 540 <= clock <= 720:
            self.votes = self.votes + 1 if self.next == value else 1
            self.next = value
            if self.votes >= 2:
                self.now, self.next, self.votes = value, None, 0
        return self.now


@dataclass
class Clock:
    now: int | None = None
    quarter: int | None = None
    running: bool = True
    missing: int = 0  # samples without a scoreboard in a row
    cut: bool = False  # a lower reading is awaited after a long gap

    def miss(self) -> None:
        """A sample without a scoreboard: a running clock goes on until the board is surely gone."""
        self.missing += 1
        if self.now is None:
            return
        if self.missing >= GONE_AFTER:
            self.running = False
        elif self.running:
            self.now = max(0, self.now - 1)

    def read(self, value: int | None, quarter: int | None) -> None:
        """A sample with a scoreboard, with or without a readable clock."""
        gap, self.missing = self.missing, 0
        if self.now is None:
            if value is not None:
                self.now, self.quarter, self.running, self.cut = value, quarter, True, False
            return
        drop = None if value is None else self.now - value
        before, self.quarter = self.quarter, quarter
        if gap >= CUT_AFTER:  # a cut: one lower reading is believed, else the clock stays where it was
            if drop is not None and 0 < drop <= MAX_CLOCK_DROP:
                self.now = value
            self.running, self.cut = True, False
            return
        if drop is None:
            self.now, self.running = max(0, self.now - 1), True
            return
        turned = quarter is not None and before is not None and quarter != before
        if turned and drop < 0:
            self.now, self.running = value, True
        elif gap and 0 <= drop <= max(2, gap + 2):
            self.now, self.running = value, self.running or drop > 0
        elif drop == 1:
            self.now, self.running = value, True
        elif drop == 0:
            self.running = False
        elif self.running:
            self.now = max(0, self.now - 1)


@dataclass
class Votes:
    """Readings of one score that wait to be confirmed, with the time and context of the first."""

    score: Score | None = None
    n: int = 0
    record: tuple | None = None

    def add(self, score: Score, record: tuple) -> int:
        if self.score != score:
            self.score, self.n, self.record = score, 0, record
        self.n += 1
        return self.n

    def clear(self) -> None:
        self.score, self.n, self.record = None, 0, None


@dataclass
class Board:
    score: Score | None = None
    quarter: Quarter = field(default_factory=Quarter)
    clock: Clock = field(default_factory=Clock)
    valid: Votes = field(default_factory=Votes)
    corrected: Votes = field(default_factory=Votes)
    resync: Votes = field(default_factory=Votes)
    start: list = field(default_factory=list)  # [score, votes, record of the last sample]

    def plausible(self, r: Reading) -> bool:
        if not all(0 <= s <= MAX_SCORE for s in r.score) or odd_pair(r.score) or (r.quarter is None and r.clock is None):
            return False
        return self.score is None or follows(r.score, self.score) or misread(r.score, self.score) is not None or resyncs(r.score, self.score)

    def sample(self, time: float, r: Reading | None) -> list[tuple]:
        """Records that this sample confirms: (time, score 1, score 2, quarter, clock)."""
        if r is None or not self.plausible(r):
            self.clock.miss()
            return []
        cut = self.clock.missing >= CUT_AFTER and self.clock.now is not None
        if cut:  # the quarter is judged by the clock that comes out
            drop = None if r.clock is None else self.clock.now - r.clock
            self.clock.read(r.clock, self.clock.quarter)
            self.clock.quarter = self.quarter.read(r.quarter, r.clock if drop is not None and 0 < drop <= MAX_CLOCK_DROP else self.clock.now)
        else:
            self.clock.read(r.clock, self.quarter.read(r.quarter, r.clock))
        record = (time, *r.score, self.quarter.now, self.clock.now)
        return self._judge(time, r.score, record)

    def _judge(self, time: float, score: Score, record: tuple) -> list[tuple]:
        out = []
        if self.score is None:
            if time < START_SECONDS:
                self._vote_start(score, record)
                return []
            if not self.start:
                self.score = score
                return [record]
            best = max(self.start, key=lambda s: s[1])  # the first of equals
            self.score = tuple(best[0])
            out.append(tuple(best[2]))
            if score == self.score:
                return out
        return out + self._change(score, record)

    def _vote_start(self, score: Score, record: tuple) -> None:
        for entry in self.start:
            if tuple(entry[0]) == score:
                entry[1], entry[2] = entry[1] + 1, record
                return
        self.start.append([score, 1, record])

    def _accept(self, votes: Votes, *cleared: Votes) -> list[tuple]:
        self.score, record = votes.score, votes.record
        for v in (votes, *cleared):
            v.clear()
        return [record]

    def _change(self, score: Score, record: tuple) -> list[tuple]:
        if follows(score, self.score):
            if score == self.score:
                self.valid.clear()
                return []
            if self.corrected.score == score:  # a misreading foretold it
                return self._accept(self.corrected, self.valid, self.resync)
            if self.valid.add(score, record) >= CONFIRM:
                return self._accept(self.valid, self.corrected, self.resync)
            return []
        meant = misread(score, self.score)
        if meant is not None:
            if self.corrected.add(meant, (record[0], *meant, *record[3:])) >= CONFIRM:
                return self._accept(self.corrected, self.valid, self.resync)
            return []
        if resyncs(score, self.score):
            if self.resync.add(score, record) >= RESYNC:
                return self._accept(self.resync)
            return []
        self.resync.clear()
        self.valid.clear()
        return []

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Board:
        pair = lambda v: None if v is None else tuple(v)
        votes = {k: Votes(pair(d[k]["score"]), d[k]["n"], pair(d[k]["record"])) for k in ("valid", "corrected", "resync")}
        return cls(pair(d["score"]), Quarter(**d["quarter"]), Clock(**d["clock"]), **votes, start=[[tuple(s), n, tuple(r)] for s, n, r in d["start"]])


def board_timeline(reads: DataFrame) -> DataFrame:
    """reads(video, time_sec, team1_score, team2_score, quarter, game_clock) as text, null scores where there is no
    scoreboard -> (video, analysis_time, team1_score, team2_score, quarter, game_clock) of confirmed scores. A video
    has one sample a second, so a video is one small group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        board, out = Board(), []
        for r in pdf.sort_values("time_sec").itertuples(index=False):
            none = pd.isna(r.team1_score) or pd.isna(r.team2_score)
            whole = lambda v: None if pd.isna(v) else int(v)
            reading = None if none else Reading((int(r.team1_score), int(r.team2_score)), whole(r.q), whole(r.c))
            out += board.sample(float(r.time_sec), reading)
        return pd.DataFrame([(pdf["video"].iloc[0], *o) for o in out], columns=["video", "time_sec", "team1_score", "team2_score", "q", "c"])

    kind = reads.schema["video"].dataType.simpleString()
    rows = reads.select("video", "time_sec", "team1_score", "team2_score", text.quarter_number(text.quarter_text(F.col("quarter"))).alias("q"), text.clock_seconds(text.clock_text(F.col("game_clock"))).alias("c"))
    got = sequences.dealt(rows, "video").groupBy("video").applyInPandas(run, f"video {kind}, time_sec double, team1_score int, team2_score int, q int, c int")
    quarter = F.when(F.col("q") == 5, "OT").when(F.col("q").isNotNull(), F.concat(F.col("q").cast("string"), F.lit("Q"))).otherwise(UNKNOWN)
    return got.select("video", text.analysis_time(F.col("time_sec")).alias("analysis_time"), "team1_score", "team2_score", quarter.alias("quarter"), F.coalesce(text.seconds_clock(F.col("c")), F.lit(UNKNOWN)).alias("game_clock"))
