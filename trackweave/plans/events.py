"""Game events from cleaned tracking rows: possession, shots, passes, steals, rebounds, contact, and their summaries.

Rows have video, frame, row_id (ingest order), class, confidence, track_id, x1, y1, x2, y2, team_id, team_name. Every
step is an equi-join on (video, frame), a window by video, or a range join on buckets; greedy rules ("not within s
seconds of the last accepted one") are decided inside runs of close events. Thresholds that depend on frames per second
are whole numbers computed here, with the rounding of Python, and enter the plans as constants.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text
from ..operators import asof, ranges, sequences
from ..sources.tables import written

#: Event types in the order of reports, and their Korean labels.
EVENT_ORDER = ["shot_attempt", "shot_made", "shot_missed", "pass", "steal_or_block", "foul", "rebound"]
LABELS_KO = {"shot_attempt": "슛시도", "shot_made": "슛성공", "shot_missed": "슛실패", "pass": "패스", "steal_or_block": "스틸/블락", "foul": "파울", "rebound": "리바운드"}
UNSAFE_STATUS = "removed|warning_large|warning_low|rim|edge|contextless"
PLAYERS, BALLS, HOOPS = ("player", "person"), ("ball", "sports ball", "basketball", "frisbee"), ("hoop", "rim", "basket", "basketball hoop")


@dataclass(frozen=True)
class Profile:
    """Frames per second and picture size, and the limits that follow."""

    fps: float = 30.0
    width: int = 1280
    height: int = 720

    @property
    def scale(self) -> float:
        return max(0.75, min(1.6, max(self.width, self.height) / 1280.0))

    def frames(self, seconds: float, least: int) -> int:
        return max(least, round((self.fps if self.fps > 0 else 30.0) * seconds))


def _box(prefix: str = "") -> g.Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def _centre(box: g.Box) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def safe_rows(rows: DataFrame) -> DataFrame:
    """Without balls whose cleaning marked them unreliable or that were predicted with little confidence."""
    ball = F.lower("class").isin(*BALLS)
    bad = F.lit(False)
    if "is_reliable" in rows.columns:
        bad = bad | ~F.coalesce(F.col("is_reliable").cast("boolean"), F.lit(True))
    if "reliability_reason" in rows.columns:
        bad = bad | F.lower(F.coalesce("reliability_reason", F.lit(""))).rlike(UNSAFE_STATUS)
    if "ball_status" in rows.columns:
        bad = bad | ((F.col("ball_status") == "Predicted") & (F.coalesce("confidence", F.lit(0.0)) < 0.10))
    return rows.where(~(ball & bad))


def best_of(rows: DataFrame, classes: tuple[str, ...], name: str) -> DataFrame:
    """(video, frame, name): the most confident row of a frame as a struct, the first of equals."""
    best = F.max_by(F.struct("x1", "y1", "x2", "y2"), F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("row_id")))
    return rows.where(F.lower("class").isin(*classes)).groupBy("video", "frame").agg(best.alias(name))


def player_rows(rows: DataFrame) -> DataFrame:
    p = rows.where(F.lower("class").isin(*PLAYERS))
    return p.withColumns({"team_id": text.clean_team_id(F.col("team_id")), "team_name": text.clean_text(F.col("team_name"))})


def possessions(rows: DataFrame, profile: Profile) -> DataFrame:
    """(video, frame, player, team_id, team_name): the player nearest to the ball within reach of the box."""
    s = profile.scale
    near = player_rows(rows).join(best_of(rows, BALLS, "ball"), ["video", "frame"])
    x, y = _centre(tuple(F.col(f"ball.{c}") for c in ("x1", "y1", "x2", "y2")))
    reach = F.greatest(F.lit(55.0 * s), F.least(F.lit(150.0 * s), F.abs(F.col("y2") - F.col("y1")) * 0.32 + F.abs(F.col("x2") - F.col("x1")) * 0.22))
    near = near.withColumn("gap", g.box_distance(x, y, _box())).where(F.col("gap") <= reach)
    best = F.min_by(F.struct(F.col("track_id").alias("player"), "team_id", "team_name"), F.struct("gap", "row_id"))
    return near.groupBy("video", "frame").agg(best.alias("b")).select("video", "frame", "b.*").where(F.col("player").isNotNull())


def segments(held: DataFrame, profile: Profile) -> DataFrame:
    """(video, start_frame, end_frame, player, team_id, team_name, n): runs of one player without long gaps."""
    w = Window.partitionBy("video").orderBy("frame")
    turn = (F.lag("player").over(w) != F.col("player")) | (F.col("frame") - F.lag("frame").over(w) > profile.frames(0.35, 2))
    runs = sequences.islands(held, ["video"], ["frame"], turn, "run")
    known = F.col("team_id") != ""
    team = F.min_by(F.when(known, F.struct("team_id", "team_name")), F.when(known, F.col("frame")))
    out = runs.groupBy("video", "run").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.first("player").alias("player"), team.alias("team"), F.count("*").alias("n"))
    out = out.where(F.col("n") >= profile.frames(0.06, 1))
    return out.select("video", "start_frame", "end_frame", "player", F.coalesce("team.team_id", F.lit("")).alias("team_id"), F.coalesce("team.team_name", F.lit("")).alias("team_name"), "n")


def possession_stats(held: DataFrame, profile: Profile) -> DataFrame:
    """Frames, seconds and share of the frames whose possessor has a team."""
    per = held.where("team_id <> ''").groupBy("video", "team_id").agg(F.count("*").alias("possession_frame_count"), F.min_by("team_name", "frame").alias("team_name"))
    total = F.sum("possession_frame_count").over(Window.partitionBy("video"))
    return per.select("video", "team_id", F.when(F.col("team_name") == "", F.concat(F.lit("team_"), "team_id")).otherwise(F.col("team_name")).alias("team_name"), "possession_frame_count", F.bround(F.col("possession_frame_count") / profile.fps, 3).alias("possession_time_sec"), F.bround(100.0 * F.col("possession_frame_count") / total, 2).alias("possession_pct"))


def shots(rows: DataFrame, segs: DataFrame, profile: Profile) -> DataFrame:
    """(video, start_frame, end_frame, event_frame, min_distance, confidence, made, player, team_id, team_name)."""
    s = profile.scale
    both = best_of(rows, BALLS, "ball").join(best_of(rows, HOOPS, "hoop"), ["video", "frame"])
    box = lambda n: tuple(F.col(f"{n}.{c}") for c in ("x1", "y1", "x2", "y2"))
    (bx, by), (hx, hy) = _centre(box("ball")), _centre(box("hoop"))
    w, h = F.abs(F.col("hoop.x2") - F.col("hoop.x1")), F.abs(F.col("hoop.y2") - F.col("hoop.y1"))
    radius = F.greatest(F.lit(75.0 * s), F.least(F.lit(230.0 * s), F.greatest(F.coalesce(w, F.lit(60.0 * s)) * 1.8, F.coalesce(h, F.lit(40.0 * s)) * 2.4)))
    wide, tall = F.greatest(F.lit(8.0), w), F.greatest(F.lit(8.0), h)
    in_zone = bx.between(F.col("hoop.x1") - wide * 0.45, F.col("hoop.x2") + wide * 0.45) & by.between(F.col("hoop.y1") - tall * 0.35, F.col("hoop.y2") + tall * 1.45)
    both = both.select("video", "frame", F.hypot(bx - hx, by - hy).alias("d"), radius.alias("radius"), (in_zone & (by >= hy)).alias("scores"))
    near = sequences.gap_islands(both.where("d <= radius"), ["video"], "frame", "frame", profile.frames(0.55, 3), "cluster")
    found = near.groupBy("video", "cluster").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.min_by("frame", F.struct("d", "frame")).alias("event_frame"), F.min("d").alias("min_distance"), F.count("*").alias("n"))
    found = sequences.greedy_suppress(found, ["video"], "event_frame", "cluster", profile.frames(1.2, 10))
    bonus = F.least(F.lit(0.18), F.col("n") * 0.015) + F.greatest(F.lit(0.0), F.least(F.lit(0.22), (90.0 - F.col("min_distance")) / 260.0))
    found = found.withColumn("confidence", F.bround(g.clip(0.42 + bonus, 0.32, 0.82), 3))
    span = found.select("video", "cluster", F.col("start_frame").alias("low"), (F.col("end_frame") + profile.frames(0.75, 3)).alias("high"))
    hits = ranges.range_join(both.where("scores").select("video", "frame"), span, ["video"], "frame", F.col("low"), F.col("high"), 64.0)
    made = hits.select("video", "cluster").distinct().withColumn("made", F.lit(True))
    found = found.join(made, ["video", "cluster"], "left").withColumn("made", F.coalesce("made", F.lit(False)))
    take = {"player": "player", "team_id": "team_id", "team_name": "team_name"}
    found = asof.asof_join(found, segs.select("video", F.col("end_frame").alias("seg_end"), *take), ["video"], "event_frame", "seg_end", take, tolerance=profile.frames(4.0, 12))
    return found.drop("cluster", "n").withColumns({c: F.coalesce(c, F.lit("")) for c in ("team_id", "team_name")})


def _event(kind: Column | str, frame: str, profile: Profile, player: Column, second: Column | None, confidence: Column, details: Column) -> list[Column]:
    return [
        F.col("video"), (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), F.col(frame).cast("long").alias("frame"), F.bround(F.col(frame) / profile.fps, 3).alias("time_sec"), F.col("team_id"), F.col("team_name"),
        F.coalesce(player.cast("string"), F.lit("")).alias("player_track_id"), (F.lit("") if second is None else F.coalesce(second.cast("string"), F.lit(""))).alias("secondary_track_id"),
        F.bround(confidence, 3).alias("confidence"), details.alias("details"),
    ]


def shot_events(found: DataFrame, profile: Profile) -> DataFrame:
    tries = found.select(*_event("shot_attempt", "event_frame", profile, F.col("player"), None, F.col("confidence"), F.concat(F.lit("near_rim_distance_px="), F.format_string("%.1f", "min_distance"))))
    kind = F.when(F.col("made"), "shot_made").otherwise("shot_missed")
    detail = F.when(F.col("made"), "ball_crossed_rim_zone").otherwise("near_rim_no_make_detected")
    return tries.unionByName(found.select(*_event(kind, "event_frame", profile, F.col("player"), None, F.greatest(F.lit(0.25), F.col("confidence") - 0.12), detail)))


def transitions(segs: DataFrame) -> DataFrame:
    """Each segment with the one before it: columns of the later one, prev_*, and the gap in frames."""
    before = F.lag(F.struct("end_frame", "player", "team_id")).over(Window.partitionBy("video").orderBy("start_frame"))
    t = segs.withColumn("prev", before).where(F.col("prev").isNotNull())
    return t.select("video", F.col("start_frame").alias("frame"), "player", "team_id", "team_name", F.col("prev.player").alias("prev_player"), F.col("prev.team_id").alias("prev_team"), (F.col("start_frame") - F.col("prev.end_frame")).alias("gap"))


def pass_events(segs: DataFrame, found: DataFrame, profile: Profile) -> DataFrame:
    t = transitions(segs).where((F.col("player") != F.col("prev_player")) & F.col("gap").between(0, profile.frames(3.0, 6)) & (F.col("team_id") != "") & (F.col("prev_team") != ""))
    made = found.where("made").select("video", "event_frame", "end_frame")
    t = ranges.range_join(t, made, ["video"], "frame", F.col("event_frame"), F.col("end_frame") + profile.frames(2.5, 5), 128.0, "left_anti")
    missed = found.where("NOT made").select("video", "start_frame", "end_frame")
    m = profile.frames(2.0, 5)
    near = ranges.range_join(t, missed, ["video"], "frame", F.col("start_frame") - m, F.col("end_frame") + m, 128.0, "left_semi")
    t = t.join(near.select("video", "frame").distinct().withColumn("missed", F.lit(True)), ["video", "frame"], "left")
    same = F.col("team_id") == F.col("prev_team")
    reason = F.when(same, "possession_changed_same_team").when(F.col("missed"), "opponent_possession_after_missed_shot_or_block").otherwise("possession_changed_opponent_team")
    detail = F.concat(reason, F.lit(";gap_frames="), F.col("gap").cast("string"))
    return t.select(*_event(F.when(same, "pass").otherwise("steal_or_block"), "frame", profile, F.col("player"), F.col("prev_player"), F.when(same, 0.58).otherwise(0.52), detail))


def rebound_events(segs: DataFrame, found: DataFrame, profile: Profile) -> DataFrame:
    missed = found.where("NOT made").select("video", "event_frame", F.col("end_frame").alias("shot_end"), F.col("team_id").alias("shooter_team"))
    take = {"start_frame": "frame", "player": "player", "team_id": "team_id", "team_name": "team_name"}
    got = asof.asof_join(missed, segs, ["video"], "shot_end", "start_frame", take, direction="forward", tolerance=profile.frames(5.0, 8)).where(F.col("frame").isNotNull())
    side = F.when((F.col("shooter_team") != "") & (F.col("team_id") == F.col("shooter_team")), "offensive").otherwise("defensive")
    return got.select(*_event("rebound", "frame", profile, F.col("player"), None, F.lit(0.5), F.concat(side, F.lit("_rebound_after_missed_shot_frame="), F.col("event_frame").cast("string"))))


def contact_pairs(rows: DataFrame, profile: Profile) -> DataFrame:
    """(video, frame, pair): the first pair of opponents in contact near the ball in a frame, in ingest order."""
    s = profile.scale
    p = player_rows(rows).where("team_id <> ''").select("video", "frame", "row_id", "track_id", "team_id", "x1", "y1", "x2", "y2")
    left, right = (p.select("video", "frame", *(F.col(c).alias(f"{n}_{c}") for c in p.columns[2:])) for n in ("l", "r"))
    pairs = left.join(right, ["video", "frame"]).where("l_row_id < r_row_id AND l_team_id <> r_team_id").join(best_of(rows, BALLS, "ball"), ["video", "frame"])
    a, b = _box("l_"), _box("r_")
    (ax, ay), (bx, by) = _centre(a), _centre(b)
    x, y = _centre(tuple(F.col(f"ball.{c}") for c in ("x1", "y1", "x2", "y2")))
    close = (F.hypot(ax - bx, ay - by) <= 85.0 * s) | (g.iou(a, b) >= 0.04)
    at_ball = F.least(g.box_distance(x, y, a), g.box_distance(x, y, b)) <= 130.0 * s
    pair = F.struct(F.col("l_track_id").alias("first"), F.col("r_track_id").alias("second"))
    return pairs.where(close & at_ball).groupBy("video", "frame").agg(F.min_by(pair, F.struct("l_row_id", "r_row_id")).alias("pair"))


def foul_events(rows: DataFrame, segs: DataFrame, found: DataFrame, profile: Profile) -> DataFrame:
    t = transitions(segs).where("team_id <> '' AND prev_team <> '' AND team_id <> prev_team").select("video", "frame", "team_id", "team_name")
    m, r = profile.frames(0.7, 4), profile.frames(0.35, 2)
    t = ranges.range_join(t, found.select("video", "start_frame", "end_frame"), ["video"], "frame", F.col("start_frame") - m, F.col("end_frame") + m, 128.0, "left_anti")
    near = t.withColumn("near", F.explode(F.sequence(F.col("frame") - r, F.col("frame") + r)))
    hit = near.join(contact_pairs(rows, profile).withColumnRenamed("frame", "near"), ["video", "near"])
    hit = hit.groupBy("video", "frame", "team_id", "team_name").agg(F.min_by("pair", "near").alias("pair"))
    hit = hit.where("pair.first IS NOT NULL AND pair.second IS NOT NULL")  # a pair without ids ends the search
    kept = sequences.greedy_suppress(hit, ["video"], "frame", "team_id", profile.frames(2.5, 10))
    return kept.select(*_event("foul", "frame", profile, F.col("pair.first"), F.col("pair.second"), F.lit(0.28), F.lit("heuristic_contact_near_ball_during_opponent_possession_change")))


def measure(rows: DataFrame, profile: Profile) -> dict[str, DataFrame]:
    """events, segments, shots, possessions and stats of all videos, and the rows themselves, for the reports."""
    # each is read by several later steps: written once to the shared folder, which also keeps the later plans small
    given = written(rows)
    rows = safe_rows(given)
    held = written(possessions(rows, profile))
    segs = written(segments(held, profile))
    found = written(shots(rows, segs, profile))
    parts = [shot_events(found, profile), pass_events(segs, found, profile), rebound_events(segs, found, profile), foul_events(rows, segs, found, profile)]
    events = reduce(DataFrame.unionByName, parts)
    labels = F.create_map(*(F.lit(v) for kv in LABELS_KO.items() for v in kv))
    order = F.create_map(*(F.lit(v) for i, n in enumerate(EVENT_ORDER) for v in (n, i)))
    events = events.withColumns({"row_type": F.lit("event"), "event_label_ko": labels[F.col("event_type")], "_kind": order[F.col("event_type")]})
    w = Window.partitionBy("video").orderBy("frame", "_kind", "player_track_id", "secondary_track_id", "details")
    events = events.withColumn("event_id", F.format_string("E%05d", F.row_number().over(w))).drop("_kind")
    events = written(events)
    return {"rows": given, "events": events, "segments": segs, "shots": found, "possessions": held, "stats": possession_stats(held, profile)}


def _counts() -> dict[str, Column]:
    return {f"{n}_count": F.count_if(F.col("event_type") == n) for n in EVENT_ORDER}


def _rates(df: DataFrame) -> DataFrame:
    tries = F.col("shot_attempt_count")
    return df.withColumns({"shot_success_rate_pct": F.when(tries > 0, F.bround(100.0 * F.col("shot_made_count") / F.nullif(tries, F.lit(0)), 2)).otherwise(0.0), "count": reduce(lambda a, b: a + b, (F.col(f"{n}_count") for n in EVENT_ORDER))})


def team_keys(rows: DataFrame, events: DataFrame, stats: DataFrame) -> DataFrame:
    """(video, team_id, team_name) of teams known from players, events or possession, in that order of names."""
    # players have a row in each frame, but few names
    players = player_rows(rows.select("video", "class", "team_id", "team_name").distinct())
    parts = [players.select("video", "team_id", "team_name", F.lit(0).alias("k")), events.select("video", "team_id", "team_name", F.lit(1).alias("k")), stats.select("video", "team_id", "team_name", F.lit(2).alias("k"))]
    every = reduce(DataFrame.unionByName, parts).where("team_id <> ''")
    per = every.groupBy("video", "team_id").agg(F.min_by("team_name", F.struct("k", "team_name")).alias("team_name"))
    return per.withColumn("team_name", F.when(F.coalesce("team_name", F.lit("")) == "", F.concat(F.lit("team_"), "team_id")).otherwise(F.col("team_name")))


def summary(rows: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """Totals and team totals with possession, counts by type, and by team and type, in one table with row_type."""
    events, stats = found["events"], found["stats"]
    teams = team_keys(rows, events, stats)
    videos = rows.select("video").distinct()
    held = stats.groupBy("video").agg(F.sum("possession_frame_count").alias("possession_frame_count"), F.bround(F.sum("possession_time_sec"), 3).alias("possession_time_sec"))
    total = videos.join(events.groupBy("video").agg(*(c.alias(n) for n, c in _counts().items())), "video", "left").join(held, "video", "left")
    zero = {f"{n}_count": 0 for n in EVENT_ORDER} | {"possession_frame_count": 0, "possession_time_sec": 0.0}
    total = _rates(total.na.fill(zero)).withColumns({"row_type": F.lit("total_summary"), "event_type": F.lit("all_totals"), "event_label_ko": F.lit("전체종합"), "team_id": F.lit("all"), "team_name": F.lit("all"), "possession_pct": F.when(F.col("possession_frame_count") > 0, 100.0).otherwise(0.0), "details": F.lit("wide_team_event_totals")})
    per = teams.join(events.groupBy("video", "team_id").agg(*(c.alias(n) for n, c in _counts().items())), ["video", "team_id"], "left").join(stats.drop("team_name"), ["video", "team_id"], "left")
    per = _rates(per.na.fill(zero | {"possession_pct": 0.0})).withColumns({"row_type": F.lit("team_summary"), "event_type": F.lit("team_totals"), "event_label_ko": F.lit("팀별종합"), "details": F.lit("wide_team_event_totals")})
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("event_type"), F.lit(LABELS_KO[n]).alias("event_label_ko")) for n in EVENT_ORDER)))
    sets = events.groupingSets([[F.col("video"), F.col("event_type")], [F.col("video"), F.col("event_type"), F.col("team_id")]], F.col("video"), F.col("event_type"), F.col("team_id")).agg(F.count("*").alias("n"), F.grouping("team_id").alias("all_teams"))
    by_type = videos.withColumn("k", kinds).select("video", "k.*").join(sets.where("all_teams = 1").select("video", "event_type", F.col("n").alias("count")), ["video", "event_type"], "left")
    by_type = by_type.withColumns({"row_type": F.lit("event_summary"), "team_id": F.lit("all"), "team_name": F.lit("all"), "details": F.lit("total_count"), "count": F.coalesce("count", F.lit(0))})
    seen = events.where("team_id <> ''").select("video", "team_id", "team_name").distinct()
    by_team = seen.withColumn("k", kinds).select("video", "team_id", "team_name", "k.*").join(sets.where("all_teams = 0").select("video", "event_type", "team_id", F.col("n").alias("count")), ["video", "event_type", "team_id"], "left")
    by_team = by_team.withColumns({"row_type": F.lit("team_event_summary"), "details": F.lit("team_count"), "count": F.coalesce("count", F.lit(0))})
    note = videos.withColumns({"row_type": F.lit("note"), "event_type": F.lit("measurement_note"), "event_label_ko": F.lit("측정메모"), "details": F.lit("객체 박스와 공 궤적 기반 추정값.")})
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [total, per, by_type, by_team, note, events])


def snapshot_ticks(last: Column, profile: Profile, interval: float = 30.0) -> Column:
    """array<struct<frame, time_sec>>: the ticks of a video up to its last frame and, if it is long enough after the last
    tick, its end."""
    interval, last = max(1.0, interval), F.greatest(last, F.lit(0)).cast("long")
    length = (last + 1) / profile.fps
    n = F.greatest(F.ceil((length - 1e-6) / interval) - 1, F.lit(0)).cast("long")
    tick = lambda frame, time: F.struct(frame.cast("long").alias("frame"), time.cast("double").alias("time_sec"))
    at = lambda k: tick(F.greatest(F.least(last, F.bround(k * interval * profile.fps).cast("long") - 1), F.lit(0)), F.bround(k * interval, 3))
    ticks = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), n), lambda k: k > 0), at)
    end, final = F.bround(length, 3), F.try_element_at(ticks, F.lit(-1))
    late = final.isNull() | ((final["frame"] != last) & (end - final["time_sec"] >= min(1.0, interval * 0.25)))
    return F.when(late, F.concat(ticks, F.array(tick(last, end)))).otherwise(ticks)


def cumulative(rows: DataFrame, found: dict[str, DataFrame], profile: Profile, interval: float = 30.0) -> DataFrame:
    """Team totals since the start at every tick: events and possession frames are counted by tick first, then summed
    up in order. Two teams a video, 1 and 2 where fewer are known."""
    events, held = found["events"], found["possessions"]
    last = rows.groupBy("video").agg(F.max("frame").cast("int").alias("last"))
    ticks = last.select("video", F.posexplode(snapshot_ticks(F.col("last"), profile, interval)).alias("i", "tick")).select("video", "i", "tick.*")
    keys = team_keys(rows, events, found["stats"]).select("video", "team_id", "team_name")
    default = last.select("video", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("team_id")).withColumn("team_name", F.concat(F.lit("team_"), "team_id"))
    keys = keys.unionByName(default.join(keys, ["video", "team_id"], "left_anti"))
    order = [F.coalesce(F.col("team_id").try_cast("double").cast("int"), F.lit(999999)), F.col("team_id")]
    keys = sequences.top_k(keys, ["video"], order, 2)
    marks = events.select("video", "team_id", "frame", "event_type", F.lit(0).alias("held")).unionByName(held.where("team_id <> ''").select("video", "team_id", "frame", F.lit(None).cast("string").alias("event_type"), F.lit(1).alias("held")))
    bounds = ticks.select("video", "i", F.coalesce(F.lag("frame").over(Window.partitionBy("video").orderBy("i")) + 1, F.lit(0)).alias("low"), F.col("frame").alias("high"))
    put = ranges.range_join(marks, bounds, ["video"], "frame", F.col("low"), F.col("high"), interval * profile.fps)
    per = put.groupBy("video", "team_id", "i").agg(*(c.alias(n) for n, c in _counts().items()), F.sum("held").alias("possession_frame_count"))
    names = [*(f"{n}_count" for n in EVENT_ORDER), "possession_frame_count"]
    # shares need the frames of all teams, also of those that are not shown
    everyone = per.groupBy("video", "i").agg(F.sum("possession_frame_count").alias("all_frames"))
    grid = ticks.join(keys, "video").join(per, ["video", "team_id", "i"], "left").join(everyone, ["video", "i"], "left").na.fill(0)
    w = Window.partitionBy("video", "team_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumns({n: F.sum(n).over(w) for n in [*names, "all_frames"]})
    out = _rates(grid).withColumns({"row_type": F.lit("cumulative_30s_team"), "event_type": F.lit("team_cumulative_totals"), "possession_time_sec": F.bround(F.col("possession_frame_count") / profile.fps, 3), "possession_pct": F.when(F.col("all_frames") > 0, F.bround(100.0 * F.col("possession_frame_count") / F.nullif("all_frames", F.lit(0)), 2)).otherwise(0.0), "details": F.concat(F.lit(f"cumulative_from_start_interval_{interval:g}s_snapshot_"), (F.col("i") + 1).cast("string"))})
    return out.drop("all_frames", "i")
