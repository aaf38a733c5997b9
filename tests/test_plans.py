"""Hand-made cases for the plans: events, filters, gates, readings, sources and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import geometry, text
from trackweave.operators import sequences
from trackweave.plans import events, play_by_play, possession, scoreboard, tracking
from trackweave.sources import tables
from trackweave.streaming import live

PROFILE = events.Profile(30.0, 1280, 720)
COLUMNS = "video string, frame long, row_id long, class string, confidence double, track_id long, x1 double, y1 double, x2 double, y2 double, team_id string, team_name string"


def make_rows():
    """A pass from 1 to 2 of team 1, a steal by 3 of team 2 in contact, a miss, a rebound, and a made shot."""
    rows = []

    def add(frame, kind, track, x, y, w, h, team=""):
        rows.append(("v", frame, len(rows), kind, 0.9, track, x - w / 2, y - h / 2, x + w / 2, y + h / 2, team, f"team_{team}" if team else ""))

    place = {1: (100, 400), 2: (400, 400), 3: (700, 400)}
    for frame in range(0, 240):
        holder = 1 if frame < 30 else 2 if frame < 60 else 3
        x, y = place[holder]
        if 120 <= frame < 130 or 200 <= frame < 210:  # near the rim, at first above it only
            x, y = (1000, 60) if frame < 150 else (1000, 115)
        elif frame >= 130 and frame < 200:
            x, y = place[1]
        add(frame, "ball", 0, x, y, 18, 18)
        add(frame, "hoop", -1, 1000, 100, 60, 40)
        for track, team in ((1, "1"), (2, "1"), (3, "2")):
            px, py = place[track]
            if track == 2 and 55 <= frame <= 65:
                px = 650  # contact
            add(frame, "player", track, px, py, 50, 120, team)
    return rows


def test_events_of_a_made_up_game(spark):
    found = events.measure(spark.createDataFrame(make_rows(), COLUMNS), PROFILE)
    got = [(r.event_type, r.frame, r.player_track_id, r.secondary_track_id) for r in found["events"].orderBy("event_id").collect()]
    assert ("pass", 30, "2", "1") in got
    assert ("shot_attempt", 120, "3", "") in got and ("shot_missed", 120, "3", "") in got
    assert ("rebound", 130, "1", "") in got
    assert ("shot_made", 200, "1", "") in got
    steals = [g for g in got if g[0] == "steal_or_block"]
    assert steals and steals[0][2] == "3"
    assert any(g[0] == "foul" for g in got)
    ids = [r.event_id for r in found["events"].orderBy("event_id").collect()]
    assert ids == [f"E{k:05d}" for k in range(1, len(ids) + 1)]


def test_snapshot_ticks(spark):
    rows = spark.createDataFrame([(1799,), (1801,), (100,), (0,), (1900,)], "last int").select("last", events.snapshot_ticks(F.col("last"), PROFILE).alias("t")).collect()
    got = {r["last"]: [tuple(t) for t in r.t] for r in rows}
    assert got == {1799: [(899, 30.0), (1799, 60.0)], 1801: [(899, 30.0), (1799, 60.0)], 100: [(100, 3.367)], 0: [(0, 0.033)], 1900: [(899, 30.0), (1799, 60.0), (1900, 63.367)]}


def test_possession_ties_and_missing_rows(spark):
    rows = [("v", 0, 0, "ball", -1, 50.0, 50.0), ("v", 0, 1, "player", 7, 60.0, 50.0), ("v", 0, 2, "player", 5, 40.0, 50.0), ("v", 1, 3, "ball", -1, 0.0, 0.0), ("v", 2, 4, "player", 5, 0.0, 0.0), ("v", 3, 5, "ball", -1, 0.0, 0.0), ("v", 3, 6, "player", 5, 3.0, 4.0)]
    d = spark.createDataFrame(rows, "video string, frame long, row_id long, class string, track_id long, x_center double, y_center double")
    owned = possession.owners(d)
    assert [(r.frame, r.owner_track_id, r.distance) for r in owned.orderBy("frame").collect()] == [(0, 7, 10.0), (3, 5, 5.0)]
    assert [tuple(r)[1:] for r in possession.owner_changes(owned).collect()] == [(3, 7, 5)]


def test_filter_follows_and_gives_up():
    ball = tracking.BallFilter(max_missing=3)
    for k in range(20):
        ball.see(10.0 * k, 5.0, 0.9)
    assert abs(ball.state[2] - 10) < 1
    assert [ball.advance() for _ in range(4)] == [True, True, True, False]
    ball.see(1.0, 2.0, None)
    assert ball.state.tolist() == [1.0, 2.0, 0.0, 0.0]


def test_beam_follows_the_smooth_path():
    import numpy as np

    from trackweave.plans import association

    t = np.repeat(np.arange(10), 2)
    x = np.where(np.arange(20) % 2 == 0, 30.0 * t, 900.0 - 300 * (t % 2))
    found = association.best_path(t, x, np.where(np.arange(20) % 2 == 0, 5.0 * t, 500.0), np.full(20, 0.5), np.full(20, 2.0))
    assert [i for i, _ in found] == list(range(0, 20, 2)) and {s for _, s in found} == {0}
    # too far to link: after some frames the path starts anew in another segment
    t = np.array([0, 1, 2, 12, 13])
    found = association.best_path(t, np.array([0.0, 10, 20, 1500, 1510]), np.zeros(5), np.full(5, 0.5), np.full(5, 2.0))
    assert found == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]
    assert association.best_path(t[:0], t[:0], t[:0], t[:0], t[:0]) == []


def test_score_state():
    state = scoreboard.ScoreState()
    reads = [2, 2, 2, None, 14, 14, 1, 4, 5, 5, 5, 7, 5, 7, 7]
    assert [k for k, v in enumerate(reads) if state.read(v)] == [1, 9, 14]
    assert state.confirmed == 7


def test_misread_target(spark):
    rows = spark.createDataFrame([(58, 50), (57, 50), (62, 50), (152, 50), (51, 50)], "read int, old int")
    assert [r[0] for r in rows.select(scoreboard.misread_target(F.col("read"), F.col("old"))).collect()] == [51, 51, 52, None, 52]


def test_jump_gate_compares_with_kept_rows():
    import numpy as np

    from trackweave.plans import refiner

    keep = refiner.jump_gate(np.arange(5), np.array([0.0, 50, 500, 550, 90]), np.zeros(5), 100.0, 6)
    assert keep.tolist() == [True, True, False, False, True]


def test_balls_of_a_frame_are_merged(spark):
    from trackweave.plans import candidates

    boxes = [(0, 0.9, 0.0, ["a"]), (1, 0.8, 8.0, ["b"]), (2, 0.7, 300.0, ["a"])]
    rows = spark.createDataFrame([("v", 0, i, "ball", c, x + 8, 8.0, x, 0.0, x + 16, 16.0, 1, 0.0, m) for i, c, x, m in boxes], "video string, frame long, row_id long, class string, confidence double, x_center double, y_center double, x1 double, y1 double, x2 double, y2 double, agreement int, bonus double, sources array<string>")
    got = candidates.ball_candidates(rows, candidates.Picture(1280, 720)).orderBy("row_id").collect()
    assert [(r.row_id, r.confidence, r.agreement, r.sources) for r in got] == [(0, 0.94, 2, ["a", "b"]), (2, 0.7, 1, ["a"])]


def test_greedy_suppress_keeps_at_the_cooldown(spark):
    rows = spark.createDataFrame([("a", k, float(t)) for k, t in enumerate([0, 5, 10, 14, 20, 21])], "g string, i long, t double")
    assert sorted(r.i for r in sequences.greedy_suppress(rows, ["g"], "t", "i", 10.0).collect()) == [0, 2, 4]


def test_csv_with_mark_and_leading_zeros(spark, tmp_path):
    (tmp_path / "pbp1.csv").write_text("﻿gameid, season,period,clock,h_pts\n0021,2020,1,PT11M38.00S,nan\n0022,2020,x,PT45.5S,7\n", encoding="utf-8")
    df = tables.read_csv(spark, str(tmp_path / "pbp*.csv"), tables.PLAY_BY_PLAY).orderBy("gameid")
    assert [(r.gameid, r.season, r.period, r.h_pts, r.team) for r in df.collect()] == [("0021", "2020", 1, None, None), ("0022", "2020", None, 7.0, None)]
    with pytest.raises(ValueError):
        tables.require_columns(df, ["nothing"])
    assert tables.cached_concat(spark, str(tmp_path / "pbp*.csv"), str(tmp_path / "cache"), tables.PLAY_BY_PLAY).count() == 2


def test_boxes_are_filled_by_class(spark):
    df = spark.createDataFrame([(0, 1, "Sports Ball", 0.5, 100.0, 50.0)], "frame long, track_id long, class string, confidence double, x_center double, y_center double")
    r = tables.detections(df).first()
    assert (r["class"], r.x1, r.y2) == ("ball", 91.0, 59.0)


def test_hull_and_margin(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    points = spark.createDataFrame([(5.0, 5.0), (10.0, 5.0), (11.0, 5.0), (14.0, 5.0)], "x double, y double")
    poly = geometry.polygon(square)
    assert [r[0] for r in points.select(geometry.in_polygon(F.col("x"), F.col("y"), poly, 2.0)).collect()] == [True, True, True, False]
    hull = points.limit(1).select(geometry.hull(geometry.polygon([*square, (5.0, 5.0), (5.0, 0.0)]))).first()[0]
    assert sorted((p.x, p.y) for p in hull) == sorted(square)


def test_malformed_clock_ends_the_query(spark):
    df = spark.createDataFrame([("PT5S",), (None,), ("5:00",)], "c string")
    assert [r[0] for r in df.where("c IS NULL OR c LIKE 'PT%'").select(text.strict_iso_clock(F.col("c"))).collect()] == [5.0, 0.0]
    with pytest.raises(Exception, match="unreadable clock"):
        df.select(text.strict_iso_clock(F.col("c"))).collect()


def test_windows_need_a_full_game(spark):
    df = spark.createDataFrame([("1", k, 1, 700.0 - k, 0.0, 0.0, 0.5, 0.0, 1.0, 2.0, 0) for k in range(19)], "gameid string, row_id long, period int, clock_sec_remaining double, current_home_points double, current_away_points double, team_side double, elapsed_game_sec double, remaining_home_points double, remaining_away_points double, event_type_id int")
    assert play_by_play.windows(df).count() == 0
    assert play_by_play.windows(df, size=10, stride=5).count() == 2
    with pytest.raises(ValueError):
        play_by_play.features(df, [])


def test_streams_carry_their_state(spark, tmp_path):
    reads = [("v", 1, k, s) for k, s in enumerate([2, 2, 4, 4, 9])]
    for k in range(0, 5, 2):
        spark.createDataFrame(reads[k : k + 2], "video string, side int, frame long, observed int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video string, side int, frame long, observed int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.confirm_scores(stream).writeStream.format("memory").queryName("scores").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.score for r in spark.sql("SELECT * FROM scores ORDER BY frame").collect()]
    assert got[0] == 2 and set(got) <= {2, 4}
    ticks = spark.createDataFrame([("1", "pass", k) for k in (1, 5, 31, 100)], "team_id string, event_type string, s int").withColumn("ts", F.timestamp_seconds(F.col("s")))
    ticks.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    q = live.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.sql("SELECT * FROM counts").collect()) == [1, 2]


def test_two_teams_by_colour(spark):
    rows = [("v", k, 90.0 + k, 0.0, 0.0) for k in range(4)] + [("v", 10 + k, 10.0 + k, 5.0, 5.0) for k in range(4)]
    got = {r.track_id: r.team_id for r in tracking.two_teams(spark.createDataFrame(rows, "video string, track_id long, l double, a double, b double")).collect()}
    assert got == {k: "1" for k in range(4)} | {10 + k: "2" for k in range(4)}


def test_weights_read_back(spark, tmp_path):
    from trackweave.plans import scoring

    w = scoring.init_weights(5, hidden=8)
    np.savez(tmp_path / "w.npz", **w)
    assert all((scoring.load_weights(spark, str(tmp_path / "w.npz"))[k] == v).all() for k, v in w.items())


def test_parabola_through_a_gap(spark):
    import numpy as np

    from trackweave.plans import ball_path

    t = np.array([0, 1, 2, 3, 8, 9, 10, 11])
    made = ball_path.fill(t, 10.0 * t, 100 - 20.0 * t + 0.5 * t * t, np.full(8, 0.9), np.zeros(8), 0.8)
    assert [f for f, *_ in made] == [4, 5, 6, 7] and all(abs(x - 10 * f) < 1e-9 and abs(y - (100 - 20 * f + 0.5 * f * f)) < 1e-6 and c == 0.75 and g == 1.0 for f, x, y, c, g in made)
    assert ball_path.fill(t, t * 1.0, t * 1.0, np.ones(8), np.array([0, 0, 0, 0, 1, 1, 1, 1]), 0.8) == []
    points = spark.createDataFrame([("v", f, f, 10.0 * f, 100 - 20.0 * f + 0.5 * f * f, 0.9, 0) for f in t.tolist()], "video string, frame long, row_id long, x_center double, y_center double, confidence double, ball_segment int")
    got = ball_path.parabolic(points).where("interpolated").orderBy("frame").collect()
    assert [r.frame for r in got] == [4, 5, 6, 7] and all(abs(r.y_center - (100 - 20 * r.frame + 0.5 * r.frame**2)) < 1e-6 for r in got)


def test_medians_match_sorting(spark):
    import statistics

    from trackweave.operators import quantiles

    rows = [("a", float(k * 7 % 101)) for k in range(1000)] + [("b", 3.0), ("b", 4.0), ("c", None), (None, 5.0), (None, 9.0), (None, 1.0)] + [("d", 2.0)] * 500 + [("d", 8.0)] * 500
    got = dict(tuple(r) for r in quantiles.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v")).collect())
    of = lambda k: [v for key, v in rows if key == k and v is not None]
    assert got == {k: statistics.median(of(k)) if of(k) else None for k in ("a", "b", "c", "d", None)}
    assert quantiles.medians(spark.createDataFrame(rows, "k string, v double"), [], F.col("v")).first()[0] == statistics.median([v for _, v in rows if v is not None])


def test_windows_by_blocks_are_windows_by_rows(spark):
    rows = spark.createDataFrame([("a", k) for k in range(23)] + [("b", k) for k in range(4)], "g string, i long")
    for size, stride in ((6, 3), (6, 4), (4, 1)):
        got = sorted((r.g, r.window_start, r["items"]) for r in sequences.sliding_windows(rows, ["g"], ["i"], size, stride, F.col("i")).collect())
        assert got == sorted((g, s, list(range(s, s + size))) for g, n in (("a", 23), ("b", 4)) for s in range(0, n - size + 1, stride))


def test_ball_quality_adds_in_the_order_of_its_sql(spark):
    """A sum in another order differs in its last bit, which turns the order of near-equal balls."""
    from trackweave.plans import candidates
    from trackweave.queries.candidates import ball_quality_sql

    rows = spark.createDataFrame([(q * d / 6, a, t / 2, 0.0, 0.0, w, h) for q in (7.0, 23.0, 50.0) for d in (0.01, 0.05, 0.07) for t in (0.01, 0.03, 0.05, 0.07) for a in (1, 2) for w, h in ((10.0, 11.0), (17.0, 13.0))], "confidence double, agreement int, bonus double, x1 double, y1 double, x2 double, y2 double")
    both = rows.select(candidates.ball_quality().alias("ours"), F.expr(ball_quality_sql().replace("0.035", "0.035D").replace("0.08", "0.08D")).alias("theirs"))
    assert both.where("ours <> theirs").count() == 0


def test_tracked_ball_searches_once(spark):
    """Its searches are written, so no later join runs them again, and small groups are dealt over all partitions."""
    from trackweave.queries import QUERIES

    plan = QUERIES["tracked_ball"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan
    rows = spark.createDataFrame([(v, f, 100.0 * v + f, 1.0, 0.5) for v in range(60) for f in range(5)], "video long, frame long, x_center double, y_center double, confidence double")
    found = tracking.kalman(rows)
    assert found.rdd.getNumPartitions() >= 4 and found.count() == 300
    assert all(abs(r["fx"] - r["x_center"]) < 1e-9 for r in found.where("frame = 0").collect())


def test_groups_of_batches():
    import pandas as pd

    batches = [pd.DataFrame({"k": a, "n": b}) for a, b in (([1, 1, 2], [0, 1, 2]), ([], []), ([2, 2], [3, 4]), ([3], [5]))]
    assert [(g["k"][0], g["n"].tolist()) for g in tracking.groups(iter(batches), ["k"])] == [(1, [0, 1]), (2, [2, 3, 4]), (3, [5])]


def test_farthest_pair_in_bounded_memory():
    r = np.random.default_rng(0)
    for n in (1, 2, 30, 57):
        for x in (r.normal(size=(n, 3)), r.integers(0, 3, (n, 3)).astype(float), np.repeat(r.normal(size=(n, 3)), 2, 0)):
            apart = ((x[:, None] - x[None]) ** 2).sum(2)
            assert tracking.farthest_pair(x, 50) == np.unravel_index(apart.argmax(), apart.shape)
    x = r.normal(size=(60_000, 3))  # all pairs would be 86 GB
    assert len(set(tracking.farthest_pair(x))) == 2


def test_polygons_are_computed_once(spark):
    """An inner polygon occurs once in the expressions over it."""
    poly = F.expr("array(struct(double(id) AS x, 0D AS y), struct(4D AS x, 0D AS y), struct(0D AS x, 3D AS y))")
    for c in (geometry.polygon_area(poly), geometry.expand_polygon(poly, 2.0), geometry.hull(poly)):
        assert spark.range(1).select(c.alias("c"))._jdf.queryExecution().optimizedPlan().expressions().toString().count("cast(id") == 1


def test_readings_work_each_text_out_once(spark):
    """No regular expression of a reading is repeated in the plan, neither for branches nor for a filter put before."""
    from trackweave.plans import readings

    schema = "sample long, row_id long, raw string, conf double, x double, y double, width double, height double, team string, roi string"
    items = spark.createDataFrame([(1, 1, "102:98", 0.9, 10.0, 5.0, 40.0, 20.0, "", "score_numbers"), (1, 2, "10298", 0.9, 200.0, 5.0, 40.0, 20.0, None, "other"), (1, 3, None, 0.9, 1.0, 1.0, 1.0, 20.0, "", "other"), (1, 4, "3rd", 0.9, 1.0, 1.0, 1.0, 20.0, "", "other")], schema)
    found = readings.numbers(items)
    assert sorted((r.row_id, r.part, r.value, r.x) for r in found.collect()) == [(1, 0, 102, 0.0), (1, 1, 98, 20.0), (2, 2, 102, 190.0), (2, 3, 98, 210.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[^0-9A-Z]") == 1


def test_gates_take_small_groups_in_batches(spark):
    """Many short videos cost what their rows cost: no call of a function of its own for each, and the same rows as the
    gates give video by video."""
    from trackweave.plans import refiner

    limits = refiner.Limits()
    made = [(v, 10 * v + k, k + (20 if k > 4 else 0), 100.0 + 40 * k + (900 if (k + v) % 4 == 0 else 0), 300.0, k % 10 / 10) for v in range(12) for k in range(9)]
    rows = spark.createDataFrame(made, "video long, row_id long, frame long, x_center double, y_center double, confidence double")
    rows = rows.withColumns({"context_distance": F.lit(10.0), "body_core": F.lit(False), "body_torso": F.lit(False)})
    gated, kept = refiner.gated(rows, limits), refiner.without_jumps(rows, limits)
    for df in (gated, kept):
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()
    notes = {r.row_id: (r.cleaning_note, r.ball_segment) for r in gated.collect()}
    left = {r.row_id for r in kept.collect()}
    for v in range(12):
        _, ids, frames, x, y, sure = zip(*(m for m in made if m[0] == v))
        edge, no = [a <= 24 or a >= 1896 for a in x], [False] * 9
        assert [notes[i] for i in ids] == [f[:2] for f in refiner.gate(frames, x, y, sure, edge, no, no, limits)]
        assert [i in left for i in ids] == refiner.jump_gate(frames, x, y, limits.strict_step, limits.fill + 1).tolist()
