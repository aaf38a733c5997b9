"""Play-by-play features, possession and scoring over games made of the events table: a user is a game, an event a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import play_by_play, possession, scoring
from ..sources.tables import load
from .registry import query

WHOLE = "CAST(floor(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)) AS BIGINT)"
WHOLE_SQL = "CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000) AS BIGINT)"

#: The same log in both dialects; {s} is the second since the start.
PBP = """SELECT user_id AS gameid, event_id AS row_id, 1 + s {div} 648000 AS period, 'PT' || CAST((719 - (s % 648000) {div} 900) {div} 60 AS {text}) || 'M' || lpad(CAST((719 - (s % 648000) {div} 900) % 60 AS {text}), 2, '0') || '.00S' AS clock,
CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN CAST(event_id {div} 90 AS DOUBLE) END AS h_pts, CASE WHEN event_type = 'click' AND event_id % 2 = 1 THEN CAST(event_id {div} 95 AS DOUBLE) END AS a_pts,
CASE WHEN event_id % 10 = 3 THEN NULL WHEN event_id % 2 = 0 THEN 'H' || CAST(user_id AS {text}) ELSE 'A' || CAST(user_id AS {text}) END AS team,
CASE event_type WHEN 'click' THEN 'Made Shot' WHEN 'view' THEN 'Missed   Shot' WHEN 'purchase' THEN 'Foul' WHEN 'signup' THEN 'Rebound' END AS type, CASE WHEN event_id % 3 = 0 THEN 'x block' WHEN event_id % 3 = 1 THEN 'a steal' END AS desc
FROM (SELECT *, {second} AS s FROM {events})"""
PBP_SQL = PBP.format(div="//", text="VARCHAR", second=WHOLE_SQL, events="events").replace(" AS desc", ' AS "desc"')


def play_by_play_log(spark, sf_dir) -> DataFrame:
    return spark.sql(PBP.format(div="div", text="STRING", second=WHOLE, events="{e}").replace(" AS desc", " AS `desc`"), e=load(spark, sf_dir, "events"))


SCORED_SQL = f"""p AS MATERIALIZED (SELECT *, coalesce(TRY_CAST(regexp_extract(clock, '^PT(?:(\\d+)M)?(\\d+(?:\\.\\d+)?)S$', 1) AS DOUBLE), 0) * 60 + CAST(regexp_extract(clock, '^PT(?:(\\d+)M)?(\\d+(?:\\.\\d+)?)S$', 2) AS DOUBLE) AS c FROM ({PBP_SQL})),
q AS (SELECT *, max(coalesce(h_pts, 0)) OVER w AS h, max(coalesce(a_pts, 0)) OVER w AS a FROM p WINDOW w AS (PARTITION BY gameid ORDER BY period, c DESC, row_id ROWS UNBOUNDED PRECEDING)),
r AS MATERIALIZED (SELECT *, h > lag(h, 1, 0) OVER w AS hs, a > lag(a, 1, 0) OVER w AS as_, last_value(h) OVER (PARTITION BY gameid ORDER BY period, c DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - h AS rh, last_value(a) OVER (PARTITION BY gameid ORDER BY period, c DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - a AS ra FROM q WINDOW w AS (PARTITION BY gameid ORDER BY period, c DESC, row_id)),
ht AS (SELECT gameid, team AS home FROM (SELECT gameid, team, row_number() OVER (PARTITION BY gameid ORDER BY count(*) DESC, team) AS k FROM r WHERE hs AND team IS NOT NULL GROUP BY gameid, team) WHERE k = 1),
at_ AS (SELECT gameid, team AS away FROM (SELECT gameid, team, row_number() OVER (PARTITION BY gameid ORDER BY count(*) DESC, team) AS k FROM r WHERE as_ AND team IS NOT NULL GROUP BY gameid, team) WHERE k = 1),
f AS MATERIALIZED (SELECT r.gameid, row_id, CASE WHEN coalesce(type, '') <> '' THEN regexp_replace(trim(type), '\\s+', ' ', 'g') WHEN upper("desc") LIKE '%BLOCK%' THEN 'Block' WHEN upper("desc") LIKE '%STEAL%' THEN 'Steal' ELSE 'Unknown' END AS event_type, period, c AS clock_sec_remaining,
  (period - 1) * 720.0 + (720.0 - c) AS elapsed_game_sec, h AS current_home_points, a AS current_away_points, CASE WHEN team = home THEN 1.0 WHEN team = away THEN 0.0 ELSE 0.5 END AS team_side, rh AS remaining_home_points, ra AS remaining_away_points FROM r JOIN ht USING (gameid) JOIN at_ USING (gameid)),
g AS (SELECT *, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type_id FROM f WHERE event_type IN ('Block', 'Steal', 'Missed Shot', 'Made Shot', 'Foul', 'Violation', 'Jump Ball'))"""


def _features(spark, sf_dir) -> DataFrame:
    return play_by_play.features(play_by_play_log(spark, sf_dir), play_by_play.ALLOWED)


@query(f"WITH {SCORED_SQL} SELECT gameid, row_id, event_type, event_type_id, CAST(elapsed_game_sec AS DOUBLE) AS elapsed_game_sec, period, clock_sec_remaining, current_home_points, current_away_points, CAST(team_side AS DOUBLE) AS team_side, remaining_home_points, remaining_away_points FROM g")
def pbp_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query(f"WITH {SCORED_SQL} SELECT event_type, count(*) AS n, count(DISTINCT gameid) AS n_games FROM f GROUP BY event_type")
def pbp_event_counts(spark, sf_dir):
    return play_by_play.scored(play_by_play_log(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("gameid").alias("n_games"))


@query("SELECT 0 AS n_null, 0 AS n_side, 0 AS n_negative, 0 AS n_period, 0 AS n_clock")
def pbp_violations(spark, sf_dir):
    return play_by_play.violations(_features(spark, sf_dir))


@query(f"WITH {SCORED_SQL} SELECT gameid, n - 20 AS window_start, array_to_string(ids, ',') AS ids, rh, ra FROM (SELECT gameid, row_number() OVER w AS n, list(event_type_id) OVER (PARTITION BY gameid ORDER BY period, clock_sec_remaining DESC, row_id ROWS 19 PRECEDING) AS ids, remaining_home_points AS rh, remaining_away_points AS ra FROM g WINDOW w AS (PARTITION BY gameid ORDER BY period, clock_sec_remaining DESC, row_id)) WHERE n >= 20 AND (n - 20) % 5 = 0")
def pbp_windows(spark, sf_dir):
    w = play_by_play.windows(_features(spark, sf_dir))
    return w.select("gameid", "window_start", F.array_join(F.transform("event_type_id", lambda x: x.cast("string")), ",").alias("ids"), F.element_at("target", 1).cast("double").alias("rh"), F.element_at("target", 2).cast("double").alias("ra"))


@query()
def pbp_game_detail(spark, sf_dir):
    """Window predictions of the sequence model with seeded weights."""
    return scoring.game_detail(play_by_play.windows(_features(spark, sf_dir)), scoring.init_weights(16))


def _timeline(spark, sf_dir) -> DataFrame:
    w = F.window("ts", "6 hours")
    e = load(spark, sf_dir, "events").where("event_type IN ('view', 'signup')").groupBy(F.col("user_id").alias("game"), w.alias("w")).agg(F.max("event_id").alias("e"))
    s = F.expr(WHOLE.replace("ts)", "w.end)"))
    rows = e.select("game", s.cast("double").alias("time_sec"), "e")
    return rows.selectExpr("game", "time_sec", "CAST(1 + CAST(time_sec AS BIGINT) div 648001 AS INT) AS period", "CAST(719 - (CAST(time_sec AS BIGINT) % 648000) div 900 AS INT) AS clock_sec_remaining", "CAST(e div 90 AS INT) AS team1_score", "CAST(e div 95 AS INT) AS team2_score")


def _found_events(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "shot_made").when(F.col("event_type") == "error", "shot_missed").when(F.col("event_type") == "purchase", "steal_or_block").otherwise("pass")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("game"), "event_id", F.expr(WHOLE).cast("double").alias("time_sec"), kind.alias("event_type"), (1 + F.col("event_id") % 3).cast("string").alias("team_id"))


TIMELINE_SQL = f"tl AS MATERIALIZED (SELECT user_id AS game, s AS time_sec, CAST(1 + s // 648001 AS INT) AS period, CAST(719 - (s % 648000) // 900 AS INT) AS clock_sec_remaining, CAST(max(event_id) // 90 AS INT) AS team1_score, CAST(max(event_id) // 95 AS INT) AS team2_score FROM (SELECT user_id, event_id, {WHOLE_SQL} // 21600 * 21600 + 21600 AS s FROM events WHERE event_type IN ('view', 'signup')) GROUP BY ALL)"
FOUND_SQL = f"ev AS MATERIALIZED (SELECT user_id AS game, event_id, {WHOLE_SQL} AS time_sec, CASE event_type WHEN 'click' THEN 'Made' WHEN 'error' THEN 'Missed' WHEN 'purchase' THEN 'Steal' END AS kind, 1 + event_id % 3 AS team_id FROM events)"


@query(f"WITH {TIMELINE_SQL}, {FOUND_SQL}, m AS (SELECT ev.*, team1_score, team2_score, period, clock_sec_remaining FROM ev ASOF LEFT JOIN tl ON ev.game = tl.game AND ev.time_sec >= tl.time_sec), n AS (SELECT *, coalesce(first_value(team1_score IGNORE NULLS) OVER w, 0)::DOUBLE AS home, coalesce(first_value(period IGNORE NULLS) OVER w, 1)::DOUBLE AS p FROM m WINDOW w AS (PARTITION BY game ORDER BY time_sec, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT event_id, home AS current_home_points, p AS period, CASE team_id WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.5 END::DOUBLE AS team_side FROM n")
def score_matched_events(spark, sf_dir):
    m = scoring.match_scores(_found_events(spark, sf_dir), _timeline(spark, sf_dir))
    return m.select("event_id", "current_home_points", "period", "team_side")


@query(f"WITH {TIMELINE_SQL}, {FOUND_SQL} SELECT tl.game, tl.time_sec::DOUBLE AS time_sec, least(20, count(*)) AS n_events_used, array_to_string(list_slice(list(CASE kind WHEN 'Made' THEN 3 WHEN 'Missed' THEN 4 ELSE 5 END ORDER BY ev.time_sec, event_id), -20, -1), ',') AS ids FROM tl JOIN ev ON ev.game = tl.game AND ev.time_sec <= tl.time_sec WHERE kind IS NOT NULL GROUP BY tl.game, tl.time_sec")
def seen_event_windows(spark, sf_dir):
    codes = {"Made Shot": 3, "Missed Shot": 4, "Steal": 5}
    t = _timeline(spark, sf_dir)
    rows = scoring.seen_windows(scoring.event_codes(scoring.match_scores(_found_events(spark, sf_dir), t), codes), t)
    return rows.select("game", "time_sec", "n_events_used", F.array_join(F.transform("event_type_id", lambda x: x.cast("string")), ",").alias("ids"))


@query()
def score_forecast(spark, sf_dir):
    codes = {"Block": 0, "Foul": 1, "Jump Ball": 2, "Made Shot": 3, "Missed Shot": 4, "Steal": 5, "Violation": 6}
    return scoring.forecast(_found_events(spark, sf_dir), _timeline(spark, sf_dir), codes, scoring.init_weights(7))


@query("SELECT o_orderkey, round(1 / (1 + exp(-(o_totalprice - 200000) / 50000 / 6.0)), 8) AS win_probability, CASE WHEN o_totalprice > 200000 THEN 'team_1' WHEN o_totalprice < 200000 THEN 'team_2' ELSE 'tie' END AS winner, o_totalprice - 200000 AS margin FROM orders")
def logistic_winner(spark, sf_dir):
    from ..functions import scalars

    m = F.col("o_totalprice") - 200000
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(scalars.win_probability(m / 50000), 8).alias("win_probability"), scalars.winner(m).alias("winner"), m.alias("margin"))


# possession on frames made of lineitem: an order is a frame, its lines are players, the part is the ball


def _detections(spark, sf_dir, without_ball: bool = False) -> DataFrame:
    """Every frame has a ball, or, to see what becomes of frames without one, every fifth has none."""
    l = load(spark, sf_dir, "lineitem")
    players = l.selectExpr("l_orderkey % 7 AS video", "l_orderkey AS frame", "l_suppkey AS track_id", "'player' AS class", "l_quantity * 30 AS x_center", "l_extendedprice / 100 AS y_center", "l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey AS row_id")
    seen = load(spark, sf_dir, "orders")
    balls = (seen.where("o_orderkey % 5 <> 0") if without_ball else seen).selectExpr("o_orderkey % 7 AS video", "o_orderkey AS frame", "CAST(-1 AS BIGINT) AS track_id", "'ball' AS class", "CAST(o_custkey % 1500 AS DOUBLE) AS x_center", "o_totalprice / 500 AS y_center", "CAST(0 AS BIGINT) AS row_id")
    return players.unionByName(balls)


DETECTIONS_SQL = "d AS MATERIALIZED (SELECT l_orderkey % 7 AS video, l_orderkey AS frame, l_suppkey AS track_id, 'player' AS class, l_quantity * 30 AS x, l_extendedprice / 100 AS y, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey * 10000 + l_suppkey AS row_id FROM lineitem UNION ALL SELECT o_orderkey % 7, o_orderkey, -1, 'ball', CAST(o_custkey % 1500 AS DOUBLE), o_totalprice / 500, 0 FROM orders)"
OWNERS_SQL = f"{DETECTIONS_SQL}, own AS MATERIALIZED (SELECT p.video, p.frame, arg_min(p.track_id, (sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)), p.row_id)) AS owner FROM d p JOIN d b ON b.frame = p.frame AND b.class = 'ball' WHERE p.class = 'player' GROUP BY ALL)"


@query(f"WITH {OWNERS_SQL} SELECT video, frame, owner AS owner_track_id FROM own")
def ball_owners(spark, sf_dir):
    return possession.owners(_detections(spark, sf_dir)).select("video", "frame", "owner_track_id")


@query(f"WITH {OWNERS_SQL} SELECT video, owner AS owner_track_id, count(*) AS frames, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY video), 6) AS possession_pct FROM own GROUP BY video, owner")
def possession_shares(spark, sf_dir):
    return possession.shares(possession.owners(_detections(spark, sf_dir))).withColumn("possession_pct", F.round("possession_pct", 6))


@query(f'WITH {OWNERS_SQL} SELECT * FROM (SELECT video, frame, lag(owner) OVER (PARTITION BY video ORDER BY frame) AS "from", owner AS "to" FROM own) WHERE "from" <> "to"')
def possession_changes(spark, sf_dir):
    return possession.owner_changes(possession.owners(_detections(spark, sf_dir)))


@query(f"WITH {DETECTIONS_SQL} SELECT frame, track_id, row_id, round(least(coalesce(sqrt(pow((x - lag(x) OVER w) / 1920 * 28, 2) + pow((y - lag(y) OVER w) / 1080 * 15, 2)), 0) * 30, 12.0), 6) AS speed_ms FROM d WINDOW w AS (PARTITION BY video, track_id ORDER BY frame, row_id)")
def track_speeds(spark, sf_dir):
    return possession.speeds(_detections(spark, sf_dir)).select("frame", "track_id", "row_id", F.round("speed_ms", 6).alias("speed_ms"))


@query(f"WITH {DETECTIONS_SQL.replace('FROM orders', 'FROM orders WHERE o_orderkey % 5 <> 0')}, b AS (SELECT video, frame, x / 1920 AS bx, y / 1080 AS byy FROM d WHERE class = 'ball') SELECT d.video, d.frame, round(min(sqrt(pow((x / 1920 - coalesce(bx, 0.5)) * 28, 2) + pow((y / 1080 - coalesce(byy, 0.5)) * 15, 2))), 4) AS min_dist, round(coalesce(any_value(bx), 0.5), 9) AS ball_x FROM d LEFT JOIN b ON b.video = d.video AND b.frame = d.frame WHERE class = 'player' GROUP BY d.video, d.frame")
def frame_features(spark, sf_dir):
    return possession.frame_features(_detections(spark, sf_dir, without_ball=True)).select("video", "frame", F.round("min_dist", 4).alias("min_dist"), F.round("ball_x", 9).alias("ball_x"))


@query("WITH v AS (SELECT 100 AS total), e AS (SELECT user_id AS video, event_id % 100 AS frame, arg_max(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 4 END, event_id) AS code FROM events WHERE event_type IN ('click', 'view', 'signup') GROUP BY ALL), s AS (SELECT video, frame FROM (SELECT DISTINCT user_id AS video FROM events), (SELECT unnest(range(100)) AS frame)) SELECT video, frame - 29 AS window_start, coalesce(code, 0) AS label FROM s LEFT JOIN e USING (video, frame) WHERE frame >= 29")
def window_end_labels(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "shot_made").when(F.col("event_type") == "view", "pass").when(F.col("event_type") == "signup", "rebound").otherwise("foul")
    videos = e.select(F.col("user_id").alias("video")).distinct().withColumn("total", F.lit(100))
    marks = e.select(F.col("user_id").alias("video"), (F.col("event_id") % 100).alias("frame"), kind.alias("event_type"), F.col("event_id").alias("row_id"))
    return possession.window_labels(possession.frame_labels(videos, marks))
