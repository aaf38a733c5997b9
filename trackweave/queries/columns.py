"""Small steps over columns and rows: filters, orders, names, files, boxes, profiles and assignments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import profile, scalars, text
from ..operators import sequences
from ..plans import court, play_by_play, possession, refiner, scoreboard
from ..sources import tables
from ..sources.tables import load
from .registry import query
from .refine import AROUND_SQL, SEEN_SQL, around, seen


def _pick(values: list[str], key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# names, types and missing values

MODEL_NAMES = ["person", "Sports Ball", "chair", "basketball", "Rim", "referee", "dog", "net"]


@query(f"SELECT DISTINCT n_regionkey AS class_id, name FROM (SELECT n_regionkey, ({_list(MODEL_NAMES)})[1 + n_regionkey] AS name FROM nation) WHERE lower(name) IN ('sports ball', 'basketball', 'rim', 'net')")
def class_ids(spark, sf_dir):
    """The ids of a model's classes that mean a ball or a hoop."""
    names = load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("class_id"), _pick(MODEL_NAMES, F.col("n_regionkey")).alias("name")).distinct()
    return names.where(tables.canonical_class(F.col("name")).isin("ball", "hoop"))


@query("SELECT s_acctbal AS confidence, s_suppkey AS track_id, s_name AS extra, '' AS team_id, 0.0::DOUBLE AS team_confidence FROM supplier")
def ensured_columns(spark, sf_dir):
    """Names are stripped, absent columns come with their default, preferred ones first."""
    raw = load(spark, sf_dir, "supplier").select(F.col("s_name").alias(" extra"), F.col("s_suppkey").alias("track_id "), F.col("s_acctbal").alias(" confidence "))
    named = raw.toDF(*(c.strip() for c in raw.columns))
    whole = tables.preferred_first(tables.with_columns(named, {"team_id": "", "team_confidence": 0.0, "track_id": 7}))
    assert whole.columns[:3] == ["track_id", "confidence", "team_id"]
    return tables.require_columns(whole, ["track_id", "extra"])


TEXTS = [" a b ", "NaN", "none", "null", "", "Unknown", " x"]


@query(f"SELECT event_id, CASE WHEN lower(trim(t)) IN ('nan', 'none') THEN '' ELSE trim(t) END AS cleaned FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE ({_list(TEXTS)})[1 + event_id % 7] END AS t FROM events)")
def text_clean(spark, sf_dir):
    raw = F.when(F.col("event_id") % 11 != 0, _pick(TEXTS, F.col("event_id")))
    return load(spark, sf_dir, "events").select("event_id", text.clean_text(raw).alias("cleaned"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer")
def display_nulls(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    return tables.show_rows(c, 1_000_000_000)


@query("SELECT o_orderkey, o_orderkey % 90 + 2 AS score1, o_orderkey % 70 AS score2, o_orderstatus AS quarter FROM orders")
def replaced_scores(spark, sf_dir):
    from ..plans import readings

    parsed = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 90).alias("score1"), F.lit(0).cast("long").alias("score2"), F.col("o_orderstatus").alias("quarter"))
    return readings.with_score(parsed, F.col("score1") + 2, F.col("o_orderkey") % 70)


@query("SELECT o_orderkey, m AS margin, CASE WHEN m > 0 THEN 'team_1' WHEN m < 0 THEN 'team_2' ELSE 'tie' END AS winner, round(CASE WHEN m > 0 THEN 1 / (1 + exp(-m / 6.0)) WHEN m < 0 THEN 1 - 1 / (1 + exp(-m / 6.0)) ELSE 0.5 END, 6) AS probability FROM (SELECT o_orderkey, o_orderkey % 41 - 20 AS m FROM orders)")
def winner_odds(spark, sf_dir):
    m = F.col("o_orderkey") % 41 - 20
    return load(spark, sf_dir, "orders").select("o_orderkey", m.alias("margin"), scalars.winner(m).alias("winner"), F.round(scalars.winner_probability(m), 6).alias("probability"))


@query("SELECT user_id, round(count(*) FILTER (WHERE event_type = 'purchase') * 2.3, 4) AS points FROM events GROUP BY user_id")
def reference_points(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.count_if(F.col("event_type") == "purchase") * 2.3, 4).alias("points"))


PATHS = ["runs/train3/tracking_results.csv", "/a/b/game7_tracking_results.csv", "clip.mp4", "x/archive.tar.gz", "plain"]


@query(f"SELECT event_id, CASE WHEN name LIKE '%tracking\\_results.csv' ESCAPE '\\' THEN name[1:length(name) - 20] ELSE regexp_replace(name, '(.)\\.[^.]*$', '\\1') || '_' END AS prefix FROM (SELECT event_id, regexp_extract(({_list(PATHS)})[1 + event_id % 5], '([^/]*)$', 1) AS name FROM events)")
def output_prefixes(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", tables.output_prefix(_pick(PATHS, F.col("event_id"))).alias("prefix"))


# filters


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 5 AND 40 AND l_orderkey % 3 <> 0")
def row_filters(spark, sf_dir):
    """By class, by range of frames, and without null keys."""
    rows = load(spark, sf_dir, "lineitem").select("l_linenumber", F.lower("l_returnflag").alias("class"), "l_quantity", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey")).alias("l_orderkey"))
    return rows.dropna(subset=["l_orderkey"]).where(F.col("class").isin("a", "r") & F.col("l_quantity").between(5, 40)).select("l_orderkey", "l_linenumber")


@query(f"WITH {SEEN_SQL} SELECT row_id, x_center <= 24 OR y_center <= 24 OR x_center >= 1896 OR y_center >= 1056 AS near_edge, (row_id % 13 = 0 AND confidence < 0.56) OR (row_id % 13 <> 0 AND row_id % 13 IN (5, 6) AND confidence < 0.2) AS weak FROM s")
def edge_and_body_flags(spark, sf_dir):
    flags = seen(spark, sf_dir).withColumns({"body_core": F.col("row_id") % 13 == 0, "body_torso": (F.col("row_id") % 13).isin(0, 5, 6)})
    limits = refiner.Limits()
    return flags.select("row_id", refiner.near_edge(limits).alias("near_edge"), refiner.weak_on_body(limits).alias("weak"))


@query(f"WITH {SEEN_SQL} SELECT row_id FROM s WHERE row_id % 2 = 0 OR (x_center BETWEEN 0 AND 1280 AND y_center BETWEEN 0 AND 720)")
def balls_inside_picture(spark, sf_dir):
    rows = seen(spark, sf_dir).withColumn("class", F.when(F.col("row_id") % 2 == 0, "player").otherwise("ball"))
    return court.inside_picture(rows, 1280, 720).select("row_id")


def _outside_sql(corners: list[str], x: str, y: str) -> tuple[str, str]:
    """(is inside, distance to the nearest edge) of a polygon whose corners are SQL structs."""
    inside, near = [], []
    for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
        inside.append(f"coalesce(((({a}.y > {y}) <> ({b}.y > {y})) AND {x} < {a}.x + ({y} - {a}.y) * ({b}.x - {a}.x) / nullif({b}.y - {a}.y, 0))::INT, 0)")
        t = f"least(greatest((({x} - {a}.x) * ({b}.x - {a}.x) + ({y} - {a}.y) * ({b}.y - {a}.y)) / (pow({b}.x - {a}.x, 2) + pow({b}.y - {a}.y, 2)), 0), 1)"
        near.append(f"sqrt(pow({x} - ({a}.x + {t} * ({b}.x - {a}.x)), 2) + pow({y} - ({a}.y + {t} * ({b}.y - {a}.y)), 2))")
    return f"({' + '.join(inside)}) % 2 = 1", f"least({', '.join(near)})"


_IN, _NEAR = _outside_sql(["p[1]", "p[2]", "p[3]", "p[4]"], "x_center", "ay")
_MOVED = "[{'x': 0.05 * 1920 + d, 'y': 0.3 * 1080}, {'x': 0.95 * 1920 - d, 'y': 0.3 * 1080}, {'x': 1920.0 - d, 'y': 0.98 * 1080}, {'x': d + 0.0, 'y': 0.98 * 1080}]"


@query(f"""WITH {SEEN_SQL}, {AROUND_SQL}, mv AS (SELECT video, frame, 60 + row_id % 5 * 20 AS d FROM s WHERE row_id % 7 = 0),
j AS (SELECT a.*, coalesce(mv.d, 0) AS d FROM a ASOF LEFT JOIN mv ON a.video = mv.video AND a.frame >= mv.frame),
w AS (SELECT *, {_MOVED} AS p, CASE class WHEN 'player' THEN y2 ELSE y_center END AS ay FROM j)
SELECT row_id FROM w WHERE {_IN} OR {_NEAR} <= 12""")
def moving_court(spark, sf_dir):
    """Players and hoops on a court whose polygon is seen now and then, before that on the usual one."""
    d = (60 + F.col("row_id") % 5 * 20).cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    polygon = F.array(corner(0.05 * 1920 + d, 0.3 * 1080), corner(0.95 * 1920 - d, 0.3 * 1080), corner(1920.0 - d, 0.98 * 1080), corner(d, 0.98 * 1080))
    polygons = seen(spark, sf_dir).where("row_id % 7 = 0").select("video", "frame", polygon.alias("polygon"))
    return court.on_moving_court(around(spark, sf_dir), polygons, 1920, 1080).select("row_id")


# orders, numbers and sections


@query("SELECT s_suppkey, t AS team_id, row_number() OVER (ORDER BY coalesce(TRY_CAST(TRY_CAST(t AS DOUBLE) AS INT), 999999), t, s_suppkey) AS place FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN (s_suppkey % 30)::VARCHAR WHEN 2 THEN (s_suppkey % 9)::VARCHAR || '.0' ELSE 'unknown' END AS t FROM supplier)")
def team_sort_order(spark, sf_dir):
    n = F.col("s_suppkey")
    t = F.when(n % 4 == 0, "A").when(n % 4 == 1, (n % 30).cast("string")).when(n % 4 == 2, F.concat((n % 9).cast("string"), F.lit(".0"))).otherwise("unknown")
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", t.alias("team_id"))
    return rows.withColumn("_order", text.team_order(F.col("team_id"))[0]).transform(lambda d: tables.numbered(d, ["_order", "team_id", "s_suppkey"], "place")).drop("_order")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place, 'E' || lpad((row_number() OVER (ORDER BY ts, event_id))::VARCHAR, greatest(5, length((row_number() OVER (ORDER BY ts, event_id))::VARCHAR))::INT, '0') AS name FROM events")
def global_event_ids(spark, sf_dir):
    """Numbers over all events, by ranges instead of one sorted task."""
    e = load(spark, sf_dir, "events").select("event_id", "ts")
    named = tables.event_ids(e, ["ts", "event_id"], "name")
    return named.select("event_id", F.substring("name", 2, 20).cast("long").alias("place"), "name")


@query("SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 3")
def first_distinct_keys(spark, sf_dir):
    return load(spark, sf_dir, "events").select("user_id").distinct().orderBy("user_id").limit(3)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE md5(l_orderkey || '-' || l_linenumber || '-42') < '4'")
def seeded_subset(spark, sf_dir):
    """A quarter of the training windows, the same at each run and on each cluster."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", F.lit("42"))
    return load(spark, sf_dir, "lineitem").where(F.md5(key) < "4").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber")


@query("""SELECT 1 AS section, 'event' AS row_type, user_id AS key, count(*) AS n FROM events GROUP BY user_id UNION ALL SELECT 2, 'team_summary', n_regionkey, count(*) FROM nation GROUP BY n_regionkey UNION ALL SELECT 3, 'total_summary', NULL, count(*) FROM events UNION ALL SELECT 4, 'note', NULL, NULL""")
def sectioned_report(spark, sf_dir):
    """Reports of several kinds as one table with the sections in order."""
    e, n = load(spark, sf_dir, "events"), load(spark, sf_dir, "nation")
    part = lambda df, k, name: df.withColumns({"section": F.lit(k), "row_type": F.lit(name)})
    events = part(e.groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n")), 1, "event")
    teams = part(n.groupBy(F.col("n_regionkey").cast("long").alias("key")).agg(F.count("*").alias("n")), 2, "team_summary")
    total = part(e.agg(F.count("*").alias("n")), 3, "total_summary")
    note = part(spark.range(1).select(), 4, "note")
    out = events.unionByName(teams).unionByName(total, allowMissingColumns=True).unionByName(note, allowMissingColumns=True)
    return out.select("section", "row_type", "key", "n").orderBy("section", "key")


@query("SELECT max(l_orderkey) AS max_frame, count(DISTINCT l_returnflag) AS n_teams, count(DISTINCT l_orderkey) AS n_frames FROM lineitem")
def frame_extent(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    return rows.agg(F.max("l_orderkey").alias("max_frame"), F.count_distinct("l_returnflag").alias("n_teams"), F.count_distinct("l_orderkey").alias("n_frames"))


@query("SELECT l_orderkey AS frame, l_returnflag AS class, count(*) AS n, array_to_string(list(l_partkey ORDER BY l_partkey), ',') AS members FROM lineitem GROUP BY ALL")
def frame_lists(spark, sf_dir):
    """The rows of a frame and class as one list."""
    lists = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("class")).agg(F.array_sort(F.collect_list("l_partkey")).alias("all"))
    return lists.select("frame", "class", F.size("all").cast("long").alias("n"), F.concat_ws(",", "all").alias("members"))


@query("SELECT l_orderkey AS frame, row_number() OVER w - 1 AS raw_candidate_index, w_ AS bbox_width, h_ AS bbox_height, w_ * h_ AS bbox_area FROM (SELECT *, l_quantity / 2 + 6 AS w_, 6.0::DOUBLE + l_partkey % 30 AS h_ FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey, l_suppkey, l_linenumber, l_quantity)")
def raw_ball_check(spark, sf_dir):
    """All candidates of a frame, numbered by confidence, with their sizes."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    wide, high = F.col("l_quantity") / 2 + 6, F.lit(6.0) + F.col("l_partkey") % 30
    box = (F.lit(0.0), F.lit(0.0), wide, high)
    rows = load(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("frame"), (F.row_number().over(w) - 1).alias("raw_candidate_index"), wide.alias("bbox_width"), high.alias("bbox_height"), g.area(box).alias("bbox_area"))


# boxes and polygons


@query("SELECT p_partkey, x1, y2 FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size::DOUBLE END AS x1, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_size * 2 + 30.0 END::DOUBLE AS y2 FROM part)")
def read_boxes(spark, sf_dir):
    """Boxes as an array, as corners, or as a corner with width and height."""
    n, s = F.col("p_partkey") % 4, F.col("p_size").cast("double")
    rows = load(spark, sf_dir, "part").select(
        "p_partkey", F.when(n == 0, F.array(s, s * 2, s + 10, s * 2 + 30)).alias("bbox"), F.when(n == 1, s).alias("x1"), F.when(n == 1, s * 2).alias("y1"), F.when(n == 1, s + 10).alias("x2"), F.when(n == 1, s * 2 + 30).alias("y2"),
        F.when(n == 2, s).alias("left"), F.when(n == 2, s * 2).alias("top"), F.when(n == 2, F.lit(10.0)).alias("width"), F.when(n == 2, F.lit(30.0)).alias("height"),
    )
    box = g.any_box()
    return rows.select("p_partkey", box[0].alias("x1"), box[3].alias("y2"))


@query("SELECT p_partkey, round(abs(80.0 * s + (p_partkey % 7) * 1.0 * s) / 2 + 40.0 * s / 2 + 0, 4) AS area, round((abs(80.0 * s + (p_partkey % 7) * 1.0 * s) / 2 + 40.0 * s / 2) * 2.25, 4) AS wider, round(abs(80.0 * s + (p_partkey % 7) * 1.0 * s) / 2 + 40.0 * s / 2, 4) AS hull FROM (SELECT p_partkey, p_size::DOUBLE AS s FROM part)")
def polygon_areas(spark, sf_dir):
    """Areas of a quadrilateral by part, of the one half as large again, and of the hull of it with a point inside."""
    s, k = F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double")
    corner = lambda x, y: F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "alias") else x.alias("x"), y.alias("y"))
    # two triangles on the base from 0 to s: heights 80 + k below and 40 above
    poly = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(s / 2, -(80 + k)), corner(s, F.lit(0.0)), corner(s / 3, F.lit(40.0)))
    # a part is a few bytes and much arithmetic
    parts = sequences.dealt(load(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return parts.select("p_partkey", F.round(g.polygon_area(poly), 4).alias("area"), F.round(g.polygon_area(g.expand_polygon(poly, 1.5)), 4).alias("wider"), F.round(g.polygon_area(g.hull(F.concat(poly, F.array(corner(s / 2, F.lit(1.0)))))), 4).alias("hull"))


# assignments and segments


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s % 5 = 0 THEN '' ELSE (s % 2 + 1)::VARCHAR END AS team_id, CASE WHEN s % 5 = 0 THEN 'unknown' ELSE 'team_' || s % 2 + 1 END AS team_name FROM (SELECT *, l_suppkey AS s FROM lineitem)")
def assigned_teams(spark, sf_dir):
    """Teams of tracks put on their rows; tracks without one are unknown."""
    teams = load(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("track_id"), (F.col("s_suppkey") % 2 + 1).cast("string").alias("team_id"), F.concat(F.lit("team_"), (F.col("s_suppkey") % 2 + 1).cast("string")).alias("team_name"))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("track_id"))
    return rows.join(teams, "track_id", "left").select("l_orderkey", "l_linenumber", F.coalesce("team_id", F.lit("")).alias("team_id"), F.coalesce("team_name", F.lit("unknown")).alias("team_name"))


@query("SELECT e.event_id FROM events e SEMI JOIN (SELECT DISTINCT user_id, event_id // 20 AS seg FROM events WHERE event_type = 'purchase' AND value > 40) b ON b.user_id = e.user_id AND b.seg = e.event_id // 20")
def whole_segments(spark, sf_dir):
    """All rows of the segments that have a marked one."""
    e = load(spark, sf_dir, "events").withColumn("seg", F.floor(F.col("event_id") / 20))
    hit = e.where("event_type = 'purchase' AND value > 40").select("user_id", "seg").distinct()
    return e.join(hit, ["user_id", "seg"], "left_semi").select("event_id")


@query("""WITH RECURSIVE p AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id FROM events),
r AS MATERIALIZED (SELECT video, n, n // 3 + CASE WHEN event_id % 7 = 0 THEN 9 ELSE 0 END AS a, n // 4 + CASE WHEN event_id % 11 = 0 THEN -5 ELSE 0 END AS b FROM p),
t AS (SELECT video, n, a, b, false AS shown FROM r WHERE n = 1 UNION ALL SELECT video, n, CASE WHEN ok THEN na ELSE a END, CASE WHEN ok THEN nb ELSE b END, ok FROM (SELECT r.video, r.n, t.a, t.b, r.a AS na, r.b AS nb, least(r.a - t.a, r.b - t.b) = 0 AND greatest(r.a - t.a, r.b - t.b) BETWEEN 1 AND 3 AS ok FROM t JOIN r ON r.video = t.video AND r.n = t.n + 1))
SELECT video, n::DOUBLE AS time_sec, a::INT AS team1_score, b::INT AS team2_score FROM t WHERE shown""")
def score_changes(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    p = load(spark, sf_dir, "events").select(F.col("user_id").alias("video"), n.alias("n"), "event_id")
    a = F.floor(F.col("n") / 3) + F.when(F.col("event_id") % 7 == 0, 9).otherwise(0)
    b = F.floor(F.col("n") / 4) + F.when(F.col("event_id") % 11 == 0, -5).otherwise(0)
    return scoreboard.score_changes(p.select("video", F.col("n").cast("double").alias("time_sec"), a.cast("int").alias("team1_score"), b.cast("int").alias("team2_score")))


# profiles and limits

VIDEO_SQL = "v AS (SELECT n_nationkey AS video, 640 + n_nationkey * 113 AS width, 360 + n_nationkey * 70 AS height, 15.0::DOUBLE + n_nationkey * 2 AS fps FROM nation)"


def _videos(spark, sf_dir):
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("video"), (640 + F.col("n_nationkey") * 113).alias("width"), (360 + F.col("n_nationkey") * 70).alias("height"), (15.0 + F.col("n_nationkey") * 2).alias("fps"))


_SCALE = "least(greatest(greatest(width, height) / 1280, 0.85), 1.45)"


@query(f"WITH {VIDEO_SQL} SELECT video, round({_SCALE} * 220, 6) AS rim_rescue_margin_px, round({_SCALE} * least(greatest(30 / fps, 0.72), 1.25) * 280, 6) AS association_max_distance_px, CASE WHEN fps >= 45 THEN 16 ELSE 12 END AS max_gap, (round_even(least(greatest(greatest(width, height) * 1.05, 1280), 1600) / 32, 0) * 32)::INT AS imgsz, round(160 * greatest(greatest(width, height) / 1920, 0.75), 6) AS step FROM v")
def adaptive_profiles(spark, sf_dir):
    w, h, f = F.col("width"), F.col("height"), F.col("fps")
    found = profile.adaptive(w, h, f)
    return _videos(spark, sf_dir).select("video", *(F.round(found[c], 6).alias(c) for c in ("rim_rescue_margin_px", "association_max_distance_px")), found["max_gap"].alias("max_gap"), found["imgsz"].alias("imgsz"), F.round(profile.scaled_step(160.0, w, h), 6).alias("step"))


@query(f"WITH {VIDEO_SQL} SELECT video, least(CASE WHEN video % 3 > 0 THEN greatest(1, round_even(video % 3 * 7.5 * fps, 0))::INT END, CASE WHEN video % 4 = 0 THEN 300 END) AS frame_limit FROM v")
def frame_limits(spark, sf_dir):
    v = _videos(spark, sf_dir)
    limit = profile.frame_limit(F.col("fps"), F.col("video") % 3 * 7.5, F.col("video") % 4 == 0, F.lit(300))
    return v.select("video", limit.alias("frame_limit"))


@query("SELECT o_orderkey, m * 60.0 + s AS seconds, round(1 / (1 + exp(-(o_orderkey % 21 - 10.0) / 6)), 6) AS odds, round(iw * ih / (400 + 400 - iw * ih), 6) AS iou FROM (SELECT o_orderkey, o_orderkey % 15 AS m, o_orderkey % 60 AS s, greatest(20 - o_orderkey % 30, 0) AS iw, greatest(20 - o_orderkey % 25, 0) AS ih FROM orders)")
def sql_functions(spark, sf_dir):
    """The engine's functions by name, as SQL users call them."""
    profile.register(spark)
    load(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%d:%02d", F.col("o_orderkey") % 15, F.col("o_orderkey") % 60).alias("clock"), (F.col("o_orderkey") % 30).cast("double").alias("dx"), (F.col("o_orderkey") % 25).cast("double").alias("dy")).createOrReplaceTempView("tw_orders")
    return spark.sql("SELECT o_orderkey, clock_seconds(clock) AS seconds, round(win_probability(o_orderkey % 21 - 10D), 6) AS odds, round(box_iou(0D, 0D, 20D, 20D, dx, dy, dx + 20, dy + 20), 6) AS iou FROM tw_orders")


# files


@query("SELECT lpad(n_nationkey::VARCHAR, 4, '0') AS gameid, n_name AS season, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey END AS period, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey / 2 END AS h_pts FROM nation")
def csv_round_trip(spark, sf_dir):
    """Written with a byte order mark, read as text and cast: ids keep their zeros, unreadable numbers become null."""
    path = tables.scratch(spark, "csv")
    n = F.col("n_nationkey")
    rows = load(spark, sf_dir, "nation").select(F.lpad(n.cast("string"), 4, "0").alias("gameid"), F.col("n_name").alias("season"), F.when(n % 5 != 0, F.col("n_regionkey").cast("string")).otherwise("x").alias(" period "), F.when(n % 4 != 0, (F.col("n_regionkey") / 2).cast("string")).otherwise("nan").alias("h_pts"))
    tables.write_csv(rows.where(n % 2 == 0), f"{path}/a", ["gameid"])
    tables.write_csv(rows.where(n % 2 == 1), f"{path}/b", ["gameid"])
    return tables.read_csv(spark, tables.require_file(spark, path, "games") + "/*", "gameid string, season string, period int, h_pts double")


@query("SELECT epoch, 1.0 / epoch AS loss, epoch = 5 AS best FROM range(1, 6) t(epoch)")
def training_history(spark, sf_dir):
    """Epochs as JSON lines in the next free run folder."""
    path = tables.next_folder(spark, tables.scratch(spark, "runs"))
    tables.write_history(spark, [{"epoch": k, "loss": 1.0 / k, "best": k == 5} for k in range(1, 6)], path)
    return tables.read_history(spark, path, "epoch long, loss double, best boolean")


@query("WITH f AS (SELECT l_orderkey % 5 AS video, l_orderkey AS frame, avg(l_discount) AS x FROM lineitem GROUP BY ALL), w AS (SELECT video, frame, row_number() OVER o AS n, sum(x::FLOAT) OVER (PARTITION BY video ORDER BY frame ROWS 29 PRECEDING) AS total FROM f WINDOW o AS (PARTITION BY video ORDER BY frame)) SELECT video, frame, round(total, 3) AS total FROM w WHERE n >= 30")
def feature_windows(spark, sf_dir):
    """Every run of 30 frames as one row of features."""
    f = load(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("video"), F.col("l_orderkey").alias("frame")).agg(F.avg("l_discount").alias("ball_x"))
    f = f.withColumns({c: F.lit(0.0) for c in ("ball_y", "ball_speed", "min_dist", "player_speed")})
    total = F.aggregate(F.transform("items", lambda i: i[0].cast("double")), F.lit(0.0), lambda a, v: a + v)
    return possession.feature_windows(f).select("video", "frame", F.round(total, 3).alias("total"))


CLOCKS = ["7:41", "0741", "741", "12:59", "1300", "O1.30", "9:75", "x", "", "L2;05"]
_LOOSE = f"regexp_replace(translate(upper(trim(({_list(CLOCKS)})[1 + event_id % 10])), 'OIL;.', '011::'), '[^0-9:]', '', 'g')"


@query(f"WITH c AS (SELECT event_id, {_LOOSE} AS t FROM events), d AS (SELECT event_id, regexp_extract(CASE WHEN regexp_full_match(t, '[0-9]{{3,4}}') THEN t[1:length(t) - 2] || ':' || t[-2:] ELSE t END, '^([0-9]{{1,2}}):([0-9]{{1,2}})$', ['m', 's']) AS x FROM c) SELECT event_id, CASE WHEN TRY_CAST(x.m AS INT) <= 12 AND TRY_CAST(x.s AS INT) <= 59 THEN TRY_CAST(x.m AS INT) * 60 + TRY_CAST(x.s AS INT) END AS seconds FROM d")
def lenient_clocks(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", text.lenient_clock_seconds(_pick(CLOCKS, F.col("event_id"))).alias("seconds"))


@query("SELECT p_partkey, least(greatest(p_size * 50.0 - 300, 0), 1279) AS x, least(greatest(p_size * 30.0 - 100, 0), 719) AS y FROM part")
def clamped_corners(spark, sf_dir):
    corner = F.struct((F.col("p_size") * 50.0 - 300).alias("x"), (F.col("p_size") * 30.0 - 100).alias("y"))
    inside = g.clamp_polygon(F.array(corner), 1280.0, 720.0)
    return load(spark, sf_dir, "part").select("p_partkey", inside[0]["x"].alias("x"), inside[0]["y"].alias("y"))


@query("SELECT n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS y FROM nation")
def court_config(spark, sf_dir):
    """A polygon from a JSON object."""
    path = tables.scratch(spark, "court")
    points = load(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.collect_list(F.array("n_nationkey", F.col("n_regionkey").cast("long"))).alias("polygon"))).alias("value"))
    points.coalesce(1).write.text(path)
    return spark.createDataFrame(tables.read_polygon(spark, path), "x double, y double")


@query("""WITH r AS (SELECT user_id AS video, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 0.5 AS t, event_id % 3 AS a, event_id % 2 AS b FROM events),
v AS (SELECT video, a, b, count(*) AS n, min(t) AS first FROM r WHERE t <= 5 AND a > 0 GROUP BY ALL) SELECT video, a::INT AS team1_score, b::INT AS team2_score FROM v QUALIFY row_number() OVER (PARTITION BY video ORDER BY n DESC, first) = 1""")
def majority_start(spark, sf_dir):
    """The score read most often in a video's first five seconds."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    reads = load(spark, sf_dir, "events").select(F.col("user_id").alias("video"), (n * 0.5).alias("time_sec"), F.nullif((F.col("event_id") % 3).cast("int"), F.lit(0)).alias("team1_score"), (F.col("event_id") % 2).cast("int").alias("team2_score"))
    return scoreboard.majority_start(reads)


@query("SELECT l_orderkey AS gameid, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 5)")
def sound_games(spark, sf_dir):
    """Rows of games in which no row is bad."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gameid"), "l_linenumber", "l_quantity")
    return play_by_play.drop_games(rows, F.col("l_quantity") < 5).select("gameid", "l_linenumber")
