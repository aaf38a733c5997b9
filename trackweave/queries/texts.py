"""Scoreboard and clock texts, made from keys of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, text
from ..sources.tables import canonical_class, load
from .registry import query


@query("SELECT event_id, coalesce(TRY_CAST(regexp_extract(c, '^PT(?:(\\d+)M)?(\\d+(?:\\.\\d+)?)S$', 1) AS DOUBLE), 0) * 60 + CAST(regexp_extract(c, '^PT(?:(\\d+)M)?(\\d+(?:\\.\\d+)?)S$', 2) AS DOUBLE) AS seconds FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'PT' || event_id % 60 || '.5S' ELSE 'PT' || event_id % 12 || 'M' || lpad((event_id % 60)::VARCHAR, 2, '0') || '.00S' END AS c FROM events)")
def clock_parse(spark, sf_dir):
    n = F.col("event_id")
    c = F.when(n % 3 == 0, F.concat(F.lit("PT"), (n % 60).cast("string"), F.lit(".5S"))).otherwise(F.concat(F.lit("PT"), (n % 12).cast("string"), F.lit("M"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(".00S")))
    return load(spark, sf_dir, "events").select("event_id", text.strict_iso_clock(c).alias("seconds"))


CLOCKS = ["O7;41", "6:48", "12.05", "I1:59", "16:00", "5:77", "abc", "L0|30", "", "1:05 2Q"]
CLOCKS_SQL = "[" + ", ".join(f"'{c}'" for c in CLOCKS) + "]"


@query(f"WITH c AS (SELECT event_id, regexp_extract(translate(upper(trim(({CLOCKS_SQL})[1 + event_id % 10])), 'OIL|;.', '011:::'), '(\\d{{1,2}})\\s*:\\s*(\\d{{2}})', ['m', 's']) AS x FROM events), d AS (SELECT event_id, TRY_CAST(x.m AS INT) AS m, TRY_CAST(x.s AS INT) AS s FROM c) SELECT event_id, CASE WHEN m <= 15 AND s <= 59 THEN lpad(m::VARCHAR, 2, '0') || ':' || lpad(s::VARCHAR, 2, '0') ELSE '' END AS clock, CASE WHEN m <= 15 AND s <= 59 THEN m * 60 + s END AS seconds FROM d")
def clock_text(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, CLOCKS)), (F.col("event_id") % 10 + 1).cast("int"))
    clock = text.clock_text(raw)
    return load(spark, sf_dir, "events").select("event_id", clock.alias("clock"), text.clock_seconds(clock).alias("seconds"))


QUARTERS = ["1ST", "2nd", "3 rd", "4Th", "2Q", "OT", "0T", "S1", "5T", "x9", "", "1QQ"]
QUARTERS_SQL = "[" + ", ".join(f"'{c}'" for c in QUARTERS) + "]"


@query(f"WITH c AS (SELECT event_id, replace(replace(replace(regexp_replace(upper(({QUARTERS_SQL})[1 + event_id % 12]), '[^0-9A-Z]', '', 'g'), 'OQ', '0Q'), '5T', 'ST'), 'S1', 'ST') AS t FROM events), d AS (SELECT event_id, CASE WHEN t LIKE '%ST' THEN '1Q' WHEN t LIKE '%ND' THEN '2Q' WHEN t LIKE '%RD' THEN '3Q' WHEN t LIKE '%TH' THEN '4Q' WHEN regexp_full_match(t, '[1-4]Q') THEN t WHEN t IN ('OT', '0T') THEN 'OT' ELSE '' END AS q FROM c) SELECT event_id, q AS quarter, CASE WHEN q = 'OT' THEN 5 WHEN q <> '' THEN q[1]::INT END AS period FROM d")
def quarter_norm(spark, sf_dir):
    q = text.quarter_text(F.element_at(F.array(*map(F.lit, QUARTERS)), (F.col("event_id") % 12 + 1).cast("int")))
    return load(spark, sf_dir, "events").select("event_id", q.alias("quarter"), text.quarter_number(q).alias("period"))


@query("SELECT p_partkey, regexp_replace(translate(upper(p_name), 'ODILZASGB', '001124568'), '[^0-9]', '', 'g') AS digits FROM part")
def digit_lookalike(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.digits(F.col("p_name")).alias("digits"))


TEAM_CASE = " ".join([f"WHEN contains(t, '{a}') THEN '{text.TEAM_ALIASES[a]}'" for a in sorted(text.TEAM_ALIASES, key=lambda a: (-len(a), a))] + [f"WHEN contains(t, '{c}') THEN '{c}'" for c in text.TEAM_CODES])


@query(f"SELECT n_nationkey, p_partkey, CASE WHEN length(t) < 2 THEN '' {TEAM_CASE} ELSE '' END AS team FROM (SELECT n_nationkey, p_partkey, regexp_replace(upper(replace(p_type || p_name, ' ', '')), '[^A-Z]', '', 'g') AS t FROM part, nation WHERE n_nationkey = p_partkey % 25)")
def team_code(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumn("n_nationkey", (F.col("p_partkey") % 25).cast("int"))
    rows = p.join(load(spark, sf_dir, "nation"), "n_nationkey")
    return rows.select("n_nationkey", "p_partkey", text.team_code(F.concat("p_type", "p_name")).alias("team"))


VALUES = ["1.0", " 2.5", "nan", "", "inf", "x", "-3.7", "None"]
VALUES_SQL = "[" + ", ".join(f"'{c}'" for c in VALUES) + "]"


@query(f"SELECT event_id, CASE WHEN isfinite(d) THEN d END AS number, CASE WHEN isfinite(d) THEN trunc(d)::BIGINT END AS whole FROM (SELECT event_id, TRY_CAST(trim(({VALUES_SQL})[1 + event_id % 8]) AS DOUBLE) AS d FROM events)")
def safe_numbers(spark, sf_dir):
    v = F.element_at(F.array(*map(F.lit, VALUES)), (F.col("event_id") % 8 + 1).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", scalars.number(v).alias("number"), scalars.whole(v).alias("whole"))


TEAMS = ["1.0", "2", " nan", "None", "unknown", "", "-1", "A.0"]
TEAMS_SQL = "[" + ", ".join(f"'{c}'" for c in TEAMS) + "]"


@query(f"WITH c AS (SELECT event_id, trim(({TEAMS_SQL})[1 + event_id % 8]) AS t FROM events) SELECT event_id, CASE WHEN lower(t) IN ('nan', 'none', 'unknown') THEN '' ELSE regexp_replace(t, '\\.0$', '') END AS team_id FROM c")
def team_id_clean(spark, sf_dir):
    v = F.element_at(F.array(*map(F.lit, TEAMS)), (F.col("event_id") % 8 + 1).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", text.clean_team_id(v).alias("team_id"))


CLASSES = ["Sports Ball", "person", " Rim ", "Referee", "net", "dog", "players", "BALL"]
CLASSES_SQL = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"


@query(f"SELECT event_id, CASE c WHEN 'sports ball' THEN 'ball' WHEN 'person' THEN 'player' WHEN 'rim' THEN 'hoop' WHEN 'net' THEN 'hoop' ELSE c END AS class FROM (SELECT event_id, lower(trim(({CLASSES_SQL})[1 + event_id % 8])) AS c FROM events)")
def class_names(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", canonical_class(F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("event_id") % 8 + 1).cast("int"))).alias("class"))


@query("SELECT o_orderkey, 'Q' || 1 + o_orderkey % 5 || ' ' || lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock, CASE WHEN p <= 4 THEN (p - 1) * 720.0 + (720.0 - s) ELSE 2880 + (p - 5) * 300.0 + (300.0 - s) END::DOUBLE AS elapsed FROM (SELECT o_orderkey, o_orderkey % 300 AS s, 1 + o_orderkey % 5 AS p FROM orders)")
def game_clock_format(spark, sf_dir):
    s, p = F.col("o_orderkey") % 300, 1 + F.col("o_orderkey") % 5
    return load(spark, sf_dir, "orders").select("o_orderkey", text.game_clock(p, s).alias("clock"), scalars.elapsed_seconds(p, s).alias("elapsed"))
