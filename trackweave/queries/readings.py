"""Scoreboard readings: an order is a sample, its lines are the items that were read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import readings
from ..sources.tables import load
from .registry import query

RAWS = ["102:98", "10298", "95", "1I2|9B", "7", "UTA", "1ST", "10:25", "1188", "B8", "105104", "2", "3rd", "O7;41", "abcdef", "1234567", "88", "102-98", "250", "45:300"]
RAW_SQL = "[" + ", ".join(f"'{r}'" for r in RAWS) + "]"
ROIS = ["score_numbers", "team1_score", "team2_score", "center_info", "right_info", "other"]
ROI_SQL = "[" + ", ".join(f"'{r}'" for r in ROIS) + "]"
#: The same expressions in both engines.
MADE = [
    "l_orderkey AS sample", "l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 97 AS row_id", "CAST(l_discount * 10 AS DOUBLE) AS conf", "CAST(100 + l_partkey * 13 % 300 AS DOUBLE) AS x", "CAST(40 + l_suppkey * 7 % 23 AS DOUBLE) AS y",
    "CAST(20 + l_partkey % 30 AS DOUBLE) AS width", "CAST(8 + l_quantity / 2 AS DOUBLE) AS height", "CASE WHEN l_partkey % 9 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'UTA' ELSE 'DEN' END ELSE '' END AS team",
]
ITEMS_SQL = f"i AS MATERIALIZED (SELECT {', '.join(MADE)}, ({RAW_SQL})[1 + l_partkey % {len(RAWS)}] AS raw, ({ROI_SQL})[1 + l_suppkey % {len(ROIS)}] AS roi FROM lineitem)"


def items(spark, sf_dir) -> DataFrame:
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    rows = load(spark, sf_dir, "lineitem").withColumns({"raw": pick(RAWS, "l_partkey"), "roi": pick(ROIS, "l_suppkey")})
    return rows.selectExpr(*MADE, "raw", "roi")


_DIGITS = lambda t: f"regexp_replace(translate(upper({t}), 'ODILZASGB', '001124568'), '[^0-9]', '', 'g')"
_FIX = "replace(replace(replace(regexp_replace(upper(raw), '[^0-9A-Z]', '', 'g'), 'OQ', '0Q'), '5T', 'ST'), 'S1', 'ST')"
_QUARTER = f"CASE WHEN {_FIX} LIKE '%ST' THEN '1Q' WHEN {_FIX} LIKE '%ND' THEN '2Q' WHEN {_FIX} LIKE '%RD' THEN '3Q' WHEN {_FIX} LIKE '%TH' THEN '4Q' WHEN regexp_full_match({_FIX}, '[1-4]Q') THEN {_FIX} WHEN {_FIX} IN ('OT', '0T') THEN 'OT' ELSE '' END"
_CLOCKED = "regexp_extract(translate(upper(trim(raw)), 'OIL|;.', '011:::'), '(\\d{1,2})\\s*:\\s*(\\d{2})', ['m', 's'])"
_CLOCK = f"CASE WHEN TRY_CAST(({_CLOCKED}).m AS INT) <= 15 AND TRY_CAST(({_CLOCKED}).s AS INT) <= 59 THEN lpad(({_CLOCKED}).m, 2, '0') || ':' || lpad(({_CLOCKED}).s, 2, '0') ELSE '' END"
_PAIR = "^\\s*([0-9A-Z]{1,3})\\s*[:|]\\s*([0-9A-Z]{1,3})\\s*$"
NUMBERS_SQL = f"""{ITEMS_SQL}, e AS MATERIALIZED (SELECT *, {_QUARTER} AS q, {_CLOCK} AS ck, replace(upper(raw), ' ', '') AS compact, {_DIGITS('raw')} AS d FROM i),
f AS (SELECT *, regexp_extract(compact, '{_PAIR}', ['a', 'b']) AS ab FROM e WHERE team = '' AND q = '' AND ck = '' AND NOT regexp_full_match(compact, '[A-Z]+')),
s AS (SELECT *, CASE WHEN regexp_matches(compact, '{_PAIR}') THEN [[{_DIGITS('ab.a')}, {_DIGITS('ab.b')}]] WHEN length(d) = 5 THEN [[d[1:2], d[3:]], [d[1:3], d[4:]]] WHEN length(d) IN (4, 6) THEN [[d[1:length(d) // 2], d[length(d) // 2 + 1:]]] ELSE [] END AS splits, regexp_matches(compact, '{_PAIR}') AS paired FROM f),
t AS (SELECT *, unnest(splits) AS sp, generate_subscripts(splits, 1) - 1 AS nth FROM s),
u AS (SELECT * FROM t WHERE regexp_full_match(sp[1], '\\d{{1,3}}') AND regexp_full_match(sp[2], '\\d{{1,3}}') AND sp[1]::INT <= 200 AND sp[2]::INT <= 200),
n AS MATERIALIZED (SELECT sample, row_id, 2 * nth AS part, sp[1]::INT AS value, conf, x - width * 0.25 AS x, y, width / 2 AS width, height, roi FROM u UNION ALL SELECT sample, row_id, 2 * nth + 1, sp[2]::INT, conf, x + width * 0.25, y, width / 2, height, roi FROM u
UNION ALL SELECT sample, row_id, 0, d::INT, conf, x, y, width, height, roi FROM s WHERE NOT paired AND length(d) BETWEEN 1 AND 3 AND d::INT <= 200 AND height >= 12)"""


@query(f"WITH {NUMBERS_SQL} SELECT row_id, part, value, x, width FROM n")
def score_number_candidates(spark, sf_dir):
    return readings.numbers(items(spark, sf_dir)).select("row_id", F.col("part").cast("long").alias("part"), "value", "x", "width")


_SAME = "c.s.value = k.value AND abs(c.s.x - k.x) <= greatest(c.s.width, k.width) AND abs(c.s.y - k.y) <= greatest(c.s.height, k.height) * 0.6"
DISTINCT_SQL = f"""{NUMBERS_SQL}, c AS MATERIALIZED (SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY height * conf DESC, height DESC, row_id, part, value, conf, x, y) AS pos, {{'row_id': row_id, 'part': part, 'value': value, 'conf': conf, 'x': x, 'y': y, 'width': width, 'height': height, 'roi': roi}} AS s FROM n),
g AS (SELECT sample, pos, [s] AS kept FROM c WHERE pos = 1 UNION ALL SELECT g.sample, c.pos, CASE WHEN len(list_filter(kept, lambda k: {_SAME})) = 0 THEN list_append(kept, c.s) ELSE kept END FROM g JOIN c ON c.sample = g.sample AND c.pos = g.pos + 1),
dn AS MATERIALIZED (SELECT sample, nth, z.* FROM (SELECT sample, unnest(kept) AS z, generate_subscripts(kept, 1) AS nth FROM (SELECT sample, arg_max(kept, pos) AS kept FROM g GROUP BY sample)))"""


@query(f"WITH RECURSIVE {DISTINCT_SQL} SELECT sample, value, x FROM dn")
def distinct_numbers(spark, sf_dir):
    return readings.distinct_numbers(readings.numbers(items(spark, sf_dir))).select("sample", "value", "x")


_POINTS = lambda r: f"(CASE {r} WHEN 'score_numbers' THEN 45 WHEN 'team1_score' THEN 32 WHEN 'team2_score' THEN 32 WHEN 'score_pair' THEN 22 ELSE 0 END - CASE WHEN {r} IN ('center_info', 'middle_info', 'right_info') THEN 22 ELSE 0 END)"
PAIRS_SQL = f"""{DISTINCT_SQL}, ta AS (SELECT *, height >= greatest(12, max(height) OVER (PARTITION BY sample) * 0.55) AS tall FROM dn), us AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) FILTER (WHERE tall) OVER (PARTITION BY sample) >= 2 AS enough FROM ta) WHERE tall OR NOT enough),
pr AS (SELECT l.sample, l.value AS score1, r.value AS score2, least(l.nth, r.nth) AS i, greatest(l.nth, r.nth) AS j, (l.height + r.height) * 2.4 + (l.conf + r.conf) * 12 + least(l.height, r.height) / greatest(l.height, r.height) * 25 + {_POINTS('l.roi')} + {_POINTS('r.roi')}
+ CASE WHEN (l.roi = 'team1_score' AND r.roi = 'team2_score') OR (l.roi = 'team2_score' AND r.roi = 'team1_score') THEN 18 ELSE 0 END - abs(r.y - l.y) * 0.7 - (r.x - l.x) * 0.025 AS pair_score FROM us l JOIN us r ON l.sample = r.sample AND (l.x < r.x OR (l.x = r.x AND l.nth < r.nth))
WHERE NOT (least(l.value, r.value) <= 4 AND greatest(l.value, r.value) >= 20) AND r.x - l.x >= greatest(l.height, r.height) * 0.7 AND abs(r.y - l.y) <= greatest(l.height, r.height) * 0.75 AND least(l.height, r.height) / greatest(l.height, r.height) >= 0.58),
bp AS MATERIALIZED (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY sample ORDER BY round(pair_score, 9) DESC, i, j) = 1)"""


@query(f"WITH RECURSIVE {PAIRS_SQL} SELECT sample, score1, score2, floor(pair_score * 1000 + 0.1) / 1000 AS pair_score FROM bp")
def score_pairs(spark, sf_dir):
    found = readings.score_pairs(readings.distinct_numbers(readings.numbers(items(spark, sf_dir))))
    return found.select("sample", "score1", "score2", (F.floor(F.col("pair_score") * 1000 + 0.1) / 1000).alias("pair_score"))


BEST_SQL = f"""bq AS (SELECT sample, arg_min(q, (-(conf * 20 + CASE WHEN roi IN ('center_info', 'middle_info', 'right_info') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(raw, '(?i)(st|nd|rd|th|q|ot)') THEN 8 ELSE 0 END - height * 0.03), row_id)) AS quarter FROM e WHERE q <> '' GROUP BY sample),
bc AS (SELECT sample, arg_min(ck, (-(conf * 20 + CASE WHEN roi = 'center_info' THEN 25 ELSE 0 END + CASE WHEN height < 45 THEN 8 ELSE 0 END + CASE WHEN regexp_matches(raw, '[:|;.]') THEN 6 ELSE 0 END - height * 0.05), row_id)) AS game_clock FROM e WHERE ck <> '' GROUP BY sample)"""


@query(f"WITH {NUMBERS_SQL}, {BEST_SQL} SELECT sample, coalesce(quarter, '') AS quarter, coalesce(game_clock, '') AS game_clock FROM bq FULL JOIN bc USING (sample)")
def best_quarter_and_clock(spark, sf_dir):
    both = readings.best_readings(items(spark, sf_dir))
    return both.select("sample", F.coalesce("quarter", F.lit("")).alias("quarter"), F.coalesce("game_clock", F.lit("")).alias("game_clock"))


@query(f"WITH {ITEMS_SQL}, t AS (SELECT sample, team, min((x, row_id)) AS place FROM i WHERE team <> '' GROUP BY ALL), o AS (SELECT sample, list(team ORDER BY place) AS ts FROM t GROUP BY sample) SELECT sample, coalesce(ts[1], '') AS team1, coalesce(ts[2], '') AS team2 FROM o")
def team_order(spark, sf_dir):
    return readings.team_order(items(spark, sf_dir))


@query(f"WITH RECURSIVE {PAIRS_SQL}, {BEST_SQL}, cn AS (SELECT sample, count(*) AS k FROM dn GROUP BY sample) SELECT sample, coalesce(quarter, '') AS quarter, coalesce(game_clock, '') AS game_clock, floor((pair_score + k * 1.5 + CASE WHEN game_clock IS NULL THEN 0 ELSE 8 END + CASE WHEN quarter IS NULL THEN 0 ELSE 6 END) * 1000 + 0.1) / 1000 AS region_score FROM bp JOIN cn USING (sample) LEFT JOIN bq USING (sample) LEFT JOIN bc USING (sample)")
def parsed_regions(spark, sf_dir):
    return readings.regions(items(spark, sf_dir)).select("sample", "quarter", "game_clock", (F.floor(F.col("region_score") * 1000 + 0.1) / 1000).alias("region_score"))
