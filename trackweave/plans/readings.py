"""From text readings of a picture's regions to a score, quarter, clock and the two teams.

Items have sample (one picture or region), row_id, raw, conf, x, y, width, height, team and roi. Numbers of a sample are
paired by a self-join on the sample with the geometry as condition; a sample has few of them. Best quarter and clock are
grouped maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import written

# Bounds of a score and of its height, and what a region says about its items.
MAX_SCORE, MIN_HEIGHT = 200, 12.0
SCORE_ROI = {"score_numbers": 45.0, "team1_score": 32.0, "team2_score": 32.0, "score_pair": 22.0}
INFO_ROI = ("center_info", "middle_info", "right_info")
TALL, RATIO, LEAST_GAP, MOST_DROP = 0.55, 0.58, 0.7, 0.75


def _number(t: Column) -> Column:
    return t.try_cast("int")


def read(items: DataFrame) -> DataFrame:
    """items with _compact, _digits, _quarter and _clock. Step by step, so that each text is worked out once: Spark does
    not merge projections that would repeat a function, but repeats what stands in one expression several times."""
    upper = items.withColumn("_upper", F.upper(F.coalesce("raw", F.lit(""))))
    keys = upper.withColumns({"_compact": F.replace("_upper", F.lit(" "), F.lit("")), "_digits": text.digits(F.col("_upper")), "_q": text.quarter_key(F.col("_upper")), "_c": text.clock_key(F.col("_upper"))})
    minutes, seconds = text.clock_numbers(F.col("_c"))
    parts = keys.withColumns({"_m": minutes, "_s": seconds})
    return parts.withColumns({"_quarter": text.quarter_of(F.col("_q")), "_clock": text.clock_of(F.col("_m"), F.col("_s"))}).drop("_upper", "_q", "_c", "_m", "_s")


def numbers(items: DataFrame) -> DataFrame:
    """(sample, row_id, part, value, ...): the numbers that items may hold. `a:b` or `a|b` gives two, as do four to six
    digits that stand together (five in both ways); teams, quarters, clocks and words give none."""
    compact, digits, n = F.col("_compact"), F.col("_digits"), F.length("_digits")
    plain = (F.coalesce("team", F.lit("")) == "") & (F.col("_quarter") == "") & (F.col("_clock") == "") & ~compact.rlike("^[A-Z]+$")
    pair = r"^\s*([0-9A-Z]{1,3})\s*[:|]\s*([0-9A-Z]{1,3})\s*$"
    side = lambda v, part, at: F.struct(v.alias("value"), F.lit(part).alias("part"), (F.col("x") + F.col("width") * at).alias("x"), (F.col("width") / 2).alias("width"))
    halves = lambda first, *ab: [side(_number(v), first + i, at) for i, (v, at) in enumerate(zip(ab, (-0.25, 0.25), strict=True))]
    cut = lambda at: (F.substring(digits, F.lit(1), at), F.substring(digits, at + 1, n - at))
    none = F.array().cast("array<struct<value:int,part:int,x:double,width:double>>")
    # texts first, each once; which of them are whole scores is told after that
    middle = F.when(n == 5, F.lit(2)).otherwise(F.floor(n / 2)).cast("int")
    rows = read(items).withColumns({"_plain": plain, "_paired": plain & compact.rlike(pair)})
    paired, alone = F.col("_paired"), F.col("_plain") & ~F.col("_paired") & n.between(4, 6)
    texts = {"_a": F.when(paired, text.digits(F.regexp_extract(compact, pair, 1))).when(alone, cut(middle)[0]), "_b": F.when(paired, text.digits(F.regexp_extract(compact, pair, 2))).when(alone, cut(middle)[1])}
    texts |= {"_a3": F.when(alone & (n == 5), cut(F.lit(3))[0]), "_b3": F.when(alone & (n == 5), cut(F.lit(3))[1])}
    rows = rows.withColumns(texts)
    whole = lambda t: F.col(t).rlike(r"^\d{1,3}$") & (_number(F.col(t)) <= MAX_SCORE)
    single = F.col("_plain") & ~paired & n.between(1, 3) & (_number(digits) <= MAX_SCORE) & (F.col("height") >= MIN_HEIGHT)
    one = F.struct(_number(digits).alias("value"), F.lit(0).alias("part"), F.col("x").alias("x"), F.col("width").alias("width"))
    two, three = (F.when(whole(a) & whole(b), F.array(*halves(k, F.col(a), F.col(b)))).otherwise(none) for k, a, b in ((0, "_a", "_b"), (2, "_a3", "_b3")))
    parts = F.when(single, F.array(one)).when(F.col("_a3").isNotNull(), F.concat(two, three)).otherwise(two)
    # the outer form, as for the inner one Spark adds a filter that works the whole array out again
    found = rows.select("sample", "row_id", "conf", "y", "height", "roi", F.explode_outer(parts).alias("p")).where("p IS NOT NULL")
    return found.select("sample", "row_id", "p.part", "p.value", "conf", "p.x", "y", "p.width", "height", "roi")


def distinct_numbers(found: DataFrame) -> DataFrame:
    """The same value at the same place once, the surest and tallest first."""
    order = F.struct((-F.col("height") * F.col("conf")).alias("a"), (-F.col("height")).alias("b"), "row_id", "part", "value", "conf", "x", "y", "width", "height", "roi")
    every = found.groupBy("sample").agg(F.sort_array(F.collect_list(order)).alias("all"))
    same = lambda a, b: (a["value"] == b["value"]) & (F.abs(a["x"] - b["x"]) <= F.greatest(a["width"], b["width"])) & (F.abs(a["y"] - b["y"]) <= F.greatest(a["height"], b["height"]) * 0.6)
    put = lambda kept, n: F.when(F.exists(kept, lambda k: same(n, k)), kept).otherwise(F.concat(kept, F.array(n)))
    kept = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.slice("all", 1, 1), put)
    return every.select("sample", F.posexplode(kept).alias("nth", "k")).select("sample", "nth", "k.row_id", "k.part", "k.value", "k.conf", "k.x", "k.y", "k.width", "k.height", "k.roi")


def _roi_points(roi: Column) -> Column:
    points = F.create_map(*(F.lit(v) for kv in SCORE_ROI.items() for v in kv))
    return F.coalesce(F.try_element_at(points, roi), F.lit(0.0)) - F.when(roi.isin(*INFO_ROI), 22.0).otherwise(0.0)


def score_pairs(found: DataFrame) -> DataFrame:
    """(sample, score1, score2, pair_score): of the numbers of a sample the two that look most like a score. Only tall
    numbers are compared if there are two of them."""
    w = Window.partitionBy("sample")
    tall = found.withColumn("_tall", F.col("height") >= F.greatest(F.lit(MIN_HEIGHT), F.max("height").over(w) * TALL))
    use = tall.withColumn("_enough", F.count_if("_tall").over(w) >= 2).where("_tall OR NOT _enough")
    side = lambda p: use.select("sample", *(F.col(c).alias(f"{p}_{c}") for c in ("nth", "value", "conf", "x", "y", "height", "roi")))
    # each pair once, the left one first; at the same place the earlier one
    pairs = side("l").join(side("r"), "sample").where("l_x < r_x OR (l_x = r_x AND l_nth < r_nth)")
    tallest, lowest = F.greatest("l_height", "r_height"), F.least("l_height", "r_height")
    gap, drop = F.col("r_x") - F.col("l_x"), F.abs(F.col("r_y") - F.col("l_y"))
    odd = (F.least("l_value", "r_value") <= 4) & (F.greatest("l_value", "r_value") >= 20)
    fits = ~odd & (gap >= tallest * LEAST_GAP) & (drop <= tallest * MOST_DROP) & (lowest / tallest >= RATIO)
    sides = (F.array_sort(F.array("l_roi", "r_roi")) == F.array(F.lit("team1_score"), F.lit("team2_score"))).cast("double") * 18
    score = (F.col("l_height") + F.col("r_height")) * 2.4 + (F.col("l_conf") + F.col("r_conf")) * 12 + lowest / tallest * 25 + _roi_points(F.col("l_roi")) + _roi_points(F.col("r_roi")) + F.coalesce(sides, F.lit(0.0)) - drop * 0.7 - gap * 0.025
    rated = pairs.where(fits).withColumn("pair_score", score)
    first = F.struct((-F.round("pair_score", 9)).alias("s"), F.least("l_nth", "r_nth").alias("i"), F.greatest("l_nth", "r_nth").alias("j"))
    return rated.groupBy("sample").agg(F.min_by(F.struct(F.col("l_value").alias("score1"), F.col("r_value").alias("score2"), "pair_score"), first).alias("b")).select("sample", "b.*")


def best_readings(items: DataFrame) -> DataFrame:
    """(sample, quarter, game_clock) of the samples with one of them, null for the other."""
    of_quarter = F.col("conf") * 20 + F.when(F.col("roi").isin(*INFO_ROI), 20.0).otherwise(0.0) + F.when(F.col("raw").rlike("(?i)(st|nd|rd|th|q|ot)"), 8.0).otherwise(0.0) - F.col("height") * 0.03
    of_clock = F.col("conf") * 20 + F.when(F.col("roi") == "center_info", 25.0).otherwise(0.0) + F.when(F.col("height") < 45, 8.0).otherwise(0.0) + F.when(F.col("raw").rlike("[:|;.]"), 6.0).otherwise(0.0) - F.col("height") * 0.05
    hit = lambda kind, t, score: F.when(F.col(t) != "", F.struct(F.lit(kind).alias("kind"), F.col(t).alias("text"), (-score).alias("s"), F.col("row_id").alias("i")))
    # a filter after the explode is not put before it, where Spark would work the texts out once more
    hits = read(items).select("sample", F.explode(F.array(hit("q", "_quarter", of_quarter), hit("c", "_clock", of_clock))).alias("h")).where("h IS NOT NULL")
    best = lambda kind: F.min_by("h.text", F.when(F.col("h.kind") == kind, F.struct("h.s", "h.i")))
    return hits.groupBy("sample").agg(best("q").alias("quarter"), best("c").alias("game_clock"))


def team_order(items: DataFrame) -> DataFrame:
    """(sample, team1, team2): the first two different teams from left to right."""
    teams = items.where(F.coalesce("team", F.lit("")) != "").groupBy("sample", "team").agg(F.min(F.struct("x", "row_id")).alias("at"))
    order = teams.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("at", "team"))).alias("t"))
    at = lambda i: F.coalesce(F.get("t", F.lit(i))["team"], F.lit(""))
    return order.select("sample", at(0).alias("team1"), at(1).alias("team2"))


def regions(items: DataFrame) -> DataFrame:
    """One row for each sample with a score: the pair, quarter, clock, and how much the region looks like a board."""
    found = written(distinct_numbers(numbers(items)))  # read by several joins
    counts = found.groupBy("sample").agg(F.count("*").alias("_n"))
    out = score_pairs(found).join(counts, "sample").join(best_readings(items), "sample", "left")
    score = F.col("pair_score") + F.col("_n") * 1.5 + F.when(F.col("game_clock").isNotNull(), 8.0).otherwise(0.0) + F.when(F.col("quarter").isNotNull(), 6.0).otherwise(0.0)
    return out.select("sample", "score1", "score2", F.coalesce("quarter", F.lit("")).alias("quarter"), F.coalesce("game_clock", F.lit("")).alias("game_clock"), score.alias("region_score"))


def with_score(parsed: DataFrame, score1: Column, score2: Column) -> DataFrame:
    """The parsed boards with another score, all else as it is."""
    return parsed.withColumns({"score1": score1, "score2": score2})
