"""False balls at the rim, at the picture's edge and away from all players, found by what clusters of them do.

A ball near a rim is compared with its nearest hoop some frames around (a range join with a cost). Clusters of such
balls are gaps and islands; whether a cluster looks like a shot is told by the ball's way in the frames before it, by one
range join of clusters and balls and a grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import ranges, sequences
from ..sources.tables import written
from .candidates import BOX, Picture, above_rim, box_size, inside_share, inside_wider

# Cost of a frame between a ball and its hoop, and how many frames are looked at.
FRAME_COST, NEAR_FRAMES, PRIOR_FRAMES = 18.0, 3, 5


def frames_of(fps: float, seconds: float, least: int) -> int:
    return max(least, round((fps if fps and fps > 0 else 30.0) * seconds))


def nearest_hoops(balls: DataFrame, rows: DataFrame, reach: int) -> DataFrame:
    """balls with the columns c_* of the hoop of least distance plus FRAME_COST for each frame between, at most `reach`
    frames away; balls without one are left out."""
    hoops = rows.where(F.col("class") == "hoop").select(F.col("video").alias("_v"), F.col("frame").alias("_hf"), F.col("row_id").alias("_hi"), *(F.col(c).alias(f"c_{c}") for c in (*BOX, "x_center", "y_center")))
    # buckets of the reach's frames: a hoop is copied twice and not for each frame that it may serve
    pairs = ranges.range_join(balls.select("video", "frame", "row_id", "x_center", "y_center"), hoops.withColumnRenamed("_v", "video"), ["video"], "frame", F.col("_hf") - reach, F.col("_hf") + reach, 2.0 * reach + 1)
    cost = g.distance(F.col("x_center"), F.col("y_center"), F.col("c_x_center"), F.col("c_y_center")) + F.abs(F.col("_hf") - F.col("frame")) * FRAME_COST
    best = pairs.groupBy("video", "row_id").agg(F.min_by(F.struct(*(F.col(c) for c in pairs.columns if c.startswith("c_"))), F.struct(cost, F.col("_hf"), F.col("_hi"))).alias("_hoop"))
    return balls.join(best, ["video", "row_id"]).select(*balls.columns, "_hoop.*")


def rim_marks(balls: DataFrame, rows: DataFrame, p: Picture) -> DataFrame:
    """balls with rim_distance, near_rim and remove_now (part of the rim beyond doubt)."""
    near = nearest_hoops(balls, rows, NEAR_FRAMES)
    box, hoop = tuple(F.col(c) for c in BOX), tuple(F.col(f"c_{c}") for c in BOX)
    size = F.greatest(F.col("c_x2") - F.col("c_x1"), F.col("c_y2") - F.col("c_y1"), F.lit(1.0))
    away = g.distance(F.col("x_center"), F.col("y_center"), F.col("c_x_center"), F.col("c_y_center"))
    share, inside = inside_share(box, hoop), inside_wider(F.col("x_center"), F.col("y_center"), hoop, 5.0 * p.scale)
    centred = away <= F.greatest(F.lit(22.0 * p.scale), size * 0.34)
    low = ~above_rim(F.col("y_center"), p) & (box_size(box) <= F.greatest(F.lit(52.0 * p.scale), size * 0.62))
    sure = (F.coalesce("confidence", F.lit(0.0)) < 0.16) & ((inside & (share >= 0.65)) | (centred & (share >= 0.50)))
    return near.select(*balls.columns, away.alias("rim_distance"), (low & (inside | centred) & (share >= 0.25)).alias("near_rim"), (low & sure).alias("remove_now"))


def clusters(marked: DataFrame, gap: int, name: str = "cluster") -> DataFrame:
    return sequences.gap_islands(marked, ["video"], "frame", "row_id", gap, name)


def spread(x: str = "x_center", y: str = "y_center") -> Column:
    return F.hypot(F.max(x) - F.min(x), F.max(y) - F.min(y))


def rim_clusters(marked: DataFrame, p: Picture, fps: float) -> DataFrame:
    """One row per cluster of balls near a rim: its frames, mean place, least rim distance, and whether it stands still."""
    near = clusters(marked.where("near_rim"), frames_of(fps, 0.45, 3))
    first = F.struct("frame", "row_id")
    out = near.groupBy("video", "cluster").agg(
        F.count("*").alias("n"), F.min("frame").alias("start"), F.max("frame").alias("end"), F.avg("x_center").alias("x"), F.avg("y_center").alias("y"), F.min("rim_distance").alias("least"), spread().alias("spread"),
        F.min_by("x_center", first).alias("first_x"), F.min_by("y_center", first).alias("first_y"),
    )
    lasts = F.col("end") - F.col("start") + 1
    short = (lasts >= frames_of(fps, 0.16, 4)) & (F.col("spread") <= 20.0 * p.scale)
    long = (lasts >= frames_of(fps, 0.42, 8)) & (F.col("spread") <= 38.0 * p.scale)
    return out.withColumn("static", (F.col("n") >= 3) & (short | long))


def _before(found: DataFrame, balls: DataFrame, rows: DataFrame, lookback: int) -> DataFrame:
    """(video, cluster, way): the balls up to `lookback` frames before each cluster, in order, as structs of frame, place
    and distance to their nearest hoop (null without one). A bounded number of frames, so a bounded array."""
    hooped = nearest_hoops(balls, rows, PRIOR_FRAMES)
    away = hooped.select("video", "row_id", g.distance(F.col("x_center"), F.col("y_center"), F.col("c_x_center"), F.col("c_y_center")).alias("away"))
    way = balls.select("video", "row_id", "frame", "x_center", "y_center").join(away, ["video", "row_id"], "left")
    block = lambda c: F.floor(c / lookback)
    left = found.select("video", "cluster", "start", F.explode(F.array(block(F.col("start")), block(F.col("start")) - 1)).alias("_block"))
    pairs = left.join(way.withColumn("_block", block(F.col("frame"))), ["video", "_block"]).where((F.col("frame") < F.col("start")) & (F.col("frame") >= F.col("start") - lookback))
    return pairs.groupBy("video", "cluster").agg(F.array_sort(F.collect_list(F.struct("frame", "row_id", F.col("x_center").alias("x"), F.col("y_center").alias("y"), "away"))).alias("way"))


def _high_arc(hooped: Column, p: Picture, fps: float) -> Column:
    """Did the ball come down to the cluster from a higher point shortly before."""
    top = F.aggregate(hooped, F.get(hooped, F.lit(0)), lambda a, w: F.when(w["y"] < a["y"], w).otherwise(a))
    gap = F.greatest(F.col("start") - top["frame"], F.lit(1))
    drop = F.col("y") - top["y"]
    moved = g.distance(F.col("x"), F.col("y"), top["x"], top["y"])
    return (F.size(hooped) >= 3) & (gap <= frames_of(fps, 1.6, 0)) & (drop >= 30.0 * p.scale) & ((moved >= 45.0 * p.scale) | (drop / gap >= 0.55 * p.scale))


def judged_clusters(marked: DataFrame, balls: DataFrame, rows: DataFrame, p: Picture, fps: float) -> DataFrame:
    """rim_clusters with shot_like (the ball came from afar or from above) and sudden (it jumped there)."""
    s = p.scale
    found = rim_clusters(marked, p, fps)
    far_back, near_back = frames_of(fps, 2.2, 18), frames_of(fps, 0.85, 8)
    out = found.join(_before(found, balls, rows, far_back), ["video", "cluster"], "left").withColumn("way", F.coalesce("way", F.array().cast("array<struct<frame:bigint,row_id:bigint,x:double,y:double,away:double>>")))
    hooped = F.filter("way", lambda w: w["away"].isNotNull())
    far = F.filter(hooped, lambda w: w["away"] >= F.col("least") + 55.0 * s)
    first = F.get(far, F.lit(0))
    gap = F.greatest(F.col("start") - first["frame"], F.lit(1))
    drop = first["away"] - F.col("least")
    speed = drop / gap
    moved = g.distance(F.col("first_x"), F.col("first_y"), first["x"], first["y"])
    last = F.get(hooped, F.size(hooped) - 1)
    comes = (F.size(far) > 0) & (drop >= 65.0 * s) & (last["away"] - F.col("least") >= 24.0 * s) & ((speed >= 1.35 * s) | (moved >= 85.0 * s)) & ((F.col("end") - F.col("start") + 1 <= frames_of(fps, 1.4, 0)) | (speed >= 2.0 * s))
    shot = (F.size("way") >= 3) & (F.size(hooped) >= 3) & (_high_arc(hooped, p, fps) | comes)

    recent = F.filter("way", lambda w: w["frame"] >= F.col("start") - near_back)
    seen = F.filter(recent, lambda w: w["away"].isNotNull())
    ago, ago_hooped = F.get(recent, F.size(recent) - 1), F.get(seen, F.size(seen) - 1)
    since = F.greatest(F.col("start") - ago["frame"], F.lit(1))
    jumped = g.distance(F.col("x"), F.col("y"), ago["x"], ago["y"]) >= F.greatest(F.lit(95.0 * s), 34.0 * s * since)
    sudden = (F.size(recent) > 0) & ~_high_arc(seen, p, fps) & (since <= frames_of(fps, 0.28, 8)) & jumped & (F.col("y") - ago["y"] < 25.0 * s) & ((F.size(seen) == 0) | (ago_hooped["away"] > F.col("least") + 55.0 * s))
    keep = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns({"shot_like": keep(shot), "sudden": keep(sudden)}).drop("way")


def static_edge_rows(balls: DataFrame, p: Picture, fps: float) -> DataFrame:
    """(video, row_id) of balls at the picture's edge in clusters that stand still with little confidence."""
    s = p.scale
    margin = F.greatest(F.lit(36.0 * s), box_size(tuple(F.col(c) for c in BOX)) * 1.2)
    x, y = F.col("x_center"), F.col("y_center")
    edge = clusters(balls.where((x <= margin) | (x >= p.width - margin) | (y <= margin) | (y >= p.height - margin)), frames_of(fps, 0.20, 2))
    sure = F.coalesce("confidence", F.lit(0.0))
    # the upper one of the two middle values
    per = edge.groupBy("video", "cluster").agg(F.count("*").alias("n"), F.avg(sure).alias("mean"), F.sort_array(F.collect_list(sure)).alias("all"), spread().alias("spread"), (F.max("x_center") - F.min("x_center")).alias("wide"), (F.max("y_center") - F.min("y_center")).alias("high"))
    middle = F.get("all", F.floor(F.col("n") / 2).cast("int"))
    most = 18.0 * s
    still = (F.col("spread") <= most) & ((F.col("mean") <= 0.24) | (middle <= 0.08))
    column = (F.col("n") >= 6) & (F.col("wide") <= most) & ((F.col("mean") <= 0.20) | (middle <= 0.06))
    line = (F.col("n") >= 5) & (F.col("high") <= most * 1.65) & (middle <= 0.10)
    bad = per.where((F.col("n") >= 4) & (still | column | line)).select("video", "cluster")
    return edge.join(bad, ["video", "cluster"], "left_semi").select("video", "row_id")


def contextless_rows(balls: DataFrame, rows: DataFrame, p: Picture, fps: float) -> DataFrame:
    """(video, row_id, ball_segment) of balls in long clusters that stand still with hardly a player near them."""
    s = p.scale
    them = rows.where("class = 'player'").select(F.col("video").alias("_v"), F.explode(F.sequence(F.col("frame") - 2, F.col("frame") + 2)).alias("_f"), *(F.col(c).alias(f"c_{c}") for c in BOX))
    beside = inside_wider(F.col("x_center"), F.col("y_center"), tuple(F.col(f"c_{c}") for c in BOX), 95.0 * s)
    near = balls.join(them, (F.col("video") == F.col("_v")) & (F.col("frame") == F.col("_f")) & beside, "left_semi").select("video", "row_id", F.lit(1).alias("_near"))
    runs = clusters(balls.where("x_center IS NOT NULL AND y_center IS NOT NULL"), frames_of(fps, 0.20, 2)).join(near, ["video", "row_id"], "left")
    per = runs.groupBy("video", "cluster").agg(F.count("*").alias("n"), spread().alias("spread"), F.count("_near").alias("beside"))
    bad = per.where((F.col("n") >= frames_of(fps, 0.28, 7)) & (F.col("spread") <= 24.0 * s) & (F.col("beside") / F.col("n") < 0.30))
    return runs.join(bad.select("video", "cluster"), ["video", "cluster"], "left_semi").select("video", "row_id", "ball_segment")


def false_rows(rows: DataFrame, p: Picture, fps: float) -> DataFrame:
    """(video, row_id) of the balls to take out. rows of all classes; ball_segment is used where it is not null: of a
    cluster that stands still its whole segments go, of a sudden one only its rows."""
    balls = rows.where("class = 'ball' AND frame IS NOT NULL")
    # each is read several times below; unwritten, the joins behind it are made anew each time
    alone = written(contextless_rows(balls, rows, p, fps))
    marked = written(rim_marks(balls, rows, p).where("near_rim OR remove_now"))
    near = clusters(marked.where("near_rim"), frames_of(fps, 0.45, 3)).select("video", "row_id", "cluster", "ball_segment")
    bad = judged_clusters(marked, balls, rows, p, fps).where("NOT shot_like AND (static OR sudden)").select("video", "cluster", "static")
    hit = written(near.join(bad, ["video", "cluster"]))
    whole = hit.where("static").select("video", "ball_segment").union(alone.select("video", "ball_segment")).where("ball_segment IS NOT NULL").distinct()
    out = marked.where("remove_now").select("video", "row_id").union(hit.select("video", "row_id")).union(static_edge_rows(balls, p, fps)).union(alone.select("video", "row_id"))
    return out.union(balls.join(whole, ["video", "ball_segment"], "left_semi").select("video", "row_id")).distinct()


def without_false_balls(rows: DataFrame, p: Picture, fps: float) -> DataFrame:
    rows = written(rows)
    return rows.join(written(false_rows(rows, p, fps)), ["video", "row_id"], "left_anti").select(*rows.columns)


def occlusion(balls: DataFrame, players: DataFrame, margin: float = 35.0, radius: float = 90.0) -> DataFrame:
    """balls with occluded_by_track_id and occlusion_distance: the nearest player of the frame whose box is within
    `margin` of the (predicted) place, or whose centre is within `radius` if he has no box."""
    boxed = F.lit(True)
    for c in BOX:
        boxed = boxed & F.col(f"_{c}").isNotNull()
    them = players.select(F.col("video").alias("_v"), F.col("frame").alias("_f"), F.col("row_id").alias("_i"), F.col("track_id").alias("_t"), *(F.col(c).alias(f"_{c}") for c in (*BOX, "x_center", "y_center")))
    pairs = balls.select("video", "frame", "row_id", "x_center", "y_center").join(them, (F.col("video") == F.col("_v")) & (F.col("frame") == F.col("_f")))
    away = F.when(boxed, g.box_distance(F.col("x_center"), F.col("y_center"), tuple(F.col(f"_{c}") for c in BOX))).otherwise(g.distance(F.col("x_center"), F.col("y_center"), F.col("_x_center"), F.col("_y_center")))
    near = pairs.withColumn("_away", away).where(F.col("_away") <= F.when(boxed, margin).otherwise(radius))
    best = near.groupBy("video", "row_id").agg(F.min_by(F.coalesce("_t", F.lit(-1)), F.struct("_away", "_i")).alias("occluded_by_track_id"), F.round(F.min("_away"), 2).alias("occlusion_distance"))
    return balls.join(best, ["video", "row_id"], "left").withColumn("occluded", F.col("occlusion_distance").isNotNull())


def stable_hoops(rows: DataFrame, choose, p: Picture, fps: float) -> DataFrame:
    """One hoop a frame, the best that `choose` (such as candidates.hoop_candidates) leaves, with straight lines between
    two that are near in time and place; adds hoop_status."""
    whole = rows.where("class = 'hoop' AND frame IS NOT NULL AND x_center IS NOT NULL AND y_center IS NOT NULL")
    best = choose(whole).withColumns({"track_id": F.lit(0).cast(rows.schema["track_id"].dataType), "confidence": F.coalesce("confidence", F.lit(0.0))})
    w = Window.partitionBy("video").orderBy("frame")
    numbers = ["x_center", "y_center", *BOX]
    nxt = best.withColumn("_next", F.lead(F.struct("frame", "confidence", *numbers)).over(w))
    gap = F.col("_next.frame") - F.col("frame")
    near = (gap <= (28 if fps >= 45 else 18)) & (g.distance(F.col("x_center"), F.col("y_center"), F.col("_next.x_center"), F.col("_next.y_center")) <= F.greatest(F.lit(130.0 * p.scale), gap * 9.0 * p.scale))
    out = nxt.withColumns({"_gap": gap, "_k": F.explode(F.sequence(F.lit(0), F.when(F.coalesce(near, F.lit(False)), gap - 1).otherwise(0).cast("int")))})
    made = F.col("_k") > 0
    line = {c: F.when(made, F.round(F.col(c) + (F.col(f"_next.{c}") - F.col(c)) * (F.col("_k") / F.col("_gap")), 2)).otherwise(F.col(c)) for c in numbers}
    sure = F.when(made, F.round(F.greatest(F.lit(0.03), F.least("confidence", F.col("_next.confidence")) * 0.85), 3)).otherwise(F.col("confidence"))
    out = out.withColumns(line | {"confidence": sure, "frame": F.col("frame") + F.col("_k"), "hoop_status": F.when(made, "Interpolated").otherwise("Detected")})
    return out.select(*rows.columns, "hoop_status")
