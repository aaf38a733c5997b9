"""From detections of a video to cleaned, assigned rows: the tracking steps in their order.

Each step is a plan of its own; here they are only put together. Rows that several later steps read are written once to
the shared folder, and only the last rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import canonical_class, written
from . import association, ball_path, candidates, court, refiner, rims, tracking


def candidate_rows(detections: DataFrame, p: candidates.Picture, fps: float) -> DataFrame:
    """Detections with canonical classes, reduced to the candidates of each frame, hoops made steady."""
    rows = written(detections.withColumn("class", canonical_class(F.col("class"))))
    chosen = written(court.inside_picture(candidates.chosen(rows, p), p.width, p.height))
    hoops = rims.stable_hoops(chosen, lambda r: candidates.hoop_candidates(r, p), p, fps)
    # filled hoops have the row_id of the one before; their frame tells them apart
    return chosen.where("class <> 'hoop'").unionByName(hoops.drop("hoop_status"))


def tracked_ball(rows: DataFrame, max_gap: int = ball_path.MAX_GAP) -> DataFrame:
    """One ball a frame: association over frames, short gaps filled by parabolas, a filter over all frames, and the
    player who hides it where it is only predicted."""
    balls = rows.where("class = 'ball'")
    # each is read several times below, and the searches behind them are the work
    path = written(ball_path.parabolic(written(association.associate(balls)), max_gap))
    spine = path.groupBy("video").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).select("video", F.explode(F.sequence("a", "b")).alias("frame"))
    filtered = written(tracking.kalman(spine.join(path.select("video", "frame", "x_center", "y_center", "confidence"), ["video", "frame"], "left"), gravity=ball_path.USUAL_PULL))
    predicted = filtered.where("source = 'kalman_prediction'").select("video", "frame", F.col("frame").alias("row_id"), F.col("fx").alias("x_center"), F.col("fy").alias("y_center"))
    hidden = rims.occlusion(predicted, rows.where("class IN ('player', 'person')")).where("occluded").select("video", "frame", "occluded_by_track_id", "occlusion_distance")
    return filtered.join(hidden, ["video", "frame"], "left").withColumn("occluded", F.col("occlusion_distance").isNotNull())


def run(detections: DataFrame, width: int, height: int, fps: float, polygons: DataFrame | None = None) -> DataFrame:
    """detections(video, frame, row_id, class, confidence, x1..y2, x_center, y_center, track_id, agreement, bonus, sources)
    -> cleaned rows with teams, in order of frame, class and track."""
    p = candidates.Picture(width, height)
    limits = refiner.Limits.adaptive(width, height, fps)
    rows = candidate_rows(detections, p, fps)
    if polygons is not None:
        rows = court.on_moving_court(rows, polygons, width, height)
    kept = rims.without_false_balls(refiner.clean_rows(rows, limits), p, fps)
    teams = tracking.teams_by_place(kept)
    out = kept.join(teams, ["video", "track_id"], "left")
    team = F.when(F.col("class") == "player", F.coalesce("team_id", F.lit("")))
    return out.withColumns({"team_id": team, "team_name": F.when(F.col("class") == "player", F.when(F.col("team_id").isNull(), "unknown").otherwise(F.concat(F.lit("team_"), "team_id")))}).orderBy("video", "frame", "class", "track_id")
