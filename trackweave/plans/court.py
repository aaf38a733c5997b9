"""Rows on the court: a polygon per video that moves with the camera, margins and anchors by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import asof

# The court of a broadcast picture (shares of width and height), and how far off it a class may be.
DEFAULT_COURT = [(0.05, 0.30), (0.95, 0.30), (1.00, 0.98), (0.00, 0.98)]
DEFAULT_MARGIN = {"ball": 260.0, "sports ball": 260.0, "basketball": 260.0, "frisbee": 260.0}
FEET = ("person", "player", "referee")


def anchor(anchor_of: str, kind: Column) -> tuple[Column, Column]:
    """Where a row stands: center, bottom_center, top_center or bbox_center; `by_class` takes people at their feet."""
    x, y = F.col("x_center"), F.col("y_center")
    places = {
        "center": (x, y), "bottom_center": (x, F.coalesce("y2", y)), "top_center": (x, F.coalesce("y1", y)),
        "bbox_center": (F.coalesce((F.col("x1") + F.col("x2")) / 2, x), F.coalesce((F.col("y1") + F.col("y2")) / 2, y)),
        "by_class": (x, F.when(kind.isin(*FEET), F.coalesce("y2", y)).otherwise(y)),
    }
    return places[anchor_of]


def default_polygon(width: int, height: int) -> Column:
    return g.scale_polygon(g.polygon(DEFAULT_COURT), float(width), float(height))


def on_court(rows: DataFrame, polygon: Column, margin: float = 8.0, margins: dict[str, float] | None = None) -> DataFrame:
    """Rows whose anchor is in the polygon, on its edge, or within the margin of their class; adds inside_court. Rows
    without a place are not on the court."""
    wide = F.create_map(*(F.lit(v) for kv in (DEFAULT_MARGIN | (margins or {})).items() for v in kv))
    x, y = anchor("by_class", F.col("class"))
    marked = rows.withColumns({"_x": x, "_y": y, "_polygon": polygon, "_margin": F.coalesce(F.try_element_at(wide, F.col("class")), F.lit(margin))})
    inside = g.in_polygon(F.col("_x"), F.col("_y"), F.col("_polygon")) | (g.polygon_distance(F.col("_x"), F.col("_y"), F.col("_polygon")) <= F.col("_margin"))
    return marked.where(F.coalesce(inside, F.lit(False))).select(*rows.columns, F.lit(True).alias("inside_court"))


def on_moving_court(rows: DataFrame, polygons: DataFrame, width: int, height: int, margin: float = 12.0, margins: dict[str, float] | None = None) -> DataFrame:
    """polygons(video, frame, polygon), one now and then: each row is judged by the last one up to its frame, by the
    default court before the first."""
    kept = asof.asof_join(rows, polygons, ["video"], "frame", "frame", {"polygon": "_court"})
    found = on_court(kept, F.coalesce("_court", default_polygon(width, height)), margin, margins)
    return found.select(*rows.columns, "inside_court")


def inside_picture(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Without balls whose centre is missing or outside of the picture; other classes pass."""
    ok = F.coalesce(F.col("x_center").between(0, width) & F.col("y_center").between(0, height), F.lit(False))
    return rows.where((F.col("class") != "ball") | ok)
