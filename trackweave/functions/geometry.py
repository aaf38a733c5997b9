"""Column functions over points, boxes (x1, y1, x2, y2) and polygons (array of structs x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]

#: Edge lengths of a box drawn round a centre, by class; other classes get 40.
DEFAULT_SIZE = {"ball": 18.0, "player": 70.0, "referee": 70.0, "hoop": 80.0}


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def box_distance(x: Column, y: Column, box: Box) -> Column:
    """From a point to a rectangle, 0 inside."""
    l, t, r, b = box
    zero = F.lit(0.0)
    return F.hypot(F.greatest(l - x, zero, x - r), F.greatest(t - y, zero, y - b))


def area(box: Box) -> Column:
    l, t, r, b = box
    return F.greatest(r - l, F.lit(0.0)) * F.greatest(b - t, F.lit(0.0))


def any_box() -> Box:
    """The box of a row that has it as an array `bbox`, as x1..y2, or as left, top, width and height."""
    whole = F.size("bbox") >= 4
    corner = lambda i: F.when(whole, F.get("bbox", F.lit(i)))
    return (
        F.coalesce(corner(0), F.col("x1"), F.col("left")), F.coalesce(corner(1), F.col("y1"), F.col("top")),
        F.coalesce(corner(2), F.col("x2"), F.col("left") + F.col("width")), F.coalesce(corner(3), F.col("y2"), F.col("top") + F.col("height")),
    )


def overlap(a: Box, b: Box) -> Column:
    """Area that two boxes share."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def overlap_share(a: Box, b: Box) -> Column:
    """Share of the smaller box."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap(a, b) / F.nullif(least, F.lit(0.0))).otherwise(0.0)


def side(box: Box) -> Column:
    return F.greatest(F.abs(box[2] - box[0]), F.abs(box[3] - box[1]))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def ball_size(box: Box) -> Column:
    return clip(side(box), 8, 40)


def default_size(kind: Column) -> Column:
    sizes = F.create_map(*(F.lit(v) for kv in DEFAULT_SIZE.items() for v in kv))
    return F.coalesce(F.try_element_at(sizes, F.lower(kind)), F.lit(40.0))


def centred_box(kind: Column, x: Column, y: Column) -> Box:
    half = default_size(kind) / 2
    return tuple(F.round(c, 2) for c in (x - half, y - half, x + half, y + half))


def anchor(kind: Column, box: Box) -> tuple[Column, Column]:
    """Where a box stands: people at the middle of their lower edge, others at the centre."""
    l, t, r, b = box
    return (l + r) / 2, F.when(F.lower(kind).isin("player", "referee", "person"), b).otherwise((t + b) / 2)


def once(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression that occurs n times in a function of arrays is computed n
    times, and nested ones multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def polygon(points: list[tuple[float, float]]) -> Column:
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def edges(poly: Column) -> Column:
    """array<struct<a, b>> of a polygon's edges, the closing one too."""

    def pairs(p: Column) -> Column:
        shifted = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
        return F.transform(F.arrays_zip(p.alias("a"), shifted.alias("b")), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b")))

    return once(poly, pairs)


def segment_distance(x: Column, y: Column, edge: Column) -> Column:
    ax, ay = edge["a"]["x"], edge["a"]["y"]
    dx, dy = edge["b"]["x"] - ax, edge["b"]["y"] - ay
    length = dx * dx + dy * dy
    t = F.coalesce(((x - ax) * dx + (y - ay) * dy) / F.nullif(length, F.lit(0.0)), F.lit(0.0))
    t = clip(t, 0, 1)
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def polygon_distance(x: Column, y: Column, poly: Column) -> Column:
    """To the nearest edge."""
    return F.array_min(F.transform(edges(poly), lambda e: segment_distance(x, y, e)))


def crosses(x: Column, y: Column, edge: Column) -> Column:
    """Does a ray from the point to the right cross the edge."""
    ay, by = edge["a"]["y"], edge["b"]["y"]
    at = edge["a"]["x"] + (y - ay) * (edge["b"]["x"] - edge["a"]["x"]) / F.nullif(by - ay, F.lit(0.0))
    return ((ay > y) != (by > y)) & F.coalesce(x < at, F.lit(False))


def in_polygon(x: Column, y: Column, poly: Column, margin: float = 0.0, edge_width: float = 1e-6) -> Column:
    """Inside by ray casting, on the boundary, or within `margin` of it."""
    odd = F.aggregate(edges(poly), F.lit(False), lambda acc, e: acc != crosses(x, y, e))
    return odd | (polygon_distance(x, y, poly) <= max(margin, edge_width))


def polygon_area(poly: Column) -> Column:
    cross = F.transform(edges(poly), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2


def scale_polygon(poly: Column, width: Column | float, height: Column | float) -> Column:
    """Normalised points to pixels."""
    return F.transform(poly, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y")))


def expand_polygon(poly: Column, factor: float) -> Column:
    """Away from the mean of the corners."""

    def grown(p: Column) -> Column:
        mean = lambda c: F.aggregate(p, F.lit(0.0), lambda a, v: a + v[c]) / F.size(p)
        wider = lambda m: F.transform(p, lambda v: F.struct((m["x"] + (v["x"] - m["x"]) * factor).alias("x"), (m["y"] + (v["y"] - m["y"]) * factor).alias("y")))
        return once(F.struct(mean("x").alias("x"), mean("y").alias("y")), wider)

    return once(poly, grown)


def clamp_polygon(poly: Column, width: float, height: float) -> Column:
    return F.transform(poly, lambda p: F.struct(clip(p["x"], 0, width - 1).alias("x"), clip(p["y"], 0, height - 1).alias("y")))


def hull(poly: Column) -> Column:
    """Convex hull, counter-clockwise from the leftmost point. One chain after the other over the sorted points."""
    points = F.array_sort(F.array_distinct(poly))
    kind = "array<struct<x:double,y:double>>"
    turn = lambda o, a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])

    def chain(items: Column) -> Column:
        def push(acc: Column, p: Column) -> Column:
            # points of the chain that stay when p comes: up to the last one that still turns left before it
            left = F.filter(F.sequence(F.lit(2), F.greatest(F.size(acc), F.lit(2))), lambda i: (i <= F.size(acc)) & (turn(F.try_element_at(acc, i - 1), F.try_element_at(acc, i), p) > 0))
            stay = F.when(F.size(acc) < 2, F.size(acc)).otherwise(F.coalesce(F.array_max(left), F.lit(1)))
            return F.concat(F.slice(acc, F.lit(1), stay), F.array(p))

        return F.aggregate(items, F.array().cast(kind), push)

    drop_last = lambda c: once(c, lambda v: F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))))
    return once(points, lambda p: F.when(F.size(p) < 3, p).otherwise(F.concat(drop_last(chain(p)), drop_last(chain(F.reverse(p))))))
