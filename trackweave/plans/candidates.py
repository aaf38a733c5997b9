"""Choice of detection candidates in each frame: shape rules, quality, duplicates, false balls and context.

Rows have video, frame, row_id, class, confidence, the box x1..y2 and its centre x_center, y_center; balls may have
agreement (models that agree), bonus (priority of the model) and sources (array). Rules between rows of a frame are
equi-joins on (video, frame); the only arrays are the candidates of one class in one frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import sequences

KEYS = ["video", "frame"]
BOX = ("x1", "y1", "x2", "y2")

# Limits of the candidate rules.
BALL_AREA, BALL_AREA_PX, BALL_SIDE, BALL_ASPECT = 0.0032, 5200.0, 95.0, (0.45, 2.2)
HOOP_LEAST, HOOP_LOWEST, HOOP_OUTSIDE, HOOP_AREA, HOOP_SIDE, HOOP_ASPECT = 4.0, 0.78, 0.03, 0.035, 0.23, (0.25, 4.5)
PLAYER_LEAST, PLAYER_MOST, PLAYER_AREA, PLAYER_ASPECT = (10.0, 22.0), (0.38, 0.95), (0.00018, 0.22), (0.12, 1.35)
TOP_BALLS, TOP_HOOPS, TOP_PLAYERS = 12, 4, 18
BODY_CORE = ((0.12, 0.88), (0.10, 0.70))
RESCUE_MARGIN = {"hoop": 250.0, "player": 185.0, "referee": 185.0}


@dataclass(frozen=True)
class Picture:
    width: int
    height: int

    @property
    def scale(self) -> float:
        return max(0.85, min(1.45, max(self.width, self.height) / 1280.0))

    @property
    def area(self) -> float:
        return float(self.width * self.height)


def _size() -> tuple[Column, Column]:
    return F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")


def _aspect() -> Column:
    w, h = _size()
    return w / F.greatest(h, F.lit(1.0))


def has_box() -> Column:
    out = F.lit(True)
    for c in BOX:
        out = out & F.col(c).isNotNull() & ~F.isnan(c)
    return out


def box_size(box: g.Box) -> Column:
    return F.greatest(F.abs(box[2] - box[0]), F.abs(box[3] - box[1]))


# provenance and geometry of records


def annotate(rows: DataFrame, model: str, bonus: float) -> DataFrame:
    """Which model a ball comes from; one model agrees with itself."""
    return rows.withColumns({"source": F.lit(model), "sources": F.array(F.lit(model)), "bonus": F.lit(float(bonus)), "agreement": F.lit(1)})


def shifted(rows: DataFrame, dx: float, dy: float) -> DataFrame:
    """Boxes of a crop in the whole picture, two decimals."""
    return rows.withColumns({c: F.round(F.col(c) + (dx if c[0] == "x" else dy), 2) for c in ("x_center", "y_center", *BOX)})


def attenuated(rows: DataFrame, share: float = 0.35, most: float = 0.07) -> DataFrame:
    """Confidence of rescue passes, which count little."""
    return rows.withColumn("confidence", F.round(F.least(F.lit(most), F.coalesce("confidence", F.lit(0.0)) * share), 3))


def inside_wider(x: Column, y: Column, box: g.Box, margin: Column | float) -> Column:
    return x.between(box[0] - margin, box[2] + margin) & y.between(box[1] - margin, box[3] + margin)


# shape rules


def ball_shaped(p: Picture) -> Column:
    w, h = _size()
    return (w > 3) & (h > 3) & (w * h <= min(p.area * BALL_AREA, BALL_AREA_PX * p.scale**2)) & (F.greatest(w, h) <= BALL_SIDE * p.scale) & _aspect().between(*BALL_ASPECT)


def hoop_shaped(p: Picture) -> Column:
    w, h = _size()
    fits = (w > HOOP_LEAST * p.scale) & (h > HOOP_LEAST * p.scale) & (w * h <= p.area * HOOP_AREA) & (F.greatest(w, h) <= max(p.width, p.height) * HOOP_SIDE) & _aspect().between(*HOOP_ASPECT)
    return fits & (F.col("y_center") <= p.height * HOOP_LOWEST) & F.col("x_center").between(-p.width * HOOP_OUTSIDE, p.width * (1 + HOOP_OUTSIDE))


def player_shaped(p: Picture) -> Column:
    w, h = _size()
    fits = (w > PLAYER_LEAST[0] * p.scale) & (h > PLAYER_LEAST[1] * p.scale) & (w <= p.width * PLAYER_MOST[0]) & (h <= p.height * PLAYER_MOST[1])
    return fits & (w * h).between(p.area * PLAYER_AREA[0], p.area * PLAYER_AREA[1]) & _aspect().between(*PLAYER_ASPECT)


# quality


def ball_quality(of=F.col) -> Column:
    """Of a row, or of a struct through `of`."""
    w, h = of("x2") - of("x1"), of("y2") - of("y1")
    aspect = F.abs(1 - w / F.greatest(h, F.lit(1.0)))
    # added in this order, as near-equal sums decide ranks
    return of("confidence") + 0.035 * F.greatest(of("agreement") - 1, F.lit(0)) + of("bonus") - aspect * 0.08 - F.greatest(F.greatest(w * h, F.lit(1.0)) - 1600, F.lit(0.0)) / 8000


def hoop_quality(p: Picture) -> Column:
    w, h = (F.greatest(c, F.lit(1.0)) for c in _size())
    upper = F.greatest((p.height * 0.65 - F.col("y_center")) / max(1.0, p.height), F.lit(0.0)) * 0.04
    return F.col("confidence") + upper - F.abs(1.25 - w / h) * 0.025 - F.greatest(w * h / max(1.0, p.area) - 0.006, F.lit(0.0)) * 6


def player_quality() -> Column:
    """Tracked players count more; track 0 counts as untracked."""
    w, h = (F.greatest(c, F.lit(1.0)) for c in _size())
    return F.col("confidence") + F.when(F.col("track_id") > 0, 0.10).otherwise(0.0) - F.abs(0.42 - w / h) * 0.035


# duplicates


def _folded(rows: DataFrame, quality: Column, same, merge) -> DataFrame:
    """Per video and frame, best first: a row joins the first kept row that it duplicates, or is kept. A frame has few
    candidates of a class."""
    every = F.array_sort(F.collect_list(F.struct((-quality).alias("o"), F.col("row_id").alias("i"), F.struct(*rows.columns).alias("r"))))
    frames = rows.groupBy(*KEYS).agg(F.transform(every, lambda s: s["r"]).alias("all"))

    def put(kept: Column, row: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: same(row, k)), True)
        return F.when(hit > 0, F.transform(kept, lambda k, i: F.when(i + 1 == hit, merge(row, k)).otherwise(k))).otherwise(F.concat(kept, F.array(row)))

    kept = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.slice("all", 1, 1), put)
    return frames.select(F.posexplode(kept).alias("nth", "r")).select("r.*", "nth")


def _struct_box(s: Column) -> g.Box:
    return tuple(s[c] for c in BOX)


def merged_balls(rows: DataFrame) -> DataFrame:
    """Balls of a frame that overlap or lie next to each other become one: the better row, with the sources of both, the
    greater confidence and something for each model that agrees; `nth` is its rank in the frame."""

    def same(a: Column, b: Column) -> Column:
        near = F.greatest(F.lit(10.0), box_size(_struct_box(a)) * 0.65, box_size(_struct_box(b)) * 0.65)
        return (g.iou(_struct_box(a), _struct_box(b)) > 0.45) | (g.distance(a["x_center"], a["y_center"], b["x_center"], b["y_center"]) <= near)

    def merge(a: Column, b: Column) -> Column:
        sources = F.array_sort(F.array_union(a["sources"], b["sources"]))
        best = F.when(ball_quality(lambda c: a[c]) >= ball_quality(lambda c: b[c]), a).otherwise(b)
        sure = F.round(F.least(F.lit(0.99), F.greatest(a["confidence"], b["confidence"]) + 0.04 * F.greatest(F.size(sources) - 1, F.lit(0))), 3)
        changed = {"confidence": sure, "sources": sources, "agreement": F.size(sources), "bonus": F.greatest(a["bonus"], b["bonus"])}
        return F.struct(*((changed[c] if c in changed else best[c]).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))

    return _folded(rows, ball_quality(), same, merge)


def distinct_hoops(rows: DataFrame, p: Picture) -> DataFrame:
    same = lambda a, b: (g.iou(_struct_box(a), _struct_box(b)) > 0.35) | (g.distance(a["x_center"], a["y_center"], b["x_center"], b["y_center"]) <= 28.0 * p.scale)
    return _folded(rows, hoop_quality(p), same, lambda a, b: b)


# false balls and context


def _context(rows: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    found = rows.where(F.col("class").isin(*classes) & has_box())
    return found.select(*(F.col(k).alias(f"c_{k}") for k in KEYS), F.col("class").alias("c_class"), *(F.col(c).alias(f"c_{c}") for c in (*BOX, "x_center", "y_center")))


def _with_context(balls: DataFrame, rows: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    return balls.join(_context(rows, classes), (F.col("video") == F.col("c_video")) & (F.col("frame") == F.col("c_frame")))




def _context_box() -> g.Box:
    return tuple(F.col(f"c_{c}") for c in BOX)


def above_rim(y: Column, p: Picture) -> Column:
    """Higher than the rim's zone, where a shot's arc is."""
    h = F.greatest(F.col("c_y2") - F.col("c_y1"), F.lit(1.0))
    return y < F.col("c_y_center") - F.greatest(F.lit(8.0 * p.scale), h * 0.2)


def inside_share(box: g.Box, other: g.Box) -> Column:
    """Share of the box that lies in the other one."""
    return F.when(g.area(box) > 0, g.overlap(box, other) / F.nullif(g.area(box), F.lit(0.0))).otherwise(0.0)


def rim_false(p: Picture) -> Column:
    """Is a ball of little confidence part of the hoop it is joined with."""
    box, hoop = tuple(F.col(c) for c in BOX), _context_box()
    w, h = F.col("c_x2") - F.col("c_x1"), F.col("c_y2") - F.col("c_y1")
    size, ball = F.greatest(w, h), box_size(box)
    share = inside_share(box, hoop)
    centred = g.distance(F.col("x_center"), F.col("y_center"), F.col("c_x_center"), F.col("c_y_center")) <= F.greatest(F.lit(18.0 * p.scale), size * 0.28)
    weak = (F.col("confidence") < 0.06) & inside_wider(F.col("x_center"), F.col("y_center"), hoop, 3.0 * p.scale) & (share >= 0.70) & (ball <= F.greatest(F.lit(42.0 * p.scale), size * 0.48))
    middle = (F.col("confidence") < 0.10) & centred & (share >= 0.88) & (ball <= F.greatest(F.lit(54.0 * p.scale), size * 0.62))
    return (w > 6) & (h > 6) & ~above_rim(F.col("y_center"), p) & (weak | middle)


def body_false(p: Picture) -> Column:
    """Does the centre lie in the core of the player it is joined with, and is the ball not sure enough to stay."""
    w, h = (F.greatest(F.abs(F.col(f"c_{c}2") - F.col(f"c_{c}1")), F.lit(1.0)) for c in "xy")
    core = ((F.col("x_center") - F.col("c_x1")) / w).between(*BODY_CORE[0]) & ((F.col("y_center") - F.col("c_y1")) / h).between(*BODY_CORE[1])
    sure = (F.col("confidence") >= 0.62) | ((F.col("agreement") >= 2) & (F.col("confidence") >= 0.25))
    return inside_wider(F.col("x_center"), F.col("y_center"), _context_box(), 4.0 * p.scale) & core & ~sure


def false_balls(rows: DataFrame, p: Picture) -> DataFrame:
    """(video, row_id, reason) of the balls that are part of a hoop or of a player's body."""
    balls = rows.where(F.col("class") == "ball")
    hoop = _with_context(balls, rows, ("hoop",)).where(rim_false(p)).select("video", "row_id", F.lit("hoop").alias("reason"))
    body = _with_context(balls, rows, ("player", "person")).where(body_false(p)).select("video", "row_id", F.lit("body").alias("reason"))
    return hoop.union(body).distinct()


def near_context(balls: DataFrame, rows: DataFrame, p: Picture, reach: float = 1.0) -> DataFrame:
    """Balls of a rescue pass that lie near a player, referee or hoop of their frame, and not at the top; `reach`
    multiplies the usual margins."""
    margin = F.when(F.col("c_class") == "hoop", RESCUE_MARGIN["hoop"]).otherwise(RESCUE_MARGIN["player"]) * (p.scale * reach)
    hit = _with_context(balls.where(F.col("y_center") >= p.height * 0.08), rows, tuple(RESCUE_MARGIN)).where(inside_wider(F.col("x_center"), F.col("y_center"), _context_box(), margin))
    return balls.join(hit.select("video", "row_id").distinct(), ["video", "row_id"], "left_semi").select(*balls.columns)


# the candidates of a class


def ball_candidates(rows: DataFrame, p: Picture) -> DataFrame:
    """Balls of a plausible shape that are not part of a hoop or body, duplicates merged, the best of each frame."""
    shaped = rows.where((F.col("class") == "ball") & ball_shaped(p)).join(false_balls(rows, p).select("video", "row_id").distinct(), ["video", "row_id"], "left_anti").select(*rows.columns)
    return merged_balls(shaped).where(F.col("nth") < TOP_BALLS).drop("nth")


def hoop_candidates(rows: DataFrame, p: Picture) -> DataFrame:
    return distinct_hoops(rows.where((F.col("class") == "hoop") & has_box() & hoop_shaped(p)), p).where(F.col("nth") < TOP_HOOPS).drop("nth")


def distinct_players(rows: DataFrame, p: Picture) -> DataFrame:
    """For rescue passes: players of a frame that stand apart from each other, the best 14."""
    same = lambda a, b: (g.iou(_struct_box(a), _struct_box(b)) > 0.42) | (g.distance(a["x_center"], a["y_center"], b["x_center"], b["y_center"]) <= 32.0 * p.scale)
    return _folded(rows, player_quality(), same, lambda a, b: b).where(F.col("nth") < 14).drop("nth")


def player_candidates(rows: DataFrame, p: Picture) -> DataFrame:
    fits = rows.where((F.col("class") == "player") & has_box() & player_shaped(p))
    return sequences.top_k(fits, KEYS, [player_quality().desc(), F.col("row_id")], TOP_PLAYERS)


def replace_class(base: DataFrame, rescued: DataFrame, kind: str, choose) -> DataFrame:
    """The base without a class, and what `choose` takes of that class in base and rescue rows together."""
    both = base.where(F.col("class") == kind).unionByName(rescued.where(F.col("class") == kind))
    return base.where(F.col("class") != kind).unionByName(choose(both))


def chosen(rows: DataFrame, p: Picture) -> DataFrame:
    """All candidates that later steps read: balls, hoops, players, and the other classes as they are."""
    other = rows.where(~F.col("class").isin("ball", "hoop", "player"))
    return other.unionByName(ball_candidates(rows, p)).unionByName(hoop_candidates(rows, p)).unionByName(player_candidates(rows, p))
