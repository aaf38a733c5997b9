"""Play-by-play logs to model features: scores, sides, targets, codes, checks, splits and windows.

All of it is one shuffle by game: every window of a game shares its partitioning and order, so Spark sorts once. Games
are short (hundreds of rows), so a game is a natural unit of work and no game is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import sequences
from ..sources.tables import numbered, require_columns

REQUIRED = ["gameid", "period", "clock", "h_pts", "a_pts", "team", "type", "desc"]
NUMERIC = ["elapsed_game_sec", "period", "clock_sec_remaining", "current_home_points", "current_away_points", "team_side"]
TARGETS = ["remaining_home_points", "remaining_away_points"]
#: The event types that the score model reads.
ALLOWED = ["Block", "Steal", "Missed Shot", "Made Shot", "Foul", "Violation", "Jump Ball"]
#: Names as callers write them, without spaces and case, and as the log has them.
EVENT_ALIASES = {"missedshot": "Missed Shot", "madeshot": "Made Shot", "freethrow": "Free Throw", "jumpball": "Jump Ball"}


def canonical_event(name: str) -> str:
    return EVENT_ALIASES.get("".join(name.lower().split()), " ".join(name.split()))


def in_game_order() -> Window:
    return Window.partitionBy("gameid").orderBy("period", F.desc("clock_sec_remaining"), "row_id")


def scored(pbp: DataFrame) -> DataFrame:
    """Clock, running scores, sides and remaining points; games where a side never scores are left out."""
    require_columns(pbp, [*REQUIRED, "row_id"])
    w = in_game_order()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = pbp.withColumn("clock_sec_remaining", text.strict_iso_clock(F.trim("clock")))
    df = df.withColumns({f"current_{s}_points": F.max(F.coalesce(scalars.number(F.col(c)), F.lit(0.0))).over(so_far) for s, c in (("home", "h_pts"), ("away", "a_pts"))})
    gained = {s: F.col(f"current_{s}_points") > F.lag(f"current_{s}_points", 1, 0.0).over(w) for s in ("home", "away")}
    df = df.withColumns({f"_{s}": F.when(g & F.col("team").isNotNull(), F.col("team")) for s, g in gained.items()})
    # the team that scores most often for a side is that side; of equals the smallest code
    game = Window.partitionBy("gameid")
    df = df.withColumns({f"{s}_team": F.mode(f"_{s}", deterministic=True).over(game) for s in ("home", "away")}).where("home_team IS NOT NULL AND away_team IS NOT NULL")
    side = F.when(F.col("team") == F.col("home_team"), 1.0).when(F.col("team") == F.col("away_team"), 0.0).otherwise(0.5)
    df = df.withColumns({"team_side": side, "elapsed_game_sec": scalars.elapsed_seconds(F.col("period"), F.col("clock_sec_remaining")), **{f"remaining_{s}_points": F.last(f"current_{s}_points").over(whole) - F.col(f"current_{s}_points") for s in ("home", "away")}})
    name = text.event_name(F.col("type"), F.col("desc"))
    return df.withColumn("event_type", F.when(name == "", "Unknown").otherwise(name)).drop("_home", "_away")


def features(pbp: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """The feature table. Rows are filtered by event type only after scores and targets saw all rows; codes are those
    of the types that are left."""
    if allowed is not None and not allowed:
        raise ValueError("allowed must be None or name an event type")
    df = scored(pbp)
    if allowed is not None:
        df = df.where(F.col("event_type").isin(sorted({canonical_event(n) for n in allowed})))
    codes = sequences.dense_codes(df, "event_type", "event_type_id")  # a vocabulary: a few dozen rows
    df = df.join(codes, "event_type")
    return df.select("gameid", "row_id", "event_type", "event_type_id", *NUMERIC, *TARGETS)


def violations(df: DataFrame, filtered: bool = True) -> DataFrame:
    """One row of counts, all 0 for a sound feature table."""
    w = in_game_order()
    rows = df.withColumns({"_p": F.lag("period").over(w), "_c": F.lag("clock_sec_remaining").over(w), "_last": F.lead("row_id").over(w).isNull()})
    any_null = F.greatest(*(F.col(c).isNull() for c in [*NUMERIC, *TARGETS, "event_type_id"]))
    checks = {
        "n_null": any_null, "n_side": ~F.col("team_side").isin(0.0, 0.5, 1.0), "n_negative": F.least(*TARGETS) < 0, "n_period": F.col("_p") > F.col("period"),
        "n_clock": (F.col("_p") == F.col("period")) & (F.col("clock_sec_remaining") > F.col("_c")),
    }
    if not filtered:
        checks["n_last"] = F.col("_last") & (F.greatest(*TARGETS) != 0)
    return rows.agg(*(F.count_if(c).alias(n) for n, c in checks.items()))


def drop_games(df: DataFrame, bad: Column) -> DataFrame:
    """All rows of games without a row for which `bad` holds."""
    return df.join(df.where(bad).select("gameid").distinct(), "gameid", "left_anti")


def split_games(games: DataFrame, game: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(game, part): train, val and test by the numeric order of distinct ids, numbered without one task for all."""
    if not (train > 0 and val > 0 and train + val < 1):
        raise ValueError("shares must be positive and leave some for the test part")
    ids = numbered(games.select(game).distinct().withColumn("_order", F.col(game).cast("long")), ["_order", game], "_rank")
    total = ids.agg(F.max("_rank")).first()[0] or 0  # one number
    i, n = F.col("_rank") - 1, F.lit(total)
    first, second = F.floor(n * F.lit(train)), F.floor(n * F.lit(val))
    return ids.select(game, F.when(i < first, "train").when(i < first + second, "val").otherwise("test").alias("part"))


def windows(df: DataFrame, size: int = 20, stride: int = 5) -> DataFrame:
    """(gameid, window_start, event_type_id, num_features, target, seq_len) of every full window of a game; the target
    is that of the last event. Games with fewer events have none."""
    item = F.struct("event_type_id", F.array(*(F.col(c).cast("float") for c in NUMERIC)).alias("f"), F.array(*(F.col(c).cast("float") for c in TARGETS)).alias("y"))
    full = sequences.sliding_windows(df, ["gameid"], ["period", F.desc("clock_sec_remaining"), "row_id"], size, stride, item)
    return full.select(
        "gameid", F.col("window_start").cast("int").alias("window_start"), F.transform("items", lambda x: x["event_type_id"].cast("int")).alias("event_type_id"),
        F.transform("items", lambda x: x["f"]).alias("num_features"), F.element_at("items", -1)["y"].alias("target"), F.lit(size).alias("seq_len"),
    )
