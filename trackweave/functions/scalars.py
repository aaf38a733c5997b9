"""Safe scalars: reading numbers, rounding as Python does, probabilities and losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Margin in points at which the odds of winning grow by e.
WIN_SCALE = 6.0


def number(c: Column) -> Column:
    """A finite double, else null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def whole(c: Column) -> Column:
    """A whole number, cut toward zero, else null."""
    return number(c).try_cast("long")


def flag(c: Column) -> Column:
    """Booleans as CSV files spell them."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0", "yes", "y", "t")



def elapsed_seconds(period: Column, left: Column) -> Column:
    """Game time that has passed: four periods of 720 s, then overtimes of 300 s."""
    return F.when(period <= 4, (period - 1) * 720.0 + (720.0 - left)).otherwise(4 * 720.0 + (period - 5) * 300.0 + (300.0 - left))


def win_probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin / WIN_SCALE))


def winner(margin: Column) -> Column:
    return F.when(margin > 0, "team_1").when(margin < 0, "team_2").otherwise("tie")


def winner_probability(margin: Column) -> Column:
    p = win_probability(margin)
    return F.when(margin > 0, p).when(margin < 0, 1 - p).otherwise(0.5)


def smooth_l1(difference: Column) -> Column:
    d = F.abs(difference)
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)


def capped_speed(step: Column, fps: float = 30.0, most: float = 12.0) -> Column:
    return F.least(step * fps, F.lit(most))
