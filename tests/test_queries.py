"""Every query with SQL gives the rows that DuckDB gives; every other one runs with a stable schema."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from trackweave.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    value = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) or v is pd.NA else (round(float(v), 5) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v))
    return sorted((tuple(value(v) for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"game_summary", "game_cumulative", "game_events"}))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())


def test_nearest_in_group_odd_values(spark):
    """Equal distances on both sides, copies, values one rounding apart, NaN, infinities and nulls: as all pairs say."""
    from pyspark.sql import functions as F

    from trackweave.operators import asof

    bals = [0.0, -0.0, 1.0, 3.0, 3.0, 2.0, 0.3, 0.30000000000000004, 1000.0, float("nan"), float("inf"), float("-inf"), None]
    left = spark.createDataFrame([(i * 20 + g, g, v) for i, v in enumerate(bals) for g in (1, 2, 3, 4)] + [(900, None, 1.0), (901, 9, 1.0)], "c long, g int, v double")
    right = spark.createDataFrame([(100 - i, 1, v) for i, v in enumerate(bals)] + [(200 + i, 2, v) for i, v in enumerate((4.0, 2.0, 2.0, 0.0))] + [(300, 3, None), (301, 3, float("nan"))] + [(401, 4, None), (400, 4, None), (500, None, 1.0)], "s long, h int, w double")
    got = asof.nearest_in_group(left, right, "g", "v", "h", "w", "s", "nearest")
    away = F.abs(F.col("v") - F.col("w"))
    every = left.join(right, F.col("g") == F.col("h")).groupBy("c").agg(F.min(F.struct(away.isNull().alias("n"), away.alias("a"), "s"))["s"].alias("nearest"))
    assert sorted(map(tuple, got.select("c", "nearest").collect())) == sorted(map(tuple, every.collect()))


def leaves(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_false_balls_are_found_once(spark):
    """What several steps read is written, so the plan that is left has the rows and the false ones."""
    assert leaves(QUERIES["without_false_balls"](spark, SF)) == 2


def test_pipeline_reads_written_steps(spark):
    """Only the last rows are sorted, and no step before it is made anew for the teams."""
    df = QUERIES["tracking_pipeline"](spark, SF)
    assert leaves(df) <= 4


def test_cumulative_reads_written_rows(spark):
    """The report scans no table anew: all its leaves are written steps."""
    plan = QUERIES["game_cumulative"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "user_id" not in plan
