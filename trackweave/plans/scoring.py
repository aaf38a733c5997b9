"""Forecasts of final scores: events matched to the score timeline, the last events seen at each timeline row, a
sequence model over them, and what follows from current and remaining points.

The model is an embedding of the event type beside six numbers, two LSTM layers and a two-layer head, in numpy. Weights
are a dict of arrays (init_weights gives seeded ones, load_weights reads an .npz); it is sent to the workers as a
whole, about 1 MB, and runs on Arrow batches.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import asof
from .play_by_play import NUMERIC

#: Events that video analysis finds, and the model's names for them; others are not read.
EVENT_TYPES = {"shot_made": "Made Shot", "shot_missed": "Missed Shot", "steal_or_block": "Steal"}
WINDOW, HIDDEN, EMBEDDING, LAYERS = 20, 128, 16, 2
SCORE = ["current_home_points", "current_away_points", "period", "clock_sec_remaining"]


def init_weights(vocabulary: int, hidden: int = HIDDEN, seed: int = 42) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"embedding": rng.normal(0, 0.1, (vocabulary, EMBEDDING))}
    for layer in range(LAYERS):
        n = EMBEDDING + len(NUMERIC) if layer == 0 else hidden
        k = 1 / np.sqrt(hidden)
        w |= {f"in{layer}": rng.uniform(-k, k, (n, 4 * hidden)), f"rec{layer}": rng.uniform(-k, k, (hidden, 4 * hidden)), f"bias{layer}": rng.uniform(-k, k, 4 * hidden)}
    w |= {"head0": rng.normal(0, hidden**-0.5, (hidden, hidden // 2)), "head0_bias": np.zeros(hidden // 2), "head1": rng.normal(0, (hidden // 2) ** -0.5, (hidden // 2, 2)), "head1_bias": np.zeros(2)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def lstm(weights: dict[str, np.ndarray], ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """(batch, 2) remaining points for ids (batch, steps) and numbers (batch, steps, 6)."""
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    x = np.concatenate([weights["embedding"][ids], numbers.astype(np.float32)], 2)
    for layer in range(LAYERS):
        k = weights[f"rec{layer}"].shape[0]
        h = c = np.zeros((len(x), k), np.float32)
        out = []
        for t in range(x.shape[1]):
            g = x[:, t] @ weights[f"in{layer}"] + h @ weights[f"rec{layer}"] + weights[f"bias{layer}"]
            i, f, o = (sigmoid(g[:, j * k : (j + 1) * k]) for j in (0, 1, 3))
            c = f * c + i * np.tanh(g[:, 2 * k : 3 * k])
            h = o * np.tanh(c)
            out.append(h)
        x = np.stack(out, 1)
    return np.maximum(x[:, -1] @ weights["head0"] + weights["head0_bias"], 0) @ weights["head1"] + weights["head1_bias"]


def predict(windows: DataFrame, weights: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """Columns `keep` and rem_home, rem_away for rows with event_type_id array<int> and num_features array<array<float>>;
    rows of one window length make one batch."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros((len(pdf), 2))
            size = pdf["event_type_id"].map(len).to_numpy()
            for n in np.unique(size[size > 0]):
                at = np.flatnonzero(size == n)
                ids = np.stack([np.asarray(v) for v in pdf["event_type_id"].iloc[at]])
                numbers = np.stack([np.stack([np.asarray(r, np.float32) for r in v]) for v in pdf["num_features"].iloc[at]])
                out[at] = lstm(weights, ids, numbers)
            yield pdf[keep].assign(rem_home=out[:, 0], rem_away=out[:, 1])

    return windows.select(*keep, "event_type_id", "num_features").mapInPandas(run, f"{fields}, rem_home double, rem_away double")


def match_scores(events: DataFrame, timeline: DataFrame, game: str = "game") -> DataFrame:
    """events(game, event_id, time_sec, event_type, team_id) with the score, period and clock of the last timeline row
    up to them; those before the first row take the next known ones, those of games without a timeline defaults."""
    usable = timeline.dropna(subset=["time_sec", "period", "clock_sec_remaining", "team1_score", "team2_score"])
    take = {"team1_score": SCORE[0], "team2_score": SCORE[1], "period": SCORE[2], "clock_sec_remaining": SCORE[3]}
    df = asof.asof_join(events.where(F.col("time_sec").isNotNull()), usable, [game], "time_sec", "time_sec", take)
    w = Window.partitionBy(game).orderBy("time_sec", "event_id").rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumns({c: F.coalesce(F.first(c, ignorenulls=True).over(w).cast("double"), F.lit(d)) for c, d in zip(SCORE, (0.0, 0.0, 1.0, 720.0), strict=True)})
    team = text.clean_team_id(F.col("team_id"))
    return df.withColumns({"team_side": F.when(team == "1", 1.0).when(team == "2", 0.0).otherwise(0.5), "elapsed_game_sec": scalars.elapsed_seconds(F.col("period"), F.col("clock_sec_remaining"))})


def event_codes(events: DataFrame, codes: dict[str, int]) -> DataFrame:
    """Only the events that the model knows, with event_type_id."""
    pairs = {k: codes[v] for k, v in EVENT_TYPES.items() if v in codes}
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return events.withColumn("event_type_id", F.try_element_at(table, F.col("event_type"))).where(F.col("event_type_id").isNotNull())


def seen_windows(events: DataFrame, timeline: DataFrame, game: str = "game", size: int = WINDOW) -> DataFrame:
    """Timeline rows with the last `size` coded events up to their time; rows before the first event are left out."""
    w = Window.partitionBy(game).orderBy("time_sec", "event_id").rowsBetween(-(size - 1), 0)
    item = F.struct("event_type_id", F.array(*(F.col(c).cast("float") for c in NUMERIC)).alias("f"))
    rolled = events.select(game, "time_sec", "event_id", F.collect_list(item).over(w).alias("items"))
    rows = asof.asof_join(timeline, rolled, [game], "time_sec", "time_sec", {"items": "items"}, tie="event_id")
    rows = rows.where(F.size("items") > 0)
    return rows.withColumns({"event_type_id": F.transform("items", lambda x: x["event_type_id"]), "num_features": F.transform("items", lambda x: x["f"]), "n_events_used": F.size("items")}).drop("items")


def forecast(events: DataFrame, timeline: DataFrame, codes: dict[str, int], weights: dict[str, np.ndarray], game: str = "game") -> DataFrame:
    """One row for each timeline row that has seen an event: current, remaining and final points, margin, winner."""
    usable = timeline.dropna(subset=["time_sec", "period", "clock_sec_remaining", "team1_score", "team2_score"])
    rows = seen_windows(event_codes(match_scores(events, usable, game), codes), usable, game)
    rows = predict(rows, weights, [game, "time_sec", "period", "clock_sec_remaining", "n_events_used", "team1_score", "team2_score"])
    return outcomes(rows, game)


def outcomes(rows: DataFrame, game: str = "game") -> DataFrame:
    """What follows from current scores and remaining points (rem_home, rem_away)."""
    r3 = lambda c: F.bround(c, 3)
    f1, f2 = F.col("team1_score") + F.col("rem_home"), F.col("team2_score") + F.col("rem_away")
    margin = f1 - f2
    return rows.select(
        game, r3(F.col("time_sec")).alias("time_sec"), F.col("period").cast("int").alias("period"), text.game_clock(F.col("period"), F.col("clock_sec_remaining")).alias("clock"), F.col("n_events_used"),
        F.col("team1_score").cast("double").alias("current_team1_points"), F.col("team2_score").cast("double").alias("current_team2_points"), r3(F.col("rem_home")).alias("pred_team1_remaining"),
        r3(F.col("rem_away")).alias("pred_team2_remaining"), r3(f1).alias("pred_team1_final"), r3(f2).alias("pred_team2_final"), r3(margin).alias("pred_margin_team1"), scalars.winner(margin).alias("pred_winner"),
    )


def game_detail(windows: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """Window by window: predicted and true remaining points, and how far the prediction moved since the last one."""
    rows = predict(windows, weights, ["gameid", "window_start", "target"])
    w = Window.partitionBy("gameid").orderBy("window_start")
    rows = rows.withColumn("pred_total", F.col("rem_home") + F.col("rem_away"))
    return rows.withColumns({"delta": F.coalesce(F.col("pred_total") - F.lag("pred_total").over(w), F.lit(0.0)), "abs_error": (F.abs(F.col("rem_home") - F.element_at("target", 1)) + F.abs(F.col("rem_away") - F.element_at("target", 2))) / 2})


def errors(detail: DataFrame) -> DataFrame:
    """Mean and median absolute error by side, and the smooth L1 loss."""
    h, a = F.col("rem_home") - F.element_at("target", 1), F.col("rem_away") - F.element_at("target", 2)
    return detail.agg(F.avg(F.abs(h)).alias("mae_home"), F.avg(F.abs(a)).alias("mae_away"), F.avg((F.abs(h) + F.abs(a)) / 2).alias("mae"), F.median((F.abs(h) + F.abs(a)) / 2).alias("median_ae"), F.avg((scalars.smooth_l1(h) + scalars.smooth_l1(a)) / 2).alias("smooth_l1"))


def fit_baseline(windows: DataFrame, target: int) -> tuple[object, list[str]]:
    """A trainable model of remaining points where there is no deep learning library: gradient-boosted trees of Spark
    over the last event's numbers and the counts of event types in the window. Returns (model, feature columns)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows, names = tabular(windows)
    steps = [VectorAssembler(inputCols=names, outputCol="features"), GBTRegressor(labelCol="label", maxIter=20, seed=42)]
    return Pipeline(stages=steps).fit(rows.withColumn("label", F.element_at("target", target).cast("double"))), names


def tabular(windows: DataFrame, vocabulary: int = 8) -> tuple[DataFrame, list[str]]:
    last = F.element_at("num_features", -1)
    columns = {f"last_{n}": F.element_at(last, i + 1).cast("double") for i, n in enumerate(NUMERIC)}
    columns |= {f"n_type_{k}": F.size(F.filter("event_type_id", lambda x, k=k: x == k)).cast("double") for k in range(vocabulary)}
    return windows.withColumns(columns), list(columns)
