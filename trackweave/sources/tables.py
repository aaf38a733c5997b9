"""Scans, schemas and sinks: explicit schemas, repaired columns, one order of rows."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, scalars

#: Columns of the files that go in and out, in their order.
DETECTIONS = "frame long, track_id long, class string, confidence double, x_center double, y_center double, x1 double, y1 double, x2 double, y2 double"
PLAY_BY_PLAY = "gameid string, season string, period int, clock string, h_pts double, a_pts double, team string, type string, desc string"
EVENTS = (
    "row_type string, event_id string, event_type string, event_label_ko string, count int, frame long, time_sec double, team_id string, team_name string, shot_attempt_count int, shot_made_count int, "
    "shot_missed_count int, pass_count int, steal_or_block_count int, foul_count int, rebound_count int, shot_success_rate_pct double, possession_frame_count int, possession_time_sec double, "
    "possession_pct double, player_track_id string, secondary_track_id string, confidence double, details string"
)
SCORE_TIMELINE = "frame long, time_sec double, period int, quarter string, clock string, clock_sec_remaining int, team1_score int, team2_score int, team1_conf double, team2_conf double"
ANALYSIS_TIMELINE = "analysis_time string, team1 string, team2 string, team1_score int, team2_score int, quarter string, game_clock string"
VIDEOS = "video_id string, fps double, width int, height int, frame_count long"
OCR_ITEMS = "frame long, time_sec double, roi string, raw string, conf double, x double, y double, width double, height double, team string"
PREFERRED = [
    "frame", "track_id", "class", "confidence", "x_center", "y_center", "x1", "y1", "x2", "y2", "ball_status", "cleaning_note", "raw_x_center", "raw_y_center", "ball_segment", "is_reliable",
    "reliability_reason", "jump_distance", "context_distance", "team_id", "team_name", "team_confidence",
]
#: What detectors call the four classes.
CLASS_ALIASES = {
    "ball": "ball", "basketball": "ball", "sports ball": "ball", "sports_ball": "ball", "player": "player", "person": "player", "people": "player", "human": "player",
    "referee": "referee", "ref": "referee", "hoop": "hoop", "rim": "hoop", "basket": "hoop", "net": "hoop",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV with a header by an explicit schema (ids keep leading zeros); a byte order mark is dropped by the reader,
    several files or a glob are one table, unreadable numbers become null, column names are matched without spaces."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", mode="PERMISSIVE")
    raw = raw.toDF(*(c.strip().lstrip("﻿") for c in raw.columns))
    return conform(raw, schema)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of `schema` in order, by try_cast; absent ones are null, NaN and infinities too."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    have = {c.lower(): c for c in df.columns}

    def cast(f) -> Column:
        if f.name.lower() not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c, kind = F.col(f"`{have[f.name.lower()]}`"), f.dataType.simpleString()
        if kind == "double":
            c = scalars.number(c)
        elif kind in ("int", "bigint"):
            c = scalars.whole(c).try_cast(kind)
        elif kind == "boolean":
            c = scalars.flag(c)
        return c.cast(f.dataType).alias(f.name)

    return df.select(*(cast(f) for f in wanted))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Absent columns are added with their default."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def preferred_first(df: DataFrame, first: list[str] = PREFERRED) -> DataFrame:
    return df.select(*(c for c in first if c in df.columns), *(c for c in df.columns if c not in first))


def canonical_class(name: Column) -> Column:
    key = F.lower(F.trim(name))
    aliases = F.create_map(*(F.lit(v) for kv in CLASS_ALIASES.items() for v in kv))
    return F.coalesce(F.try_element_at(aliases, key), key)


def detections(df: DataFrame) -> DataFrame:
    """Detections as the engine uses them: schema, canonical classes, a box for every row."""
    d = conform(df, DETECTIONS).withColumn("class", canonical_class(F.col("class")))
    box = geometry.centred_box(F.col("class"), F.col("x_center"), F.col("y_center"))
    lacks = F.greatest(*(F.col(c).isNull() for c in ("x1", "y1", "x2", "y2")))
    return d.withColumns({c: F.when(lacks, v).otherwise(F.col(c)) for c, v in zip(("x1", "y1", "x2", "y2"), box, strict=True)})


def read_polygon(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """A polygon from JSON: a list of points, or an object with one under `polygon`."""
    found = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    if isinstance(found, dict):
        if "polygon" not in found:
            raise ValueError("the object has no polygon")
        found = found["polygon"]
    return [(float(x), float(y)) for x, y in found]


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, mark: bool = True) -> None:
    """A report as one CSV file with a header, which begins with a byte order mark as spreadsheets want it; absent
    folders are made. Reports are small; tables are written as Parquet."""
    rows = df.orderBy(*order) if order else df
    if mark:
        first = df.columns[0]
        rows = rows.withColumnRenamed(first, "\ufeff" + first)
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_history(spark: SparkSession, history: list[dict], path: str) -> None:
    """The epochs of a training, one JSON object a line."""
    spark.createDataFrame(history).coalesce(1).write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def require_file(spark: SparkSession, path: str, label: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"{label}: {path} does not exist")
    return path


def next_folder(spark: SparkSession, root: str, stem: str = "train") -> str:
    """root/train1, root/train2, ...: the first that does not exist."""
    n = 1
    while exists(spark, f"{root}/{stem}{n}"):
        n += 1
    return f"{root}/{stem}{n}"


def output_prefix(path: Column, suffix: str = "tracking_results.csv") -> Column:
    """What files of one run begin with: the name before the suffix, else the name without its ending and a `_`."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(F.concat(stem, F.lit("_")))


def show_rows(df: DataFrame, n: int = 20) -> DataFrame:
    """The first rows for a console, with nothing in place of nulls."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns)).limit(n)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A table as Parquet; an earlier one at this path is replaced."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def cached_concat(spark: SparkSession, glob: str, cache: str, schema: str) -> DataFrame:
    """All CSV files of a glob as one table, kept as Parquet after the first time."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        write_table(read_csv(spark, glob, schema), cache)
    return spark.read.parquet(cache)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1, 2, ... in order, without one task for all rows: rows are range-partitioned by the order and written once, so
    that a lost task cannot change the partitions, then counted by partition and numbered within. `order` must tell
    rows apart."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").count()  # one row a partition
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_nth", nth).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def event_ids(df: DataFrame, order: list[str], name: str = "event_id") -> DataFrame:
    """E00001, E00002, ... in order."""
    return numbered(df, order, "_n").withColumn(name, F.format_string("E%05d", F.col("_n").cast("int"))).drop("_n")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session shares with its executors (spark.checkpoint.dir). A local folder stands in only where
    the executors are threads of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if getattr(sc, "_trackweave_tables", None) is None:
        sc._trackweave_tables = "file://" + tempfile.mkdtemp(prefix="trackweave-")
    return sc._trackweave_tables


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
