"""What the operators of this subpackage share: reading tables, shipping code, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once; with the mean document of a few kB a batch is a few MB.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, and keep Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_trackweave_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="trackweave-")) / "trackweave-code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._trackweave_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one of our own stands in only where the session names none and
    the executors are threads of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(sc, "_trackweave_folder", None)
        if found is None:
            found = sc._trackweave_folder = "file://" + tempfile.mkdtemp(prefix="trackweave-shared-")
    return found.rstrip("/")


class Workspace:
    """Tables written to the shared folder: they cut lineage, survive lost executors and can be dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
        """Write a table, if asked in a folder for each value of the column `by`, and read it."""
        path = self.path(name)
        writer = df.write.mode("overwrite").option("compression", codec)
        (writer.partitionBy(by) if by else writer).parquet(path)
        self.collect_garbage()
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, part: str, schema: str) -> DataFrame:
        """One folder of a table written with `by`; no rows had that value if there is none."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/{part}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path(name)}/{part}")

    def drop(self, name: str = "") -> None:
        """Remove one table, or all of them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Remove all tables but these."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in fs.listStatus(root):
            if found.getPath().getName() not in names:
                fs.delete(found.getPath(), True)

    def collect_garbage(self) -> None:
        """Shuffle files of finished steps go only when the JVM notices that nothing refers to them."""
        self.spark.sparkContext._jvm.System.gc()


#: A table goes to every executor only if it has at most this many rows, and its files (compressed) by Spark's statistics
#: at most this many bytes; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, read from a written table, with a broadcast hint if its counted `rows` and its size are within the bounds,
    else for a shuffled join. What is computed from a written table counts as that table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if rows <= limit and size <= BROADCAST_BYTES else df.hint("merge")


def named(column: str) -> Column:
    """A top-level column by its exact name, dots and quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, max_rows: int, max_bytes: int) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """A bounded sample of labelled texts for a fit on the driver, and the number of labelled rows by label.

    labels(key, label). Of each label the different texts of smallest hash: at most `max_rows`, and only while their
    bytes, added up in that order, stay within `max_bytes`. Texts of more than max_bytes / 8 are not taken. So the
    sample does not depend on the layout of the tables or on how many copies a text has.
    """
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    work = Workspace(docs.sparkSession, "sample")
    known = F.coalesce(named(text), F.lit(""))
    # hashes and sizes meet the labels, never the texts
    rows = docs.select(named(key).alias("key"), F.xxhash64(known).alias("hash"), F.octet_length(known).alias("size")).join(labels, "key")
    every = work.write(rows.groupBy("label", "hash").agg(F.max("size").alias("size")).where(F.col("size") <= max_bytes // 8), "hashes")
    picked: list[tuple[int, int]] = []
    for value in sorted(counts):
        total = 0
        for r in every.where(F.col("label") == value).orderBy("hash").limit(max_rows).collect():
            total += r["size"]
            if total > max_bytes:
                break
            picked.append((value, r["hash"]))
    work.drop()
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, "label int, hash long"))  # at most max_rows of each label
    texts = docs.select(F.xxhash64(known).alias("hash"), known.alias("text")).join(chosen, "hash").groupBy("label", "hash").agg(F.min("text").alias("text"))
    return [(r["label"], r["text"]) for r in sorted(texts.collect(), key=lambda r: (r["label"], r["hash"]))], counts
