"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame operations only.

Each arrival is appended as the small files its tasks write. Files are never changed. Files below the target size are
put in tiers by size (a tier spans a factor of FAN_IN); a tier with FAN_IN files or more is merged: its files are
dealt, in order, into outputs of about the target size, and each output is read and written by one task, so a merge
needs no shuffle and its memory does not depend on the data. Merging goes on until no tier is full.

The manifest is a log. Version n + 1 lists the files that it adds and removes, is written apart and renamed to its
place in one step that fails if the version exists; so readers see the old or the new version as a whole. A writer that
comes second tries again on top of the other's version: an append always can, a merge only if its inputs are still
live. Every BASE_EVERY versions all live files are written down as a base, by Spark and in as many parts as it takes, so
a version is one base and few changes. The driver sees counts by tier and the files of full tiers, never the list of
files of the target size; only `read` names all files, as any scan does.

`vacuum` drops old versions, and files that no kept version lists and that are older than a retention time: what a
writer has written and not yet committed is younger, so it stays.

Defined results: rows come back exactly as they were appended, repeated ones too, in no order; nulls, empty and very
long texts are only carried; column names do not matter, as no column is read; files of equal size are merged in order
of their names; an arrival without rows adds a file without rows, so that the schema is known.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 64 << 20
FAN_IN = 4
#: Outputs of one job.
JOB_OUTPUTS = 64
BASE_EVERY = 16
#: Attempts at a commit while others commit too.
ATTEMPTS = 20
#: What vacuum keeps: versions, and the seconds for which unlisted files stay.
KEEP_VERSIONS, RETENTION_S = 8, 24 * 3600
_FILES = "path string, bytes long, rows long"


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _listed(self, folder: str) -> list:
        path = self._path(folder)
        return list(self.fs.listStatus(path)) if self.fs.exists(path) else []

    # versions

    def _numbers(self, folder: str) -> list[int]:
        return sorted(int(s.getPath().getName()[1:]) for s in self._listed(folder) if s.getPath().getName().startswith("v"))

    def versions(self) -> list[int]:
        return self._numbers("manifest")

    def latest(self) -> int:
        return (self.versions() or [0])[-1]

    def manifest(self, version: int | None = None) -> DataFrame:
        """path (below the root), bytes and rows of the live files of a version, the last one by default."""
        version = self.latest() if version is None else version
        base = max((b for b in self._numbers("bases") if b <= version), default=0)
        changes = [f"{self.root}/manifest/v{v:010d}" for v in self.versions() if base < v <= version]
        live = self.spark.read.schema(_FILES).parquet(f"{self.root}/bases/v{base:010d}") if base else self.spark.createDataFrame([], _FILES)
        if not changes:
            return live
        log = self.spark.read.schema(f"added boolean, {_FILES}").parquet(*changes)
        live = live.union(log.where("added").drop("added"))
        return live.join(log.where("NOT added").select("path"), "path", "left_anti")

    def shards(self, version: int | None = None) -> list[Shard]:
        """All live files; for tests and small stores."""
        return sorted((Shard(*r) for r in self.manifest(version).collect()), key=lambda s: s.path)

    def _put(self, rows: DataFrame, place: str) -> None:
        """Write apart, then move in one step; Conflict if the place is taken."""
        written = f"staging/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{written}")
        target = self._path(place)
        self.fs.mkdirs(target.getParent())
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        plain = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            if self.fs.exists(target):
                raise Conflict(f"{place} exists")
            files.rename(self._path(written), target, plain)
        except Exception as e:
            self.fs.delete(self._path(written), True)
            if self.fs.exists(target):
                raise Conflict(f"{place} exists") from e
            raise

    def commit(self, added: list[Shard], removed: list[Shard], after: int) -> int:
        """Make version after + 1 of version `after` and these changes, if nobody else has made it."""
        rows = [(True, s.path, s.bytes, s.rows) for s in added] + [(False, s.path, s.bytes, s.rows) for s in removed]
        self._put(self.spark.createDataFrame(rows, f"added boolean, {_FILES}").coalesce(1), f"manifest/v{after + 1:010d}")
        if (after + 1) % BASE_EVERY == 0:
            self._base(after + 1)
        return after + 1

    def _base(self, version: int) -> None:
        try:
            self._put(self.manifest(version), f"bases/v{version:010d}")
        except Conflict:
            pass  # another writer has written the same one

    def _committed(self, added: list[Shard], removed: list[Shard], still: Callable[[], bool]) -> int:
        for _ in range(ATTEMPTS):
            before = self.latest()
            if removed and not still():
                raise Conflict("another writer has merged these files")
            try:
                return self.commit(added, removed, before)
            except Conflict:
                time.sleep(0.05)
        raise Conflict(f"no commit in {ATTEMPTS} attempts")

    # shards

    def written(self, df: DataFrame, kind: str) -> list[Shard]:
        """Write the rows as files of their own, not listed yet."""
        folder = f"shards/{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        sizes = {s.getPath().getName(): s.getLen() for s in self._listed(folder) if s.getPath().getName().startswith("part-")}
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        counted = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}").select(name.alias("name")).groupBy("name").count()
        rows = {r[0]: r[1] for r in counted.collect()}  # one row a file of this arrival
        return [Shard(f"{folder}/{n}", size, rows.get(n, 0)) for n, size in sorted(sizes.items())]

    def append(self, df: DataFrame) -> int:
        """Add an arrival, as the files that its tasks write, and commit."""
        return self._committed(self.written(df, "arrival"), [], lambda: True)

    def _tier(self) -> F.Column:
        """0 for files of at least half the target, n for those smaller by up to fan_in ** n."""
        halves = F.log(F.lit(float(self.target)) / (2 * F.greatest("bytes", F.lit(1)))) / F.log(F.lit(float(self.fan_in)))
        return F.greatest(F.ceil(halves), F.lit(0)).cast("int")

    def full_tiers(self) -> list[list[Shard]]:
        """What to merge: of each tier with fan_in files, groups in order whose sum stays within the target."""
        tiered = self.manifest().withColumn("tier", self._tier()).where("tier > 0")
        full = [r["tier"] for r in tiered.groupBy("tier").count().collect() if r["count"] >= self.fan_in]
        groups = []
        for n in sorted(full):
            group: list[Shard] = []
            total = 0
            for s in (Shard(*r) for r in tiered.where(F.col("tier") == n).orderBy("path").select("path", "bytes", "rows").toLocalIterator()):
                if group and total + s.bytes > self.target:
                    groups.append(group)
                    group, total = [], 0
                group.append(s)
                total += s.bytes
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> int:
        """Merge full tiers until there is none; a commit for each round. The last version."""
        while groups := self.full_tiers():
            schema = self.spark.read.parquet(f"{self.root}/{groups[0][0].path}").schema
            merged: list[Shard] = []
            for a in range(0, len(groups), JOB_OUTPUTS):
                parts = [self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in g)).coalesce(1) for g in groups[a : a + JOB_OUTPUTS]]
                whole = parts[0]
                for part in parts[1:]:
                    whole = whole.union(part)
                merged += self.written(whole, "merged")
            gone = [s for g in groups for s in g]
            wanted = self.spark.createDataFrame([(s.path,) for s in gone], "path string")
            try:
                self._committed(merged, gone, lambda wanted=wanted, n=len(gone): self.manifest().join(wanted, "path", "left_semi").count() == n)
            except Conflict:
                continue  # what was written here is listed nowhere; vacuum takes it
        return self.latest()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default."""
        return self.spark.read.parquet(*(f"{self.root}/{r[0]}" for r in self.manifest(version).select("path").toLocalIterator()))

    def vacuum(self, keep: int = KEEP_VERSIONS, retention_s: float = RETENTION_S) -> int:
        """Drop all but the last `keep` versions, and files that none of those lists and that are older than the
        retention time, which must be longer than any writer takes from its first file to its commit and any reader
        to its last; returns how many files went."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        if not kept:
            return 0
        if old:
            self._base(kept[0])
            for v in old:
                self.fs.delete(self._path(f"manifest/v{v:010d}"), True)
            for b in self._numbers("bases"):
                if b < kept[0]:
                    self.fs.delete(self._path(f"bases/v{b:010d}"), True)
        listed = self.manifest(kept[0]).select("path")
        for v in kept[1:]:
            listed = listed.union(self.spark.read.parquet(f"{self.root}/manifest/v{v:010d}").where("added").select("path"))
        before, gone = (time.time() - retention_s) * 1000, 0
        folders = [s.getPath().getName() for s in self._listed("shards")]
        for a in range(0, len(folders), 100):  # a folder is what one job wrote
            files = [(f"shards/{name}/{f.getPath().getName()}", f.getModificationTime()) for name in folders[a : a + 100] for f in self._listed(f"shards/{name}")]
            aged = [(path,) for path, changed in files if path.rsplit("/", 1)[1].startswith("part-") and changed <= before]
            if not aged:
                continue
            unlisted = [r[0] for r in self.spark.createDataFrame(aged, "path string").join(listed, "path", "left_anti").collect()]
            left = {name: 0 for name in folders[a : a + 100]}
            for path, _ in files:
                left[path.split("/")[1]] += path.rsplit("/", 1)[1].startswith("part-")
            for path in unlisted:
                self.fs.delete(self._path(path), False)
                left[path.split("/")[1]] -= 1
            gone += len(unlisted)
            for name in {path.split("/")[1] for path in unlisted}:
                if not left[name]:
                    self.fs.delete(self._path(f"shards/{name}"), True)
        return gone


def store_arrivals(df: DataFrame, root: str, arrivals: int, deal: F.Column, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, keep: int = KEEP_VERSIONS, retention_s: float = RETENTION_S) -> ShardStore:
    """Append the rows in `arrivals` batches, those of `deal` 0, 1, ..., and compact and vacuum after each."""
    store = ShardStore(df.sparkSession, root, target_bytes, fan_in)
    for k in range(arrivals):
        store.append(df.where(deal == k))
        store.compact()
        store.vacuum(keep, retention_s)
    return store
