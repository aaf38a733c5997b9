"""Token ids in files of byte-aligned codes of variable length with the control bits apart, ids ranked by frequency.

An id is replaced by its rank in the corpus (0 for the most frequent), which takes 1 to 4 bytes. The lengths of four
ranks make a control byte; control bytes and rank bytes are stored as two streams, so decoding looks each control
byte up in a table of 256 x 4 lengths and gathers all ranks at once.

A file is a Parquet file of blocks in ascending order of key. Each block has whole documents, about BLOCK_IDS ids:
the keys, the number of ids of each document and the two streams. The table of ranks lies beside the blocks. Files
are written and read by Spark, so any store works and a lost task is simply written again.

Defined results: null and empty texts have the end id alone; repeated rows are stored each, next to each other; null
keys come first; ids that are equally frequent are ranked by id; an empty table gives files without blocks; a very long
text is one block of its own. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textcore as tc
from . import tokens
from .shared import Workspace, named, ship

BLOCK_IDS = 1 << 16
#: Bytes of text that a range of keys has on average, one file each.
FILE_BYTES = 32 << 20

#: The lengths of the four ranks of each control byte, their sum, and where each rank begins.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_BYTE = np.uint32(8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, rank bytes) of uint32 ranks."""
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    begin = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        use = size > k
        body[begin[use] + k] = (ranks[use] >> (_BYTE * np.uint32(k))) & np.uint32(0xFF)
    return control.tobytes(), body.tobytes()


def decode_ranks(control: bytes, body: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    begin = np.cumsum(size) - size
    padded = np.concatenate([np.frombuffer(body, np.uint8), np.zeros(4, np.uint8)])
    out = padded[begin].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        use = np.flatnonzero(size > k)
        out[use] |= padded[begin[use] + k].astype(np.uint32) << (_BYTE * np.uint32(k))
    return out


def _tokenised(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.columns
            for a, b, data, offsets in tc.slices(texts, tokens.TEXT_BYTES):
                ids, first = tokens.encoder(path).encode(data, offsets)
                narrow = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4")
                raw, at = narrow.tobytes(), (first * narrow.itemsize).tolist()
                m = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, part, np.int32)), pa.array(np.arange(nth, nth + m)), keys.slice(a, m), pa.array(np.diff(first)), pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    ["part", "nth", "id", "n", "ids"],
                )
                nth += m

    return run


def _unpacked(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype(np.uint32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True):
            found = np.bincount(_unpacked(ids, n))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["token", "n"])


def _blocks(rank_of: np.ndarray, block_ids: int):
    names = ["part", "block", "keys", "counts", "control", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n, kind = 0, None

        def flush() -> pa.RecordBatch:
            ranks = rank_of[np.concatenate([_unpacked(ids, m) for _, _, m, ids, _ in held])]
            control, body = encode_ranks(ranks)
            values = [[held[0][0]], [held[0][4]], [[r[1] for r in held]], [[r[2] for r in held]], [control], [body]]
            kinds = [pa.int32(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)

        for batch in batches:
            kind = batch.column("id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "n", "ids", "nth")), strict=True):
                if held and (held[0][0] != row[0] or n + row[2] > block_ids):
                    yield flush()
                    n, held = 0, []
                held.append(row)
                n += row[2]
        if held:
            yield flush()

    return run


def _read(id_of: np.ndarray):
    names = ["part", "block", "id", "at", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.asarray(batch.column("counts")[i].values, np.int64)
                ids = id_of[decode_ranks(batch.column("control")[i].as_py(), batch.column("body")[i].as_py(), int(counts.sum()))].astype("<u4")
                raw, ends = ids.tobytes(), np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                m = len(counts)
                part, block = batch.column("part")[i].as_py(), batch.column("block")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, block, np.int64)), batch.column("keys")[i].values, pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES) -> None:
    """Tokenise the texts and write them to the folder `path` in ascending order of key."""
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "token-files")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(named(key).alias("id"), F.coalesce(named(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // file_bytes), spark.sparkContext.defaultParallelism)
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(parts, "id", tie).sortWithinPartitions("id", tie, "text")
    ids = work.write(dealt.mapInArrow(_tokenised(tokenizer), f"part int, nth long, id {kind}, n long, ids binary"), "ids")
    counts = ids.select("n", "ids").mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    ranked = counts.collect()  # at most the vocabulary
    order = [t for t, _ in sorted(ranked, key=lambda r: (-r[1], r[0]))]
    spark.createDataFrame([(r, t) for r, t in enumerate(order)], "rank long, token long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    rank_of = np.zeros(max(order, default=0) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    # a block is named by its file and its first document's place in it, so it does not matter how the files are read
    ids.mapInArrow(_blocks(rank_of, block_ids), f"part int, block long, keys array<{kind}>, counts array<long>, control binary, body binary").write.mode("overwrite").parquet(f"{path}/blocks")
    work.collect_garbage()
    work.drop()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all before it."""
    ship(spark)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([r[1] for r in ranks], np.uint32)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    total = blocks.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    until = lambda *keys: Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    per_part = total.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(until("part")), F.lit(0)).alias("part_start"))  # one row a file
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = total.select("part", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("block_start")).join(per_part, "part")
    rows = blocks.mapInArrow(_read(id_of), f"part int, block long, id {kind}, at long, n_tokens long, ids_crc32 long")
    return rows.join(per_block, ["part", "block"]).select("id", (F.col("part_start") + F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
