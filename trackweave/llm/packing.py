"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

A bin is filled greedily with the longest document that fits. If a gap remains, the bin's smallest document gives way
to the two unpacked documents that fill the expanded gap most tightly, if they fill more; this repeats until nothing
fits better. The method only looks at lengths, and there are at most `capacity` different ones: it runs on their
histogram, and a finished bin is repeated as often as its lengths allow. So the whole corpus is packed at once, by a
plan whose size does not depend on it (at most 2 * capacity patterns of at most sqrt(2 * capacity) lengths each).
Documents then take the places of their length by rank; ranks come from counts per (length, slice), so a length that
a third of the corpus has is counted in many tasks.

Longer documents are cut into pieces of `capacity` ids, the first piece being the shorter one.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; a null doc_id is a value like
any other; no documents give no sequences; a very long text is many pieces, each packed by itself; pieces of one length
tie and take places by key, piece and checksum. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from . import tokens
from .shared import Workspace, named, ship, small

CAPACITY = 2048
#: Pieces of one length that are ranked in one task.
SLICE_ROWS = 100_000


def _pieces(path: str, capacity: int, with_ids: bool):
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns
            for a, _, data, offsets in tc.slices(texts, tokens.TEXT_BYTES):
                ids, first = tokens.encoder(path).encode(data, offsets)
                size = np.diff(first)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                lead = size[doc] - capacity * (n[doc] - 1)  # of the first piece
                start = np.where(piece == 0, 0, lead + capacity * (piece - 1))
                length = np.where(piece == 0, lead, capacity)
                raw, begin = ids.astype("<u4").tobytes(), 4 * (first[:-1][doc] + start)
                parts = [raw[x:y] for x, y in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                crc = pa.array([zlib.crc32(p) for p in parts], pa.int64())
                columns = [keys.take(pa.array(a + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), crc]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(parts, pa.binary())] * with_ids], names)

    return run


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths): bins that hold each length as often as the histogram has it; lengths are in order of place."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = []
    while left.any():
        have = left.copy()
        gap, held = capacity, []
        while gap:
            fit = np.flatnonzero(have[: gap + 1])
            if not len(fit):
                break
            size = int(fit[-1])
            n = min(gap // size, int(have[size]))
            held += [size] * n
            have[size] -= n
            gap -= size * n
        while gap:
            smallest = min(held)
            room = gap + smallest
            pair = _tightest_pair(have, room)
            if pair is None or sum(pair) <= smallest:
                break
            held.remove(smallest)
            have[smallest] += 1
            for size in pair:
                held.append(size)
                have[size] -= 1
            gap = room - sum(pair)
        used = np.bincount(held, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= times * used
        out.append((times, sorted(held, reverse=True)))
    return out


def _tightest_pair(have: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two available lengths whose sum is largest within room."""
    sizes = np.flatnonzero(have[: max(room, 0)])
    if not len(sizes):
        return None
    at = np.searchsorted(sizes, room - sizes, "right") - 1  # the longest partner of each
    own = np.arange(len(sizes))
    at = np.where((at == own) & (have[sizes] < 2), at - 1, at)
    sums = np.where(at >= 0, sizes + sizes[at], -1)
    best = int(sums.argmax())
    return (int(sizes[best]), int(sizes[at[best]])) if sums[best] > 0 else None


def plan_places(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset, number of that length in a bin), sorted."""
    rows, rank, sequence = [], {}, 0
    for times, lengths in patterns:
        offset = 0
        for size in sorted(set(lengths), reverse=True):
            n = lengths.count(size)
            rows.append((size, rank.get(size, 0), sequence, offset, n))
            rank[size] = rank.get(size, 0) + times * n
            offset += size * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(places: np.ndarray, with_ids: bool):
    order = (places[:, 0] << 44) + places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            at = np.searchsorted(order, (length << 44) + rank, "right") - 1
            size, first, sequence, offset, n = places[at].T
            nth = rank - first
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence + nth // n), pa.array(offset + size * (nth % n))], [*keep, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, work: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """pieces(id, piece, length, ...), a written table -> the same rows with sequence_id and offset."""
    ship(pieces.sparkSession)
    per_length = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most `capacity` rows
    n = sum(per_length.values())
    places = plan_places(best_two_fit(per_length, capacity))
    slices = max(1, -(-n // SLICE_ROWS))
    dealt = pieces.withColumn("slice", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.lit(slices)).cast("int"))
    counts = work.write(dealt.groupBy("length", "slice").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "slice").orderBy("id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(own)).join(small(counts, capacity * slices), ["length", "slice"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("nth") - 1).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(_placed(places, "ids" in pieces.columns), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds the ids themselves
    (little-endian unsigned 32-bit), from which a sequence is its rows in order of offset."""
    ship(docs.sparkSession)
    work = Workspace(docs.sparkSession, "packing")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = work.write(docs.select(named(key), named(text)).mapInArrow(_pieces(tokenizer, capacity, with_ids), schema), "pieces")
    return pack(pieces, work, capacity).withColumnRenamed("id", key)
