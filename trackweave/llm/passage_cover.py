"""Repeated word passages found through difference-cover anchors.

A difference cover D modulo v has, for any two places i and j, a shift below v that takes both into D. So if windows
of `length` words at i and j are equal, then some shorter window of length - v + 1 words inside them begins at covered
places of both documents. Only those windows are hashed (6 of 31 places for length 50, anchors of 20 words):

1. scan: the anchors (hash, document, place) at covered places;
2. a grouped minimum and maximum of the document per hash leaves the hashes that more than one document has; a join
   brings them back to the documents' places. Both are sums or splittable joins, so a passage that a third of the
   documents share makes no task large;
3. extension: only windows of the full length around shared anchors are hashed, with 128 bits, and the smallest
   document of each is found in the same way;
4. a word goes if a window that a smaller document has covers it.

The order of documents is that of the key; null keys come last and count as equal to each other. Words are runs of
bytes other than space and 0x09-0x0D. Defined results: null, empty and blank texts have no words, nothing is removed
and the kept text is empty; texts of fewer words than a window are kept whole; rows with equal keys (a tie in the order)
never remove from each other; an empty table gives no rows; very long texts are read whole, a slice of documents at a
time; other columns are untouched, and helper columns avoid their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import Workspace, fresh_name, named, ship

LENGTH = 50
#: A perfect difference set: each distance modulo 31 once.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Parts in which the full windows are compared, one after the other.
SLICES = 4
#: Of the second hash of words and windows, independent of the first.
SECOND = 1


def difference_cover(v: int) -> tuple[int, ...]:
    """A difference cover modulo v: the perfect set for 31, else chosen greedily."""
    if v == PERIOD:
        return COVER
    chosen, open_ = [0], set(range(1, v))
    while open_:
        gain = lambda c: len(open_ & {x for d in chosen for x in ((c - d) % v, (d - c) % v)})
        best = max((c for c in range(v) if c not in chosen), key=gain)
        open_ -= {x for d in chosen for x in ((best - d) % v, (d - best) % v)}
        chosen.append(best)
    return tuple(sorted(chosen))


def period_for(length: int) -> int:
    """31 for 50 words; in general three fifths of the length, so that anchors keep two fifths of the words."""
    return max(1, min(length, round(length * 0.62)))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(hash, document, place) of the anchors of a slice, and the word hashes and first words of its documents."""
    starts, ends, first = tc.words(data, offsets)
    h = tc.span_hashes(data, starts, ends)
    doc = tc.owner(first)
    v = period_for(length)
    size = length - v + 1
    place = np.arange(len(h)) - first[doc]
    covered = np.zeros(v, bool)
    covered[list(difference_cover(v))] = True
    n = np.diff(first)[doc]
    at = np.flatnonzero(covered[place % v] & (place + size <= n) & (n >= length))
    return tc.window_hashes(h, size)[at] if len(at) else np.zeros(0, np.uint64), doc[at], place[at], h, first


def _scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for a, _, data, offsets in tc.slices(texts):
                x, doc, place, _, _ = anchors(data, offsets, length)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), ids.take(pa.array(a + doc)), pa.array(place.astype(np.int32))], ["x", "id", "place"])

    return run


def _windows(length: int):
    """Windows of full length around the listed places, hashed twice, from two hashes of each word."""
    size = length - period_for(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts, lists = (batch.column(c) for c in ("id", "hash", "text", "places"))
            listed, ends_ = np.asarray(lists.flatten(), np.int64), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
            for a, b, data, offsets in tc.slices(texts):
                starts, ends, first = tc.words(data, offsets)
                h = tc.span_hashes(data, starts, ends)
                doc = tc.owner(first)
                of = np.repeat(np.arange(b - a), np.diff(ends_[a : b + 1]))
                places = first[of] + listed[ends_[a] : ends_[b]]
                places = places[places + size <= first[of + 1]]  # of another text with this id
                near = np.zeros(len(h) + 1, np.int64)
                np.add.at(near, np.maximum(places - (length - size), 0), 1)
                np.add.at(near, places + 1, -1)
                s = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                s = s[s + length <= first[doc[s] + 1]]
                x, y = tc.window_hashes(h, length), tc.window_hashes(tc.span_hashes(data, starts, ends, SECOND), length)
                row = pa.array(a + doc[s])
                yield pa.RecordBatch.from_arrays([pa.array(x[s].view(np.int64)), pa.array(y[s].view(np.int64)), ids.take(row), hashes.take(row), pa.array((s - first[doc[s]]).astype(np.int32))], ["x", "y", "id", "hash", "start"])

    return run


def _shared_by_documents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that documents with different ids have, and the smallest id (a null id is larger than any)."""
    found = rows.groupBy(*keys).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count_if(F.col("id").isNull()).alias("nulls"))
    return found.where("least < most OR (nulls > 0 AND least IS NOT NULL)").select(*keys, "least")


def repeated_windows(docs: DataFrame, work: Workspace, length: int = LENGTH) -> DataFrame:
    """docs(id, hash, text) -> (id, hash, starts): the windows that a document with a smaller id has as well."""
    ship(docs.sparkSession)
    kind = docs.schema["id"].dataType.simpleString()
    scan = work.write(docs.select("id", "text").mapInArrow(_scan(length), f"x long, id {kind}, place int"), "anchors")
    common = work.write(_shared_by_documents(scan, ["x"]).select("x"), "shared")
    places = work.write(scan.join(common, "x").groupBy("id").agg(F.collect_list("place").alias("places")), "places")
    work.drop("anchors")
    work.drop("shared")
    near = docs.join(places.withColumnRenamed("id", "own"), F.col("id").eqNullSafe(F.col("own"))).select("id", "hash", "text", "places")
    windows = near.mapInArrow(_windows(length), f"x long, y long, id {kind}, hash int, start int")
    work.write(windows.withColumn("slice", F.pmod("x", F.lit(SLICES)).cast("int")), "windows", by="slice")
    found = None
    for k in range(SLICES):  # one after the other, so that only a part of the windows is in shuffles at a time
        some = work.read("windows", f"slice={k}", f"x long, y long, id {kind}, hash int, start int")
        least = work.write(_shared_by_documents(some, ["x", "y"]), "least")
        late = work.write(some.join(least, ["x", "y"]).where("id IS NULL OR least < id").select("id", "hash", "start"), f"late-{k}")
        found = late if found is None else found.union(late)
    work.drop("windows")
    out = work.write(found.groupBy("id", "hash").agg(F.collect_list("start").alias("starts")), "found")
    work.keep("found")
    return out


def _applied(edit: Callable, length: int, out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carry, texts, lists = batch.columns[:-2], batch.columns[-2], batch.columns[-1]
            values = np.asarray(lists.flatten(), np.int64)
            ends_ = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))])
            for a, b, data, offsets in tc.slices(texts):
                starts, ends, first = tc.words(data, offsets)
                of = np.repeat(np.arange(b - a), np.diff(ends_[a : b + 1]))
                gone = tc.cover(first[of] + values[ends_[a] : ends_[b]], length, len(starts))
                size = (ends - starts + 1)[~gone]  # kept words with a space after each
                joined = np.full(int(size.sum()), 32, np.uint8)
                at = np.concatenate([[0], np.cumsum(size)])
                word = np.repeat(np.arange(len(starts)), ends - starts)
                body = data[~tc.SPACE[data]][~gone[word]]
                joined[np.arange(len(body)) + np.repeat(np.arange(len(size)), size - 1)] = body
                kept = np.concatenate([[0], np.cumsum(~gone)])[first]  # kept words before each document
                raw = joined.tobytes()
                n, left = np.diff(first), np.diff(kept)
                rows = [edit(raw[at[kept[i]] : max(at[kept[i]], at[kept[i + 1]] - 1)], int(n[i]), int(n[i] - left[i])) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in carry), *(pa.array(c) for c in zip(*rows, strict=True))], [*batch.schema.names[:-2], *out])

    return run


def _digest(kept: bytes, n: int, gone: int) -> tuple[int, int, str]:
    return n, gone, hashlib.sha256(kept).hexdigest()


def _text(kept: bytes, n: int, gone: int) -> tuple[str, int]:
    return kept.decode(), gone


def _with_starts(docs: DataFrame, key: str, text: str, carry: list[str], length: int) -> DataFrame:
    work = Workspace(docs.sparkSession, "passages")
    found = repeated_windows(docs.select(named(key).alias("id"), F.hash(named(text)).alias("hash"), named(text).alias("text")), work, length)
    own, spot = fresh_name(docs, "row_key"), fresh_name(docs, "row_starts")
    rows = docs.select(F.struct(named(key).alias("id"), F.hash(named(text)).alias("hash")).alias(own), *map(named, carry), named(text).alias(fresh_name(docs, "row_text")))
    return rows.join(found.select(F.struct("id", "hash").alias(own), F.col("starts").alias(spot)), own, "left").drop(own)


def passage_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: key, n_words, n_removed and kept_sha256 of the kept words joined by one space."""
    kind = docs.schema[key].dataType.simpleString()
    return _with_starts(docs, key, text, [key], length).mapInArrow(_applied(_digest, length, ["n_words", "n_removed", "kept_sha256"]), f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows of `docs` with `text` replaced by its kept words, and n_removed, the number of words taken out."""
    others = [c for c in docs.columns if c != text]
    count = fresh_name(docs, "n_removed")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return _with_starts(docs, key, text, others, length).mapInArrow(_applied(_text, length, [text, count]), f"{fields}, `{text}` string, `{count}` long").select(*map(named, docs.columns), named(count))
