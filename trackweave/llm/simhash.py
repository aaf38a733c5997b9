"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most `bits` bits share at least
8 - bits of them, the guaranteed minimum. Postings of single positional bytes would each hold 1/256 of the corpus and
a tally over them would be quadratic. So the positions are dealt into bits + 2 blocks and the index is keyed by every
two blocks at once (6 keys of 4 bytes for 2 bits): two blocks at least are free of differing bits, so every pair of the
minimum meets in a list. Within a list the shared positional bytes of a pair are tallied, pairs that reach the minimum
are retained, and their bit distance is verified. In a list of more members than the ball of radius `bits` has, the
members are probed for the neighbours in the ball and only those pairs are tallied. Only a spanning forest of a list's
links is passed on, which loses no reachability.

Lists of more than LIST_MEMBERS fingerprints are counted beforehand and never gathered: their members are indexed anew
by every choice of 8 - bits positions, where a list has at most 256**bits fingerprints whatever the corpus.

Fingerprints: words are runs of bytes other than space and 0x09-0x0D after A-Z are lower-cased; a shingle is
`shingle` words joined by a space, repeats included; a text of fewer words is one shingle; its hash is XXH64 with
seed 42; a bit is set if set in over half of the hashes. Null, empty and blank texts have fingerprint 0 and link like
any other. Rows with equal doc_id keep their rows; null doc_ids never name a component unless a class has no other.
Very long texts are read whole, one slice of documents at a time; an empty table gives no rows; fingerprints that tie
(equal ones) are one vertex; other columns are not read by near_duplicates and kept by keep_one, whose helper columns
avoid their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .components import connected_components
from .shared import Workspace, fresh_name, named, ship

SEED = 42
#: The most fingerprints that are gathered under one key of two blocks (128 kB).
LIST_MEMBERS = 16_384
#: The eight bits of a byte spread over the eight byte lanes of a word, to count 255 hashes without carries.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of h[first[i]:first[i + 1]] have each bit set; every range has a hash. (ranges, 64)"""
    count = np.diff(first)
    pieces = -(-count // 255)
    of = np.repeat(np.arange(len(count)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[of] + 255 * nth
    lanes = _LANES[h.view(np.uint8).reshape(-1, 8)]  # (hashes, byte position)
    part = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(len(of), 64)
    out = np.zeros((len(count), 64), np.int64)
    np.add.at(out, of, part)
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """The uint64 fingerprint of each document of a slice."""
    data = tc.LOWER[data]
    starts, ends, first = tc.words(data, offsets)
    n_words = np.diff(first)
    # the words of all documents with one space after each
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(at[-1], 32, np.uint8)
    joined[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = data[~tc.SPACE[data]]
    raw = joined.tobytes()
    n_hashes = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    spot = np.concatenate([[0], np.cumsum(n_hashes)])
    doc = np.repeat(np.arange(len(n_words)), n_hashes)
    begin = first[:-1][doc] + np.arange(spot[-1]) - spot[doc]
    end = begin + np.minimum(shingle, n_words[doc])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[end] - 1).tolist(), strict=True)), np.uint64, len(begin))
    out = np.zeros(len(n_words), np.uint64)
    some = np.flatnonzero(n_hashes)
    if len(some):
        bits = 2 * _bit_counts(h, spot[np.append(some, len(n_words))]) > n_hashes[some, None]
        out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprinted(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tc.slices(batch.columns[-1]):
                got = fingerprints(data, offsets, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(got)], [*batch.schema.names[:-1], "fp"])

    return run


def with_fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """The columns of `carry` and fp, the fingerprint as a signed 64-bit integer. No shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(*map(named, carry), named(text).alias(fresh_name(docs, "row_text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(_fingerprinted(shingle), f"{fields}, fp long")


def _signed(masks: list[int]) -> list[int]:
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _bytes_mask(positions) -> int:
    return sum(0xFF << (8 * int(p)) for p in positions)


def block_masks(bits: int) -> list[int]:
    """Every two of bits + 2 blocks of byte positions."""
    blocks = np.array_split(np.arange(8), bits + 2)
    return _signed([_bytes_mask(np.concatenate(two)) for two in combinations(blocks, 2)])


def narrow_masks(bits: int) -> list[int]:
    """Every choice of 8 - bits byte positions."""
    return _signed([_bytes_mask(keep) for keep in combinations(range(8), 8 - bits)])


def retained(differ: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs, given as the xor of their fingerprints, share the minimum of positional bytes and are verified."""
    tally = (np.ascontiguousarray(differ)[:, None].view(np.uint8) == 0).sum(1)  # shared positional bytes
    out = tally >= 8 - bits
    out[out] = np.bitwise_count(differ[out]) <= bits
    return out


def list_links(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of `members` (distinct uint64) within `bits` bits of each other."""
    n = len(members)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    vary = int(np.bitwise_or.reduce(members ^ members[0]))
    flips = [1 << k for k in range(64) if vary >> k & 1]
    ball = [sum(c) for r in range(1, bits + 1) for c in combinations(flips, r)] if n > 2 * len(flips) else [0] * n
    links: list[tuple[int, int]] = []

    def join(i: int, js: np.ndarray) -> None:
        for j in js[retained(members[js] ^ members[i], bits)].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))

    if len(ball) < n:
        order = np.argsort(members)
        ranked, probes = members[order], np.array(ball, np.uint64)
        for i in range(n):
            near = members[i] ^ probes
            at = np.minimum(np.searchsorted(ranked, near), n - 1)
            join(i, order[at[ranked[at] == near]])
    else:
        for i in range(n - 1):
            join(i, np.arange(i + 1, n))
    return links


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            size = np.asarray(lists.value_lengths(), np.int64)
            values, begin = np.asarray(lists.flatten()).view(np.uint64), np.cumsum(size) - size
            two = begin[size == 2]  # most lists, all at once
            two = two[retained(values[two] ^ values[two + 1], bits)]
            a, b = [values[two]], [values[two + 1]]
            for at, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                members = values[at : at + n]
                found = np.array(list_links(members, bits), np.int64).reshape(-1, 2)
                a.append(members[found[:, 0]])
                b.append(members[found[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return run


def _postings(distinct: DataFrame, masks: list[int]) -> DataFrame:
    """(k, key, fp): the fingerprints under each masked value."""
    keys = F.array(*(F.struct(F.lit(k).cast("tinyint").alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))
    return distinct.select("fp", F.explode(keys).alias("p")).select("p.k", "p.key", "fp")


def _list_links(postings: DataFrame, bits: int) -> DataFrame:
    lists = postings.groupBy("k", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return lists.select("fps").mapInArrow(_links(bits), "a long, b long")


def fingerprint_links(distinct: DataFrame, work: Workspace, bits: int = 2, list_members: int = LIST_MEMBERS) -> DataFrame:
    """distinct(fp) -> (a, b): links that connect exactly what the pairs within `bits` bits connect."""
    if not 0 <= bits <= 6:
        raise ValueError("bits must be from 0 to 6")
    wide = _postings(distinct, block_masks(bits))
    hot = work.write(wide.groupBy("k", "key").agg(F.count("*").alias("n")).where(F.col("n") > list_members).select("k", "key"), "hot-lists")
    if hot.isEmpty():
        return _list_links(wide, bits)
    many = work.write(wide.join(hot, ["k", "key"], "left_semi").select("fp").distinct(), "hot-members")
    rest = wide.join(hot, ["k", "key"], "left_anti")
    return _list_links(rest, bits).union(_list_links(_postings(many, narrow_masks(bits)), bits))


def _labelled(rows: DataFrame, work: Workspace, bits: int) -> DataFrame:
    """rows(id, fp, ...), written, with component (the smallest fingerprint of the class) and component_id."""
    groups = work.write(rows.groupBy("fp").agg(F.min("id").alias("least")), "groups")
    links = fingerprint_links(groups.select("fp"), work, bits)
    found = connected_components(links, work)
    # name each component by its smallest document; fingerprints without a link name themselves
    classes = groups.join(found.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    classes = work.write(classes, "classes")
    least = work.write(classes.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    label = work.write(classes.join(least, "component").select("fp", "component", "component_id"), "labels")
    work.keep("fingerprints", "labels")
    return rows.join(label, "fp")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row per input row: key, fp (signed 64-bit) and component_id, the smallest key reachable over links."""
    work = Workspace(docs.sparkSession, "simhash")
    rows = work.write(with_fingerprints(docs.select(named(key).alias("id"), named(text).alias("text")), "text", ("id",), shingle), "fingerprints")
    return _labelled(rows, work, bits).select(F.col("id").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, bits: int = 2) -> DataFrame:
    """The rows of `docs` with one document of each class: the one of smallest key, once. Rows may share a key or have
    none: among those of the smallest key the text of smallest hash stays."""
    work, kept_work = Workspace(docs.sparkSession, "simhash"), Workspace(docs.sparkSession, "simhash-kept")
    source = docs.select(named(key).alias("id"), F.xxhash64(named(text)).alias("hash"), named(text).alias("text"))
    rows = work.write(with_fingerprints(source, "text", ("id", "hash"), shingle), "fingerprints")
    leads = _labelled(rows, work, bits).where(F.col("id").eqNullSafe(F.col("component_id")))
    leads = leads.groupBy("component", "id", "hash").agg(F.count("*").alias("n"))
    first = leads.groupBy("component", "id").agg(F.min("hash").alias("first_hash"), F.min_by("n", "hash").alias("n"))
    first = kept_work.write(first.select(F.col("id").alias("first_id"), "first_hash", "n"), "first")
    tie = fresh_name(docs, "row_hash")
    mine = first.select(F.col("first_id").alias(fresh_name(docs, "first_id")), F.col("first_hash").alias(fresh_name(docs, "first_hash")))
    same = named(key).eqNullSafe(F.col(mine.columns[0])) & (F.col(tie) == F.col(mine.columns[1]))
    kept = docs.withColumn(tie, F.xxhash64(named(text))).join(mine.hint("merge"), same, "left_semi")
    if not first.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([key, tie])
    return kept.drop(tie)
