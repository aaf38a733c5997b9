"""Repeated byte strings across a corpus from common-prefix interval trees over enhanced suffix arrays.

Every string of `length` bytes holds a k-gram of smallest hash, the same one wherever the string stands. These anchors
sample about one suffix in (length - k) / 2, and two equal strings always meet at equal anchors. So the suffix array
need only hold the suffixes at anchors, and falls apart by the anchor's hash into parts that fit in a task:

1. scan: the anchors of every document (hash, document, place);
2. hashes that occur once are left out by a grouped count and a join (both split hot keys);
3. the others get their context, all bytes that strings around this anchor can reach; equal contexts (equal 128-bit
   hashes) are merged before any group is formed, so copies do not make a group large;
4. per anchor hash: the suffixes from the anchor on are sorted and get their common-prefix lengths (the enhanced
   array). A stack scan makes the tree of prefix intervals; within one, the reversed left contexts are sorted too, and
   the same scan over them gives the sets that agree to the left. A set whose members continue differently on either
   side (left and right diversity) and agree in `length` bytes or more is a maximal repeat: it is put out with all its
   occurrences. Bytes are compared here, so hashes that collide do no harm;
5. the spans of a context are those of its occurrences in all groups; those that lie within another one say nothing
   more and stay behind. The others go back to every document that has the context.

A shorter length can be asked for besides: an anchor of a longer string is one of a shorter string too, so one scan
with the contexts of both serves both. A repeat wider than a context shows up as a chain of overlapping groups.

A hash with more than GROUP_CONTEXTS different contexts takes another exact way that needs no group in a task: its
strings are hashed with 128 bits and counted by a grouped sum; each string that occurs twice is a group.

Defined results: null and empty texts have no bytes and no spans; matches never cross rows; two rows that hold the
same text are occurrences of each other, equal doc_ids or not; documents shorter than `length` keep everything; very
long texts are read in slices of whole documents, so memory follows the longest one; an empty table gives no rows;
other columns are carried by name only, and helper columns avoid their names; ties have no say, as all occurrences of
a repeat count alike (with keep_first the one of smallest key and place stays, a null key before all others).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import Workspace, fresh_name, named, ship

LENGTH, K = 400, 64
#: The most different contexts of an anchor that are sorted in one task (about 5 MB).
GROUP_CONTEXTS = 8192
_PLACE = np.uint64((1 << 31) - 1)


def _choosers(keys: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(place, first start, end of the last string) of the k-grams that strings of `length` bytes choose."""
    n, w = int(offsets[-1]), length - k + 1
    none = np.zeros(0, np.int64)
    count = n - length + 1
    if count <= 0:
        return none, none, none
    padded = np.full(-(-len(keys) // w) * w, np.uint64(2**64 - 1))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(back[:count], ahead[w - 1 : w - 1 + count]) & _PLACE).astype(np.int64)
    inside = np.arange(count) + length <= np.repeat(offsets[1:], np.diff(offsets))[:count]
    start = np.flatnonzero(inside)
    at = chosen[start]
    if not len(at):
        return none, none, none
    turn = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], turn]), np.append(turn, len(at)) - 1
    return at[first], start[first], start[last] + length


def anchors(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], k: int):
    """(hash, place, begin, end): the anchors, and the bytes of all strings of one of `lengths` that choose each one."""
    h = tc.byte_windows(data, k)
    keys = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    place, begin, end = map(np.concatenate, zip(*(_choosers(keys, offsets, n, k) for n in lengths), strict=True))
    place, of = np.unique(place, return_inverse=True)
    lo, hi = np.full(len(place), len(data)), np.zeros(len(place), np.int64)
    np.minimum.at(lo, of, begin)
    np.maximum.at(hi, of, end)
    return h[place], place, lo, hi


def _scan(lengths: tuple[int, ...], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for a, _, data, offsets in tc.slices(texts):
                h, place, _, _ = anchors(data, offsets, lengths, k)
                doc = np.searchsorted(offsets, place, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids.take(pa.array(a + doc)), pa.array((place - offsets[doc]).astype(np.int32))], ["h", "id", "place"])

    return run


def _contexts(lengths: tuple[int, ...], k: int):
    """The contexts of the anchors whose places are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, lists = batch.column("key"), batch.column("text"), batch.column("places")
            wanted, ends = np.asarray(lists.flatten(), np.int64), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
            for a, b, data, offsets in tc.slices(texts):
                h, place, lo, hi = anchors(data, offsets, lengths, k)
                doc = np.searchsorted(offsets, place, "right") - 1
                listed = np.repeat(offsets[:-1], np.diff(ends[a : b + 1])) + wanted[ends[a] : ends[b]]
                use = np.flatnonzero(np.isin(place, listed))
                h, place, lo, hi, doc = h[use], place[use], lo[use], hi[use], doc[use]
                raw, anchor = data.tobytes(), (place - lo).astype(np.int32)
                context = [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                ck = [xxhash.xxh3_128_digest(c, x) for c, x in zip(context, anchor.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ck, pa.binary()), keys.take(pa.array(a + doc)), pa.array((lo - offsets[doc]).astype(np.int32)), pa.array(anchor), pa.array(context, pa.binary())],
                    ["h", "ck", "key", "base", "anchor", "context"],
                )

    return run


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan of an array of common-prefix lengths (lcp[i] of items i - 1 and i; lcp[0] unused): each prefix
    interval as (length, first item, end item), children before parents."""
    stack: list[tuple[int, int]] = []
    n = len(lcp)
    for i in range(1, n + 1):
        now = lcp[i] if i < n else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            size, first = stack.pop()
            yield size, first, i
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(contexts: list[bytes], anchor: list[int], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): the members, all that do so, agree on exactly `left` bytes before and `right` bytes from
    the anchor on, left + right >= length, and neither side can be extended for all of them."""
    m = len(contexts)
    rights = [c[a:] for c, a in zip(contexts, anchor, strict=True)]
    lefts = [c[:a][::-1] for c, a in zip(contexts, anchor, strict=True)]
    if m == 2:  # most anchors
        left, right = common(*lefts), common(*rights)
        if left + right >= length:
            yield left, right, [0, 1]
        return
    order = sorted(range(m), key=rights.__getitem__)
    lcp = [0, *(common(rights[order[i - 1]], rights[order[i]]) for i in range(1, m))]
    rank = [0] * m
    for r, x in enumerate(sorted(range(m), key=lefts.__getitem__)):
        rank[x] = r
    child = [0] * m
    for right, a, b in intervals(lcp):
        need = max(0, length - right)
        nth, members = 0, []
        for i in range(a, b):
            nth += i > a and lcp[i] == right  # where the interval's children part
            x = order[i]
            child[x] = nth
            if len(lefts[x]) >= need:
                members.append(x)
        if len(members) < 2:
            continue
        members.sort(key=rank.__getitem__)
        llcp = [0, *(common(lefts[members[i - 1]], lefts[members[i]]) for i in range(1, len(members)))]
        for left, c, d in intervals(llcp):
            if left >= need:
                group = members[c:d]
                one = child[group[0]]
                if any(child[x] != one for x in group):  # diverse to the right, and to the left by the scan
                    yield left, right, group


def context_groups(contexts: list[bytes], anchor: list[int], copies: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(group, context, start, end): the occurrences, relative to their contexts, of an anchor's maximal repeats. A
    context that occurs more than once is a group of its own."""
    group = 0
    for x, n in enumerate(copies):
        if n > 1:
            yield group, x, 0, len(contexts[x])
            group += 1
    if len(contexts) > 1:
        for left, right, members in maximal_repeats(contexts, anchor, length):
            for x in members:
                yield group, x, anchor[x] - left, anchor[x] + right
            group += 1


def widest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those that lie in no other one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans), key=lambda x: (x[0], -x[1])):
        if not out or e > out[-1][1]:
            out.append((s, e))
    return out


def context_spans(contexts: list[bytes], anchor: list[int], copies: list[int], length: int, firsts: list[tuple] | None = None) -> Iterator[tuple[int, int, int, bool]]:
    """(context, start, end, but one): the widest spans of each context that occur elsewhere too. With `firsts`, the
    order and place of each context's first copy, spans that occur earlier; `but one` if that holds for all copies of
    the context except the first, as that one is the first of its group."""
    m = len(contexts)
    all_, later = [[] for _ in range(m)], [[] for _ in range(m)]
    for _, group in groupby(context_groups(contexts, anchor, copies, length), key=lambda r: r[0]):
        members = list(group)
        lead = None if firsts is None else min((*firsts[x][:-1], firsts[x][-1] + s, x) for _, x, s, _ in members)[-1]
        for _, x, s, e in members:
            (later if x == lead else all_)[x].append((s, e))
    for x in range(m):
        kept = widest(all_[x])
        yield from ((x, s, e, False) for s, e in kept)
        if copies[x] > 1 and later[x]:
            wide = set(kept)
            yield from ((x, s, e, True) for s, e in widest(kept + later[x]) if (s, e) not in wide)


def _by_anchor(length: int, spans: bool, key_order: bool):
    """Batches sorted by h; an anchor's contexts go on from one batch to the next. Puts out the occurrences of groups,
    or the spans of contexts."""
    last = ("but_one", pa.bool_()) if spans else ("g", pa.int64())
    names = ["h", "ck", "s", "e", last[0]]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), last[1]]
    read = ["h", "ck", "anchor", "copies", "context"]

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def order(first: dict) -> tuple:
        key = first["key"]["id"]
        return (key is not None, key if key is not None else 0, first["key"]["hash"], first["base"])

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            firsts = batch.column("first").to_pylist() if key_order else [None] * batch.num_rows
            yield from zip(*(batch.column(c).to_pylist() for c in read), firsts, strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for h, members in groupby(rows(batches), key=lambda r: r[0]):
            _, cks, anchor, copies, contexts, firsts = map(list, zip(*members, strict=True))
            if spans:
                found = context_spans(contexts, anchor, copies, length, list(map(order, firsts)) if key_order else None)
                out += [(h, cks[x], s, e, but_one) for x, s, e, but_one in found]
            else:
                out += [(h, cks[x], s, e, g) for g, x, s, e in context_groups(contexts, anchor, copies, length)]
            if len(out) >= 20_000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    return run


def _strings(lengths: tuple[int, ...], carried: list[str]):
    """Every string of one of `lengths` of a context, as two hashes, with the context's columns `carried`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("context").to_pylist()
            for length in lengths:
                found = [(tc.byte_windows(d, length), tc.byte_windows(d, length, 1)) for d in (np.frombuffer(c, np.uint8) for c in raw)]
                n = np.array([len(x) for x, _ in found], np.int64)
                row, s = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                x, y = (np.concatenate(v).view(np.int64) for v in zip(*found, strict=True))
                same = [batch.column(c).take(pa.array(row)) for c in carried]
                yield pa.RecordBatch.from_arrays([*same, pa.array(x), pa.array(y), pa.array(s.astype(np.int32)), pa.array(np.full(len(s), length, np.int32))], [*carried, "x", "y", "s", "size"])

    return run


def _counted_strings(hot: DataFrame, lengths: tuple[int, ...], keep_first: bool = False) -> DataFrame:
    """(h, ck, s, e, g, but_one, size): the strings of hot anchors that occur twice, each a group. With keep_first only
    those that are not the first of their group, or (but_one) whose context has copies besides the first."""
    carried = ["h", "ck", "copies", *["first"] * keep_first]
    kinds = {f.name: f.dataType.simpleString() for f in hot.schema}
    strings = hot.select(*carried, "context").mapInArrow(_strings(lengths, carried), ", ".join(f"{c} {kinds[c]}" for c in carried) + ", x long, y long, s int, size int")
    place = F.struct(F.col("first.key").alias("key"), (F.col("first.base") + F.col("s")).alias("at"), "ck") if keep_first else F.lit(0)
    often = strings.groupBy("h", "x", "y", "size").agg(F.sum("copies").alias("n"), F.min(place).alias("lead")).where("n > 1").drop("n")
    found = strings.join(often, ["h", "x", "y", "size"])
    mine = (F.col("lead.ck") == F.col("ck")) & (F.col("lead.at") == F.col("first.base") + F.col("s")) if keep_first else F.lit(False)
    found = found.withColumn("but_one", mine).where(~F.col("but_one") | (F.col("copies") > 1))
    return found.select("h", "ck", "s", (F.col("s") + F.col("size")).cast("int").alias("e"), F.xxhash64("x", "y", "size").alias("g"), "but_one", "size")


class Repeats:
    """The contexts of docs(key, text) around shared anchors, in the shared folder, and what repeats in them."""

    def __init__(self, docs: DataFrame, work: Workspace, lengths: tuple[int, ...] = (LENGTH,), k: int = K, group_contexts: int = GROUP_CONTEXTS):
        ship(docs.sparkSession)
        self.work, self.lengths = work, lengths
        k, kind = min(k, *lengths), docs.schema["key"].dataType.simpleString()
        scan = work.write(docs.select("key", "text").mapInArrow(_scan(lengths, k), f"h long, id {kind}, place int"), "anchors")
        often = work.write(scan.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")  # apart from the join, so that it can split hot keys
        places = work.write(scan.join(often, "h").groupBy("id").agg(F.collect_list("place").alias("places")), "places")
        work.drop("anchors")
        contexts = docs.join(places, F.col("key") == F.col("id")).select("key", "text", "places").mapInArrow(_contexts(lengths, k), f"h long, ck binary, key {kind}, base int, anchor int, context binary")
        contexts = work.write(contexts, "contexts")
        work.drop("places")
        self.occurrences = contexts.select("h", "ck", "key", "base")
        merged = contexts.groupBy("h", "ck").agg(F.count("*").alias("copies"), F.min(F.struct("key", "base")).alias("first"), F.first("anchor").alias("anchor"), F.first("context").alias("context"))
        distinct = work.write(merged, "distinct")
        sizes = distinct.groupBy("h").agg(F.count("*").alias("m"))
        hot = work.write(sizes.where(F.col("m") > group_contexts).select("h"), "hot")
        self.first = distinct.select("h", "ck", "first")
        self.hot = None if hot.isEmpty() else distinct.join(hot, "h", "left_semi")
        grouped = distinct if self.hot is None else distinct.join(hot, "h", "left_anti")
        self.grouped = grouped.repartition("h").sortWithinPartitions("h")

    def _counted_spans(self, keep_first: bool) -> DataFrame:
        """Of the contexts of hot anchors: runs of overlapping strings of one length as one span."""
        strings = _counted_strings(self.hot, self.lengths, keep_first)
        per = strings.groupBy("h", "ck", "size", "but_one").agg(F.array_sort(F.collect_list("s")).alias("all"))  # at most a context's strings

        def grow(runs, s):
            last, new = F.element_at(runs, -1), F.struct(s.alias("s"), (s + F.col("size")).alias("e"))
            wider = F.struct(last["s"].alias("s"), new["e"].alias("e"))
            return F.when(s <= last["e"], F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(wider))).otherwise(F.concat(runs, F.array(new)))

        first = F.array(F.struct(F.col("all")[0].alias("s"), (F.col("all")[0] + F.col("size")).alias("e")))
        runs = per.select("h", "ck", "but_one", "size", F.explode(F.aggregate("all", first, grow)).alias("r"))
        return runs.select("h", "ck", "r.s", "r.e", "but_one", (F.col("size") >= self.lengths[0]).alias("main"))

    def groups(self) -> DataFrame:
        """(h, g, key, s, e): all occurrences, as byte spans, of each maximal repeat (h, g) of at least the smallest
        length. Strings of the other lengths lie in groups of at least their length as well."""
        found = self.grouped.drop("first").mapInArrow(_by_anchor(min(self.lengths), False, False), "h long, ck binary, s int, e int, g long")
        if self.hot is not None:
            found = found.union(_counted_strings(self.hot, self.lengths).select("h", "ck", "s", "e", "g"))
        return self.occurrences.join(found, ["h", "ck"]).select("h", "g", "key", (F.col("base") + F.col("s")).alias("s"), (F.col("base") + F.col("e")).alias("e"))

    def spans(self, keep_first: bool = False) -> DataFrame:
        """(key, spans): the parts of each text that are occurrences of a maximal repeat, packed as start, end and a bit
        that tells repeats of lengths[0], unordered and possibly overlapping; only keys that have some."""
        rows = self.grouped if keep_first else self.grouped.drop("first")
        found = rows.mapInArrow(_by_anchor(min(self.lengths), True, keep_first), "h long, ck binary, s int, e int, but_one boolean")
        found = found.withColumn("main", F.col("e") - F.col("s") >= self.lengths[0])
        if self.hot is not None:
            found = found.union(self._counted_spans(keep_first))
        found = self.work.write(found, "spans")
        back = self.occurrences.join(found, ["h", "ck"])
        if keep_first:
            back = back.join(self.first, ["h", "ck"]).where(~(F.col("but_one") & (F.struct("key", "base") == F.col("first"))))
        put = F.shiftleft(F.col("base") + F.col("s").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("base") + F.col("e").cast("long"), 1)).bitwiseOR(F.col("main").cast("long"))
        found = self.work.write(back.select("key", put.alias("span")).groupBy("key").agg(F.collect_set("span").alias("spans")), "found")
        self.work.keep("found")
        return found


def unpacked(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, is it of the main length)."""
    return spans >> 32, (spans & 0xFFFFFFFF) >> 1, (spans & 1).astype(bool)


def removed(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes the spans cover."""
    return tc.cover(starts, ends - starts, n) if len(starts) else np.zeros(n, bool)


def _applied(edit: Callable, out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carry, texts, lists = batch.columns[:-2], batch.columns[-2], batch.columns[-1]
            values = np.asarray(lists.flatten(), np.int64)
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))])
            for a, b, data, offsets in tc.slices(texts):
                rows = [edit(data[offsets[i] : offsets[i + 1]], values[ends[a + i] : ends[a + i + 1]]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in carry), *(pa.array(c) for c in zip(*rows, strict=True))], [*batch.schema.names[:-2], *out])

    return run


def _digest(with_shorter: bool):
    def edit(data: np.ndarray, spans: np.ndarray) -> tuple:
        s, e, main = unpacked(spans)
        gone = removed(len(data), s[main], e[main])
        n_spans = int(gone[:1].sum() + (np.diff(gone.astype(np.int8)) == 1).sum())
        return len(data), int(gone.sum()), n_spans, hashlib.sha256(data[~gone].tobytes()).hexdigest(), *([int(removed(len(data), s, e).sum())] if with_shorter else [])

    return edit


def _cleaned(data: np.ndarray, spans: np.ndarray) -> tuple[str, int]:
    gone = removed(len(data), *unpacked(spans)[:2])
    lead = (data & 0xC0) != 0x80  # a character goes only if all its bytes go
    char = np.cumsum(lead) - 1
    stay = np.zeros(int(char[-1]) + 1 if len(data) else 0, bool)
    stay[char[~gone]] = True
    kept = data[stay[char]] if len(data) else data
    return kept.tobytes().decode(), int(gone.sum())


def _row_key(docs: DataFrame, key: str, text: str):
    """Rows of one doc_id and one text may share their key: they get the same result."""
    return F.struct(named(key).alias("id"), F.xxhash64(named(text)).alias("hash"))


def _with_spans(docs: DataFrame, key: str, text: str, carry: list[str], lengths: tuple[int, ...], k: int, group_contexts: int, keep_first: bool) -> DataFrame:
    work = Workspace(docs.sparkSession, "repeats")
    found = Repeats(docs.select(_row_key(docs, key, text).alias("key"), named(text).alias("text")), work, lengths, k, group_contexts).spans(keep_first)
    own, spans = fresh_name(docs, "row_key"), fresh_name(docs, "row_spans")
    rows = docs.select(_row_key(docs, key, text).alias(own), *map(named, carry), named(text).alias(fresh_name(docs, "row_text")))
    return rows.join(found.select(F.col("key").alias(own), F.col("spans").alias(spans)), own, "left").drop(own)


def repeat_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """Every maximal repeat with all its occurrences: (h, g) names it; key, start and end in bytes of an occurrence."""
    found = Repeats(docs.select(_row_key(docs, key, text).alias("key"), named(text).alias("text")), Workspace(docs.sparkSession, "repeats"), (length,), k, group_contexts).groups()
    return found.select("h", "g", F.col("key.id").alias(key), F.col("s").alias("start"), F.col("e").alias("end"))


def repeat_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shorter: int | None = None, k: int = K, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans and kept_sha256 of the remaining bytes; with a `shorter`
    length also n_passage_bytes, the bytes under strings of that length that occur elsewhere too."""
    lengths = (length,) if shorter is None else (length, shorter)
    rows = _with_spans(docs, key, text, [key], lengths, k, group_contexts, False)
    kind = docs.schema[key].dataType.simpleString()
    extra = [] if shorter is None else ["n_passage_bytes"]
    return rows.mapInArrow(_applied(_digest(bool(extra)), ["n_bytes", "n_removed", "n_spans", "kept_sha256", *extra]), f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_passage_bytes long" * len(extra))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = False, k: int = K, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """The rows of `docs` with every repeated string cut out of `text` (whole characters only), all columns kept, and
    n_removed, the number of bytes found repeated. With keep_first the first occurrence, by key and place, stays."""
    others = [c for c in docs.columns if c != text]
    count = fresh_name(docs, "n_removed")
    rows = _with_spans(docs, key, text, others, (length,), k, group_contexts, keep_first)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(_applied(_cleaned, [text, count]), f"{fields}, `{text}` string, `{count}` long").select(*map(named, docs.columns), named(count))
