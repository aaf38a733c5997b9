"""The operators on Spark: small tables against brute force, and defined results for odd input."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import compaction, components, decontamination, packing, passage_cover, repetition, simhash, site_quality, suffix_repeats, token_files, toxicity
from trackweave.llm.queries import tokenizer_path
from trackweave.llm.shared import Workspace, labelled_sample

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 12, n), rng.integers(0, 50, n), strict=True))


SHARED = prose(99, 70)
#: Nulls in every column, empty and blank texts, ties, repeated rows, a long text, and columns with clashing names.
ODD = [
    (1, prose(1, 80), "en", "s", 1, "x"), (2, prose(2, 40) + " " + SHARED, "en", "s", 1, "x"), (3, SHARED + "\n" + prose(3, 60), None, None, None, None), (4, None, "en", "s", None, "x"), (5, "", "fr", "t", 0, None),
    (6, " \n\t ", "fr", "t", 0, "y"), (7, prose(1, 80), "en", "s", 1, "x"), (8, prose(8, 3000), "de", "t", 9, "z"), (8, prose(8, 3000), "de", "t", 9, "z"), (None, prose(10, 60), "de", "t", 9, "z"), (None, None, None, None, None, None),
    (11, "É " + SHARED.upper(), "fr", "s", 1, "x"), (12, "one", "en", "s", 3, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def test_repetition_rules(odd, none):
    got = rows(repetition.repetition_rules(odd).select("doc_id", "n_words", "kept"))
    assert len(got) == len(ODD)
    want = sorted(((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in ODD), key=str)
    assert sorted(((d, n) for d, n, _ in got), key=str) == want
    assert repetition.repetition_rules(none).count() == 0
    kept = repetition.keep_clean(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, 8, 11, None}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 3), (9, 8), (8, 9), (7, 10), (10, 4), (None, 5), *((i, i + 1) for i in range(20, 60))], "a long, b long")
    got = dict(rows(components.connected_components(edges, Workspace(spark, "t"))))
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 4: 4, 7: 4, 10: 4} | {i: 20 for i in range(20, 61)}
    assert components.connected_components(edges.limit(0), Workspace(spark, "t")).count() == 0


def test_near_duplicates(odd, none):
    got = rows(simhash.near_duplicates(odd))
    fps = {}
    for d, fp, _ in got:
        fps.setdefault(fp % 2**64, []).append(d)
    values = list(fps)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    for d, fp, component in got:
        members = [x for v in values if root(v) == root(fp % 2**64) for x in fps[v] if x is not None]
        assert component == (min(members) if members else None), d
    assert simhash.near_duplicates(none).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 2, 3, 4, 8, 11, 12]


@pytest.mark.parametrize("list_members", [16_384, 1])
def test_links_connect_what_all_pairs_connect(spark, list_members):
    rng = np.random.default_rng(6)
    bases = rng.integers(0, 2**63, 12, np.int64)
    fps = {int(b) ^ int(sum(1 << int(k) for k in rng.choice(16, rng.integers(0, 5), replace=False))) for b in bases for _ in range(60)} | {-1, 0, 3, 1 << 40, 7}
    work = Workspace(spark, "links")
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), work, 2, list_members)
    got = dict(rows(components.connected_components(links, work)))
    parent = {f: f for f in fps}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) % 2**64).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {f: got.get(f, f) for f in fps} == {f: root(f) for f in fps}


def test_one_of_each_class_stays_where_ids_repeat(spark):
    a, b = prose(21, 80), prose(22, 80)
    near = lambda t: t.replace(" ", "\n", 3)  # noqa: E731  the same words, another text
    docs = [(1, a), (2, near(a)), (2, b), (5, near(b)), (7, prose(23, 80)), (7, near(prose(23, 80))), (None, prose(24, 80)), (None, near(prose(24, 80))), (9, prose(25, 80)), (9, prose(25, 80))]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, " ".join(r.text.split())) for r in kept)
    assert got == [(0, prose(24, 80)), (1, a), (2, b), (7, prose(23, 80)), (9, prose(25, 80))]


def brute_passages(docs, length):
    texts = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t, *_ in docs]
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, ws in texts:
        for i in range(len(ws) - length + 1):
            k = tuple(ws[i : i + length])
            first[k] = min(first.get(k, d), d, key=order)
    out = []
    for d, ws in texts:
        gone = set()
        for i in range(len(ws) - length + 1):
            if order(first[tuple(ws[i : i + length])]) < order(d):
                gone |= set(range(i, i + length))
        out.append((d, len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest()))
    return out


def test_passages(odd, none):
    assert rows(passage_cover.passage_digest(odd)) == sorted(brute_passages(ODD, 50), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
    assert passage_cover.passage_digest(none).count() == 0
    cut = passage_cover.remove_passages(odd)
    assert cut.columns == [*odd.columns, "n_removed"]


def brute_strings(docs, length):
    texts = [(d, (t or "").encode()) for d, t, *_ in docs]
    count = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("group_contexts", [8192, 1])
def test_strings(odd, none, group_contexts):
    got = suffix_repeats.repeat_digest(odd, shorter=200, group_contexts=group_contexts)
    assert rows(got.drop("n_passage_bytes")) == brute_strings(ODD, 400)
    assert sorted((str(r.doc_id), r.n_passage_bytes) for r in got.collect()) == sorted((str(r[0]), r[2]) for r in brute_strings(ODD, 200))
    assert suffix_repeats.repeat_digest(none).count() == 0


def test_repeat_groups_list_all_occurrences(spark):
    a, b = prose(41, 40), prose(42, 40)
    texts = [(1, f"{a} p {b}"), (2, f"q {a} r"), (3, f"{b}{a}"), (4, f"{a} r"), (5, prose(43, 40))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    raw = dict(texts)
    for group_contexts in (8192, 1):
        groups = {}
        for r in suffix_repeats.repeat_groups(docs, length=200, group_contexts=group_contexts).collect():
            groups.setdefault((r.h, r.g), []).append((raw[r.doc_id][r.start : r.end], r.doc_id, r.start))
        assert all(len({t for t, *_ in g}) == 1 and len(g) == len(set(g)) > 1 for g in groups.values())
        holders = {frozenset(d for _, d, _ in g) for g in groups.values()}
        assert {frozenset({1, 2, 3, 4}), frozenset({2, 4}), frozenset({1, 3})} <= holders and not any(5 in h for h in holders)


def brute_later(docs, length):
    """The texts without the bytes under strings that start earlier too, in order of doc_id and place."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(raw[i : i + length])
        out[d] = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode()
    return out


@pytest.mark.parametrize("group_contexts", [8192, 1])
def test_the_first_occurrence_can_stay(spark, group_contexts):
    a, b, c = (prose(n, 60) for n in (31, 32, 33))
    texts = [(4, f"{a} x {b}"), (1, f"{b} y"), (2, f"z {b} {c}"), (3, f"{c} {a} {a}"), (5, f"u {b} {c}"), (6, prose(34, 60))]
    got = {r.doc_id: r.text for r in suffix_repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), length=200, keep_first=True, group_contexts=group_contexts).collect()}
    assert got == brute_later(texts, 200) and got[1] == f"{b} y" and got[6] == prose(34, 60)


def test_self_similar_texts_are_told_apart(spark):
    a = b"a"
    while len(a) < 2048:
        a += a.translate(bytes.maketrans(b"ab", b"ba"))
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    words = [f"{w.decode()}{i}" for w in (a, b) for i in range(1)]
    tail = " ".join(f"w{i}" for i in range(49))
    texts = [(1, f"{words[0]} {tail}"), (2, f"{words[1]} {tail}"), (3, a.decode()), (4, b.decode())]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert [r.n_removed for r in passage_cover.passage_digest(docs).collect()] == [0, 0, 0, 0]
    assert rows(suffix_repeats.repeat_digest(docs)) == brute_strings(texts, 400)


def test_strings_are_cut_at_characters(spark):
    a, b = "é" * 300, "è" * 300  # the characters share their first byte
    docs = spark.createDataFrame([(1, "x" + a), (2, "y" + a), (3, "z" + b)], "doc_id long, text string")
    got = dict((r.doc_id, r.text) for r in suffix_repeats.remove_repeats(docs).collect())
    assert got[1] == "x" and got[2] == "y" and set(got[3]) <= {"z", "è"}


def test_contamination(spark, odd, none):
    items = spark.createDataFrame([(1, " ".join(SHARED.split()[10:40])), (2, "ONE"), (3, None), (4, "not there at all"), (5, SHARED)], "item_id long, text string")
    got = {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(odd, items).collect()}
    assert {(2, 70, 2, True), (3, 70, 2, True), (11, 70, 2, True), (12, 1, 1, True), (1, 0, 0, False), (4, 0, 0, False), (None, 0, 0, False)} <= got
    assert {r.doc_id for r in decontamination.drop_contaminated(odd, items).collect()} == {1, 4, 5, 6, 7, 8, None}
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0
    index = decontamination.PositionalIndex(odd, items)
    assert {(r.key.id, r.item_id) for r in index.proximity_matches(3).collect()} == {(d, i) for d in (2, 3, 11) for i in (1, 5)} | {(12, 2)}


def test_proximity_matches_what_stretches_have(spark):
    rng = np.random.default_rng(12)
    draw = lambda n: [f"w{i}" for i in rng.zipf(1.6, n) % 40]
    docs = [(i, " , ".join(draw(int(rng.integers(0, 120))))) for i in range(40)]
    items = [(i, " ".join(draw(int(rng.integers(1, 9))))) for i in range(25)]
    index = decontamination.PositionalIndex(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5)
    for slop in (0, 3):
        want = set()
        for i, item in items:
            ws = item.split()
            for w in [ws[k : k + 5] for k in range(max(1, len(ws) - 4))]:
                span = len(w) + slop
                for d, text in docs:
                    there = text.split(" , ")
                    if any(set(w) <= set(there[s : s + span]) for s in range(len(there))) and text:
                        want.add((d, i))
        assert {(r.key.id, r.item_id) for r in index.proximity_matches(slop).collect()} == want


def test_contamination_by_items_that_share_an_id(spark):
    passage = {n: " ".join(f"{n}{i}" for i in range(20)) for n in ("same", "one", "two", "none")}
    items = spark.createDataFrame([("a", passage["same"]), ("a", passage["same"]), ("b", passage["one"]), ("b", passage["two"]), (None, passage["none"])], "item_id string, text string")
    docs = spark.createDataFrame([(n, f"lead {p} tail") for n, p in passage.items()] + [("clean", "lead and tail")], "doc_id string, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.contamination(docs, items).collect()}
    assert got == {"same": (22, 20, 1, sha("a"), True), "one": (22, 20, 1, sha("b"), True), "two": (22, 20, 1, sha("b"), True), "none": (22, 20, 1, sha(""), True), "clean": (3, 0, 0, sha(""), False)}
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()] == ["clean"]
    near = decontamination.PositionalIndex(docs, items).proximity_matches(3)
    assert {(r.key.id, r.item_id) for r in near.collect()} == {("same", "a"), ("one", "b"), ("two", "b"), ("none", None)}


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    path = Workspace(spark, "tokens").path("files")
    token_files.write_token_files(odd, path, tokenizer_path(), block_ids=500, file_bytes=4000)
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in ODD), key=lambda d: (d is not None, d or 0))
    start = 0
    texts = {}
    for r in ODD:
        texts.setdefault(r[0], []).append(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4"))
    for d, at, n, crc in got:
        assert at == start
        start += n
        assert (n, crc) in {(len(x), zlib.crc32(x.tobytes())) for x in texts[d]}
    token_files.write_token_files(none, path, tokenizer_path())
    assert token_files.read_token_files(spark, path).count() == 0


def test_packing(odd, none):
    got = packing.pack_documents(odd, tokenizer_path(), capacity=256, with_ids=True).collect()
    sequences = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.1 * sum(r.length for r in got) / 256 + 1
    assert sum(1 for r in got if r.piece == 0) == len(ODD)
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_pieces_are_the_library_s_ids(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in ODD:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        n = -(-len(ids) // 256)
        cuts = [0, *(len(ids) - 256 * (n - 1 - k) for k in range(n))]
        want.update((r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    got = packing.pack_documents(odd, tokenizer_path(), capacity=256).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_a_very_long_text(spark):
    """Longer than a slice of any operator, beside short ones."""
    long = " ".join(f"{WORDS[i % 12]}{i}" for i in range(260_000))
    assert len(long) > 2 * (1 << 20)
    tail = " ".join(long.split()[1000:1080])
    docs = spark.createDataFrame([(1, long), (2, "short one"), (3, f"lead {tail} end")], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.repetition_rules(docs).collect()}
    assert got[1].n_words == 260_000 and got[1].kept and not got[2].kept
    assert {r.doc_id: r.n_removed for r in passage_cover.passage_digest(docs).collect()} == {1: 0, 2: 0, 3: 80}
    gone = {r.doc_id: r.n_removed for r in suffix_repeats.repeat_digest(docs).collect()}
    assert gone[1] == gone[3] and len(tail) <= gone[3] <= len(tail) + 2 and gone[2] == 0
    assert len({r.fp for r in simhash.near_duplicates(docs).collect()}) == 3
    items = spark.createDataFrame([("a", tail)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontamination.contamination(docs, items).collect()} == {1: 80, 2: 0, 3: 80}
    packed = packing.pack_documents(docs, tokenizer_path()).collect()
    path = Workspace(spark, "tokens").path("files")
    token_files.write_token_files(docs, path, tokenizer_path())
    total = {r.id: r.n_tokens for r in token_files.read_token_files(spark, path).collect()}
    assert {d: sum(r.length for r in packed if r.doc_id == d) for d in total} == total


def test_columns_with_clashing_names(spark):
    a = prose(51, 90)
    names = ["row_key", "row_text", "fp", "id", "score", "row_hash", "n_removed", "row_spans", "key", "hash"]
    docs = spark.createDataFrame([(k, a if k < 2 else prose(60 + k, 90), *[f"{n}{k}" for n in names]) for k in range(3)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([("a", " ".join(a.split()[:30]))], "item_id string, text string")
    for got, want in (
        (repetition.keep_clean(docs), {0, 1, 2}), (simhash.keep_one(docs), {0, 2}), (passage_cover.remove_passages(docs), {0, 1, 2}), (suffix_repeats.remove_repeats(docs, keep_first=True), {0, 1, 2}), (decontamination.drop_contaminated(docs, items), {2}),
    ):
        rows_ = got.collect()
        assert got.columns[: len(docs.columns)] == docs.columns and {r.doc_id for r in rows_} == want
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows_ for n in names)


def test_compaction(spark, odd, none):
    root = Workspace(spark, "shards").path("store")
    store = compaction.ShardStore(spark, root, target_bytes=30_000, fan_in=3)
    for k in range(4):
        store.append(odd.withColumn("n_chars", F.lit(k).cast("long")))
    before = store.shards()
    assert rows(store.read()) == rows(odd.withColumn("n_chars", F.explode(F.array(*(F.lit(k).cast("long") for k in range(4))))))
    version = store.compact()
    assert not store.full_tiers() and len(store.shards()) < len(before) and sum(s.rows for s in store.shards()) == 4 * len(ODD)
    assert store.read().count() == 4 * len(ODD) == store.read(4).count() and store.shards(4) == before
    with pytest.raises(compaction.Conflict):
        store.commit(before, [], version - 1)
    assert store.vacuum(keep=1) == 0 and store.vacuum(keep=1, retention_s=0) > 0 and store.read().count() == 4 * len(ODD)
    assert store.versions() == [version] and store.append(odd) == version + 1 and store.read().count() == 5 * len(ODD)
    empty = compaction.ShardStore(spark, Workspace(spark, "shards").path("empty"))
    empty.append(none)
    assert empty.read().count() == 0 and empty.read().columns == none.columns and empty.compact() == 1


def test_writers_that_meet_lose_nothing(spark, odd, monkeypatch):
    root = Workspace(spark, "shards").path("store")
    one, other = (compaction.ShardStore(spark, root, target_bytes=30_000, fan_in=3) for _ in range(2))
    for _ in range(3):
        one.append(odd)
    uncommitted = other.written(odd, "arrival")  # an append in flight
    one.compact()
    one.vacuum(keep=1, retention_s=3600)
    other.commit(uncommitted, [], other.latest())
    assert other.read().count() == 4 * len(ODD)
    # an append that another one overtakes tries again
    first, latest = other.written(odd, "arrival"), one.latest()
    one.append(odd)
    seen = iter([latest])
    monkeypatch.setattr(other, "latest", lambda: next(seen, latest + 1))
    assert other._committed(first, [], lambda: True) == latest + 2
    monkeypatch.undo()
    assert one.read().count() == 6 * len(ODD)
    # of two merges of the same files one counts
    groups = other.full_tiers()
    if groups:
        gone = [s for g in groups for s in g]
        one.compact()
        with pytest.raises(compaction.Conflict):
            other._committed([], gone, lambda: {s.path for s in gone} <= {s.path for s in other.shards()})
    assert one.read().count() == 6 * len(ODD)


def test_versions_are_read_over_bases(spark, odd, monkeypatch):
    monkeypatch.setattr(compaction, "BASE_EVERY", 2)
    store = compaction.ShardStore(spark, Workspace(spark, "shards").path("store"), target_bytes=1 << 30, fan_in=100)
    for _ in range(5):
        store.append(odd)
    assert store._numbers("bases") == [2, 4] and [store.read(v).count() for v in (1, 2, 3, 4, 5)] == [k * len(ODD) for k in (1, 2, 3, 4, 5)]
    store.vacuum(keep=2, retention_s=0)
    assert store.versions() == [4, 5] and store.read(4).count() == 4 * len(ODD) and store.read().count() == 5 * len(ODD)


def test_toxicity(spark, odd, none):
    texts = [(i, prose(i, 90) + (" scoundrel" if i % 2 else "")) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    got = toxicity.toxicity_scores(docs, net).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.9
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(odd, net).collect()}
    assert scores[4] == scores[5] == scores[6] == net.share and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.toxicity_scores(none, net).count() == 0
    blank = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.toxicity_scores(docs, blank).collect()} and blank.share == 0


def test_the_sample_does_not_depend_on_the_layout(spark):
    texts = [(i, prose(i % 150, 30 + i % 7), i % 2) for i in range(400)] + [(1000 + i, "copy", 1) for i in range(300)] + [(2000, "x" * 200_000, 0), (2001, None, 0)]
    docs = spark.createDataFrame([r[:2] for r in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in texts], "key long, label int")
    found = [labelled_sample(docs.repartition(n), labels.repartition(n, "label"), "doc_id", "text", 40, 1 << 20) for n in (1, 5)]
    assert found[0] == found[1] and found[0][1] == {0: 202, 1: 500}
    sample = found[0][0]
    assert len(sample) == len(set(sample)) == 80 and all(len(t) < 1 << 17 for _, t in sample)
    small, _ = labelled_sample(docs, labels, "doc_id", "text", 1000, 8000)
    assert 0 < sum(len(t) for y, t in small if y) <= 8000


def test_the_network_matches_plain_loops():
    data = np.frombuffer(b"aa bb cc dd ee ff aa cc " * 9, np.uint8)
    words = toxicity.read_words(data, np.array([0, len(data)]))
    net = toxicity.Network.new(np.sort(words.hashes)[:4], np.zeros(4))
    net.scale, net.shift = 1.5, -0.2
    p = {k: v.astype(float) for k, v in net.p.items()}
    row, count = net.word_rows(words), np.diff(np.append(words.begin, len(words.trigrams)))
    x = [np.concatenate([p["word"][row[w]], p["char"][words.trigrams[words.begin[w] : words.begin[w] + count[w]]].mean(0)]) for w in words.row]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def direction(xs, at, u):
        k, h, out = toxicity.HIDDEN, np.zeros(toxicity.HIDDEN), []
        for v in xs:
            a, b = v @ p["in"][:, at : at + 3 * k] + p["bias"][at : at + 3 * k], h @ u
            z, r = sigmoid(a[:k] + b[:k]), sigmoid(a[k : 2 * k] + b[k : 2 * k])
            h = z * h + (1 - z) * np.tanh(a[2 * k :] + r * b[2 * k :])
            out.append(h)
        return out

    best = -np.inf
    n = len(words.row)
    for start in sorted({min(s, n - toxicity.WINDOW) for s in range(0, n, toxicity.STRIDE)}):
        xs = x[start : start + toxicity.WINDOW]
        states = np.concatenate([direction(xs, 0, p["fwd"]), direction(xs[::-1], 3 * toxicity.HIDDEN, p["bwd"])[::-1]], 1)
        weight = np.exp([np.tanh(s @ p["att"] + p["att_bias"]) @ p["att_out"] for s in states])
        best = max(best, float((weight[:, None] * states).sum(0) / weight.sum() @ p["out"] + p["out_bias"][0]))
    assert abs(net.scores(words)[0] - sigmoid(1.5 * best - 0.2)) < 1e-5


def test_gradients_match_differences():
    data = np.frombuffer(b"aa bb cc dd ee ff aa cc", np.uint8)
    words = toxicity.read_words(data, np.array([0, 11, 23]))
    net = toxicity.Network.new(np.sort(words.hashes), np.zeros(len(words.hashes)))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows_ = net.word_rows(words)
    index, mask = toxicity._steps(words.row, np.array([0, 4]), np.array([4, 4]))
    y = np.array([1.0, 0.0])

    def loss():
        x = net.inputs(words, rows_)[index]
        z = net.forward(x @ net.p["in"] + net.p["bias"], mask)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = net.gradients(words, rows_, index, mask, y)
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape) if name not in ("word", "char") else ((int(rows_[0]), 1) if name == "word" else (int(words.trigrams[0]), 1))
        keep = value[at]
        value[at] = keep + 1e-3
        up = loss()
        value[at] = keep - 1e-3
        down = loss()
        value[at] = keep
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3, name


def test_site_quality(spark, odd, none):
    texts = [(i, prose(i, 90) if i % 3 else "spam " * 60, f"h{i % 4}", "en") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    model = site_quality.fit(docs, labels)
    got = site_quality.site_quality(docs, model, F.col("source"), F.col("lang")).collect()
    assert len(got) == 300 and np.mean([r.kept == (r.doc_id % 3 > 0) for r in got]) > 0.98
    assert all(0 < r.host_rate < 1 and 0 < r.path_rate < 1 for r in got)
    assert site_quality.site_quality(odd, model, F.col("source"), F.col("lang")).count() == len(ODD)
    assert site_quality.site_quality(none, model, F.col("source"), F.col("lang")).count() == 0
    blank = site_quality.fit(docs, labels.limit(0))
    assert {round(r.evidence, 9) for r in site_quality.site_quality(docs, blank, F.col("source"), F.col("lang")).collect()} == {0.0}


def test_posteriors_match_plain_sums(spark):
    rng = np.random.default_rng(4)
    docs = [(i, prose(i, 60) if rng.random() < 0.6 else "spam " * 60, f"h{min(int(rng.exponential(3)), 20)}", f"p{rng.integers(0, 3)}" if i % 9 else None) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    model = site_quality.fit(frame, spark.createDataFrame([(i, int(docs[i][1][:4] != "spam")) for i in range(0, 300, 2)], "doc_id long, quality int"))
    got = {r.doc_id: r for r in site_quality.site_quality(frame, model, F.col("source"), F.col("lang")).collect()}
    logit = lambda q: np.log(q / (1 - q))
    good = {i: 1 / (1 + np.exp(-(got[i].evidence + logit(model.share)))) for i in got}
    hosts, paths = {}, {}
    for i, _, h, q in docs:
        hosts.setdefault(h, []).append(good[i])
        paths.setdefault((h, q), []).append(good[i])
    rate = sum(good.values()) / len(good)

    def strength(groups):
        groups = [(len(g), sum(g), to) for g, to in groups if len(g) > 1]
        excess = (sum(n * (s / n - to) ** 2 for n, s, to in groups) - sum(to * (1 - to) for _, _, to in groups)) / max(sum(n * to * (1 - to) for n, _, to in groups), 1e-12)
        return float(np.clip(1 / max(excess, 1e-9) - 1, 1.0, 1e6))

    a = strength([(g, rate) for g in hosts.values()])
    mean = {h: (sum(g) + a * rate) / (len(g) + a) for h, g in hosts.items()}
    b = strength([(g, mean[h]) for (h, _), g in paths.items()])
    for i, _, h, q in docs:
        host = (sum(hosts[h]) - good[i] + a * rate) / (len(hosts[h]) - 1 + a)
        path = (sum(paths[h, q]) - good[i] + b * host) / (len(paths[h, q]) - 1 + b)
        assert abs(got[i].host_rate - host) < 1e-6 and abs(got[i].path_rate - path) < 1e-6
        assert abs(got[i].posterior - 1 / (1 + np.exp(-(got[i].evidence + logit(path))))) < 1e-6


def test_sparse_sites_shrink_more(spark):
    rows_ = [(i, 20.0, 19.0) for i in range(30)] + [(100 + i, 20.0, 2.0) for i in range(30)]
    spread = site_quality._strength(spark.createDataFrame(rows_, "g long, n double, good double"), F.lit(0.525))
    alike = site_quality._strength(spark.createDataFrame([(i, 20.0, 10.5) for i in range(30)], "g long, n double, good double"), F.lit(0.525))
    assert spread < 5 < 1000 < alike


def test_pipeline_stages_hold_what_they_say(spark, odd):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = odd.drop("kept")
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    one = corpus_pipeline.simhash_near_dedup(spark, kept, "")
    assert sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 2, 3, 8, 11]
    cut = corpus_pipeline.suffix_array_dedup(spark, one, "")
    assert cut.columns == docs.columns
    before = {r.doc_id: r.text for r in one.collect()}
    order = {d: (d is not None, d or 0) for d in before}  # a null doc_id before all others
    want = brute_later([(order[d], t) for d, t in before.items()], corpus_pipeline.PASSAGE_BYTES)
    got = {r.doc_id: r for r in cut.collect()}
    assert {d: r.text for d, r in got.items()} == {d: want[order[d]] for d in before if want[order[d]].split()}
    assert all(r.text == before[d] or r.n_chars == len(r.text) for d, r in got.items()) and got[2].text == before[2] != got[3].text
    packed = corpus_pipeline.best_fit_packing(spark, cut, "")
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in cut.collect()}
    for name, stage in corpus_pipeline.STAGES:
        if name != "benchmark_decontamination":
            assert stage(spark, docs.limit(0), "").count() == 0, name


def test_pipeline_drops_contaminated_documents(spark, odd, tmp_path):
    import corpus_pipeline

    docs = odd.drop("kept")
    spark.createDataFrame([("a", " ".join(SHARED.split()[10:40]))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 7, 8, 8, 12]
    assert corpus_pipeline.benchmark_decontamination(spark, docs.limit(0), str(tmp_path)).count() == 0
