"""The operators' own algorithms against brute force, without Spark."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from trackweave.llm import packing, passage_cover, repetition, simhash, suffix_repeats, token_files, tokens
from trackweave.llm import textcore as tc
from trackweave.llm.queries import tokenizer_path

TEXTS = st.lists(st.text(alphabet="ab \n\té#A.", max_size=40), max_size=8)


def parts(texts):
    return next(((d, o) for _, _, d, o in tc.slices(pa.array(texts, pa.string()))), (np.zeros(0, np.uint8), np.zeros(1, np.int64)))


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_and_repetition_match_plain_python(texts):
    texts = [*texts, None, ""]
    data, offsets = parts(texts)
    got = repetition.measure(data, offsets)
    for i, text in enumerate(t or "" for t in texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        hit = {k + j for k in range(len(ws) - 2) if grams[tuple(ws[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got["n_words"][i] == len(ws)
        assert got["word_chars"][i] == sum(map(len, ws))
        assert got["n_symbols"][i] == len(re.findall(r"[#*$%&|<>]", text))
        assert got["n_repeat_words"][i] == len(hit)
        assert got["n_dup_lines"][i] == len(lines) - len(set(lines))
        for n in repetition.NGRAMS:
            seen, covered = set(), set()
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in seen:
                    covered |= set(range(k, k + n))
                seen.add(tuple(ws[k : k + n]))
            assert got[f"dup_chars_{n}"][i] == sum(len(ws[k]) for k in covered)


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_fingerprints_match_plain_python(texts):
    texts = [*texts, None, "a " * 300]
    got = simhash.fingerprints(*parts(texts), 3)
    for i, text in enumerate(t or "" for t in texts):
        ws = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(bytes(tc.LOWER)))
        shingles = [b" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_list_links_connect_what_pairs_connect():
    rng = random.Random(5)
    for _ in range(60):
        base = rng.getrandbits(64)
        members = np.array(sorted({base ^ sum(1 << rng.choice(range(16)) for _ in range(rng.randint(0, 6))) for _ in range(rng.choice([3, 30, 400]))}), np.uint64)

        def classes(links, n=len(members)):
            parent = list(range(n))

            def root(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for a, b in links:
                parent[root(a)] = root(b)
            return [min(j for j in range(n) if root(j) == root(i)) for i in range(n)]

        pairs = [(i, j) for i in range(len(members)) for j in range(i) if int(members[i] ^ members[j]).bit_count() <= 2]
        found = simhash.list_links(members, 2)
        assert len(found) < len(members)
        assert classes(found) == classes(pairs)


def test_every_pair_of_the_minimum_meets_in_a_list_and_is_tallied():
    rng = random.Random(8)
    for bits in range(1, 7):
        for masks in (simhash.block_masks(bits), simhash.narrow_masks(bits)):
            for _ in range(200):
                flips = sum(1 << b for b in rng.sample(range(64), rng.randint(1, bits)))
                assert any(flips & m % 2**64 == 0 for m in masks)
        differ = np.array([sum(1 << b for b in rng.sample(range(64), rng.randint(1, 8))) for _ in range(500)], np.uint64)
        assert simhash.retained(differ, bits).tolist() == [int(d).bit_count() <= bits for d in differ]


def test_difference_covers_cover():
    for v in (1, 2, 5, 12, 31):
        cover = passage_cover.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def _occurrences(texts, lengths, k):
    """(text, start, end, group) of all occurrences, and each group's strings."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    anchored = defaultdict(lambda: defaultdict(list))
    for h, place, lo, hi in zip(*map(np.ndarray.tolist, suffix_repeats.anchors(data, offsets, lengths, k)), strict=True):
        anchored[h][data[lo:hi].tobytes(), place - lo].append(lo)
    found, strings = [], defaultdict(set)
    for h, contexts in anchored.items():
        keys = list(contexts)
        for g, x, s, e in suffix_repeats.context_groups([c for c, _ in keys], [a for _, a in keys], [len(contexts[x]) for x in keys], min(lengths)):
            for base in contexts[keys[x]]:
                doc = int(np.searchsorted(offsets, base, "right")) - 1
                found.append((doc, base + s - int(offsets[doc]), base + e - int(offsets[doc]), (h, g)))
                strings[h, g].add(data[base + s : base + e].tobytes())
    return found, strings


def test_repeats_match_counting_every_string():
    rng = random.Random(1)
    for _ in range(200):
        lengths = rng.choice([(8,), (12,), (20,), (20, 12), (12, 8)])
        alphabet = rng.choice([b"ab", b"abcd", bytes(range(97, 123))])
        draw = lambda n, alphabet=alphabet: bytes(rng.choice(alphabet) for _ in range(n))
        passages = [draw(rng.randint(5, 60)) for _ in range(4)]
        texts = [b"".join(rng.choice(passages) if rng.random() < 0.5 else draw(rng.randint(0, 20)) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 8))]
        found, strings = _occurrences(texts, lengths, rng.choice([3, 4, min(lengths)]))
        of = Counter(g for *_, g in found)
        for g, ss in strings.items():  # a group is one string, and has all its occurrences around this anchor
            assert len(ss) == 1 and len(min(ss)) >= min(lengths) and of[g] > 1
        for length in lengths:
            count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
            for n, text in enumerate(texts):
                want, got = np.zeros(len(text), bool), np.zeros(len(text), bool)
                for i in range(len(text) - length + 1):
                    if count[text[i : i + length]] > 1:
                        want[i : i + length] = True
                for doc, s, e, _ in found:
                    if doc == n and e - s >= length:
                        got[s:e] = True
                assert (want == got).all()


def test_maximal_repeats_have_all_occurrences_and_cannot_be_extended():
    rng = random.Random(2)
    for _ in range(300):
        m, length = rng.randint(2, 9), rng.randint(2, 6)
        contexts, anchor = [], []
        while len(contexts) < m:
            left, right = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(2))
            if (left, right) not in [(c[:a].decode(), c[a + 1 :].decode()) for c, a in zip(contexts, anchor, strict=True)]:
                contexts.append(f"{left}X{right}".encode())
                anchor.append(len(left))
        want = set()
        for left in range(6):
            for right in range(1, 7):
                by = defaultdict(list)
                for x, (c, a) in enumerate(zip(contexts, anchor, strict=True)):
                    if a >= left and len(c) - a >= right:
                        by[c[a - left : a + right]].append(x)
                for group in by.values():
                    wider = [{contexts[x][anchor[x] - left - 1 : anchor[x] - left] if anchor[x] > left else x for x in group}, {contexts[x][anchor[x] + right : anchor[x] + right + 1] or x for x in group}]
                    if len(group) > 1 and left + right >= length and all(len(w) > 1 for w in wider):
                        want.add((left, right, tuple(group)))
        assert {(a, b, tuple(sorted(g))) for a, b, g in suffix_repeats.maximal_repeats(contexts, anchor, length)} == want


def thue_morse(n):
    word = b"a"
    while len(word) < n:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    return word


def test_hashes_tell_self_similar_texts_apart():
    word = thue_morse(4096)
    data = np.frombuffer(word + word.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    raw = data.tobytes()
    for size in (1, 2, 3, 5, 8, 9, 13, 64, 65, 400, 1024, 2048):
        strings = [raw[i : i + size] for i in range(len(raw) - size + 1)]
        starts = np.arange(len(strings))
        for h in (tc.byte_windows(data, size), tc.span_hashes(data, starts, starts + size)):
            assert len(set(strings)) == len(set(h.tolist())) == len(set(zip(h.tolist(), strings, strict=True)))
    letters = tc.span_hashes(data, np.arange(len(data)), np.arange(len(data)) + 1)
    for size in (2, 3, 32, 50, 512):
        strings = [raw[i : i + size] for i in range(len(raw) - size + 1)]
        assert len(set(strings)) == len(set(zip(tc.window_hashes(letters, size).tolist(), strings, strict=True))) == len(set(tc.window_hashes(letters, size).tolist()))


def test_repetition_of_self_similar_lines():
    a = thue_morse(2048).decode()
    b = a.translate(str.maketrans("ab", "ba"))
    got = repetition.measure(*parts([f"{a}\n{b}", f"{a}\n{a}", " ".join(thue_morse(4096).decode())]))
    assert got["n_dup_lines"].tolist() == [0, 1, 0]
    ws = list(thue_morse(4096).decode())
    seen, covered = set(), set()
    for k in range(len(ws) - 9):
        if tuple(ws[k : k + 10]) in seen:
            covered |= set(range(k, k + 10))
        seen.add(tuple(ws[k : k + 10]))
    assert got["dup_chars_10"][2] == len(covered)


def test_pieces_encode_as_whole_texts():
    encoder = tokens.PieceEncoder(tokenizer_path())
    rng = random.Random(3)
    letters = [*"ab'st .,!  \n\t é1 2　", "<|endoftext|>", "'ll", "\r\n", "   ", "\x1c", " é"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", None]
    ids, first = encoder.encode(*parts(texts))
    for i, text in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_of_self_similar_text_and_of_equal_hashes(monkeypatch):
    a = thue_morse(2048).decode()
    texts = [a, a.translate(str.maketrans("ab", "ba")), "one two one", "", "three"]
    library = tokens.PieceEncoder(tokenizer_path())
    want = [[*library.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    for hashes in (tc.span_hashes, lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3)):
        monkeypatch.setattr(tc, "span_hashes", hashes)
        encoder = tokens.PieceEncoder(tokenizer_path())
        for _ in range(2):  # of new pieces and of known ones
            ids, first = encoder.encode(*parts(texts))
            assert [ids[x:y].tolist() for x, y in zip(first[:-1], first[1:], strict=True)] == want


def test_strings_of_added_tokens_get_their_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(5)
    letters = ["a", " b", " ", "  ", "\n", "<|endo", "ftext|>", "<|endoftext|>", " <|endoftext|>"]
    texts = ["x  <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>  b c"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for as_text in (False, True):
        library.encode_special_tokens = as_text
        ids, first = tokens.PieceEncoder(tokenizer_path(), as_text).encode(*parts(texts))
        for i, text in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
    assert tokens.encoder(tokenizer_path()).encode(*parts(["a<|endoftext|>"]))[0].tolist() == [64, 50256, 0]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
@settings(max_examples=150, deadline=None)
def test_ranks_round_trip(ranks):
    control, body = token_files.encode_ranks(np.array(ranks, np.uint32))
    assert token_files.decode_ranks(control, body, len(ranks)).tolist() == ranks


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
@settings(max_examples=150, deadline=None)
def test_packing_places_every_length_once(histogram):
    patterns = packing.best_two_fit(histogram, 32)
    used = Counter()
    for times, lengths in patterns:
        assert sum(lengths) <= 32 and times > 0
        for size in lengths:
            used[size] += times
    assert used == Counter(histogram)
    total = sum(k * n for k, n in histogram.items())
    assert sum(t for t, _ in patterns) <= 2 * -(-total // 32)


def test_two_documents_replace_the_smallest_where_they_fit_better():
    # greedy takes 6 and 3, a gap of 1 is left; 2 + 2 fill the gap of the 3
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])


def test_crc_of_pieces_is_of_little_endian_ids():
    ids = np.array([1, 70000], np.uint32)
    assert zlib.crc32(ids.astype("<u4").tobytes()) == zlib.crc32(b"\x01\x00\x00\x00\x70\x11\x01\x00")


def test_slices_do_not_change_results():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "é", "x.", "one\ntwo"]) for _ in range(rng.randint(0, 80))) for _ in range(30)] + [None, "", "z " * 500]
    whole = pa.array(texts, pa.string())
    (_, _, data, offsets), *more = tc.slices(whole)
    assert not more
    counts, fps = repetition.measure(data, offsets), simhash.fingerprints(data, offsets, 3)
    ids, first = tokens.PieceEncoder(tokenizer_path()).encode(data, offsets)
    encoder, seen = tokens.PieceEncoder(tokenizer_path()), []
    for a, b, d, o in tc.slices(whole, 300):
        part = repetition.measure(d, o)
        assert all((part[c] == counts[c][a:b]).all() for c in repetition.COUNTS)
        assert (simhash.fingerprints(d, o, 3) == fps[a:b]).all()
        got, at = encoder.encode(d, o)
        assert all((got[at[i] : at[i + 1]] == ids[first[a + i] : first[a + i + 1]]).all() for i in range(b - a))
        seen += range(a, b)
    assert seen == list(range(len(texts)))


def plain_best_two_fit(sizes, capacity):
    """Document by document, as the method is told."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        held, gap = [], capacity
        for size in list(left):
            if size <= gap:
                held.append(size)
                left.remove(size)
                gap -= size
        while gap and held:
            smallest = min(held)
            room = gap + smallest
            pairs = [(left[i] + left[j], left[i], left[j]) for i in range(len(left)) for j in range(i + 1, len(left)) if left[i] + left[j] <= room]
            best = max(pairs, default=(0, 0, 0))
            if best[0] <= smallest:
                break
            held.remove(smallest)
            left.append(smallest)
            for size in best[1:]:
                left.remove(size)
                held.append(size)
            left.sort(reverse=True)
            gap = room - best[0]
        bins.append(sorted(held, reverse=True))
    return bins


@given(st.lists(st.integers(1, 24), max_size=40))
@settings(max_examples=150, deadline=None)
def test_packing_fills_as_the_plain_method(sizes):
    bins = [lengths for times, lengths in packing.best_two_fit(Counter(sizes), 24) for _ in range(times)]
    plain = plain_best_two_fit(sizes, 24)
    assert sorted(x for b in bins for x in b) == sorted(sizes) and abs(len(bins) - len(plain)) <= 1
    assert not bins or sum(bins[0]) == sum(plain[0])
