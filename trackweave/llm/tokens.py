"""Whole texts to token ids with a public tokenizer file, fast because equal pieces are encoded once.

The byte-level pre-tokenizer splits texts with a pattern whose parts never hold certain places: before a single space
followed by a visible ASCII character, between an ASCII letter or digit and ASCII punctuation other than the apostrophe,
and on both sides of a single line feed between visible ASCII characters. So a text can be cut there, each distinct
piece encoded by the tokenizers library once, and the ids put together again: the result is that of encoding the whole
text. The strings of added tokens in a text get the ids of the file, as in the library; there is no cut in, just before
or next after one, as they end the text that the pattern sees. With special_as_text those of special tokens are ordinary
text. Pieces are found by a 64-bit hash and then compared with the piece that was encoded (hashes of up to 8 bytes of
one size are equal only if the bytes are); should two pieces ever share a hash, the slice is encoded whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from . import textcore as tc

END_ID = 0
#: The most pieces that a worker remembers (about 50 bytes each); then it starts anew.
KNOWN_PIECES = 2_000_000
#: Pieces that are encoded in one call.
LEARN_PIECES = 20_000
#: Bytes of text that are encoded at once.
TEXT_BYTES = 1 << 21

_VISIBLE = tc.lut(range(0x21, 0x7F))
_WORD = tc.lut(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B))
_POINT = _VISIBLE & ~_WORD
_POINT[0x27] = False
_encoders: dict[tuple[str, bool], PieceEncoder] = {}


class Grown:
    """An array that grows at its end; room is doubled, so appending costs no copy of the whole."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1024, kind), 0

    def append(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.zeros(max(2 * len(self.room), self.n + len(values)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[at]


class PieceIndex:
    """Rows of hashes: a large sorted array and a small one of the last additions, merged now and then; in front of them
    a table with one place for all hashes of equal low bits, which answers most questions at once."""

    BITS = 20

    def __init__(self):
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self.front, self.front_rows = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def recall(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash that the front table knows, else -1."""
        slot = self._slot(hashes)
        return np.where(self.front[slot] == hashes, self.front_rows[slot], np.int32(-1))

    def keep(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        slot = self._slot(hashes)
        self.front[slot], self.front_rows[slot] = hashes, rows

    def __len__(self) -> int:
        return sum(len(h) for h, _ in self.parts)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 if there is none."""
        out = np.full(len(hashes), -1, np.int32)
        for known, rows in self.parts:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                out[hit] = rows[at[hit]]
        return out

    def add(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        (large, large_rows), (small, small_rows) = self.parts
        small, small_rows = self._merged(small, small_rows, hashes, rows)
        if len(small) > max(1 << 16, len(large) // 4):
            large, large_rows = self._merged(large, large_rows, small, small_rows)
            small, small_rows = small[:0], small_rows[:0]
        self.parts = [(large, large_rows), (small, small_rows)]

    @staticmethod
    def _merged(a: np.ndarray, a_rows: np.ndarray, b: np.ndarray, b_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = np.searchsorted(a, b)
        return np.insert(a, spot, b), np.insert(a_rows, spot, b_rows)


class PieceEncoder:
    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added if t.content and not (special_as_text and t.special)]
        self.forget()

    def forget(self) -> None:
        self.index = PieceIndex()
        self.ids, self.begin, self.count = Grown(np.uint32), Grown(np.int32), Grown(np.int32)
        self.body, self.body_begin, self.size = Grown(np.uint8), Grown(np.int32), Grown(np.int32)

    def _learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        """hashes are sorted and new."""
        self.index.add(hashes, len(self.count) + np.arange(len(raw), dtype=np.int32))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.body_begin.append(len(self.body) + np.cumsum(size) - size)
        self.size.append(size)
        self.body.append(np.frombuffer(b"".join(raw), np.uint8))
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for a in range(0, len(raw), LEARN_PIECES):
            found = [e.ids for e in encode([p.decode() for p in raw[a : a + LEARN_PIECES]], add_special_tokens=False)]
            count = np.fromiter(map(len, found), np.int64, len(found))
            self.begin.append(len(self.ids) + np.cumsum(count) - count)
            self.count.append(count)
            self.ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum())))

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> bool:
        """Are the pieces those of the rows."""
        size = ends - starts
        if not np.array_equal(self.size[row], size):
            return False
        long = np.flatnonzero(size > 8)
        s, n, k = starts[long], size[long], self.body_begin[row[long]].astype(np.int64)
        have, stored = tc.chunks(data), tc.chunks(self.body.room[: len(self.body)])
        if not (np.array_equal(have[s], stored[k]) and np.array_equal(have[s + n - 8], stored[k + n - 8])):
            return False
        return all(data[a : a + m].tobytes() == self.body.room[b : b + m].tobytes() for a, m, b in zip(*(v[n > 16].tolist() for v in (s, n, k)), strict=True))

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        found = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)

    def _keep_added(self, raw: bytes, cut: np.ndarray) -> None:
        """Take away the cuts in each occurrence of an added token, at the space before and the next one after it."""
        spots = np.append(np.flatnonzero(cut), len(cut) - 1)
        for token in self.added:
            p = raw.find(token)
            while p >= 0:
                cut[max(p - 1, 0) : p + len(token)] = False
                cut[spots[np.searchsorted(spots, p + len(token))]] = False
                p = raw.find(token, p + 1)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of the documents of a slice, each followed by end_id, and where each begins."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[: max(n - 1, 0)] = (data[:-1] == 32) & _VISIBLE[data[1:]]
        if n > 1:
            cut[1:n] |= _WORD[data[:-1]] & _POINT[data[1:]]
            line = 1 + np.flatnonzero((data[1:-1] == 10) & _VISIBLE[data[:-2]] & _VISIBLE[data[2:]])
            cut[line] = cut[line + 1] = True
        raw = data.tobytes()
        self._keep_added(raw, cut)
        cut[offsets] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        h = tc.span_hashes(data, starts, ends)
        row = self.index.recall(h)
        missed = np.flatnonzero(row < 0)
        if len(missed):
            unique, first_at, which = np.unique(h[missed], return_index=True, return_inverse=True)
            rows = self.index.find(unique)
            new = rows < 0
            if len(self.index) and len(self.index) + new.sum() > KNOWN_PIECES:
                self.forget()
                return self.encode(data, offsets, end_id)
            if new.any():
                at = missed[first_at[new]]
                self._learn(unique[new], [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                rows = self.index.find(unique)
            self.index.keep(unique, rows)
            row[missed] = rows[which]
        if self._same(data, starts, ends, row):
            count = self.count[row].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(count)])
            ids = self.ids[np.arange(total[-1]) + np.repeat(self.begin[row] - total[:-1], count)]
            first = total[np.searchsorted(starts, offsets)]
        else:
            ids, first = self._whole(data, offsets)
        if end_id is None:
            return ids, first
        docs = np.arange(len(offsets) - 1)
        out = np.full(len(ids) + len(docs), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[first[1:] + docs] = False
        out[keep] = ids
        return out, first + np.arange(len(offsets))


def encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """The worker's encoder of a tokenizer file, which must be at this path on every executor."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = PieceEncoder(path, special_as_text)
    return _encoders[path, special_as_text]
