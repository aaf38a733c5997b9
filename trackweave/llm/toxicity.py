"""Toxicity scores of whole texts from a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its embedding joined to the mean embedding of its character trigrams (so unseen spellings have
evidence too). One recurrent layer reads a window in each direction, attention weighs the states, and a linear unit
gives the window's logit. Every text is scored over all its overlapping windows of WINDOW words, STRIDE apart (the
last one ends with the text); the largest logit, calibrated, is the score.

Training is on the driver with a bounded sample of the labelled rows' different texts: of each label those of smallest
hash, at most MAX_ROWS and at most MAX_BYTES together. So the sample is the same however the table is laid out, and a
text with thousands of copies enters once. Whole texts are read, long ones too (a single one of more than MAX_BYTES / 8
cannot be held beside others and is the only kind left out). Labels are of documents, so the windows that stand for a
toxic document are chosen by telling words first, and by those and the network itself from then on. A fifth of the sample is kept
from training, to fit the calibration at the labelled rows' share of toxic ones. The weights are a running mean over
the steps, which takes most of the noise out of a short training.

Scoring is one pass without a shuffle. Input projections are computed once per different word of a batch.

Defined results: texts without words (null, empty, blank) get the labelled rows' share of toxic ones as score; rows
are independent, so repeated rows score equally; labels with null are not used; without any usable label of either
kind every score is that share (0 if there are no labels at all). An empty table gives no rows; very long texts are
scored over all their windows; a score of exactly 0.5 (a tie) predicts 1, and of windows or labelled texts that tie the
first by place or hash counts; only the key is carried, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import labelled_sample, named, ship

WINDOW, STRIDE = 64, 48
MAX_ROWS, MAX_BYTES = 2000, 12 << 20
VOCABULARY, TRIGRAMS = 8192, 4096
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 16, 8, 16, 16
#: Training takes ROUNDS x STEPS batches whatever the sample's size; after each round the windows are chosen anew.
ROUNDS, STEPS, BATCH, RATE = 4, 56, 256, 3e-3
#: Weight of the last step in the running mean of the weights.
FRESH = 0.05
#: Share of a batch's different words that are hidden in training.
HIDE = 0.2
_LETTER = tc.lut(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))


@dataclass
class Words:
    """The words of a slice: for each its row among the different ones, and those as hashes and trigrams."""

    first: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    trigrams: np.ndarray  # of one different word after the other
    begin: np.ndarray  # first trigram of each


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = tc.LOWER[data]
    starts, ends, first = tc.runs(_LETTER[data], offsets)
    hashes, at, row = np.unique(tc.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    s, size = starts[at], (ends - starts)[at]
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    centre = np.repeat(s, size) + place
    one = data[centre].astype(np.uint32)
    edge = np.uint32(1)
    before = np.where(place == 0, edge, data[np.maximum(centre - 1, 0)])
    after = np.where(place == np.repeat(size, size) - 1, edge, data[np.minimum(centre + 1, max(len(data) - 1, 0))])
    mixed = (before.astype(np.uint32) * np.uint32(0x9E3779B1) ^ one * np.uint32(0x85EBCA77) ^ after.astype(np.uint32) * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return Words(first, row.ravel(), hashes, (mixed >> np.uint32(20)).astype(np.int64) % TRIGRAMS, begin)


def read_texts(texts: list[str]) -> Words:
    """The words of all texts, read slice by slice."""
    parts = [read_words(data, offsets) for _, _, data, offsets in tc.slices(pa.array(texts, pa.large_string()))]
    if not parts:
        return read_words(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    before = lambda sizes: np.cumsum([0, *sizes])[:-1]
    hashes, at, same = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
    first = np.concatenate([[0], *(p.first[1:] + n for p, n in zip(parts, before([len(p.row) for p in parts]), strict=True))])
    row = np.concatenate([same.ravel()[p.row + n] for p, n in zip(parts, before([len(p.hashes) for p in parts]), strict=True)])
    begin = np.concatenate([p.begin + n for p, n in zip(parts, before([len(p.trigrams) for p in parts]), strict=True)])
    trigrams = np.concatenate([p.trigrams for p in parts])
    trigrams, begin = _trigrams(trigrams, begin, at)
    return Words(first, row, hashes, trigrams, begin)


def _trigrams(trigrams: np.ndarray, begin: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the words `some`, in that order, and where each word's begin."""
    size = np.diff(np.append(begin, len(trigrams)))[some]
    starts = np.cumsum(size) - size
    return trigrams[np.repeat(begin[some] - starts, size) + np.arange(int(size.sum()))], starts


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of all windows; a document with a word has at least one."""
    n = np.diff(first)
    many = np.where(n == 0, 0, 1 + -(-np.maximum(n - WINDOW, 0) // STRIDE))
    doc = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = np.minimum(nth * STRIDE, np.maximum(n[doc] - WINDOW, 0))
    return doc, first[:-1][doc] + start, np.minimum(n[doc], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    vocabulary: np.ndarray  # sorted word hashes; row 0 of the embedding is for all other words
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0
    share: float = 0.0  # of toxic rows

    @classmethod
    def new(cls, vocabulary: np.ndarray, lean: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        dim = WORD_DIM + CHAR_DIM
        p = {
            "word": 0.1 * rng.normal(size=(len(vocabulary) + 1, WORD_DIM)), "char": 0.1 * rng.normal(size=(TRIGRAMS, CHAR_DIM)),
            "in": draw(dim, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN), "fwd": draw(HIDDEN, 3 * HIDDEN), "bwd": draw(HIDDEN, 3 * HIDDEN),
            "att": draw(2 * HIDDEN, ATTENTION), "att_bias": np.zeros(ATTENTION), "att_out": draw(ATTENTION), "out": draw(2 * HIDDEN), "out_bias": np.zeros(1),
        }
        p["word"][1:, 0] = np.clip(lean, -2, 2)
        return cls(vocabulary, {k: v.astype(np.float32) for k, v in p.items()})

    def word_rows(self, words: Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == words.hashes if len(self.vocabulary) else np.zeros(len(words.hashes), bool)
        return np.where(known, at + 1, 0)

    def inputs(self, words: Words, rows: np.ndarray) -> np.ndarray:
        """Input of each different word."""
        if not len(rows):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        count = np.diff(np.append(words.begin, len(words.trigrams)))
        chars = np.add.reduceat(self.p["char"][words.trigrams], words.begin, axis=0) / count[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][rows], chars], 1)

    def _read(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, steps: range, keep: list | None) -> np.ndarray:
        """States (T, B, HIDDEN) of one direction; x has the projected inputs (T, B, 3 * HIDDEN)."""
        k = HIDDEN
        h = np.zeros((x.shape[1], k), np.float32)
        out = np.empty((x.shape[0], x.shape[1], k), np.float32)
        for t in steps:
            a = h @ u
            zr = x[t, :, : 2 * k] + a[:, : 2 * k]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r, carried = zr[:, :k], zr[:, k:], a[:, 2 * k :]
            n = np.tanh(x[t, :, 2 * k :] + r * carried)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, carried, n, m))
            h = h + m * ((1 - z) * (n - h))
            out[t] = h
        return out

    def forward(self, projected: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; projected (T, B, 6 * HIDDEN), mask (T, B)."""
        steps, k, p = range(len(mask)), 3 * HIDDEN, self.p
        fwd: list | None = None if keep is None else []
        bwd: list | None = None if keep is None else []
        h = np.concatenate([self._read(projected[:, :, :k], mask, p["fwd"], steps, fwd), self._read(projected[:, :, k:], mask, p["bwd"], steps[::-1], bwd)], 2)
        u = np.tanh(h @ p["att"] + p["att_bias"])
        s = np.where(mask > 0, u @ p["att_out"], np.float32(-1e9))
        e = np.exp(s - s.max(0))
        w = e / e.sum(0)
        c = (w[:, :, None] * h).sum(0)
        if keep is not None:
            keep |= {"fwd": fwd, "bwd": bwd, "h": h, "u": u, "w": w, "c": c}
        return c @ p["out"] + p["out_bias"][0]

    def gradients(self, words: Words, rows: np.ndarray, index: np.ndarray, mask: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss; index (T, B) has each step's row among the different words."""
        p, k = self.p, HIDDEN
        x = self.inputs(words, rows)
        step_in = x[index]
        keep: dict = {}
        logit = self.forward(step_in @ p["in"] + p["bias"], mask, keep)
        g: dict[str, np.ndarray] = {}
        d = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
        h, u, w, c = keep["h"], keep["u"], keep["w"], keep["c"]
        g["out"], g["out_bias"] = c.T @ d, d.sum(keepdims=True)
        dc = d[:, None] * p["out"]
        dw = (h * dc).sum(2)
        ds = w * (dw - (w * dw).sum(0))
        du = ds[:, :, None] * p["att_out"] * (1 - u * u)
        g["att_out"] = np.tensordot(u, ds, ([0, 1], [0, 1]))
        g["att"], g["att_bias"] = np.tensordot(h, du, ([0, 1], [0, 1])), du.sum((0, 1))
        dh = w[:, :, None] * dc + du @ p["att"].T
        dx = np.empty((*mask.shape, 6 * k), np.float32)
        for name, part, at in (("fwd", dh[:, :, :k], 0), ("bwd", dh[:, :, k:], 3 * k)):
            g[name] = np.zeros_like(p[name])
            carry = np.zeros_like(part[0])
            for t, before, z, r, carried, n, m in reversed(keep[name]):
                now = carry + part[t]
                new = now * m
                dn = new * (1 - z) * (1 - n * n)
                dz = new * (before - n) * z * (1 - z)
                dr = dn * carried * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], 1)
                dx[t, :, at : at + 3 * k] = np.concatenate([dz, dr, dn], 1)
                g[name] += before.T @ da
                carry = now - new * (1 - z) + da @ p[name].T
        g["in"], g["bias"] = np.tensordot(step_in, dx, ([0, 1], [0, 1])), dx.sum((0, 1))
        flat = (dx @ p["in"].T).reshape(-1, WORD_DIM + CHAR_DIM)
        by_word = np.zeros_like(x)
        np.add.at(by_word, index.ravel(), flat)
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], rows, by_word[:, :WORD_DIM])
        count = np.diff(np.append(words.begin, len(words.trigrams)))
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], words.trigrams, np.repeat(by_word[:, WORD_DIM:] / count[:, None], count, axis=0))
        return g

    def logits(self, words: Words, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(document, logit) of every window."""
        doc, start, size = windows(words.first)
        x = self.inputs(words, self.word_rows(words)) @ self.p["in"] + self.p["bias"]
        out = np.empty(len(doc), np.float32)
        for a in range(0, len(doc), block):
            index, mask = _steps(words.row, start[a : a + block], size[a : a + block])
            out[a : a + block] = self.forward(x[index], mask)
        return doc, out

    def scores(self, words: Words) -> np.ndarray:
        doc, logit = self.logits(words)
        best = np.full(len(words.first) - 1, -np.inf)
        np.maximum.at(best, doc, logit)
        return np.where(np.isinf(best), self.share, _sigmoid(self.scale * np.where(np.isinf(best), 0, best) + self.shift))


def _steps(row: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) row of each step's word, and which steps there are."""
    longest = int(size.max(initial=1))
    t = np.arange(longest)[:, None]
    index = row[np.minimum(start + t, len(row) - 1)]
    return index, (t < size).astype(np.float32)


def _telling_words(words: Words, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, standard scores) of the words in two documents or more, the VOCABULARY ones whose shares of toxic and
    other documents differ most, sorted by hash."""
    doc = tc.owner(words.first)
    seen = np.unique(words.row * len(toxic) + doc)
    row, of = seen // len(toxic), seen % len(toxic)
    yes = np.bincount(row[toxic[of] > 0], minlength=len(words.hashes))
    no = np.bincount(row[toxic[of] == 0], minlength=len(words.hashes))
    n_yes, n_no = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    common = (yes + no + 1) / (n_yes + n_no + 2)
    score = (yes / n_yes - no / n_no) / np.sqrt(common * (1 - common) * (1 / n_yes + 1 / n_no))
    use = np.flatnonzero(yes + no >= 2)
    use = use[np.argsort(-np.abs(score[use]), kind="stable")[:VOCABULARY]]
    use = use[np.argsort(words.hashes[use])]
    return words.hashes[use], score[use]


def _part(words: Words, rows: np.ndarray, index: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The different words that a batch has, and the batch's index into them."""
    some, again = np.unique(index, return_inverse=True)
    trigrams, begin = _trigrams(words.trigrams, words.begin, some)
    return Words(words.first, words.row, words.hashes[some], trigrams, begin), rows[some], again.reshape(index.shape)


def train(texts: list[str], toxic: np.ndarray, share: float, rounds: int = ROUNDS, steps: int = STEPS, seed: int = 7) -> Network:
    """Fit to labelled texts; `share` of all labelled rows is toxic."""
    toxic = np.asarray(toxic, np.float32)
    rng = np.random.default_rng(seed)
    words = read_texts(texts)
    vocabulary, known = _telling_words(words, toxic)
    net = Network.new(vocabulary, known / 3, seed)
    net.share = share
    doc, start, size = windows(words.first)
    held = np.arange(len(toxic)) % 5 == 4
    if not len(doc) or min(toxic[~held].sum(), (1 - toxic)[~held].sum()) == 0:
        net.scale, net.shift = 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return net
    rows = net.word_rows(words)
    known = np.concatenate([[0], known])[rows][words.row]
    total = np.concatenate([[0], np.cumsum(np.maximum(known - 2, 0))])
    words_tell = total[start + size] - total[start] + 1e-3 * rng.random(len(start))
    telling = words_tell
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    mean = {k: v.copy() for k, v in net.p.items()}
    step = 0
    use = ~held[doc]
    for turn in range(rounds):
        # of a toxic document its most telling window, of the others that one and some at random
        order = np.lexsort((-telling, doc))
        top = order[np.append(True, np.diff(doc[order]) > 0)]
        rest = rng.permutation(np.flatnonzero(use & (toxic[doc] == 0)))[: len(top)]
        chosen = rng.permutation(np.concatenate([top[use[top]], rest]))
        for nth in range(steps):
            b = chosen[np.arange(nth * BATCH, nth * BATCH + min(BATCH, len(chosen))) % len(chosen)]
            index, mask = _steps(words.row, start[b], size[b])
            part, part_rows, part_index = _part(words, rows, index)
            seen = np.where(rng.random(len(part_rows)) < HIDE, 0, part_rows)  # so that spelling has to tell as well
            g = net.gradients(part, seen, part_index, mask, toxic[doc[b]])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for k, v in net.p.items():
                m, s = moment[k]
                d = g[k] * min(1, 5 / max(norm, 1e-9))
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                mean[k] += max(FRESH, 1 / step) * (v - mean[k])
        if turn + 1 < rounds:
            telling = net.logits(words)[1] + words_tell
    net.p = mean
    _, logit = net.logits(words)
    best = np.full(len(toxic), -np.inf)
    np.maximum.at(best, doc, logit)
    fit = held & ~np.isinf(best)
    weight = np.where(toxic > 0, share / max(toxic[fit].mean(), 1e-9), (1 - share) / max(1 - toxic[fit].mean(), 1e-9))
    net.scale, net.shift = _calibrate(best[fit], toxic[fit], weight[fit])
    return net


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of y on x by Newton's method with step halving; the targets are drawn in a little,
    as in Platt's scaling, so that separable scores have a finite fit."""
    yes, no = max(float(y.sum()), 1.0), max(float((1 - y).sum()), 1.0)
    y = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    design = np.stack([x, np.ones_like(x)], 1).astype(np.float64)
    loss = lambda b: float((weight * (np.logaddexp(0, design @ b) - y * (design @ b))).sum())
    b = np.zeros(2)
    for _ in range(50):
        q = _sigmoid(design @ b)
        hessian = (design * (weight * q * (1 - q))[:, None]).T @ design + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, design.T @ (weight * (q - y)))
        while loss(b - move) > loss(b) and np.abs(move).max() > 1e-9:
            move /= 2
        b = b - move
        if np.abs(move).max() < 1e-9:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def _scored(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tc.slices(batch.columns[-1]):
                got = np.clip(net.scores(read_words(data, offsets)), 0, 1)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(got, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def held_out(key: str) -> F.Column:
    return F.crc32(named(key).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Network:
    """Train on a bounded sample of the labelled rows that are not held out."""
    usable = labels.where(named(label).isin(0, 1) & ~held_out(key)).select(named(key).alias("key"), named(label).cast("int").alias("label"))
    sample, counts = labelled_sample(docs, usable, key, text, max_rows, max_bytes)
    n = sum(counts.values())
    order = np.random.default_rng(11).permutation(len(sample))
    return train([sample[i][1] for i in order], np.array([sample[i][0] for i in order], np.float32), counts.get(1, 0) / n if n else 0.0)


def toxicity_scores(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, held_out, score and predicted. No shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(named(key), held_out(key).alias("held_out"), named(text).alias("row_text"))
    kind = rows.schema[0].dataType.simpleString()
    scored = rows.mapInArrow(_scored(net), f"`{key}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
