"""Quality of documents by hierarchical empirical Bayes: a document's own evidence, its host and its path.

1. A logistic classifier over features of the text gives each document the odds by which it speaks for quality,
   relative to the labelled share (its evidence) and the probability that follows.
2. Grouped sums of those probabilities give each host and each (host, path) a number of documents and of good ones.
   A host's rate is shrunk toward the global rate, a path's toward its host's; the strengths are fitted to the spread
   of the groups (method of moments), so they come from the data: many alike sites shrink strongly.
3. A document's prior is its path's rate without itself; evidence and prior together give its posterior.

The classifier is fitted on the driver to a bounded sample of the labelled rows' different texts (of each label those
of smallest hash, at most MAX_ROWS and MAX_BYTES together; a single text of more than MAX_BYTES / 8 cannot be held
beside others and is left out). Everything else covers all documents by grouped aggregation with partial sums, so a host with a third of
the rows is no burden; the tables of hosts and paths are broadcast only when counted to be small.

Defined results: a null host or path is a group of its own; null and empty texts have zero features; repeated rows
count each; labels that are null are not used; without labels of both kinds the evidence is 0. Null keys are kept. An
empty table gives no rows; very long texts are scored whole; a posterior of exactly 0.5 (a tie) is kept; only the key is
carried, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repetition
from . import textcore as tc
from .shared import Workspace, labelled_sample, named, ship, small

MAX_ROWS, MAX_BYTES = 2000, 12 << 20
_UPPER, _DIGIT = tc.lut(range(65, 91)), tc.lut(range(48, 58))
_STOP, _BAR = tc.lut(*b".!?"), tc.lut(*b"|")
_PUNCT = tc.lut(range(33, 48), range(58, 65), range(91, 97), range(123, 127))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, features): sizes and shares that tell prose from lists, junk and repetition."""
    c = repetition.measure(data, offsets)
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    lines = np.maximum(c["n_lines"], 1)
    share = lambda table: tc.sums_by(table[data], offsets) / chars
    starts, ends, first = tc.words(data, offsets)
    doc, n = tc.owner(first), len(offsets) - 1
    h = tc.span_hashes(data, starts, ends) ^ tc.mix(np.arange(1, n + 1, dtype=np.uint64))[doc]
    _, again = tc.seen_before(h)
    repeated = np.bincount(doc[again], minlength=n) / words
    last = np.zeros(len(starts), bool)
    last[:-1] = h[1:] == h[:-1]
    stutter = np.bincount(doc[last], minlength=n) / words
    columns = [
        np.log1p(c["n_words"]), c["word_chars"] / words, np.minimum(c["n_symbols"] / words, 3), c["n_dup_lines"] / lines, c["n_repeat_words"] / words, np.minimum(words / lines, 200) / 50,
        repeated, stutter, share(_UPPER), share(_DIGIT), np.minimum(tc.sums_by(_STOP[data], offsets) / words, 1), np.minimum(tc.sums_by(_BAR[data], offsets) / words, 1), share(_PUNCT), c["dup_chars_5"] / chars,
    ]
    return np.stack(columns, 1)


@dataclass
class Classifier:
    mean: np.ndarray
    deviation: np.ndarray
    weight: np.ndarray
    bias: float
    share: float  # of good rows among the labelled

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.deviation).clip(-8, 8) @ self.weight + self.bias


def _features_of(texts: list[str]) -> np.ndarray:
    found = [features(data, offsets) for _, _, data, offsets in tc.slices(pa.array(texts, pa.large_string()))]
    return np.concatenate(found) if found else np.zeros((0, 14))


def train(texts: list[str], good: np.ndarray, whole_share: float | None = None, ridge: float = 1.0) -> Classifier:
    """Ridge logistic regression by Newton's method; the intercept is moved to the share of good rows among all
    labelled ones, where that differs from the sample's."""
    x, y = _features_of(texts), np.asarray(good, float)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Classifier(np.zeros(14), np.ones(14), np.zeros(14), 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), min(max(share, 1e-3), 1 - 1e-3))
    mean, deviation = x.mean(0), x.std(0) + 1e-6
    design = np.concatenate([((x - mean) / deviation).clip(-8, 8), np.ones((len(x), 1))], 1)
    b, penalty = np.zeros(design.shape[1]), ridge * np.eye(design.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (p - y) + penalty @ b)
        b -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    whole = share if whole_share is None else min(max(whole_share, 1e-3), 1 - 1e-3)
    return Classifier(mean, deviation, b[:-1], float(b[-1] + _odds(whole) - _odds(share)), whole)


def _odds(p: float) -> float:
    return float(np.log(p / (1 - p)))


def held_out(key: str) -> Column:
    return F.crc32(named(key).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Classifier:
    """Train on a bounded sample of the labelled rows that are not held out."""
    usable = labels.where(named(label).isin(0, 1) & ~held_out(key)).select(named(key).alias("key"), named(label).cast("int").alias("label"))
    sample, counts = labelled_sample(docs, usable, key, text, max_rows, max_bytes)
    n = sum(counts.values())
    return train([t for _, t in sample], np.array([y for y, _ in sample], float), counts.get(1, 0) / n if n else None)


def _evidence(model: Classifier):
    base = _odds(model.share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tc.slices(batch.columns[-1]):
                found = model.logits(features(data, offsets)) - base
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(found, pa.float64())], [*batch.schema.names[:-1], "evidence"])

    return run


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, toward: Column) -> float:
    """Prior weight, in documents, of the rate `toward`: from the spread of the groups' rates beyond chance."""
    spread = F.pow(F.col("good") / F.col("n") - toward, 2)
    chance = toward * (1 - toward)
    got = groups.where("n > 1").agg(F.count("*"), F.sum(F.col("n") * spread), F.sum(chance), F.sum(F.col("n") * chance)).first()
    if not got[0]:
        return 10.0
    excess = (got[1] - got[2]) / max(got[3], 1e-12)  # variance between groups as a share of p (1 - p)
    return float(np.clip(1 / max(excess, 1e-9) - 1, 1.0, 1e6))


def site_quality(docs: DataFrame, model: Classifier, host: Column, path: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, evidence (log-odds), host_rate, path_rate (without the document), posterior, kept."""
    ship(docs.sparkSession)
    work = Workspace(docs.sparkSession, "site-quality")
    group = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    rows = docs.select(named(key).alias("id"), group(host).alias("host"), group(path).alias("path"), named(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    base = _odds(model.share)
    scored = rows.mapInArrow(_evidence(model), f"id {kind}, host string, path string, evidence double")
    scored = work.write(scored.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + base)))), "evidence")

    paths = work.write(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    hosts = work.write(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    whole = hosts.agg(F.sum("n"), F.sum("good")).first()
    rate = min(max(whole[1] / whole[0], 1e-6), 1 - 1e-6) if whole[0] else model.share
    alpha = _strength(hosts, F.lit(rate))
    n_hosts, n_paths = hosts.count(), paths.count()
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), ((F.col("good") + alpha * rate) / (F.col("n") + alpha)).alias("host_mean"))
    paths = work.write(paths.join(small(hosts, n_hosts), "host"), "sites")
    beta = _strength(paths, F.col("host_mean"))

    out = scored.join(small(paths.select("host", "path", F.col("n").alias("path_n"), F.col("good").alias("path_good"), "host_n", "host_good"), n_paths), ["host", "path"])
    host_rate = (F.col("host_good") - F.col("p") + alpha * rate) / (F.col("host_n") - 1 + alpha)
    path_rate = (F.col("path_good") - F.col("p") + beta * F.col("host_rate")) / (F.col("path_n") - 1 + beta)
    bound = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.withColumn("host_rate", bound(host_rate)).withColumn("path_rate", bound(path_rate))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_rate"))))))
    return out.select(F.col("id").alias(key), "evidence", "host_rate", "path_rate", "posterior", (F.col("posterior") >= 0.5).alias("kept"))


def site_of(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: the host without www. and m., and the first folder of the path."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^(www|m)\.", "")
    return host, F.concat(F.lit("/"), F.split_part(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/")), F.lit("/"), F.lit(2)))
