"""Quality rules from repetition coverage: what share of a text lies inside repeated word n-grams and lines.

Rolling hashes of the n-gram lengths in NGRAMS are taken with numpy over whole batches. A window counts as repeated if
the same words stand earlier in the same document; the coverage is the number of characters of the words under
repeated windows. Longer windows are only hashed where all shorter ones inside them occur twice.

Defined results: null and empty texts and texts without a word have zeros everywhere and fail the base rule; rows are
independent, so repeated rows and equal doc_ids each give a row; an empty table gives no rows; very long texts are
measured whole, a slice of documents at a time; ties do not occur, as verdicts are thresholds on counts; carried columns
travel inside a struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import named, ship

#: n-gram length -> largest percentage of word characters that repeated windows of that length may cover.
NGRAMS = {5: 30, 7: 26, 10: 20}
#: Largest percentages of lines, and of word characters in lines, that may repeat an earlier line.
MAX_DUP_LINES = 40
MAX_DUP_LINE_CHARS = 40
MIN_WORDS = 50
MAX_REPEAT_WORDS = 50
SYMBOLS = tc.lut(*b"#*$%&|<>")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", *(f"dup_chars_{n}" for n in NGRAMS)]
SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each document of a slice."""
    n_docs = len(offsets) - 1
    salt = tc.mix(np.arange(1, n_docs + 1, dtype=np.uint64))
    starts, ends, first = tc.words(data, offsets)
    doc = tc.owner(first)
    inside = ~tc.SPACE[data]
    letter = inside & ((data & 0xC0) != 0x80)
    so_far = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=so_far[1:])
    chars = so_far[ends] - so_far[starts]
    out = {"n_words": np.diff(first), "word_chars": tc.sums_by(letter, offsets), "n_symbols": tc.sums_by(SYMBOLS[data], offsets)}

    line_start, line_end, line_first = tc.runs(data != 10, offsets)
    line_chars = so_far[line_end] - so_far[line_start]
    full = np.flatnonzero(line_chars)  # lines without a word count nowhere
    line_doc = tc.owner(line_first)[full]
    _, again = tc.seen_before(tc.span_hashes(data, line_start[full], line_end[full]) ^ salt[line_doc])
    out["n_lines"] = np.bincount(line_doc, minlength=n_docs)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n_docs)
    out["dup_line_chars"] = np.bincount(line_doc[again], line_chars[full][again], n_docs).astype(np.int64)

    h = tc.span_hashes(data, starts, ends)
    n = len(h)
    alive = np.ones(n, bool)  # windows of the length before that occur twice
    before = 0
    for size in (3, *NGRAMS):
        keys = tc.window_hashes(h, size)
        at = np.flatnonzero(doc[: len(keys)] == doc[size - 1 :]) if len(keys) else np.zeros(0, np.int64)
        if before:
            at = at[alive[at] & alive[at + size - before]]
        twice, again = tc.seen_before(keys[at] ^ salt[doc[at]]) if len(at) else (np.zeros(0, bool), np.zeros(0, bool))
        alive = np.zeros(n, bool)
        alive[at[twice]] = True
        before = size
        if size == 3:
            out["n_repeat_words"] = np.bincount(doc[tc.cover(at[twice], size, n)], minlength=n_docs)
        else:
            hit = tc.cover(at[again], size, n)
            out[f"dup_chars_{size}"] = np.bincount(doc[hit], chars[hit], n_docs).astype(np.int64)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, texts = batch.columns[:-1], batch.columns[-1]
        for a, b, data, offsets in tc.slices(texts):
            counts = measure(data, offsets)
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in kept), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], [*batch.schema.names[:-1], *COUNTS])


def verdicts(measured: DataFrame) -> DataFrame:
    """base_failed and kept from the counts; all comparisons are of integers."""
    of = lambda part, whole, percent: 100 * F.col(part) > percent * F.col(whole)
    base = (F.col("n_words") < MIN_WORDS) | of("n_repeat_words", "n_words", MAX_REPEAT_WORDS)
    repeats = of("n_dup_lines", "n_lines", MAX_DUP_LINES) | of("dup_line_chars", "word_chars", MAX_DUP_LINE_CHARS)
    for n, percent in NGRAMS.items():
        repeats = repeats | of(f"dup_chars_{n}", "word_chars", percent)
    return measured.withColumns({"base_failed": base, "kept": ~base & ~repeats})


def repetition_rules(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the columns of `carry`, COUNTS, base_failed and kept. No shuffle."""
    judged = _judged(docs, text, carry)
    return judged.select("row.*", *COUNTS, "base_failed", "kept")


def _judged(docs: DataFrame, text: str, carry: tuple[str, ...] | list[str]) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*map(named, carry)).alias("row"), named(text).alias("text"))
    return verdicts(rows.mapInArrow(_measured, f"row {rows.schema['row'].dataType.simpleString()}, {SCHEMA}"))


def keep_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, unchanged, that the rules keep."""
    return _judged(docs, text, docs.columns).where("kept").select("row.*")


def _ngram_sql(n: int, first_included: bool) -> str:
    """DuckDB: positions of words under windows of n words that occur twice (or, else, that stand earlier too)."""
    word = " || ' ' || ".join(f"lead(w, {i}) OVER o" if i else "w" for i in range(n))
    rank = "count(*) OVER (PARTITION BY doc_id, g) > 1" if first_included else "row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1"
    return f"""g{n} AS (SELECT doc_id, i, {word} AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r{n} AS (SELECT doc_id, i, {rank} AS hit FROM g{n} WHERE g IS NOT NULL),
c{n} AS (SELECT w.doc_id, w.i, w.chars, coalesce(max(r.hit::INT) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) AS hit FROM w LEFT JOIN r{n} r ON r.doc_id = w.doc_id AND r.i = w.i),
s{n} AS (SELECT doc_id, sum(hit)::BIGINT AS words, sum(hit * chars)::BIGINT AS chars FROM c{n} GROUP BY doc_id)"""


def oracle(source: str = "documents") -> str:
    """The measures and verdicts in DuckDB's SQL."""
    word = r"[^\x20\x09-\x0D]+"
    bad = " OR ".join(["100 * n_dup_lines > {} * n_lines".format(MAX_DUP_LINES), f"100 * dup_line_chars > {MAX_DUP_LINE_CHARS} * word_chars", *(f"100 * dup_chars_{n} > {p} * word_chars" for n, p in NGRAMS.items())])
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS} * n_words"
    joins = "\n".join(f"LEFT JOIN s{n} ON s{n}.doc_id = d.doc_id" for n in (3, *NGRAMS))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM {source}),
w AS MATERIALIZED (SELECT doc_id, i, ws[i] AS w, length(ws[i]) AS chars FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
{", ".join(_ngram_sql(n, n == 3) for n in (3, *NGRAMS))},
l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d))),
lw AS (SELECT doc_id, list_sum(list_transform(regexp_extract_all(line, '{word}'), lambda x: length(x))) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup FROM l WHERE len(regexp_extract_all(line, '{word}')) > 0),
ls AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dup) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE dup), 0)::BIGINT AS dup_line_chars FROM lw GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(s3.words, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {", ".join(f"coalesce(s{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n in NGRAMS)}
  FROM d LEFT JOIN ls ON ls.doc_id = d.doc_id
{joins})
SELECT *, ({base}) AS base_failed, NOT ({base}) AND NOT ({bad}) AS kept FROM m"""
