"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index holds (term, doc_id, position) for the terms that a search needs first: of each benchmark window its
RARE_TERMS rarest in the training corpus. Searching intersects the offset-adjusted lists of those terms: a posting of
the term at offset o of an item puts the item at position - o, and an item position is only kept where all rare terms
of a window agree. What is left is compared word for word with the text, so the matches are exact.

A proximity match is a stretch of at most size + slop words that has all different terms of a window of `size` words, in
any order. Its candidates come from the same postings: places of one source's rare terms are gathered by blocks of
document positions, and a window is searched for in the text only where all its rare terms fall into two neighbouring
blocks. A phrase match is a proximity match too, so only other pairs of document and item are looked at.

The joins with benchmark terms use a broadcast only after their rows have been counted (shared.small), otherwise they
are shuffled; postings are never gathered per term, so a frequent term is a join key that Spark can split and not a
group in one task.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z have been lower-cased. Defined results: null and empty texts
have no words and no hits; items that are null or without words have no window; an item shorter than a window is one
window; items of one item_id, null or not, all count, as one item; a row of documents that is there twice gives its
result twice; equal texts of several items all count; terms of equal frequency are ranked by place; very long texts
are searched whole; no documents give no rows, and no items no hits; other columns are carried inside a struct or not
read, so their names cannot clash.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, named, small

WINDOW = 13
RARE_TERMS = 3
#: Words that a proximity match may have between those of the window.
SLOP = 7
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of texts with capitals
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def folded(text: Column) -> Column:
    """A-Z to lower case and nothing else; for plain ASCII that is what the faster function does."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def pieces_of(text: Column) -> Column:
    """The words of a long text, not folded yet, in half the time: the parts between separators. The first and the last
    may be empty; they keep their place, so that places in a text stay comparable."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def with_value(value: Column, body) -> Column:
    """body(value), with value computed once: a plain reference would be inlined wherever it is used."""
    return F.transform(F.array(value), body)[0]


def count_words(text: Column) -> Column:
    first_and_last = lambda p: F.when(p[0] == "", 1).otherwise(0) + F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)
    return with_value(pieces_of(text), lambda p: (F.size(p) - first_and_last(p)).cast("long"))


def item_sources(items: DataFrame, item: str, text: str) -> DataFrame:
    """(source, item_id, ws): the different word lists of each item_id, numbered. An item_id may be null or stand in
    several rows, so it is carried along and never a key. Write the result before use, so that the numbers stay."""
    w = items.select(named(item).alias("item_id"), words_of(named(text)).alias("ws")).where(F.size("ws") > 0)
    return w.distinct().select(F.monotonically_increasing_id().alias("source"), "item_id", "ws")


def item_windows(sources: DataFrame, window: int) -> DataFrame:
    """(source, item_id, at, words): each window of each source; a source of fewer words is one window."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))).alias("at")
    return sources.select("source", "item_id", "ws", at).select("source", "item_id", "at", F.slice("ws", F.col("at") + 1, window).alias("words"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs(key, text) -> (term, key, position) of the given terms."""
    every = docs.select("key", F.posexplode(pieces_of(F.col("text"))).alias("position", "piece"))
    return every.select("key", "position", folded(F.col("piece")).alias("term")).join(terms, "term", "left_semi")


class PositionalIndex:
    """Postings of a corpus for the terms that the searches of `items` start from, stored in the shared folder."""

    def __init__(self, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, rare_terms: int = RARE_TERMS):
        self.work, self.window, self.matches = Workspace(docs.sparkSession, "positions"), window, None
        # equal rows of one key and text share a key here, so lists of places cannot mix
        self.docs = docs.select(F.struct(named(key).alias("id"), F.xxhash64(named(text)).alias("hash")).alias("key"), named(text).alias("text"))
        sources = self.work.write(item_sources(items, item, item_text), "sources")
        self.windows = self.work.write(item_windows(sources, window), "windows")
        terms = self.work.write(self.windows.select(F.explode("words").alias("term")).distinct(), "terms")
        self.n_terms = terms.count()
        counted = postings(self.docs, small(terms, self.n_terms)).groupBy("term").agg(F.count("*").alias("df"))
        self.frequency = self.work.write(counted, "frequency")
        spread = self.windows.select("source", "item_id", "at", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
        known = spread.join(self.frequency, "term")
        lists = known.groupBy("source", "item_id", "at", "size").agg(F.array_sort(F.collect_list(F.struct("df", "offset", "term"))).alias("terms"))
        # a window with a term that the corpus lacks cannot occur
        rare = lists.where(F.size("terms") == F.col("size")).select("source", "item_id", "at", "size", F.slice("terms", 1, rare_terms).alias("terms"))
        self.rare = self.work.write(rare, "rare")
        self.places = self.work.write(self.rare.select("source", F.explode("terms").alias("t"), "at").select("source", F.col("t.term").alias("term"), (F.col("at") + F.col("t.offset")).alias("place")).distinct(), "places")
        self.n_places = self.places.count()
        first = self.places.select("term").distinct()
        self.postings = self.work.write(postings(self.docs, small(first, self.n_places)), "postings")

    def aligned(self) -> DataFrame:
        """(key, source, shift, places): the source's rare places that stand in the document with the source at `shift`."""
        put = self.postings.join(small(self.places, self.n_places), "term").select("key", "source", (F.col("position") - F.col("place")).alias("shift"), "place")
        return put.groupBy("key", "source", "shift").agg(F.collect_set("place").alias("places"))

    def phrase_candidates(self) -> DataFrame:
        """(key, source, at, start): windows whose rare terms' offset-adjusted lists intersect at `start`."""
        need = self.rare.select("source", "at", "size", F.transform("terms", lambda t: F.col("at") + t["offset"]).alias("need"))
        n = self.rare.count()
        both = self.aligned().join(small(need, n), "source")
        both = both.where((F.size(F.array_except("need", "places")) == 0) & (F.col("shift") + F.col("at") >= 0))
        return both.select("key", "source", "at", (F.col("shift") + F.col("at")).alias("start"))

    def phrase_matches(self) -> DataFrame:
        """(key, matches): for each document with exact occurrences of windows, structs of start, size and item_id;
        searched once and kept."""
        if self.matches is None:
            self.matches = self.work.write(self._search(), "matches")
        return self.matches

    def _search(self) -> DataFrame:
        found = self.phrase_candidates().join(small(self.windows, self.windows.count()), ["source", "at"])
        found = found.groupBy("key").agg(F.collect_list(F.struct("start", "words", "item_id")).alias("found"))
        texts = self.docs.join(self.work.write(found, "candidates").hint("merge"), "key")
        same = lambda ws, m: F.transform(F.slice(ws, m["start"] + 1, F.size(m["words"])), folded) == m["words"]
        exact = with_value(pieces_of(F.col("text")), lambda ws: F.filter("found", lambda m: same(ws, m)))
        kept = self.work.write(texts.select("key", exact.alias("found")), "exact").where(F.size("found") > 0)
        self.work.drop("candidates")
        return kept.select("key", F.transform("found", lambda m: F.struct(m["start"].alias("start"), F.size(m["words"]).alias("size"), m["item_id"].alias("item_id"))).alias("matches")).distinct()

    def proximity_candidates(self, slop: int) -> DataFrame:
        """(key, source, at, block): windows whose rare terms all stand in a block of document positions or the next."""
        at = F.floor(F.col("position") / (self.window + slop))
        put = self.postings.join(small(self.places.select("source", "term").distinct(), self.n_places), "term")
        have = put.select("key", "source", "term", F.explode(F.array(at - 1, at)).alias("block")).where("block >= 0").groupBy("key", "source", "block").agg(F.collect_set("term").alias("have"))
        need = self.rare.where("size > 1").select("source", "at", F.array_distinct(F.transform("terms", lambda t: t["term"])).alias("need"))
        n, least = need.agg(F.count("*"), F.coalesce(F.min(F.size("need")), F.lit(0))).first()
        both = have.where(F.size("have") >= least).join(small(need, n), "source")
        return both.where(F.size(F.array_except("need", "have")) == 0).select("key", "source", "at", "block")

    def proximity_matches(self, slop: int = SLOP) -> DataFrame:
        """(key, item_id): documents and the items of which a window stands in them within slop additional words."""
        exact = self.phrase_matches().select("key", F.explode("matches").alias("m")).select("key", F.col("m.item_id").alias("item_id")).distinct()
        exact = self.work.write(exact, "exact-items")
        found = self.proximity_candidates(slop).join(small(self.windows, self.windows.count()), ["source", "at"])
        known = exact.select(F.col("key").alias("own"), F.col("item_id").alias("own_item"))
        found = found.join(known, (F.col("key") == F.col("own")) & F.col("item_id").eqNullSafe(F.col("own_item")), "left_anti")
        tries = F.struct(F.array_distinct("words").alias("terms"), F.size("words").alias("size"), "item_id", "block")
        found = self.work.write(found.groupBy("key").agg(F.collect_set(tries).alias("tries")), "tries")
        texts = self.docs.join(found.hint("merge"), "key")
        step = self.window + slop

        def stands(ws, t):
            starts = F.sequence((t["block"] * step).cast("int"), (t["block"] * step + step - 1).cast("int"))
            return F.exists(starts, lambda s: F.size(F.array_except(t["terms"], F.slice(ws, s + 1, t["size"] + slop))) == 0)

        near = with_value(F.transform(pieces_of(F.col("text")), folded), lambda ws: F.filter("tries", lambda t: stands(ws, t)))
        near = texts.select("key", F.explode(F.array_distinct(F.transform(near, lambda t: t["item_id"]))).alias("item_id"))
        return exact.union(near).distinct()


def _covered(matches: Column) -> Column:
    """Number of words under matches (start, size), which are sorted first."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, m: F.struct(
        F.greatest(acc["end"], m["start"] + m["size"]).alias("end"),
        (acc["n"] + F.greatest(m["start"] + m["size"] - F.greatest(acc["end"], m["start"]), F.lit(0))).alias("n"),
    )
    return F.aggregate(F.array_sort(matches), zero, step, lambda acc: acc["n"])


def _judged(docs: DataFrame, items: DataFrame, key: str, text: str, carry: tuple[str, ...] | list[str], index: dict, slop: int | None = None) -> DataFrame:
    built = PositionalIndex(docs, items, key, text, **index)
    hits = built.phrase_matches().withColumn("ids", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string")))))
    hits = hits.select("key", _covered(F.col("matches")).alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    if slop is not None:
        near = built.proximity_matches(slop).groupBy("key").agg(F.count("*").alias("n_near_items"))
        hits = hits.join(near, "key", "full")
    hits = built.work.write(hits, "hits")
    built.work.keep("hits")
    rows = docs.select(F.struct(named(key).alias("id"), F.xxhash64(named(text)).alias("hash")).alias("key"), F.struct(*map(named, carry)).alias("row"), count_words(named(text)).alias("n_words"))
    out = rows.join(small(hits, hits.count()), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "row", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        *([] if slop is None else [F.coalesce("n_near_items", F.lit(0).cast("long")).alias("n_near_items")]),
    )


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("doc_id",), slop: int | None = None, **index) -> DataFrame:
    """One row per document: the columns of `carry`, n_words, n_hit, n_items, items_sha256 and contaminated; with a slop
    also n_near_items, the number of items with a phrase or proximity match."""
    out = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", *["n_near_items"] * (slop is not None)]
    return _judged(docs, items, key, text, carry, index, slop).select("row.*", *out)


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **index) -> DataFrame:
    """The rows of `docs`, unchanged, that are not contaminated."""
    return _judged(docs, items, key, text, docs.columns, index).where("NOT contaminated").select("row.*")


def oracle() -> str:
    """The same in DuckDB's SQL, by hashing every window of the documents."""
    ws = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}')"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {ws('text')} AS ws FROM documents),
b AS (SELECT item_id, {ws('text')} AS ws FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w, least(len(ws), {WINDOW}) AS n FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM p CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE i + n - 1 <= len(ws)),
m AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, w)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
f AS (SELECT w, count(*) AS df FROM (SELECT unnest(ws) AS w FROM d) GROUP BY w),
nw AS (SELECT item_id, list_distinct(string_split(w, ' ')) AS terms, n + {SLOP} AS span FROM iw WHERE n > 1),
nr AS MATERIALIZED (SELECT item_id, terms, span, arg_min(t, (coalesce(df, 0), t)) AS rarest FROM (SELECT *, unnest(terms) AS t FROM nw) LEFT JOIN f ON f.w = t GROUP BY item_id, terms, span),
np AS MATERIALIZED (SELECT doc_id, i, w, ws[greatest(i - {WINDOW + SLOP - 1}, 1):i + {WINDOW + SLOP - 1}] AS around FROM (SELECT doc_id, ws, i, ws[i] AS w FROM p) WHERE w IN (SELECT rarest FROM nr)),
nc AS (SELECT item_id, terms, span, doc_id, around FROM np JOIN nr ON rarest = w WHERE list_has_all(around, terms)),
nm AS (SELECT DISTINCT doc_id, item_id FROM (SELECT *, unnest(range(1, len(around) + 1)) AS s FROM nc) WHERE list_has_all(around[s:s + span - 1], terms)),
ni AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT doc_id, item_id FROM m UNION SELECT * FROM nm) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN ni USING (doc_id)"""
