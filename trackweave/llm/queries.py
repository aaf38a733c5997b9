"""The registered queries over the text tables: thin wrappers that derive each contract's columns from an operator.

QUERIES maps a name to a function of (spark, sf_dir); ORACLES has DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compaction, decontamination, packing, passage_cover, repetition, simhash, site_quality, suffix_repeats, token_files, toxicity
from .shared import Workspace, table


def tokenizer_path() -> str:
    """The byte-level vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Bytes of a repeat that counts as a passage; 99 of 100 passages of 50 words have 281 or more.
PASSAGE_BYTES = 256
#: Batches in which op10 receives the table.
ARRIVALS = 4


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontamination.SLOP)


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_passage_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_cover.passage_digest(table(spark, sf_dir, "documents"))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths their languages within a source."""
    docs = table(spark, sf_dir, "documents")
    return site_quality.site_quality(docs, site_quality.fit(docs, table(spark, sf_dir, "labels")), F.col("source"), F.col("lang"))


def page_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages by host and first folder of their URL, many of them sparse, with the classifier of the documents; the
    text is the page without its tags."""
    model = site_quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    host, path = site_quality.site_of(F.col("url"))
    return site_quality.site_quality(table(spark, sf_dir, "pages").withColumn("page_text", plain), model, host, path, "page_id", "page_text")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "tokens").path("files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.read_token_files(spark, path).withColumnRenamed("id", "doc_id")


def op8_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's strings of 400 bytes; n_passage_bytes has the bytes under repeats of PASSAGE_BYTES, which passages
    of over 50 words reach and 400 bytes often miss."""
    return suffix_repeats.repeat_digest(table(spark, sf_dir, "documents"), shorter=PASSAGE_BYTES)


def op10_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through ARRIVALS appends and the compactions between them, read back over the last manifest. Nobody
    else knows this store, so merged files can go at once."""
    docs = table(spark, sf_dir, "documents")
    store = compaction.store_arrivals(docs, Workspace(spark, "shards").path("store"), ARRIVALS, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)), keep=1, retention_s=0)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_repetition_rules": op3_repetition_rules,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_passage_cover": op5_passage_cover,
    "op6_site_quality": op6_site_quality,
    "page_site_quality": page_site_quality,
    "op7_token_files": op7_token_files,
    "op8_best_two_fit_packing": op8_best_two_fit_packing,
    "op9_suffix_repeats": op9_suffix_repeats,
    "op10_tiered_compaction": op10_tiered_compaction,
}

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": decontamination.oracle(),
    "op3_repetition_rules": repetition.oracle(),
    "op10_tiered_compaction": "SELECT doc_id, lang, source, n_chars, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents",
}
