"""The operators applied to whole tables, as the driver's contract states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    with small_batches(spark):
        return jaccard_components(spark, table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_neighbours

    return fingerprint_neighbours(spark, table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import deduplicated_archives, read_archives, resolve_revisits

    with small_batches(spark):
        manifest, folder = deduplicated_archives(spark, table(spark, sf_dir, "pages"))
        records = read_archives(manifest, folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return resolve_revisits(records).select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "target")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import language_references, quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality_rules(docs, language_references(docs))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, find, of_kind, written_spans

    found = find(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [of_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written_spans(F.col("base_spans")), 256).alias("base_sha256"), written_spans(F.col("all_spans")).alias("spans"))


def op6_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    from .packing import library_encoder, pack

    with small_batches(spark):
        return pack(spark, table(spark, sf_dir, "documents"), library_encoder(vocabularies.path("byte_bpe_50k.json")))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    from .bpe import encode_documents

    with small_batches(spark):
        return written(encode_documents(table(spark, sf_dir, "documents"), vocabularies.path("word_bpe_49k.json")), "encoded")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import fit, is_held_out, score

    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        scored = written(score(spark, docs, fit(docs, table(spark, sf_dir, "labels"))), "scores")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    with small_batches(spark):
        return written(extract(table(spark, sf_dir, "pages")), "main-texts")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    with small_batches(spark):
        return remove_repeats(spark, table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_document_fingerprints, op3_warc_revisits, op4_quality_rules, op5_personal_data, op6_sequence_packing, op7_bpe_round_trip, op8_quality_classifier, op9_main_text, op10_suffix_dedup)}
ORACLES: dict[str, str] = {}
