"""A corpus pipeline of five stages, each one of the operators in ``cartolith.llm``.

Quality rules drop documents; of each group of near copies one document stays
(the smallest doc_id); passages of 200 bytes or more that occur again are cut
out; personal data is replaced by its kind in brackets; what is left is packed
into sequences.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.llm import jaccard_join, packing, pii, quality_rules, suffix_dedup
from cartolith.llm.common import shared_folder, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame, text=None) -> DataFrame:
    """The columns of documents, with ``text`` in the place of the text and its length anew."""
    if text is None:
        return df.select(*COLUMNS)
    return df.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _key(doc_id, text_key):
    """A string that is never null for a row's doc_id and the digest of its text: rows of one key are repeats of one another."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.lower(F.hex(text_key)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(docs.select(*COLUMNS), quality_rules.language_references(docs))
    # A filter pushed into the rules would repeat their expressions over and over; it isn't pushed past a random number.
    return judged.select(*COLUMNS, "kept", F.rand(0).alias("_drawn")).filter("kept AND _drawn >= 0").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that of the smallest doc_id (null comes last, ties go
    by the text's digest, rows that repeat one another by source and lang); texts without words all stay.
    """
    with small_batches(spark):
        groups = jaccard_join.jaccard_components(spark, docs, k=5, num=8, den=10, full=True).filter("n_shingles > 0")
    # Of structs the smallest has the smallest first field: false comes before true.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best")
    stay = groups.groupBy("component").agg(best).select(_key(F.col("best.doc_id"), F.col("best.text_key")).alias("_key"), F.lit(True).alias("_stays"))
    keyed = docs.select(*COLUMNS, _key(F.col("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit(""))))).alias("_key"))
    first = F.row_number().over(Window.partitionBy("_key").orderBy("source", "lang"))
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return keyed.join(stay, "_key", "left").withColumn("_nth", first).filter((F.col("_stays") & (F.col("_nth") == 1)) | wordless).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut; a character that a cut divides goes, a text that loses all is empty.

    What is cut depends on a row's text alone, so its digest is the key.
    """
    with small_batches(spark):
        cut = suffix_dedup.remove_repeats(spark, docs, full=True).filter("n_removed > 0").groupBy(F.col("digest").alias("_digest")).agg(F.first("kept_text").alias("_kept"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    joined = docs.select(*COLUMNS).join(cut, digest == F.col("_digest"), "left")
    return _documents(joined, F.coalesce("_kept", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find(spark, docs.select(*COLUMNS))
    return _documents(found, pii.redacted(F.col("text"), F.col("all_spans")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    with small_batches(spark):
        return packing.pack(spark, docs, packing.library_encoder(vocabularies.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", sequences),
]

#: Similarity joins, boosted trees and tokenizers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        path = f"{shared_folder(spark)}/pipeline-{k}-{name}-{uuid.uuid4().hex}"
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
