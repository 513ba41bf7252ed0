"""A corpus pipeline of five stages over ``documents``: language, near duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docverify.llm import decontam, langid, neardup, packing, secrets
from docverify.llm.common import settled, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: null texts and texts without a letter (``und``).  Null ids and repeated rows are judged each by its text."""
    return langid.predict(docs, langid.learn(docs), whole=True).where(F.col("lang_pred") != "und").select("row.*")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents but those rows (doc_id, text_key): rows that repeat an id are told apart by their texts, and a null id is an id."""
    gone = rows.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_key"]), "left_anti")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates (five words, 0.8).

    Texts without a word and null ids stay; of rows that repeat an id each is judged by its own text; an empty table stays empty."""
    return _without(docs, neardup.near_duplicates(docs).where(~F.col("kept")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item (five words, 0.8 of its shingles).

    Null and empty texts stay; rows with null ids, and each of those that repeat an id, are judged by their own texts; an empty table stays empty."""
    return _without(docs, decontam.contained(docs, table(spark, sf_dir, "benchmark"), by_text=True))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks live secrets in the texts; every document stays, and n_chars is that of its new text.

    Null texts stay null with a null n_chars; null and repeated ids and empty tables need no care, for a row is masked by its own text."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: a row for each piece, as the packing operator gives it.

    A null or empty text is the end token alone; null and repeated ids give pieces a row each; an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [("language ID", known_language), ("MinHash near-dedup", one_of_each_group), ("benchmark decontamination", without_benchmark), ("secret scans", without_secrets), ("packing", packed)]

#: Language prediction and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read by the next."""
    *first, (_, last) = STAGES
    docs = reduce(lambda d, step: settled(step[1](spark, d, sf_dir), f"pipeline-{step[0].split()[0]}"), first, table(spark, sf_dir, "documents"))
    return last(spark, docs, sf_dir)
