"""A corpus made ready for training: language, repeated lines, near duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.llm import lang_id, line_dedup, near_dup, packing, pii
from flowwarden.llm.common import saved, table, text_key, unused
from flowwarden.plans.ship import ship

PIECES = "piece_bpe_32k.model"
TOKENIZER = "word_bpe_49k.json"
LEAST_SCORE = 0.5
KEY = "corpus-release-key"

#: Two stages have no SQL: the models of the first, the ids of the last. Tests replay the stages by brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, if docs has it, of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of LEAST_SCORE; texts that are null or without letters go."""
    labelled = docs.where(~lang_id.held_out(F.col("doc_id"))).select("text", "lang")
    names = [unused(docs, "lang_pred"), unused(docs, "lang_score")]
    found = lang_id.identify(docs, labelled, public_tokenizers.path(PIECES), docs.columns, names)
    return found.where((F.col(names[0]) != lang_id.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).drop(*names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of earlier runs; those of which nothing is left go."""
    found = line_dedup.without_repeated_lines(docs)
    left = (F.size("_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _counted(found.where(left).select(*docs.drop("_removed", "_sources").columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates; of rows that repeat an id and text, one."""
    found = saved(near_dup.near_duplicates(docs).select("doc_id", "text_key", "kept"), "pipeline_near")
    doc, key = unused(docs, "near_doc"), unused(docs, "near_key")
    gone = found.where("not kept").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (text_key(F.col("text")) == F.col(key))
    kept = docs.join(gone, same, "left_anti")
    if found.where("kept").groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn(key, text_key(F.col("text"))).dropDuplicates(["doc_id", key]).drop(key)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return _counted(pii.with_surrogates(docs, KEY).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents lies in the training sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
