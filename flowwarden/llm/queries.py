"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_minhash(spark, sf):
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf, "documents")).drop("text_key")


@query
def op9_pack(spark, sf):
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_winnow_lines(spark, sf):
    """What goes from each document, where it stood first, and a digest of what stays."""
    from .line_dedup import LINE_WORDS, without_repeated_lines

    found = without_repeated_lines(table(spark, sf, "documents"), alone=LINE_WORDS)
    rest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("rest_sha256")
    return found.select("doc_id", F.col("_removed").alias("removed_lines"), F.col("_sources").alias("source_docs"), rest)


@query
def op4_lang_id(spark, sf):
    import public_tokenizers

    from .lang_id import held_out, identify

    docs = table(spark, sf, "documents")
    labelled = docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
    found = identify(docs.select("doc_id", "text"), labelled, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op7_surrogates(spark, sf):
    """Each document with its personal data replaced, and the kinds of entities found in it."""
    from .pii import with_surrogates

    found = with_surrogates(table(spark, sf, "documents").select("doc_id", "text"), "corpus-release-key")
    return found.select("doc_id", "text", F.col("_kinds").alias("kinds"))


@query
def op1_warc(spark, sf):
    from .warc import archived

    return archived(table(spark, sf, "pages"))


@query
def op10_imatch(spark, sf):
    from .imatch import edited_fingerprints

    return edited_fingerprints(table(spark, sf, "documents"))


@query
def op8_vectors(spark, sf):
    from .vector_links import near_vectors

    return near_vectors(table(spark, sf, "embeddings"))


@query
def op3_paragraphs(spark, sf):
    from .paragraph_dedup import repeated_paragraphs

    return repeated_paragraphs(table(spark, sf, "documents"))


@query
def op6_nbest(spark, sf):
    import public_tokenizers

    from .nbest import n_best

    return n_best(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_hard_negatives(spark, sf):
    """Labels are shifted on every seventh row, as mislabelled data are."""
    from .hard_negatives import hard_negatives, quantised

    docs = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantised(docs.withColumn("label", moved)), F.col("vec_id") % 50 == 0)


@query
def op13_quality(spark, sf):
    from .quality import quality

    return quality(table(spark, sf, "documents"))


@query
def op11_treap_search(spark, sf):
    from .treap_index import ranked_search

    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
