"""Repeated passages: paragraphs whose word shingles are nearly the same, found by MinHash bands and verified exactly.

Three coordinates make a band and twelve bands a signature: paragraphs with a similarity of 0.75 share a band with a
probability of 0.998, those with 0.9 practically always, and unrelated ones hardly ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import pieces, saved, text_key
from .passages import repeated_passages
from .near_dup import SHINGLE_WORDS, SIMILAR_PERCENT, band_keys, linked_nodes, signatures

BANDS = 12
BAND_ROWS = 3
#: Shorter paragraphs, in words, take no part.
LEAST_WORDS = 20
_PARAGRAPHS = 2_000


def _features(k: int, bands: int, rows: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            owner, number, start, lines = [], [], [], []
            for i, text in enumerate(texts):
                at = 0
                for n, line in enumerate(text.split(b"\n") if text else []):
                    if len(line) >= 2 * least - 1:
                        owner.append(i)
                        number.append(n)
                        start.append(at)
                        lines.append(line)
                    at += len(line) + 1
            for a in range(0, len(lines), _PARAGRAPHS):
                own = lines[a : a + _PARAGRAPHS]
                words = np.diff(textops.word_hashes(own)[1])
                some = np.flatnonzero(words >= least)
                own = [own[i] for i in some]
                if not own:
                    continue
                sets, bounds = textops.shingle_sets(own, k)
                n = np.diff(bounds).astype(np.uint64)
                one = textops.per_text(np.add, sets, bounds, 0)
                two = textops.per_text(np.add, textops.mix64(sets + np.uint64(0x632BE59BD9B4E019)), bounds, 0)
                raw = np.stack([textops.mix64(one + n), textops.mix64(two)], axis=1).astype(">u8").tobytes()
                keys = band_keys(signatures(sets, bounds, bands * rows), bands, rows).view(np.int64)
                at = pa.array(np.array(owner[a : a + _PARAGRAPHS])[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(at),
                        part.column("text_key").take(at),
                        pa.array(np.array(number[a : a + _PARAGRAPHS], np.int32)[some]),
                        pa.array(np.array(start[a : a + _PARAGRAPHS], np.int64)[some]),
                        pa.array(np.array([len(x) for x in own], np.int64)),
                        pa.array(words[some].astype(np.int64)),
                        pa.array(n.astype(np.int64)),
                        pa.array([raw[16 * i : 16 * i + 16] for i in range(len(own))], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1))),
                    ],
                    names=["doc_id", "text_key", "paragraph", "start_byte", "n_bytes", "n_words", "n_shingles", "node", "bands"],
                )

    return run


def repeated_paragraphs(
    docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT, bands: int = BANDS, rows: int = BAND_ROWS, least: int = LEAST_WORDS
) -> DataFrame:
    """A row for each paragraph of docs(doc_id, text) that is like another, with the cluster it is in.

    Paragraphs are lines of at least `least` words. Two are linked when 100 * shared shingles >= percent * all their
    k-word shingles; clusters are the connected components. Columns: doc_id, paragraph (line number from 0), start_byte,
    n_bytes, n_words, cluster_doc and cluster_paragraph (the cluster's first, by doc_id and number), n_paragraphs (of
    the cluster), removed (all but the first) and kind: `paragraph`, or `passage` for what repeats inside what is left
    without the removed paragraphs (see `passages`).

    Null and empty texts have no paragraphs. Rows that repeat a doc_id and text are one document. A null doc_id counts
    as least. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    if not docs.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text_key"])
    schema = (
        "doc_id bigint, text_key bigint, paragraph int, start_byte bigint, n_bytes bigint, n_words bigint, n_shingles bigint, "
        "node binary, bands array<bigint>"
    )
    found = saved(docs.mapInArrow(_features(k, bands, rows, least), schema), "paragraph_features")
    # the first half of a node's digest stands for it in the buckets
    short = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("bigint")
    rows_ = found.select(F.explode("bands").alias("bucket"), short.alias("short"))
    several = rows_.groupBy("bucket").agg(F.min("short").alias("low"), F.max("short").alias("high")).where("low <> high").select("bucket")
    shared = saved(rows_.join(several, "bucket").distinct(), "paragraph_buckets")

    place = F.struct("doc_id", "text_key", "paragraph")
    nodes = found.groupBy("node", "n_shingles").agg(F.min(place).alias("first"), F.count("*").alias("n_paragraphs"))
    nodes = saved(nodes.withColumn("short", short), "paragraph_nodes")
    degree = shared.withColumn("n", F.lit(1)).groupBy("bucket").agg(F.sum("n").alias("n"))
    degree = shared.join(degree, "bucket").groupBy("short").agg(F.sum("n").alias("degree"))
    involved = saved(degree.join(nodes, "short"), "paragraph_involved")
    buckets = saved(shared.join(involved.select("short", "node", "degree"), "short").select("bucket", "node", "degree"), "paragraph_members")
    wanted = involved.select("node", "n_shingles", F.col("first.doc_id").alias("d"), F.col("first.text_key").alias("t"), F.col("first.paragraph").alias("p"))
    wanted = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("p", "node", "n_shingles")).alias("wanted")).hint("merge")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
    texts = texts.withColumn("lines", F.split("text", "\n")).select("lines", F.explode("wanted").alias("w"))
    texts = texts.select("w.node", "w.n_shingles", F.get("lines", F.col("w.p")).alias("text")).dropDuplicates(["node"])
    links = linked_nodes(buckets, saved(texts, "paragraph_texts"), k, percent)

    named = nodes.join(links, "node", "left").withColumn("root", F.coalesce("component", "node"))
    clusters = named.groupBy("root").agg(F.min("first").alias("first"), F.sum("n_paragraphs").alias("n_paragraphs"))
    clusters = clusters.where("n_paragraphs > 1")
    named = saved(named.select("node", "root").join(clusters, "root").drop("root"), "paragraph_clusters")
    out = found.drop("bands", "n_shingles").join(named, "node")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("paragraph") == F.col("first.paragraph"))
    whole = out.select(
        "doc_id",
        "text_key",
        "paragraph",
        "start_byte",
        "n_bytes",
        "n_words",
        F.col("first.doc_id").alias("cluster_doc"),
        F.col("first.paragraph").alias("cluster_paragraph"),
        "n_paragraphs",
        (~same).alias("removed"),
    )
    whole = saved(whole, "paragraph_repeats")
    inside = repeated_passages(docs, whole.where("removed").select("doc_id", "text_key", "paragraph"))
    whole = whole.drop("text_key")
    return whole.withColumn("kind", F.lit("paragraph")).unionByName(inside.withColumn("kind", F.lit("passage")))
