"""Passages that repeat inside other text.

Two texts that share a passage need not be alike as a whole, nor have it in the same lines. Texts are therefore cut, across
their lines, at words whose hash is the least of its neighbourhood, so the pieces of a passage are the same whatever stands
around it; equal pieces meet by their hash, and neighbouring repeated pieces make a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops
from .common import pieces, saved

#: A passage has so many words in whole pieces.
LEAST_RUN = 16
#: Words on either side that a cut's hash is the least of; most words of a piece.
REACH = 5
MOST_WORDS = 64
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
# A place is one number: first word in the text, words. So are an extent, first byte and bytes, and the first and last line.
_SIZE_BITS, _HALF = 8, 32


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in pieces(batches, "text"):
        words, bounds, starts, data = textops.words_of(texts)
        if not len(words):
            continue
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, starts)  # over all texts, each ends with a line feed
        size = np.diff(bounds)
        text = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(words)) - bounds[text]
        after = bounds[text + 1] - 1 - np.arange(len(words))  # words behind it in its text
        low = words.copy()
        earlier = np.full(len(words), _MOST)
        for d in range(1, REACH + 1):
            low[:-d] = np.minimum(low[:-d], np.where(after[:-d] >= d, words[d:], _MOST))
            before = np.where(place[d:] >= d, words[:-d], _MOST)
            low[d:] = np.minimum(low[d:], before)
            earlier[d:] = np.minimum(earlier[d:], before)
        cut = (words == low) & (words < earlier)  # of equal words the first
        cut[place == 0] = True
        begin = np.flatnonzero(cut)
        inner = np.arange(len(words)) - np.repeat(begin, np.diff(np.append(begin, len(words))))
        begin = np.flatnonzero(inner % MOST_WORDS == 0)
        inner %= MOST_WORDS
        count = np.diff(np.append(begin, len(words)))
        hashes = textops.mix64(np.add.reduceat(words * textops.ORDER[inner], begin) + count.astype(np.uint64))
        some = np.flatnonzero(size[text[begin]] >= LEAST_RUN)
        if not len(some):
            continue
        begin, count, hashes = begin[some], count[some], hashes[some]
        owner = text[begin]
        text_at = np.concatenate(([0], np.cumsum([len(t or b"") + 1 for t in texts])))[owner]
        line_at = np.searchsorted(breaks, text_at)
        lines = ((line[begin] - line_at) << _HALF) + line[begin + count - 1] - line_at
        space = np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        first, last = starts[begin], ends[begin + count - 1]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").take(pa.array(owner)),
                part.column("text_key").take(pa.array(owner)),
                pa.array(hashes.view(np.int64)),
                pa.array((place[begin] << _SIZE_BITS) + count),
                pa.array(((first - text_at) << _HALF) + (last - first)),
                pa.array(lines),
            ],
            names=["doc_id", "text_key", "piece", "place", "extent", "lines"],
        )


def repeated_passages(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, paragraph, start_byte, n_bytes, n_words, cluster_doc, cluster_paragraph, n_paragraphs and removed of each
    run of LEAST_RUN words or more, in whole pieces, all of which occur elsewhere, too, in docs(doc_id, text, text_key)
    outside the paragraphs of gone(doc_id, text_key, paragraph), which are removed as a whole. It may go over lines;
    paragraph is the line where it begins.

    A run's cluster is the first place, by doc_id, where a piece of it stands; removed says whether that is elsewhere.
    Any passage of 50 words has three pieces, as a rule, whose cuts don't depend on the words around it.
    """
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "text_key").mapInArrow(
        _pieces_of, "doc_id bigint, text_key bigint, piece bigint, place bigint, extent bigint, lines bigint"
    )
    # read twice rather than kept: pieces are small next to what a table of them all would take
    often = found.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1").select("piece")
    some = found.join(often, "piece").dropDuplicates(["doc_id", "text_key", "piece", "place"])
    gone = gone.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.collect_set("paragraph").alias("gone"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))
    line, last = F.shiftright("lines", _HALF).cast("int"), F.col("lines").bitwiseAND((1 << _HALF) - 1).cast("int")
    touched = F.exists("gone", lambda p: p.between(line, last))
    some = some.join(gone, same, "left").where(F.col("gone").isNull() | ~touched).drop("d", "t", "gone")
    some = saved(some.withColumn("paragraph", line).drop("lines"), "passage_repeated")
    here = F.struct("doc_id", "text_key", "place", "paragraph")
    firsts = some.groupBy("piece").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1")
    some = some.join(firsts, "piece").select(
        "doc_id",
        "text_key",
        "paragraph",
        F.shiftright("place", _SIZE_BITS).alias("word"),
        F.col("place").bitwiseAND((1 << _SIZE_BITS) - 1).alias("words"),
        F.shiftright("extent", _HALF).alias("byte"),
        F.col("extent").bitwiseAND((1 << _HALF) - 1).alias("bytes"),
        "first",
        "n",
        (~here.eqNullSafe(F.col("first"))).alias("later"),
    )
    along = Window.partitionBy("doc_id", "text_key").orderBy("word")
    new = F.when(F.lag(F.col("word") + F.col("words")).over(along) == F.col("word"), 0).otherwise(1)
    runs = some.withColumn("new", new).withColumn("run", F.sum("new").over(along))
    runs = runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("paragraph").alias("paragraph"),
        F.min("byte").alias("start_byte"),
        (F.max(F.col("byte") + F.col("bytes")) - F.min("byte")).alias("n_bytes"),
        F.sum("words").alias("n_words"),
        F.min("first").alias("first"),
        F.max("n").alias("n_paragraphs"),
        F.max("later").alias("removed"),
    )
    return runs.where(F.col("n_words") >= LEAST_RUN).select(
        "doc_id",
        "paragraph",
        "start_byte",
        "n_bytes",
        "n_words",
        F.col("first.doc_id").alias("cluster_doc"),
        F.col("first.paragraph").alias("cluster_paragraph"),
        "n_paragraphs",
        "removed",
    )
