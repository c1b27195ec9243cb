"""Removal of runs of lines that occurred before, found by winnowing over hashes of lines.

Long lines are wrapped after a number of words, anew from each line's start, so a unit is a short line or a stretch of a
long one. Of every window of units the one with the least hash is its fingerprint: equal windows select the same unit,
so a repeated run of as many units as a window, or more, is certain to share a fingerprint. Lines of fewer units than a
window can have a fingerprint of their own, so that they are found between any neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .common import pieces, saved, text_key, unused

WRAP_WORDS = 16
WINDOW_UNITS = 3
#: Shorter lines, in words, have no fingerprint of their own.
LINE_WORDS = 1
_LINES = 1 << 30  # the places of whole lines: their numbers from here on; units are counted below
_LINE_MARK = np.uint64(0x5851F42D4C957F2D)


def units(texts: list[bytes | None], wrap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all units, their line numbers, for each text the place of its first unit (one more than texts), and the
    units' words."""
    words, bounds, starts, data = textops.words_of(texts, lower=False)
    if not len(words):
        return words, np.zeros(0, np.int64), bounds, np.zeros(0, np.uint64)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)  # over all texts: each text ends with a line feed
    head = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    place = np.arange(len(words)) - np.repeat(head, np.diff(np.append(head, len(words))))
    begin = np.flatnonzero(place % wrap == 0)
    size = np.diff(np.append(begin, len(words))).astype(np.uint64)
    hashes = textops.mix64(np.add.reduceat(words * textops.ORDER[place % wrap], begin) + size)
    unit_bounds = np.searchsorted(begin, bounds)
    first_line = np.searchsorted(np.flatnonzero(data == 10), np.concatenate(([0], np.cumsum([len(t or b"") + 1 for t in texts]))))
    own_first = np.repeat(first_line[:-1], np.diff(unit_bounds))
    return hashes, line[begin] - own_first, unit_bounds, size


def _whole_lines(part: pa.RecordBatch, hashes: np.ndarray, lines: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, window: int, least: int) -> pa.RecordBatch | None:
    """A row for each line of `least` words or more that has fewer units than a window: longer ones are windows."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    head = np.flatnonzero(np.concatenate(([True], (lines[1:] != lines[:-1]) | (owner[1:] != owner[:-1]))))
    count = np.diff(np.append(head, len(hashes)))
    inner = np.minimum(np.arange(len(hashes)) - np.repeat(head, count), window)
    whole = textops.mix64(np.add.reduceat(hashes * textops.ORDER[inner], head) ^ _LINE_MARK)
    some = (count < window) & (np.add.reduceat(sizes, head) >= least)
    if not some.any():
        return None
    rows, own = pa.array(owner[head][some]), pa.array(whole[some].view(np.int64))
    one = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32)), own)
    start = pa.array((lines[head][some] + _LINES).astype(np.int32))
    columns = [part.column("doc_id").take(rows), part.column("text_key").take(rows), own, start, one]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "print", "start", "windows"])


def _windows(wrap: int, window: int, alone: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            hashes, lines, bounds, sizes = units(texts, wrap)
            if alone is not None and len(hashes) and (own := _whole_lines(part, hashes, lines, bounds, sizes, window, alone)):
                yield own
            counts = np.maximum(np.diff(bounds) - window + 1, 0)
            if not counts.sum():
                continue
            owner = np.repeat(np.arange(len(texts)), counts)
            start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            at = bounds[owner] + start
            best, place, whole = hashes[at], at.copy(), hashes[at] * textops.ORDER[0]
            for j in range(1, window):
                unit = hashes[at + j]
                less = unit <= best
                best, place = np.where(less, unit, best), np.where(less, at + j, place)
                whole = whole + unit * textops.ORDER[j]
            whole = textops.mix64(whole)
            # windows that select the same unit follow one another
            head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(whole)).astype(np.int32)), pa.array(whole.view(np.int64)))
            rows = pa.array(owner[head])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(rows),
                    part.column("text_key").take(rows),
                    pa.array(best[head].view(np.int64)),
                    pa.array(start[head].astype(np.int32)),
                    lists,
                ],
                names=["doc_id", "text_key", "print", "start", "windows"],
            )

    return run


def repeated_windows(docs: DataFrame, wrap: int = WRAP_WORDS, window: int = WINDOW_UNITS, alone: int | None = None) -> DataFrame:
    """doc_id, text_key, start, source for each window of units that occurs earlier, by doc_id and place, in `source`.

    With `alone`, also for each line of so many words or more that has fewer units than a window; `start` is then _LINES
    and its number.

    Only fingerprints that occur more than once are followed up. Around them, a match is extended to the window that
    selected it, unit by unit; a group of equal windows yields its first place and joins it to the others.
    """
    schema = "doc_id bigint, text_key bigint, print bigint, start int, windows array<bigint>"
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    found = saved(docs.mapInArrow(_windows(wrap, window, alone), schema), "line_prints")
    often = found.groupBy("print").count().where("count > 1").select("print")
    around = found.join(often, "print").select("doc_id", "text_key", "start", F.posexplode("windows").alias("more", "window"))
    around = saved(around.select("doc_id", "text_key", (F.col("start") + F.col("more")).alias("start"), "window"), "line_windows")
    place = F.struct("doc_id", "text_key", "start")
    first = around.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = around.join(first.select("window", "first"), "window").where(~place.eqNullSafe(F.col("first")))
    return later.select("doc_id", "text_key", "start", F.col("first.doc_id").alias("source"))


def _without(wrap: int, window: int, starts_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            starts = part.column(starts_column).to_pylist()
            _, lines, bounds, _ = units([t if s else None for t, s in zip(texts, starts)], wrap)
            rest: list[bytes | None] = []
            removed: list[list[int]] = []
            for i, (text, own) in enumerate(zip(texts, starts)):
                if not own:
                    rest.append(text)
                    removed.append([])
                    continue
                covered = np.zeros(bounds[i + 1] - bounds[i], bool)
                line = lines[bounds[i] : bounds[i + 1]]
                own = np.array(own)
                for j in range(window):
                    covered[own[own < _LINES] + j] = True
                covered |= np.isin(line, own[own >= _LINES] - _LINES)
                gone = sorted(set(line.tolist()) - set(line[~covered].tolist()))
                removed.append(gone)
                drop, kept, after_gone = set(gone), [], False
                for n, x in enumerate(text.split(b"\n")):
                    after_gone = n in drop or (after_gone and not x.strip(b" \t\x0b\x0c\r"))
                    if not after_gone:
                        kept.append(x)
                rest.append(b"\n".join(kept))
            names = [n for n in part.schema.names if n != starts_column]
            columns = [pa.array(rest, pa.binary()).cast(pa.string()) if n == "text" else part.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(removed, pa.list_(pa.int32()))], names=names + ["_removed"])

    return run


def without_repeated_lines(docs: DataFrame, wrap: int = WRAP_WORDS, window: int = WINDOW_UNITS, alone: int | None = None) -> DataFrame:
    """docs with the lines of later repeated runs taken from `text`, and two columns more: `_removed`, the numbers of
    these lines from 0, and `_sources`, the documents where their runs stood first.

    A line goes if all its words lie in windows of `window` units that occur earlier, in a document with a lesser doc_id
    or further up in the same; units are lines or, after `wrap` words, parts of them, compared word for word. Blank lines
    go with the line before them. With `alone`, a line of so many words or more also goes if it occurs earlier between any
    neighbours; without, lines of texts shorter than a window stay. Null and empty texts stay. A null doc_id counts as
    least. Rows that repeat a doc_id and text are one document and lose the same lines. Other columns of docs
    stay as they are, but for columns with the names of the two new ones. An empty table gives no rows.
    """
    docs = docs.drop("_removed", "_sources")
    own_id, own_key, starts = (unused(docs, n) for n in ("_line_doc", "_line_key", "_line_starts"))
    later = repeated_windows(docs, wrap, window, alone).groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))
    later = saved(later.agg(F.collect_set("start").alias(starts), F.sort_array(F.collect_set("source")).alias("_sources")), "line_runs")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(own_id)) & (text_key(F.col("text")) == F.col(own_key))
    joined = docs.join(later, same, "left").drop(own_id, own_key)
    joined = joined.withColumn("_sources", F.coalesce("_sources", F.array().cast("array<bigint>")))
    schema = T.StructType([f for f in joined.schema.fields if f.name != starts]).add("_removed", T.ArrayType(T.IntegerType()))
    return joined.mapInArrow(_without(wrap, window, starts), schema)
