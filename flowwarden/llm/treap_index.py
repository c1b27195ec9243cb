"""Ranked lexical search on K2-treaps: quadtrees over the grid of terms and documents whose cells store impact maxima.

Documents are taken in shards. A shard's grid has a row per term, the commonest first, those of like frequency by their
first document, and a column per document, the shortest first; a point's value is the impact of the term in the document.
So points lie in few cells. Cells without points are not stored, a cell's maximum is stored as its distance from its
parent's. A query follows the row paths of its terms together down the column
ranges, best bound first, and ends when no range left can reach the answers it has.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import fits
from .common import pieces, saved
from .textops import per_text, words_of

TOP = 50
#: Terms of the documents of a shard, roughly: what a task holds while it builds one.
SHARD_TERMS = 1_000_000
#: Queries that go down a shard one after the other; a block of them is one row.
BLOCK_ITEMS = 512
#: Blocks whose answers so far a task keeps, to prune in the next shard. Others begin anew there.
HELD_BLOCKS = 32
#: Ranges that are opened at once.
WAVE = 256
INDEX = (
    "docs array<bigint>, terms array<bigint>, df array<int>, grid_rows array<int>, height int, greatest bigint, "
    "masks binary, drops binary"
)
_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False
_BITS = np.array([bin(i).count("1") for i in range(16)], np.uint8)
_LAST = np.iinfo(np.int64).max


def _hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    words, bounds, _, _ = words_of(texts, between=_BETWEEN)
    return words, bounds


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents have a term, and how many terms there are."""
    for _, texts in pieces(batches, "text"):
        data = np.frombuffer(b"\n".join([t or b"" for t in texts] + [b""]), np.uint8)
        sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
        inner = ~_BETWEEN[data]
        first = inner.copy()
        first[1:] &= ~inner[:-1]
        n = per_text(np.add, first.astype(np.int64), np.concatenate(([0], np.cumsum(sizes))), 0)
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""
    sums = docs.select("text").mapInArrow(_counted, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first()
    return sums[0] or 0, sums[1] or 0


def _spread(x: np.ndarray) -> np.ndarray:
    """Puts a zero bit before every bit of 32-bit numbers."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def build_treap(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Height, greatest value, child masks of all inner cells (half a byte each) and the distance of each cell's maximum
    from its parent's, cells in order of level and place, both compressed. Points are distinct."""
    height = max(1, int(max(row.max(), column.max())).bit_length())
    code = (_spread(row) << np.uint64(1)) | _spread(column)
    order = np.argsort(code)
    code, top = code[order], value[order]
    masks, drops = [], []
    for _ in range(height):
        parent = code >> np.uint64(2)
        start = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        above = np.maximum.reduceat(top, start)
        masks.append(np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.int64)), start).astype(np.uint8))
        drops.append((np.repeat(above, np.diff(np.append(start, len(code)))) - top).astype(np.int32))
        code, top = parent[start], above
    flat = np.concatenate(masks[::-1])
    flat = np.append(flat, np.zeros(len(flat) & 1, np.uint8))
    packed = (flat[::2] | (flat[1::2] << 4)).tobytes()
    return height, int(top[0]), zlib.compress(packed, 1), zlib.compress(np.concatenate(drops[::-1]).tobytes(), 1)


class Treap:
    """A shard's quadtree, opened for search."""

    def __init__(self, height: int, greatest: int, masks: bytes, drops: bytes, docs: np.ndarray):
        packed = np.frombuffer(zlib.decompress(masks), np.uint8)
        nibbles = np.empty(2 * len(packed), np.uint8)
        nibbles[::2], nibbles[1::2] = packed & 15, packed >> 4
        drops = np.frombuffer(zlib.decompress(drops), np.int32)
        self.height = height
        self.missing = len(drops) + 1  # stands for a cell without points
        self.top = np.zeros(self.missing + 1, np.int32)  # impacts are a million at most
        self.top[0] = greatest
        kids = _BITS[nibbles]
        inner, begin, size = 0, 0, 1
        for _ in range(height):
            n = kids[begin : begin + size]
            first, below = begin + size, int(n.sum(dtype=np.int64))
            self.top[first : first + below] = np.repeat(self.top[begin : begin + size], n) - drops[first - 1 : first - 1 + below]
            inner, begin, size = inner + size, first, below
        self.masks = np.zeros(self.missing + 1, np.uint8)
        self.masks[:inner] = nibbles[:inner]
        self.child = np.zeros(self.missing + 1, np.int32)
        self.child[0] = 1
        self.child[1:inner] = 1 + np.cumsum(kids[: inner - 1], dtype=np.int32)
        # the least id in each column range of each level, to tell which of equal scores can still count
        least = [np.append(docs, np.full((1 << height) - len(docs), _LAST))] if height < 22 else None
        while least and len(least) <= height:
            least.append(least[-1].reshape(-1, 2).min(axis=1))
        self.least = least[::-1] if least else None

    def search(self, rows: np.ndarray, weights: np.ndarray, docs: np.ndarray, score: np.ndarray, name: np.ndarray, k: int):
        """The best k of what is known already (score, name) and this shard's documents: highest first, of equal scores the
        least ids."""
        need, last = (int(score[k - 1]), int(name[k - 1])) if len(score) >= k else (1, _LAST)
        nodes = np.zeros((1, len(rows)), np.int32)
        level, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([int(self.top[0]) * int(weights.sum())])
        while True:
            useful = bound >= need
            if self.least is not None and useful.any():
                tie = np.flatnonzero(bound == need)
                if len(tie):
                    useful[tie] = [self.least[x][c] <= last for x, c in zip(level[tie], column[tie])]
            if not useful.all():
                nodes, level, column, bound = nodes[useful], level[useful], column[useful], bound[useful]
            if not len(bound):
                return score, name
            if len(bound) > WAVE:
                order = np.argpartition(-bound, WAVE)
                now, later = order[:WAVE], order[WAVE:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            own, at, place = nodes[now], level[now], column[now]
            bit = (rows[None, :] >> (self.height - 1 - at)[:, None]) & 1
            mask, first = self.masks[own], self.child[own]
            parts = [(nodes[later], level[later], column[later], bound[later])]
            for side in (0, 1):
                quarter = (2 * bit + side).astype(np.uint8)
                child = np.where((mask >> quarter) & 1 > 0, first + _BITS[mask & ((np.uint8(1) << quarter) - np.uint8(1))], self.missing).astype(np.int32)
                parts.append((child, at + 1, 2 * place + side, self.top[child] @ weights))
            nodes, level, column, bound = (np.concatenate(p) for p in zip(*parts))
            leaf = level == self.height
            if leaf.any():
                found = np.flatnonzero(leaf & (bound >= need))
                keep = ~leaf
                score, name = np.concatenate([score, bound[found]]), np.concatenate([name, docs[column[found]]])
                order = np.lexsort((name, -score))[:k]
                score, name = score[order], name[order]
                if len(score) == k:
                    need, last = max(1, int(score[-1])), int(name[-1])
                nodes, level, column, bound = nodes[keep], level[keep], column[keep], bound[keep]


def _indexed(n_docs: int, n_terms: int, shard_terms: int):
    def shard(held: list) -> pa.RecordBatch:
        docs, length = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        offset = np.cumsum([0, *[len(h[0]) for h in held]])
        doc = np.concatenate([h[2] + o for h, o in zip(held, offset)])
        term, tf = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        order = np.lexsort((docs, length))
        column = np.empty(len(docs), np.int64)
        column[order] = np.arange(len(docs))
        names, own, df = np.unique(term, return_inverse=True, return_counts=True)
        row = np.empty(len(names), np.int64)
        at = np.full(len(names), len(docs))
        np.minimum.at(at, own, column[doc])
        row[np.lexsort((at, -np.frexp(df)[1]))] = np.arange(len(names))  # by the power of two of their frequency
        m = 100 - 50 + (50 * length * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        height, greatest, masks, drops = build_treap(row[own], column[doc], impact)
        list_of = lambda x, t: pa.array([x], pa.list_(t))
        ids = docs[order]
        ids = pa.array(ids, mask=ids == _LAST)
        arrays = [
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            list_of(names.view(np.int64), pa.int64()),
            list_of(df.astype(np.int32), pa.int32()),
            list_of(row.astype(np.int32), pa.int32()),
            pa.array([height], pa.int32()),
            pa.array([greatest], pa.int64()),
            pa.array([masks], pa.binary()),
            pa.array([drops], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["docs", "terms", "df", "grid_rows", "height", "greatest", "masks", "drops"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part, texts in pieces(batches, "text"):
            words, bounds = _hashes(texts)
            if not len(words):
                continue
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            doc = np.repeat(np.arange(len(some)), n[some])
            order = np.lexsort((words, doc))
            word, doc = words[order], doc[order]
            start = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1]))))
            ids = part.column("doc_id").fill_null(_LAST).to_numpy()
            held.append((ids[some], n[some], doc[start], word[start], np.diff(np.append(start, len(word)))))
            size += len(word)
            if size >= shard_terms:
                yield shard(held)
                held, size = [], 0
        if held:
            yield shard(held)

    return run


def build_index(docs: DataFrame, size: tuple[int, int] | None = None, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The index of all of docs(doc_id, text), a row per shard, as a table in the shared folder."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n_docs, n_terms = size or corpus_size(docs)
    return saved(docs.mapInArrow(_indexed(n_docs, max(1, n_terms), shard_terms), INDEX), "treap_index")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in pieces(batches, "text"):
        words, bounds = _hashes(texts)
        own = [np.unique(words[a:b]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:])]
        terms = pa.array(own, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("item_id"), part.column("item"), terms], names=["item_id", "item", "terms"])


def weighted_items(index: DataFrame, items: DataFrame, n_docs: int) -> DataFrame:
    """item_id, item, and the terms of each item that the index has with their weights, from items(item_id, text)."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null").distinct()
    keyed = items.withColumn("item", F.xxhash64("item_id", "text"))
    asked = keyed.mapInArrow(_item_terms, "item_id bigint, item bigint, terms array<bigint>")
    asked = saved(asked.select("item_id", "item", F.explode("terms").alias("term")), "treap_items")
    wanted = asked.select("term").distinct()
    wanted = F.broadcast(wanted) if fits(wanted) else wanted
    counts = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    df = counts.join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    weighted = asked.join(df, "term").select("item_id", "item", F.struct("term", weight.alias("weight")).alias("t"))
    return weighted.where("t.weight > 0").groupBy("item_id", "item").agg(F.sort_array(F.collect_list("t")).alias("terms"))


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, tuple[list, list]] = OrderedDict()

        def answers(items: list, best: list) -> pa.RecordBatch:
            n = [len(s) for s, _ in best]
            names = np.concatenate([d for _, d in best] + [np.zeros(0, np.int64)])
            arrays = [
                pa.array([i["item_id"] for i, c in zip(items, n) for _ in range(c)], pa.int64()),
                pa.array([i["item"] for i, c in zip(items, n) for _ in range(c)], pa.int64()),
                pa.array(names, mask=names == _LAST),
                pa.array(np.concatenate([s for s, _ in best] + [np.zeros(0, np.int64)])),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["item_id", "item", "doc_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                block = row["block"].as_py()
                if block not in held:
                    if len(held) == HELD_BLOCKS:
                        yield answers(*held.popitem(last=False)[1])
                    items = row["items"].as_py()
                    held[block] = (items, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items))
                held.move_to_end(block)
                items, best = held[block]
                docs = row["docs"].values.fill_null(_LAST).to_numpy()
                terms, rows = row["terms"].values.to_numpy().view(np.uint64), row["grid_rows"].values.to_numpy()
                treap = Treap(row["height"].as_py(), row["greatest"].as_py(), row["masks"].as_py(), row["drops"].as_py(), docs)
                for j, item in enumerate(items):
                    asked = np.array([t["term"] for t in item["terms"]], np.int64).view(np.uint64)
                    weights = np.array([t["weight"] for t in item["terms"]], np.int64)
                    at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
                    here = terms[at] == asked
                    if here.any():
                        best[j] = treap.search(rows[at[here]].astype(np.int64), weights[here], docs, *best[j], k)
        for items, best in held.values():
            yield answers(items, best)

    return run


def search(index: DataFrame, items: DataFrame, n_docs: int, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents of each of items(item_id, text)."""
    asking = weighted_items(index, items, n_docs)
    asking = saved(asking, "treap_weighted")
    blocks = max(1, -(-asking.count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    blocked = asking.groupBy(block).agg(F.collect_list(F.struct("item_id", "item", "terms")).alias("items"))
    blocked = saved(blocked, "treap_blocks")
    # every block of queries goes down every shard
    pairs = index.join(F.broadcast(blocked) if blocks <= HELD_BLOCKS else blocked)
    found = pairs.mapInArrow(_searched(k), "item_id bigint, item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best k of all docs(doc_id, text) for each of items(item_id, text).

    Terms are runs of ASCII letters, digits and all characters beyond ASCII; A-Z count as a-z. Documents with a score of 0
    are no answers; of equal scores the least doc_id comes first, a null one last. Terms are told by 64-bit hashes: with
    10^4 terms asked for and 10^10 in the documents, two of them meet once in 200,000 corpora.

    A null or empty text has no terms: as a document it doesn't count, as an item it has no answers. Every row is a document
    of its own, also one that repeats an id or all of another row. Items that repeat id and text are one; items that share
    an id only are ranked each on their own. Other columns are ignored; an empty table on either side gives no rows.
    """
    docs = docs.select("doc_id", "text")
    size = corpus_size(docs)
    return search(build_index(docs, size, shard_terms), items, size[0], k)
