"""Near-duplicate documents by circulant MinHash, banding, and exact Jaccard similarity of full shingle sets.

Two permutations of the 32-bit numbers make all signature coordinates: the first spreads the shingles, the second is
shifted circularly by one for each further coordinate, and a coordinate is the least image over the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import components, groups_of, pieces, saved, text_key

SHINGLE_WORDS = 5
BANDS = 32
BAND_ROWS = 4
#: Most documents on one side of a tile, about, and shingles that are looked at in one go.
TILE_NODES = 256
COLUMNS = 4096
SIMILAR_PERCENT = 75
_BLOCK = 1 << 15
_SALTS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, size=64, dtype=np.uint64)


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation, of the 32-bit numbers that shingles are folded to."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _circulant(x: np.ndarray, shift: int) -> np.ndarray:
    """The second permutation, shifted circularly."""
    x = x - np.uint32(shift)
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE3D)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n coordinates for each set; sets without elements have the greatest number throughout."""
    out = np.full((len(bounds) - 1, n), np.uint32(0xFFFFFFFF))
    folded = _scatter((sets >> np.uint64(32)).astype(np.uint32))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for a in range(0, len(folded), _BLOCK):
        block = folded[a : a + _BLOCK]
        own = owner[a : a + _BLOCK]
        head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        rows = own[head]
        for j in range(n):
            out[rows, j] = np.minimum(out[rows, j], np.minimum.reduceat(_circulant(block, j), head))
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        keys = textops.mix64(keys + _SALTS[r]) + signature[:, r::rows][:, :bands]
    return textops.mix64(keys * np.uint64(2) + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _features(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            sets, bounds = textops.shingle_sets(texts, k)
            n = np.diff(bounds)
            one = textops.per_text(np.add, sets, bounds, 0)
            two = textops.per_text(np.add, textops.mix64(sets + np.uint64(0x632BE59BD9B4E019)), bounds, 0)
            digest = np.stack([textops.mix64(one + n.astype(np.uint64)), textops.mix64(two)], axis=1)
            raw = digest.astype(">u8").tobytes()
            keys = band_keys(signatures(sets, bounds, bands * rows), bands, rows).view(np.int64)
            flat = pa.array(keys.reshape(-1))
            offsets = np.arange(len(keys) + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array(n.astype(np.int64)),
                    pa.array([raw[16 * i : 16 * i + 16] if n[i] else None for i in range(len(n))], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), flat),
                ],
                names=["doc_id", "text_key", "n_shingles", "node", "bands"],
            )

    return run


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, left in pieces(batches, "left_text"):
            right = part.column("right_text").cast(pa.large_binary()).to_pylist()
            # neighbouring rows mostly share their pivot's text
            own: dict[bytes, int] = {}
            places = [own.setdefault(t, len(own)) for t in right]
            sets, bounds = textops.shingle_sets(left, k)
            pivots, pivot_bounds = textops.shingle_sets(list(own), k)
            linked = []
            for i, p in enumerate(places):
                x, y = sets[bounds[i] : bounds[i + 1]], pivots[pivot_bounds[p] : pivot_bounds[p + 1]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs(a, b) with whether their full sets are similar enough. texts: node, n_shingles, text."""
    left = texts.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("text").alias("left_text"))
    right = texts.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("text").alias("right_text"))
    both = pairs.join(left, "b").join(right, "a")
    # a set can't share more than the smaller one has
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "left_text", "right_text").mapInArrow(_verify(k, percent), "a binary, b binary, linked boolean")


def _compare(k: int, percent: int):
    """Links between the left and the right documents of each tile, apart from those within a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in groups_of(batches, ["bucket", "i", "j"]):
            node, right = tile.column("node").to_pylist(), tile.column("right").to_numpy()
            component = tile.column("component").to_pylist()
            names = {c: n for n, c in enumerate(dict.fromkeys(component))}
            own = np.array([names[c] for c in component])
            texts = [t.encode() for t in tile.column("text").to_pylist()]
            sets, bounds = textops.shingle_sets(texts, k)
            size = np.diff(bounds)
            shared = np.zeros(((~right).sum(), right.sum()), np.float32)
            element, often = np.unique(sets, return_inverse=True, return_counts=True)[1:]
            owner = np.repeat(np.arange(len(node)), size)
            some = often[element] > 1
            element, owner = np.unique(element[some], return_inverse=True)[1], owner[some]
            order = np.argsort(element, kind="stable")
            element, owner = element[order], owner[order]
            place = np.where(right, np.cumsum(right), np.cumsum(~right)) - 1
            for a in range(0, int(element[-1]) + 1 if len(element) else 0, COLUMNS):
                p, q = np.searchsorted(element, [a, a + COLUMNS])
                here, column = owner[p:q], element[p:q] - a
                x, y = np.zeros((shared.shape[0], COLUMNS), np.float32), np.zeros((shared.shape[1], COLUMNS), np.float32)
                y[place[here[right[here]]], column[right[here]]] = 1
                x[place[here[~right[here]]], column[~right[here]]] = 1
                shared += x @ y.T
            left_at, right_at = np.flatnonzero(~right), np.flatnonzero(right)
            all_ = size[left_at][:, None] + size[right_at][None, :] - shared
            u, v = np.nonzero((100 * shared >= percent * all_) & (own[left_at][:, None] != own[right_at][None, :]))
            if len(u):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node[i] for i in left_at[u]], pa.binary()), pa.array([node[i] for i in right_at[v]], pa.binary())], names=["a", "b"]
                )

    return run


def linked_nodes(buckets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the nodes of buckets(bucket, node, degree) that are linked with others.

    First each bucket's pivot is compared with its other nodes. Where several components remain, the nodes that are not
    in a bucket's largest one are compared with all of the bucket, in tiles of bounded size that return links only.
    """
    pivots = buckets.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("pivot"))
    buckets = saved(buckets.join(pivots.select("bucket", F.col("pivot.node").alias("pivot")), "bucket").where("node <> pivot"), "near_pivots")
    pairs = saved(buckets.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "near_pairs")
    links = saved(_verified(pairs, texts, k, percent).where("linked").select("a", "b"), "near_linked")
    found = saved(components(links, "near_links"), "near_components")

    rest = buckets.select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = rest.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = groups.groupBy("bucket").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("largest"))
    open_ = open_.where("groups > 1").select(
        "bucket",
        F.col("largest.component").alias("largest"),
        F.ceil((F.col("n") - F.col("largest.n")) / TILE_NODES).cast("int").alias("lefts"),
        F.ceil(F.col("n") / TILE_NODES).cast("int").alias("rights"),
    )
    rest = saved(rest.join(open_, "bucket"), "near_open")
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.where("component <> largest").select("bucket", chunk("lefts").alias("i"), others("rights").alias("j"), F.lit(False).alias("right"), "node", "component")
    right = rest.select("bucket", others("lefts").alias("i"), chunk("rights").alias("j"), F.lit(True).alias("right"), "node", "component")
    tiles = left.unionByName(right).join(texts.select("node", "text"), "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = saved(tiles.mapInArrow(_compare(k, percent), "a binary, b binary").distinct(), "near_more")
    if more.isEmpty():
        return found
    before = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return saved(components(before.unionByName(more), "near_links"), "near_components")


def near_duplicates(
    docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT, bands: int = BANDS, rows: int = BAND_ROWS
) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept for each row of docs(doc_id, text).

    Documents are linked when 100 * shared shingles >= percent * all their shingles. Equal sets are one node, so copies
    cost one row each. In every band's bucket the node that meets most others is compared with all of them. Only where
    a bucket still holds several components after that, its nodes outside the largest one are compared with the rest,
    within tasks; so no link between components is lost and no group becomes all its pairs.

    Null or empty texts and texts without words have no shingles and are linked with nothing. Rows that repeat a doc_id
    and text are one document. A null doc_id takes part, but names a component only if all its ids are null. Other
    columns of docs are ignored. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    schema = "doc_id bigint, text_key bigint, n_shingles bigint, node binary, bands array<bigint>"
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text_key", "text").mapInArrow(_features(k, bands, rows), schema)
    found = saved(found, "near_features")
    nodes = found.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.min("doc_id").alias("least"))
    keyed = found.select("doc_id", "text_key", "node", "n_shingles", "bands").join(
        nodes.select("node", F.col("of.doc_id").alias("d"), F.col("of.text_key").alias("t")), "node"
    )
    one = keyed.where("doc_id <=> d and text_key = t").dropDuplicates(["node"])
    buckets = one.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = saved(buckets.join(shared, "bucket"), "near_buckets")
    # the node that meets most others is most likely to be what the others were copied from
    degree = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
    buckets = saved(buckets.drop("n").join(degree, "node"), "near_buckets")

    involved = saved(degree.select("node").join(nodes.drop("least"), "node"), "near_involved")
    wanted = involved.select("node", F.col("of.doc_id").alias("d"), F.col("of.text_key").alias("t")).hint("merge")
    sizes = found.select("node", "n_shingles").dropDuplicates(["node"])
    texts = (
        docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
        .select("node", "text")
        .dropDuplicates(["node"])
        .join(sizes, "node")
    )
    texts = saved(texts, "near_texts")
    found_in = linked_nodes(buckets, texts, k, percent)

    # named per node first, so that rows meet on their node only
    named = nodes.select("node", "least").join(found_in, "node", "left")
    named = named.withColumn("root", F.coalesce("component", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(named.join(least, "root").select("node", "component_id"), "near_named")
    out = found.join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
