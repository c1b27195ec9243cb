"""Hard negatives by exact inner products, from lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster, the rows of a block are sorted once by the most that any member could
score with them: their length times the cosine of their angle to the centre less the cluster's widest angle. Every member
walks that list and stops where what is left is certain not to change its answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # percent of the positive's score between which a negative's lies
#: Anchors that share a list, on average; more once there are MAX_CENTRES centres.
MEMBERS = 64
MAX_CENTRES = 256
#: Numbers in the sample of anchors from which centres are fitted, on the driver. Every anchor is then assigned.
SAMPLE_VALUES = 1 << 20
#: Rows and anchors of a tile, what one task call compares. Tiles of small tables are smaller, to use all cores.
TILE_ROWS = 32_768
TILE_ANCHORS = 8_192
LEAST_TILE = 4_096
STEP = 1_024
#: Greatest squared length with which a hundred times any score fits a long.
MOST_SQUARED = float(1 << 56)
_NONE = -(1 << 62)
_LAST = np.iinfo(np.int64).max


def quantised(docs: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, q of docs(vec_id, label, embedding): components times `scale`, rounded down to whole numbers.

    Rows with a null id, label, vector or component, or one that isn't finite, are left out, and rows so long that scores
    would not fit a long. Rows that repeat id, label and vector are one.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = docs.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
    whole = F.transform(v, lambda x: F.floor(scale * x.cast("double")))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("q"))
    squared = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.where(squared < MOST_SQUARED).distinct()


def _matrix(column) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; a zero vector has direction zero."""
    x = x.astype(float)
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length > 0, length, 1)[:, None], length


def fit_centres(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Unit centres of directions, by Lloyd's rounds from evenly spaced rows of the sample."""
    unit, _ = _unit(sample)
    count = max(1, min(count, len(unit)))
    centres = unit[np.linspace(0, len(unit) - 1, count).astype(int)] if len(unit) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds):
        nearest = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        length = np.linalg.norm(sums, axis=1)
        full = length > 1e-12
        centres[full] = sums[full] / length[full, None]
    return centres


def _assign(centres: np.ndarray, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                near = np.argmax(_unit(_matrix(part.column("q")))[0] @ centres.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(near)], names=[*columns, "cluster"])

    return run


class Best:
    """The `k` highest scores of each slot; of equal ones those with the least ids."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), _NONE, np.int64)
        self.id = np.full((slots, k), _LAST, np.int64)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """A row of scores for each of `slots`, a column for each of `ids`; _NONE doesn't count."""
        need = np.maximum(self.score[slots, -1], _NONE + 1)
        if scores.shape[1] > self.k:
            need = np.maximum(need, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        r, c = np.nonzero(scores >= need[:, None])
        if not len(r):
            return
        old = np.unique(r)
        slot = np.concatenate([r, np.repeat(old, self.k)])
        score = np.concatenate([scores[r, c], self.score[slots[old]].reshape(-1)])
        name = np.concatenate([ids[c], self.id[slots[old]].reshape(-1)])
        order = np.lexsort((name, -score, slot))
        slot, score, name = slot[order], score[order], name[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        top = place < self.k
        self.score[slots[slot[top]], place[top]] = score[top]
        self.id[slots[slot[top]], place[top]] = name[top]


def _walk(members: np.ndarray, centre: np.ndarray, rows: np.ndarray, offer, needed) -> int:
    """Walks all members along the one sorted list; returns how many scores were computed.

    `offer(active, scores, places)` takes the scores of the active members with rows at `places`; `needed()` says which
    score each member still has use for.
    """
    unit, length = _unit(members)
    directions, reach = _unit(rows)
    own = np.arccos(np.clip(unit @ centre, -1, 1))
    widest = own[length > 0].max(initial=0.0)
    angle = np.arccos(np.clip(directions @ centre, -1, 1))
    most = reach * np.cos(np.maximum(angle - widest - 1e-7, 0))
    order = np.argsort(-most, kind="stable")
    most = most[order]
    exact = float(length.max(initial=0)) * float(reach.max(initial=0)) < 2.0**52
    left, right = (members.astype(float), rows.astype(float)) if exact else (members, rows)
    active, done = np.arange(len(members)), 0
    for i in range(0, len(order), STEP):
        # lengths times a bound is the most that any row from here on can score
        active = active[length[active] * most[i] * (1 + 1e-9) + 1 >= needed()[active]]
        if not len(active):
            break
        places = order[i : i + STEP]
        scores = (left[active] @ right[places].T).astype(np.int64)
        done += scores.size
        offer(active, scores, places)
    return done


def _by_cluster(anchors: pa.Table, centres: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cluster = anchors.column("cluster").to_numpy()
    order = np.argsort(cluster, kind="stable")
    cuts = np.flatnonzero(np.diff(cluster[order], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield order[a:b], centres[cluster[order[a]]]


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    anchor = pc.is_valid(table.column("cluster"))
    return table.filter(anchor), table.filter(pc.invert(anchor))


def _positives(centres: np.ndarray, k: int):
    """For a tile of one label: the best k other rows of each anchor."""

    def run(table: pa.Table) -> pa.Table:
        anchors, rows = _split(table)
        name, ids = anchors.column("row").to_numpy(), anchors.column("vec_id").to_numpy()
        found = Best(len(anchors), k)
        if len(anchors) and len(rows):
            q, other = _matrix(anchors.column("q")), _matrix(rows.column("q"))
            other_name, other_id = rows.column("row").to_numpy(), rows.column("vec_id").to_numpy()
            for at, centre in _by_cluster(anchors, centres):

                def offer(active, scores, places):
                    mine = at[active]
                    same = (name[mine][:, None] == other_name[places]) & (ids[mine][:, None] == other_id[places])
                    found.offer(mine, np.where(same, _NONE, scores), other_id[places])

                _walk(q[at], centre, other, offer, lambda: found.score[at, -1])
        i, j = np.nonzero(found.score > _NONE)
        return pa.table({"row": name[i], "anchor_id": ids[i], "positive_id": found.id[i, j], "positive_score": found.score[i, j]})

    return run


def _negatives(centres: np.ndarray, k: int, low: int, high: int):
    """For a tile: the best k rows of another label of each anchor and window of scores."""

    def run(table: pa.Table) -> pa.Table:
        anchors, rows = _split(table)
        name, ids = anchors.column("row").to_numpy(), anchors.column("vec_id").to_numpy()
        wanted = anchors.column("wanted").to_pylist()
        width = max([len(w) for w in wanted], default=0)
        positive = np.full((len(anchors), width), _NONE, np.int64)
        for i, w in enumerate(wanted):
            positive[i, : len(w)] = w
        asked = positive > _NONE
        least, most = -(-low * np.where(asked, positive, 0) // 100), high * np.where(asked, positive, 0) // 100
        asked &= least <= most
        found = [Best(len(anchors), k) for _ in range(width)]
        if len(anchors) and len(rows) and width:
            q, other = _matrix(anchors.column("q")), _matrix(rows.column("q"))
            label, other_label = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
            other_id = rows.column("vec_id").to_numpy()
            for at, centre in _by_cluster(anchors, centres):

                def offer(active, scores, places):
                    mine = at[active]
                    unlike = label[mine][:, None] != other_label[places]
                    for w in range(width):
                        some = np.flatnonzero(asked[mine, w])
                        own, part = mine[some], scores[some]
                        inside = unlike[some] & (part >= least[own, w][:, None]) & (part <= most[own, w][:, None])
                        found[w].offer(own, np.where(inside, part, _NONE), other_id[places])

                def needed():
                    each = [np.where(asked[at, w], np.maximum(found[w].score[at, -1], least[at, w]), _LAST) for w in range(width)]
                    return np.min(each, axis=0)

                _walk(q[at], centre, other, offer, needed)
        parts = []
        for w in range(width):
            i, j = np.nonzero(found[w].score > _NONE)
            parts.append((name[i], ids[i], positive[i, w], found[w].id[i, j], found[w].score[i, j]))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(["row", "anchor_id", "positive_score", "negative_id", "negative_score"], columns)))

    return run


def _tiled(rows: DataFrame, anchors: DataFrame, key: str, tile: int, apply, schema: str) -> DataFrame:
    """Every block of anchors with every block of rows of the same `key`. Blocks are dealt by hash of id and content, so
    neither a hot key nor many equal vectors make a large one."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / tile).cast("int").alias("_n"))
    counts = anchors.groupBy(key).agg(F.ceil(F.count("*") / TILE_ANCHORS).cast("int").alias("_m"))
    blocks = saved(sizes.join(counts, key), "hard_blocks")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("row", "vec_id"), F.col(n)).cast("int")
    rows = rows.join(blocks, key).withColumn("_a", mine("_n")).withColumn("_b", upto("_m"))
    anchors = anchors.join(blocks, key).withColumn("_a", upto("_n")).withColumn("_b", mine("_m"))
    both = rows.unionByName(anchors, allowMissingColumns=True).drop("_n", "_m")
    return both.groupBy(key, "_a", "_b").applyInArrow(apply, schema)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows(vec_id, label, q).

    `q` holds whole numbers; a row's score with an anchor is their exact inner product. An anchor's positives are its best
    `positives` other rows of its label, and its negatives for each of them the best `negatives` rows of other labels whose
    score is between `low` and `high` percent of the positive's; equal scores go by the least id. All rows are compared, or
    certified not to matter by the bound on their angle.

    Rows are told apart by id, label and vector: rows of one id are others to each other, rows that repeat all three should
    come once (`quantised` sees to it). Vectors of different length score nothing with each other; empty ones take no part. A positive without
    negatives gives no rows, and neither does an anchor without positives; an empty table gives none. Other columns are
    ignored.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "label", "q").withColumn("row", F.xxhash64("vec_id", "label", "q"))
    rows = saved(rows, "hard_rows")
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for dims, n, n_anchors in rows.groupBy(F.size("q")).agg(F.count("*"), F.count_if(is_anchor)).orderBy(F.size("q")).collect():
        if dims and n_anchors:
            out = out.unionByName(_of_length(rows.where(F.size("q") == dims), is_anchor, dims, n, n_anchors, positives, negatives, low, high))
    return out


def _of_length(rows, is_anchor, dims, n, n_anchors, positives, negatives, low, high) -> DataFrame:
    anchors = rows.where(is_anchor)
    sample = anchors.orderBy(F.xxhash64("row", F.lit(1))).limit(max(1, SAMPLE_VALUES // dims)).select("q").toArrow()
    centres = fit_centres(_matrix(sample.column("q")), min(MAX_CENTRES, math.ceil(n_anchors / MEMBERS)))
    columns = ["vec_id", "label", "q", "row"]
    fields = "vec_id long, label long, q array<bigint>, row long"
    anchors = saved(anchors.select(*columns).mapInArrow(_assign(centres, columns), f"{fields}, cluster int"), "hard_anchors")
    tile = min(TILE_ROWS, max(LEAST_TILE, n // (4 * rows.sparkSession.sparkContext.defaultParallelism)))
    key = "row long, anchor_id long"
    found = _tiled(rows, anchors, "label", tile, _positives(centres, positives), f"{key}, positive_id long, positive_score long")
    best = Window.partitionBy("row", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= positives)
    found = saved(found, "hard_positives")
    wanted = found.groupBy("row", F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score")).alias("wanted"))
    asking = anchors.join(wanted, ["row", "vec_id"])  # at most `positives` scores each
    schema = f"{key}, positive_score long, negative_id long, negative_score long"
    all_of = lambda df: df.withColumn("_all", F.lit(0))
    hard = _tiled(all_of(rows), all_of(asking), "_all", tile, _negatives(centres, negatives, low, high), schema)
    best = Window.partitionBy("row", "anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    joined = found.drop("_rank").join(hard, ["row", "anchor_id", "positive_score"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
