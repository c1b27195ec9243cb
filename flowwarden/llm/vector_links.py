"""Near-duplicate vectors by cosine: blocks of vectors are compared in pairs where they lie, none is copied to its partners.

The cosine of unit vectors is at most the inner product of their leading coordinates along principal directions plus the
product of the lengths of what remains. Pairs whose bound reaches the threshold are verified. Vectors are dealt out once,
in the order of a tree over leading coordinates, into blocks in the shared folder. Every two blocks whose boxes are near
enough meet in a cartesian product, which reads the blocks again instead of shuffling copies of them.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, saved

COSINE = 0.95
#: Least number of leading coordinates.
BLOCK_DIMS = 16
#: Most rows that one side of a tile has; a tile is what is compared in one go.
TILE_ROWS = 2048
#: A block is a row of the shared table: so many tiles, or bytes of vectors, at most.
_BLOCK_TILES = 8
_BLOCK_BYTES = 1 << 22
#: Bytes of vectors in a file of blocks; beyond _FILES files they get larger. A task compares two files.
_FILE_BYTES = 1 << 24
_FILES = 256
#: The tree: about so many vectors place its cuts. It decides where a vector lies, not what it is compared with.
_CUT_ROWS = 1 << 15
_TREE_DIMS = 8
_DEEPEST = 14
#: Of a task: bytes of pairs of blocks it gets at a time, decoded blocks it keeps, edges before they are joined, nodes it
#: remembers, pairs verified at a time.
_BATCH_BYTES = 1 << 22
_KEPT = 4
_EDGES = 1 << 20
_SEEN = 1 << 16
_SLICE = 1 << 17

_BLOCK = "block bigint, nodes binary, copies binary, least binary, known binary, vectors binary, ends array<bigint>, lo array<double>, hi array<double>"
_FOUND = "node binary, links bigint, root binary, copies bigint, least bigint"


def _numbers(docs: DataFrame) -> str:
    return "float" if isinstance(docs.schema["embedding"].dataType.elementType, FloatType) else "double"


def _good(docs: DataFrame) -> Column:
    """Whether a vector has finite components only, at least one of them other than zero."""
    number = _numbers(docs)
    v = F.col("embedding").cast(f"array<{number}>")
    whole = F.array_contains(v, F.lit(float("nan")).cast(number)).eqNullSafe(False)  # null if a component is
    least, most = F.array_min(v), F.array_max(v)
    inf = float("inf")
    return F.coalesce(whole & (least > -inf) & (most < inf) & ((least < 0) | (most > 0)), F.lit(False))


def usable(docs: DataFrame) -> DataFrame:
    """Rows whose vector has finite components only and isn't zero, with `node`, the same for equal vectors."""
    v = F.col("embedding")
    name = F.concat(F.lpad(F.hex(F.xxhash64(v)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), F.size(v), v)), 16, "0"))
    return docs.where(_good(docs)).withColumn("node", F.unhex(name))


def _raw(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = np.array(vectors, float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _moments(batches):
    """Sums of products of the components and of a one behind them."""
    total = None
    for batch in batches:
        for i in range(0, batch.num_rows, 8192):
            x = _unit(_raw(batch.slice(i, 8192).column("embedding")))
            x = np.hstack([x, np.ones((len(x), 1))])
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()])], names=["m"])


class Leading:
    """The principal directions that tell pairs apart, and a tree over the first of them."""

    def __init__(self, moment: np.ndarray, cosine: float, least: int):
        n = moment[-1, -1]
        mean = moment[-1, :-1] / n
        value, vector = np.linalg.eigh(moment[:-1, :-1] / n - np.outer(mean, mean))
        value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
        self.cosine, self.reach = cosine, max(2 - 2 * cosine, 0) + 1e-5
        # Chernoff's bound for the share of pairs that the first coordinates leave within reach, were they normal
        theta = np.geomspace(0.1, 1e4, 60)[:, None] / self.reach
        share = (theta * self.reach - np.cumsum(np.log1p(4 * theta * value), axis=1) / 2).min(axis=0)
        enough = np.flatnonzero(share < np.log(1e-4))
        self.axes = np.ascontiguousarray(vector[:, : max(least, enough[0] + 1 if len(enough) else len(value))])
        self.bound = np.float32(cosine - 1e-6 - 1.2e-7 * (self.axes.shape[1] + 2))
        self.dim, self.cut = np.zeros(1, int), np.zeros(1)

    def near(self, x: np.ndarray) -> np.ndarray:
        """Leading coordinates of unit vectors and the length of the rest; inner products of these bound the cosine."""
        lead = x @ self.axes
        rest = np.sqrt(np.maximum(1 - (lead**2).sum(1, keepdims=True), 0))
        return np.hstack([lead, rest]).astype(np.float32)

    def coordinates(self, vectors: np.ndarray) -> np.ndarray:
        """The tree's coordinates, one row each. Summed up one by one: equal vectors have the very same in any batch."""
        x = np.array(vectors.T, float, order="C")
        x /= np.abs(x).max(axis=0)
        out, square = np.zeros((min(_TREE_DIMS, self.axes.shape[1]), x.shape[1])), np.zeros(x.shape[1])
        for own, axis in zip(x, self.axes[:, : len(out)]):
            out += axis[:, None] * own
            square += own * own
        return out / np.sqrt(square)

    def grow(self, rows: np.ndarray, leaves: float) -> None:
        """Cuts rows of coordinates in half at the median of the widest until there are so many leaves."""
        depth = min(_DEEPEST, max(0, int(np.ceil(np.log2(max(1.0, leaves))))))
        self.dim, self.cut = np.zeros(1 << depth, int), np.zeros(1 << depth)
        parts = {1: rows}
        for k in range(1, 1 << depth):
            part = parts.pop(k)
            if len(part) > 1:
                self.dim[k] = part.var(axis=0).argmax()
                self.cut[k] = np.median(part[:, self.dim[k]])
            right = part[:, self.dim[k]] > self.cut[k]
            parts[2 * k], parts[2 * k + 1] = part[~right], part[right]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        at = self.coordinates(vectors)
        k, each = np.ones(len(vectors), int), np.arange(len(vectors))
        for _ in range(len(self.cut).bit_length() - 1):
            k = 2 * k + (at[self.dim[k], each] > self.cut[k])
        return k.astype(np.int32)


def _coordinates(space: Leading):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                rows = space.coordinates(_raw(batch.slice(i, 4096).column("embedding"))).T
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in rows], pa.binary())], names=["at"])

    return run


def _place(space: Leading, once: bool):
    """Rows with the cell of their vector. once: with the vector, and without those that the task has just seen."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                if once:
                    new = []
                    for k, node in enumerate(part.column("node").to_pylist()):
                        if node not in seen:
                            seen.add(node)
                            new.append(k)
                    if len(seen) > _SEEN:
                        seen.clear()
                    part = part.take(pa.array(new, pa.int64()))
                if part.num_rows:
                    cell = pa.array(space.cells(_raw(part.column("embedding"))))
                    names = ["node", "vec_id", "embedding"][: 3 if once else 2]
                    yield pa.RecordBatch.from_arrays([cell, *map(part.column, names)], names=["cell", *names])

    return run


def _tile_ends(cell: np.ndarray, tile_rows: int) -> list[int]:
    """Tiles end where a cell does, unless that would make them small or large."""
    ends, start = [], 0
    for end in [*(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]:
        if end - start >= tile_rows // 2 or end == len(cell):
            ends += [*range(start + tile_rows, end, tile_rows), end]
            start = end
    return ends


def _pack(space: Leading, tile_rows: int, block_rows: int):
    """Rows in the order of their cells as blocks, with the box of a block."""

    def block(number: int, rows: pa.Table) -> pa.RecordBatch:
        raw = _raw(rows.column("embedding").combine_chunks())
        near = space.near(_unit(raw)).astype(float)
        least = rows.column("least")
        values = {
            "block": number,
            "nodes": b"".join(rows.column("node").to_pylist()),
            "copies": rows.column("copies").to_numpy().astype(np.int64).tobytes(),
            "least": least.fill_null(0).to_numpy().astype(np.int64).tobytes(),
            "known": least.is_valid().to_numpy().astype(bool).tobytes(),
            "vectors": raw.tobytes(),
            "ends": _tile_ends(rows.column("cell").to_numpy(), tile_rows),
            "lo": near.min(axis=0).tolist(),
            "hi": near.max(axis=0).tolist(),
        }
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in values.values()], names=list(values))

    def run(batches):
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < block_rows:
                continue
            table = pa.Table.from_batches(held)
            while rows >= block_rows:
                yield block(number, table.slice(0, block_rows))
                number, table, rows = number + 1, table.slice(block_rows), rows - block_rows
            held = table.to_batches()
        if rows:
            yield block(number, pa.Table.from_batches(held))

    return run


def _linked_pairs(space: Leading, x, near, y, far, within: bool):
    """Places (i, j) of linked pairs of x and y, some at a time; within: x is y, i < j."""
    rows = max(1, (1 << 19) // max(1, len(y)))
    room = np.empty(rows * len(y), np.float32)
    for i in range(0, len(x), rows):
        first = i if within else 0
        shape = min(rows, len(x) - i), len(y) - first
        best = np.matmul(near[i : i + rows], far[first:].T, out=room[: shape[0] * shape[1]].reshape(shape))
        if within:
            best[:, : len(best)][np.tri(len(best), dtype=bool)] = -2
        some = np.flatnonzero(best.max(axis=1) >= space.bound)
        if not len(some):
            continue
        likely = best[some] >= space.bound
        p, q = np.nonzero(likely)
        if len(p) > likely.size >> 4:
            exact = x[i + some] @ y[first:].T
            sure = likely & (exact >= space.cosine + 1e-12)
            open_ = likely & ~sure & (exact >= space.cosine - 1e-12)  # sums in another order could differ
            for found, check in ((sure, False), (open_, True)):
                p, q = np.nonzero(found)
                yield from _verified(space, x, y, some[p] + i, q + first, check)
        else:
            yield from _verified(space, x, y, some[p] + i, q + first, True)


def _verified(space: Leading, x, y, u, v, check: bool):
    for s in range(0, len(u), _SLICE):
        i, j = u[s : s + _SLICE], v[s : s + _SLICE]
        if check:
            ok = np.einsum("ij,ij->i", x[i], y[j]) >= space.cosine
            i, j = i[ok], j[ok]
        if len(i):
            yield i, j


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets that hold i and j; label names the least place of each place's set."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class _Block:
    """A row of the shared table, decoded."""

    def __init__(self, space: Leading, row: dict, kind: str):
        self.nodes = row["nodes"].to_pybytes()
        self.copies, self.least = np.frombuffer(row["copies"], np.int64), np.frombuffer(row["least"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        vectors = np.frombuffer(row["vectors"], kind).reshape(len(self.known), -1)
        self.x = np.empty(vectors.shape)
        self.near = np.empty((len(vectors), space.axes.shape[1] + 1), np.float32)
        for i in range(0, len(vectors), 2048):
            self.x[i : i + 2048] = _unit(vectors[i : i + 2048])
            self.near[i : i + 2048] = space.near(self.x[i : i + 2048])
        self.copies, self.least, self.known = self.copies.copy(), self.least.copy(), self.known.copy()  # lets the batch go
        ends = row["ends"]
        self.tiles = [slice(a, b) for a, b in zip([0, *ends], ends)]
        self.boxes = [(self.near[t].min(axis=0), self.near[t].max(axis=0)) for t in self.tiles]


class _Links:
    """What a task has found: links of each vector in its blocks, and which vectors they connect."""

    def __init__(self):
        self.size, self.at, self.names, self.links, self.edges, self.waiting = 0, {}, [], [], [], 0
        self.label = np.zeros(0, int)

    def place(self, number: int, block: _Block) -> tuple[int, np.ndarray]:
        if number not in self.at:
            self.at[number] = (self.size, len(self.names))
            self.names.append((block.nodes, block.copies, block.least, block.known))
            self.links.append(np.zeros(len(block.x), np.int64))
            self.size += len(block.x)
        start, k = self.at[number]
        return start, self.links[k]

    def tile(self, space: Leading, a: int, left: _Block, s: slice, b: int, right: _Block, t: slice) -> None:
        (start, links), (other, others) = self.place(a, left), self.place(b, right)
        within = a == b and s == t
        n, m = s.stop - s.start, t.stop - t.start
        label = None
        for i, j in _linked_pairs(space, left.x[s], left.near[s], right.x[t], right.near[t], within):
            if label is None:
                label = np.arange(n if within else n + m)
            links[s] += np.bincount(i, right.copies[t][j], n).astype(np.int64)
            others[t] += np.bincount(j, left.copies[s][i], m).astype(np.int64)
            _join(label, i, j if within else j + n)
        if label is not None:
            place = np.arange(start + s.start, start + s.stop)
            place = place if within else np.concatenate([place, np.arange(other + t.start, other + t.stop)])
            up = np.flatnonzero(label != np.arange(len(label)))
            self.edges.append((place[up], place[label[up]]))
            self.waiting += len(up)
            if self.waiting > _EDGES:
                self.join()

    def join(self) -> None:
        self.label = np.concatenate([self.label, np.arange(len(self.label), self.size)])
        if self.edges:
            _join(self.label, *map(np.concatenate, zip(*self.edges)))
        self.edges, self.waiting = [], 0

    def found(self):
        """A row for each vector with links."""
        self.join()
        nodes = np.frombuffer(b"".join(x[0] for x in self.names), "V16")
        binary = lambda x: pa.Array.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
        for (start, k), (_, copies, least, known) in zip(self.at.values(), self.names):
            some = np.flatnonzero(self.links[k])
            if len(some):
                columns = [binary(nodes[start + some]), pa.array(self.links[k][some]), binary(nodes[self.label[start + some]])]
                columns += [pa.array(copies[some]), pa.array(least[some], mask=~known[some])]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "links", "root", "copies", "least"])


def _compare(space: Leading, kind: str):
    """For pairs of blocks: the vectors with links among them, each once in a task, and one they are connected with."""

    def run(batches):
        links, kept = _Links(), {}
        sides = {s: [f"{s}_{c}" for c in ("nodes", "copies", "least", "known", "vectors")] for s in "ab"}
        for batch in batches:
            numbers = zip(batch.column("a_block").to_pylist(), batch.column("b_block").to_pylist())
            for k, pair in enumerate(numbers):
                for side, number in zip("ab", pair):
                    if number not in kept:
                        if len(kept) >= _KEPT:
                            kept = {n: x for n, x in kept.items() if n in pair}
                        row = {c[2:]: batch.column(c)[k].as_buffer() for c in sides[side]}
                        kept[number] = _Block(space, row | {"ends": batch.column(f"{side}_ends")[k].as_py()}, kind)
                left, right = kept[pair[0]], kept[pair[1]]
                for i, s in enumerate(left.tiles):
                    for j, t in enumerate(right.tiles):
                        if pair[0] == pair[1] and j < i:
                            continue
                        (lo, hi), (low, high) = left.boxes[i], right.boxes[j]
                        if (np.maximum(np.maximum(lo - high, low - hi), 0) ** 2).sum() <= space.reach:
                            links.tile(space, pair[0], left, s, pair[1], right, t)
        yield from links.found()

    return run


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """What runs meanwhile sends Python tasks few large rows at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(_BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _gap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """The squared distance of two boxes."""
    minus = lambda x, y: x - y
    apart = F.zip_with(F.zip_with(a_lo, b_hi, minus), F.zip_with(b_lo, a_hi, minus), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda total, x: total + x * x)


def _blocks(own: DataFrame, many: DataFrame, space: Leading, kind: str, rows: int, tile_rows: int) -> DataFrame:
    """Distinct vectors as blocks of near ones; `many` has the copies and least vec_id of those with several vec_ids."""
    width = np.dtype(kind).itemsize * len(space.axes)
    files = min(_FILES, max(-(-rows * width // _FILE_BYTES), min(own.sparkSession.sparkContext.defaultParallelism, rows // (4 * tile_rows)), 1))
    block_rows = max(1, min(_BLOCK_TILES * tile_rows, _BLOCK_BYTES // width))
    vector = own.schema["embedding"].dataType
    placed = own.mapInArrow(_place(space, True), f"cell int, node binary, vec_id bigint, embedding {vector.simpleString()}")
    none = lambda kind: F.lit(None).cast(kind)
    placed = placed.select("cell", "node", "embedding", none("bigint").alias("copies"), F.col("vec_id").alias("least"))
    placed = placed.unionByName(many.select("cell", "node", none(vector).alias("embedding"), "copies", "least"))
    placed = placed.repartitionByRange(files, "cell", "node").groupBy("cell", "node")
    placed = placed.agg(
        F.first("embedding", ignorenulls=True).alias("embedding"), F.coalesce(F.max("copies"), F.lit(1)).alias("copies"), F.min("least").alias("least")
    )
    return saved(placed.sortWithinPartitions("cell", "node").mapInArrow(_pack(space, tile_rows, block_rows), _BLOCK), "vector_blocks")


def near_vectors(docs: DataFrame, cosine: float = COSINE, block_dims: int = BLOCK_DIMS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of docs(vec_id, embedding).

    Vectors are linked if their cosine, in double precision, is at least `cosine`. Equal vectors are compared once. Links
    are counted in the task that verifies them and only counts and spanning links leave it, never all pairs.

    A null, empty or zero vector and one with a null or non-finite component are linked with nothing, as are vectors of
    different length. Rows that repeat a vec_id and vector are one vector. A null vec_id takes part, but names a component
    only if all its ids are null. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    good = usable(docs)
    kind = {"float": "f4", "double": "f8"}[_numbers(docs)]
    vectors = good.select("node", "vec_id", F.col("embedding").cast(f"array<{_numbers(docs)}>").alias("embedding"))
    spark = docs.sparkSession
    found = spark.createDataFrame([], _FOUND)
    several = spark.createDataFrame([], "node binary, copies bigint, least bigint")
    for dims in sorted(r[0] for r in vectors.select(F.size("embedding")).distinct().collect()):
        own = vectors.where(F.size("embedding") == dims)
        sums = own.select("embedding").mapInArrow(_moments, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x"))
        moment = np.zeros((dims + 1) ** 2)
        for i, x in sums.collect():  # (dims + 1) ** 2 numbers
            moment[i] = x
        rows = round(moment[-1])
        space = Leading(moment.reshape(dims + 1, dims + 1), cosine, block_dims)
        cuts = own.where(F.pmod(F.xxhash64("node"), F.lit(max(1, rows // _CUT_ROWS))) == 0).dropDuplicates(["node"])
        cuts = [r[0] for r in cuts.select("embedding").mapInArrow(_coordinates(space), "at binary").collect()]
        space.grow(np.frombuffer(b"".join(cuts)).reshape(-1, min(_TREE_DIMS, space.axes.shape[1])), rows / tile_rows)
        many = own.mapInArrow(_place(space, False), "cell int, node binary, vec_id bigint").distinct().groupBy("cell", "node")
        many = saved(many.agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).where("copies > 1"), "vector_copies")
        several = several.unionByName(many.select("node", "copies", "least"))
        blocks = _blocks(own, many, space, kind, rows, tile_rows)
        a, b = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in blocks.columns)) for side in "ab")
        near = (F.col("a_block") <= F.col("b_block")) & (_gap(*map(F.col, ("a_lo", "a_hi", "b_lo", "b_hi"))) <= space.reach)
        pairs = a.join(b.hint("shuffle_replicate_nl"), near).drop("a_lo", "a_hi", "b_lo", "b_hi")
        found = found.unionByName(pairs.mapInArrow(_compare(space, kind), _FOUND))
    with _small_batches(spark):
        found = saved(found, "vector_links")
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector_edges")
    named = found.drop("root").unionByName(several.withColumn("links", F.lit(0).cast("bigint")))
    named = named.groupBy("node").agg(F.sum("links").alias("links"), F.max("copies").alias("copies"), F.min("least").alias("least"))
    named = named.join(joined, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    named = saved(named, "vector_named")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "root").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    # what has no links and no copies is not in `named`
    keyed = good.select("vec_id", "node").join(named, "node", "left")
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    keyed = keyed.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"))
    alone = docs.where(~_good(docs)).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return keyed.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
