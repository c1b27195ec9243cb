"""Tables in the shared folder, connected components, and arrow batches in small pieces."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: its lineage is cut, and its size is known to the planner."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """Tells texts of repeated document ids apart; null texts have a key, too."""
    return F.xxhash64(text, F.octet_length(text))


def unused(docs: DataFrame, name: str) -> str:
    """`name`, or a longer one if docs has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of arrow batches of about `limit` bytes of text at most (one row at least), with the texts as bytes."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, size = 0, 0
        for i, more in enumerate([*lengths, limit]):
            if i > start and (size + more > limit or i == len(lengths)):
                part = batch.slice(start, i - start)
                yield part, part.column(column).cast(pa.large_binary()).to_pylist()
                start, size = i, 0
            size += more


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, from batches in which they follow one another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            own = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of `edges(a, b)`: the component is its least node.

    Alternating large and small stars. A round sends each node's neighbours to the least one by a grouped minimum and a
    join, so the neighbours of a hot node are never in one group; the number of rounds grows with the logarithm of the
    component's size. Each round is a table in the shared folder.
    """
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = saved(links, name)
    before = None
    while True:
        now = links.agg(mark).first()[0]
        if now == before or now["n"] == 0:
            break
        before = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, name)
        # every link of `large` goes from a greater to a lesser node
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = saved(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
