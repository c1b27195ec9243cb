"""Dense grids of keys and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 65_536


def spread(keys: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """A row per key and number from `first` to `last`.

    Long ranges are laid out in blocks that are shuffled before they are filled, so no task and
    no array holds a whole range.
    """
    if last < first:
        return keys.withColumn(column, F.lit(None).cast("bigint")).where(F.lit(False))

    def numbers(lo, hi):
        return F.explode(F.sequence(lo, hi))

    start, end = F.lit(first).cast("bigint"), F.lit(last).cast("bigint")
    blocks = (last - first) // BLOCK + 1
    if blocks == 1:
        return keys.withColumn(column, numbers(start, end))
    cut = keys.withColumn("_block", numbers(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    lo = start + F.col("_block") * BLOCK
    laid = cut.repartition(*keys.columns, "_block").withColumn(column, numbers(lo, F.least(lo + BLOCK - 1, end)))
    return laid.drop("_block")


def spread_between(keys: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """A row per key and number between its own columns `first` and `last`, which are dropped; laid out in blocks."""
    lo, hi = F.col(first), F.col(last)
    cut = keys.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", hi - lo, F.lit(BLOCK).cast("bigint")))))
    start = lo + F.col("_block") * BLOCK
    laid = cut.repartition(*keys.columns, "_block").withColumn(column, F.explode(F.sequence(start, F.least(start + BLOCK - 1, hi))))
    return laid.drop("_block", first, last)
