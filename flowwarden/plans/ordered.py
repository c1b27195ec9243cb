"""Ordered per-key computations that do not depend on one task seeing a whole key.

A running statistic needs the rows of a key in order, and a plain window puts each key in one
task. Here a key with very many rows is cut along its order into pieces. Windows run per
(key, piece); one summary row per piece is scanned to find what each piece inherits from the
pieces before it, and a join brings that in. The answer is the same however keys are cut.
Keys that are not cut have a null piece and no inheritance; when none is cut there is no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .sizing import checkpointed, fits

PIECE = "piece"
ROWS_PER_PIECE = 4_000_000
PARTS = 64  # pieces that one round makes of one


def split_hot(df: DataFrame, keys: Sequence[str], at: str = "us", rows_per_piece: int | None = None) -> DataFrame:
    """Add `piece`: null for ordinary keys, the start of an `at` range for keys with many rows.

    A key or piece with more than `rows_per_piece` rows is cut at quantiles of its own rows, again and
    again until every piece fits or holds rows of a single `at` only.
    """
    rows_per_piece = rows_per_piece or ROWS_PER_PIECE
    keys = list(keys)
    if PIECE in df.columns:
        if df.schema[PIECE].metadata.get("keys") == keys:
            return df
        df = df.drop(PIECE)
    whole = _label(df, F.lit(None).cast("bigint"), keys, cut=False)
    if df.count() <= rows_per_piece:
        return whole
    out, cut, before = whole, False, None
    while True:
        rows = out.where(F.col(PIECE).isNotNull()) if cut else out
        on = [*keys, PIECE] if cut else keys
        sizes = rows.groupBy(*keys, PIECE).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
        hot = checkpointed(sizes.where((F.col("_n") > rows_per_piece) & (F.col("_hi") > F.col("_lo"))).select(*on, "_n", "_lo"))
        # as many as total rows / rows_per_piece at most
        now = hot.agg(F.count(F.lit(1)).alias("k"), F.sum("_n").alias("n")).first()
        if not now["k"] or now == before:
            break
        before = now
        small = F.broadcast(hot) if fits(hot) else hot
        shares = [i / PARTS for i in range(1, PARTS)]
        found = rows.join(small, on).groupBy(*on, "_lo").agg(F.percentile_approx(at, shares, 100 * PARTS).alias("_cuts"))
        cuts = checkpointed(found)
        cut = True
        start = F.coalesce(F.array_max(F.filter("_cuts", lambda c: c <= F.col(at))), F.col("_lo"))
        out = (
            out.join(F.broadcast(cuts) if fits(cuts) else cuts, on, "left")
            .withColumn(PIECE, F.coalesce(start, F.col(PIECE)))
            .select(*df.columns, PIECE)
        )
    return _label(out, F.col(PIECE), keys, cut=True) if cut else whole


def is_split(df: DataFrame) -> bool:
    return bool(df.schema[PIECE].metadata.get("cut"))


def relabel(df: DataFrame, like: DataFrame) -> DataFrame:
    """Give a derived `piece` column the marks of the frame it came from."""
    return df.withColumn(PIECE, F.col(PIECE).alias(PIECE, metadata=like.schema[PIECE].metadata))


def _label(df: DataFrame, piece: Column, keys: list[str], cut: bool) -> DataFrame:
    return df.withColumn(PIECE, piece.alias(PIECE, metadata={"keys": keys, "cut": cut}))


def in_piece(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Rows of a key, or of a piece of it. Uncut frames keep the partitioning of the plain keys."""
    return Window.partitionBy(*keys, *([PIECE] if is_split(df) else [])).orderBy(*order)


def _pieces(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(PIECE)


def _inherit(df: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join what each piece inherits. One row per piece: written out, so no later step repeats it."""
    heads = checkpointed(heads)
    return df.join(F.broadcast(heads) if fits(heads) else heads, [*keys, PIECE], "left")


def _restore(df: DataFrame, columns: Sequence[str], like: DataFrame) -> DataFrame:
    return relabel(df.select(*columns), like)


def before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, how: str, name: str) -> DataFrame:
    """Sum or max of `value` over the rows before each row of its key; null on the first row."""
    agg = {"sum": F.sum, "max": F.max}[how]
    columns = [*_without(df.columns, name), name]
    valued = df.withColumn("_v", value)
    here = agg("_v").over(in_piece(df, keys, order).rowsBetween(Window.unboundedPreceding, -1))
    if not is_split(df):
        return _restore(valued.withColumn(name, here), columns, df)
    totals = valued.where(F.col(PIECE).isNotNull()).groupBy(*keys, PIECE).agg(agg("_v").alias("_total"))
    heads = totals.select(
        *keys, PIECE, agg("_total").over(_pieces(keys).rowsBetween(Window.unboundedPreceding, -1)).alias("_head")
    )
    if how == "max":
        both = F.greatest("_head", "_local")
    else:
        both = F.coalesce(F.col("_head") + F.col("_local"), F.col("_head"), F.col("_local"))
    joined = _inherit(valued.withColumn("_local", here), heads, keys).withColumn(name, both)
    return _restore(joined, columns, df)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """`value` (never null) of the row before; null on the first row of a key."""
    columns = [*_without(df.columns, name), name]
    here = F.lag(value).over(in_piece(df, keys, order))
    if not is_split(df):
        return _restore(df.withColumn(name, here), columns, df)
    lasts = (
        df.where(F.col(PIECE).isNotNull())
        .groupBy(*keys, PIECE)
        .agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    )
    heads = lasts.select(*keys, PIECE, F.lag("_last").over(_pieces(keys)).alias("_head"))
    joined = _inherit(df.withColumn("_local", here), heads, keys)
    return _restore(joined.withColumn(name, F.coalesce("_local", "_head")), columns, df)


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, new_at: int, name: str
) -> DataFrame:
    """First `value` of the run a row belongs to.

    `value` never falls along the order; a run ends where it jumps by `new_at` or more.
    """
    columns = [*_without(df.columns, name), name]
    w = in_piece(df, keys, order)
    jump = F.col(value) - F.lag(value).over(w)
    starts = df.withColumn("_start", F.when(jump.isNull() | (jump >= new_at), F.col(value)))
    here = F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    if not is_split(df):
        return _restore(starts.withColumn(name, here), columns, df)
    pieces = (
        starts.where(F.col(PIECE).isNotNull())
        .groupBy(*keys, PIECE)
        .agg(F.min(value).alias("_first"), F.max(value).alias("_last"), F.max("_start").alias("_lastrun"))
    )
    along = _pieces(keys)
    goes_on = F.coalesce(F.col("_first") - F.lag("_last").over(along) < new_at, F.lit(False))
    own = F.when((F.col("_lastrun") > F.col("_first")) | ~F.col("_goes_on"), F.col("_lastrun"))
    heads = (
        pieces.withColumn("_goes_on", goes_on)
        .withColumn("_own", own)
        .withColumn("_head", F.last("_own", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
        .where("_goes_on")
        .select(*keys, PIECE, "_first", "_head")
    )
    # Rows before the first new run of a piece that goes on belong to the inherited run.
    run = F.when(F.col("_run") == F.col("_first"), F.col("_head")).otherwise(F.col("_run"))
    joined = _inherit(starts.withColumn("_run", here), heads, keys)
    return _restore(joined.withColumn(name, run), columns, df)


def floored_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Running sum of `value` that never falls below zero.

    With S the plain running sum it equals S - min(0, lowest S so far), so two running
    aggregates replace the row-by-row loop.
    """
    columns = [*_without(df.columns, name), name]
    zero = F.lit(0).cast("bigint")
    w = in_piece(df, keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_s", F.sum(value).over(w)).withColumn("_low", F.min("_s").over(w))
    if not is_split(df):
        return _restore(local.withColumn(name, F.col("_s") - F.least(zero, F.col("_low"))), columns, df)
    along = _pieces(keys).rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        local.where(F.col(PIECE).isNotNull())
        .groupBy(*keys, PIECE)
        .agg(F.sum(value).alias("_total"), F.min("_s").alias("_lowest"))
        .withColumn("_s0", F.coalesce(F.sum("_total").over(along), zero))
        .withColumn("_low0", F.min(F.col("_s0") + F.col("_lowest")).over(along))
        .select(*keys, PIECE, "_s0", "_low0")
    )
    s0 = F.coalesce("_s0", zero)
    low = F.least(zero, F.col("_low0"), s0 + F.col("_low"))
    joined = _inherit(local, heads, keys)
    return _restore(joined.withColumn(name, s0 + F.col("_s") - low), columns, df)


def _without(columns: Sequence[str], name: str) -> list[str]:
    return [c for c in columns if c != name]
