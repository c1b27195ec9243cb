"""Size checks that decide how a small side reaches the tasks, and durable cuts of long plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
FEW_ROWS = 10_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="flowwarden-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def few_rows(df: DataFrame, limit: int = FEW_ROWS) -> list[Row] | None:
    """The rows of a short table such as a rule set, or None when there are more than `limit`."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows; reads no more than one row beyond that."""
    return few_rows(df.select(F.lit(1)), min(rows, FEW_ROWS)) is not None or df.limit(rows + 1).count() <= rows
