"""Heavy-flow admission: small flows are held back until enough size units were seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import flow_bucket, size_units
from ..plans.ordered import PIECE, before
from ..schema import ORDER
from .flowstats import sessions

UNIT = 64  # fixed value: bytes per size unit


def admission(packets: DataFrame, threshold: int, epoch_us: int, buckets: int | None = None) -> DataFrame:
    """Packets + epoch + admitted.

    A packet is admitted when the units before it in the session reach ceil(threshold / 64) - 1;
    the one that crosses is itself held back. With `buckets` flows share hashed counters, which
    can only admit more.
    """
    keys = ["host", "srcip", "dstip", "sport", "dport", "proto"]
    if buckets:
        packets = packets.withColumn("_bucket", flow_bucket(buckets))
        keys = ["host", "_bucket"]
    live = sessions(packets, epoch_us, keys)
    counted = before(live, [*keys, "session"], ORDER, size_units("len"), "sum", "_units")
    needed = -(-threshold // UNIT) - 1
    admitted = F.coalesce("_units", F.lit(0).cast("bigint")) >= needed
    return counted.withColumn("admitted", admitted).drop("_units", "_bucket", PIECE)


def admit(packets: DataFrame, threshold: int, epoch_us: int, buckets: int | None = None) -> DataFrame:
    """The packets that are counted; threshold 0 turns the filter off."""
    if threshold == 0:
        return packets
    kept = admission(packets, threshold, epoch_us, buckets).where("admitted")
    return kept.select(*packets.columns)


def admission_counts(packets: DataFrame, threshold: int, epoch_us: int, buckets: int | None = None) -> DataFrame:
    return (
        admission(packets, threshold, epoch_us, buckets)
        .groupBy("epoch")
        .agg(
            F.count_if("admitted").alias("admitted"),
            F.count_if(~F.col("admitted")).alias("filtered"),
        )
    )


def predict_threshold(params: DataFrame) -> DataFrame:
    """Smallest threshold (in units) that keeps matching and sweeping within the cycle budget."""
    share, rest = F.col("dos_share"), 1 - F.col("dos_share")
    rate = 1e10 / ((64 * share + 1500 * rest + 20) * 8)
    sweeps = 1.5 * rest * F.col("matches_per_flow") * F.col("sweep")
    spare = F.col("budget") * F.col("flowlen") - rate * (rest * F.col("match_cycles") + sweeps)
    need = share * F.col("flowlen") * F.col("match_cycles") * rate / spare
    return params.select("patterns", "dos_share", F.ceil(need).cast("bigint").alias("threshold"))
