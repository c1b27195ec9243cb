"""Packet tables and streams, and the alert sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PACKETS


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKETS).parquet(path)


def stream_packets(spark: SparkSession, source: str, files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """Packets as a stream: a folder of parquet files, or Kafka where its connector is installed.

    `kafka:<topic>` reads JSON packets; pass `kafka.bootstrap.servers` in the options.
    """
    if source.startswith("kafka:"):
        raw = spark.readStream.format("kafka").option("subscribe", source[6:]).options(**options).load()
        parsed = F.from_json(F.col("value").cast("string"), PACKETS)
        return raw.select(parsed.alias("p")).select("p.*")
    reader = spark.readStream.schema(PACKETS).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(source)


def heartbeat(spark: SparkSession, us: int) -> DataFrame:
    """A row without a packet that tells `states` the time, so that the epochs before it are closed."""
    row = spark.range(1).select(F.timestamp_micros(F.lit(us)).alias("ts"))
    return row.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in PACKETS])


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    alerts.write.mode(mode).parquet(path)
