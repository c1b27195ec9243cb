"""Text logs and traces to tables. Each is a scan with native pattern functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Message codes of the controller log and of the host log.
CONTROLLER_TYPES = {
    "poll": 1,
    "sat": 2,
    "poll_return": 3,
    "add_return": 4,
    "all_data": 5,
    "addevent": 6,
    "delevent": 7,
    "del_return": 8,
}
HOST_TYPES = {"send": 1, "poll": 2, "add": 3, "del": 4}


def _code(names: dict[str, int], word: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[word]


def _tokens(lines: DataFrame) -> DataFrame:
    """Words of the lines that begin with a number and a colon, split once."""
    words = F.split("value", "[ :]+")
    return lines.where(F.col("value").rlike(r"^\d+:")).select(F.explode(F.array(words)).alias("w"))


def _at(i: int | Column, kind: str = "bigint") -> Column:
    return F.get("w", i).try_cast(kind)


def read_controller_log(lines: DataFrame) -> DataFrame:
    """time, server, type, server_epoch, event, epoch; events without a server get server and epoch 0.

    `time: serverdata S: word time T event E ctime C` or `time: word event E ctime C`.
    """
    from_server = F.get("w", 1) == "serverdata"
    zero = F.lit(0).cast("bigint")
    return (
        _tokens(lines)
        .select(
            _at(0).alias("time"),
            F.when(from_server, _at(2)).otherwise(zero).cast("int").alias("server"),
            _code(CONTROLLER_TYPES, F.when(from_server, F.get("w", 3)).otherwise(F.get("w", 1))).alias("type"),
            F.when(from_server, _at(5)).otherwise(zero).alias("server_epoch"),
            F.when(from_server, _at(7)).otherwise(_at(3)).cast("int").alias("event"),
            F.when(from_server, _at(9)).otherwise(_at(5)).alias("epoch"),
        )
        .where(F.col("type").isNotNull())
    )


def read_host_log(lines: DataFrame) -> DataFrame:
    """time, type, rtime, step, event; add and delete lines carry no time of their own.

    `time: word time T step S event E` or `time: word step S event E`.
    """
    timed = F.get("w", 2) == "time"
    return (
        _tokens(lines)
        .select(
            _at(0).alias("time"),
            _code(HOST_TYPES, F.get("w", 1)).alias("type"),
            F.when(timed, _at(3)).otherwise(F.lit(0).cast("bigint")).alias("rtime"),
            F.when(timed, _at(5)).otherwise(_at(3)).alias("step"),
            F.when(timed, _at(7)).otherwise(_at(5)).cast("int").alias("event"),
        )
        .where(F.col("type").isNotNull())
    )


def trace_from_lines(lines: DataFrame, network: str = "192.168.1.") -> DataFrame:
    """Trace lines `seconds,address,length,protocol` to t, src, len, proto.

    Only lines of the given network are kept; `src` is the last part of the address.
    """
    part = F.split("value", ",")
    return lines.where(F.startswith(F.get(part, 1), F.lit(network))).select(
        F.get(part, 0).try_cast("double").alias("t"),
        F.substring_index(F.get(part, 1), ".", -1).try_cast("int").alias("src"),
        F.get(part, 2).try_cast("int").alias("len"),
        F.get(part, 3).try_cast("int").alias("proto"),
    )


def read_trace(spark: SparkSession, path: str, network: str = "192.168.1.") -> DataFrame:
    return trace_from_lines(spark.read.text(path), network)


TRACE_TABLE = T.StructType(
    [
        T.StructField("t", T.DoubleType()),
        T.StructField("src", T.IntegerType()),
        T.StructField("len", T.IntegerType()),
        T.StructField("proto", T.IntegerType()),
    ]
)


def read_trace_table(spark: SparkSession, path: str) -> DataFrame:
    """A trace whose addresses were already shortened to ids."""
    return spark.read.schema(TRACE_TABLE).csv(path)


_FLOAT = r"(-?[0-9.]+(?:e[+-]?\d+)?)"


def read_run_summaries(lines: DataFrame, config: dict[str, int]) -> DataFrame:
    """Lines with their `file` to one row per run.

    `config` names the parts of the file name (split at `_`, folder and extension removed), for
    example {"interval": 1, "flows": 2}.
    """
    v = F.col("value")

    def first(pattern: str, kind: str) -> Column:
        found = F.regexp_extract(v, pattern, 1)
        return F.max(F.when(found != "", found).try_cast(kind))

    per_file = lines.groupBy("file").agg(
        first(r"Summary1 pkts:(\d+)", "bigint").alias("pkts"),
        first(r"Summary1 .*cycles:(\d+)", "bigint").alias("cycles"),
        first(rf"Summary1 .*rate:{_FLOAT}", "double").alias("rate"),
        first(rf"Summary1 .*loss:{_FLOAT}", "double").alias("loss"),
        first(rf"Summary2 .*zerots:{_FLOAT}", "double").alias("zerots"),
        first(r"Summary3 notfinished (\d+)", "bigint").alias("notfinished"),
        first(rf"Summary3 .*mstepticks {_FLOAT}", "double").alias("sweep_ticks"),
        first(r"RX Packets *: (\d+)/", "bigint").alias("rx_packets"),
        first(r"RX Packets *: \d+/(\d+)", "bigint").alias("rx_errors"),
        first(rf"RX Packet Loss: *{_FLOAT}", "double").alias("rx_loss"),
        first(rf"match delay {_FLOAT}", "double").alias("match_ns"),
        first(rf"Avg match cycles {_FLOAT}", "double").alias("match_cycles"),
    )
    name = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[a-z]+$", "")
    parts = F.split(name, "_")
    return per_file.select(
        "file", *[F.get(parts, i).alias(c) for c, i in config.items()], *[c for c in per_file.columns if c != "file"]
    )


def read_run_files(spark: SparkSession, path: str, config: dict[str, int]) -> DataFrame:
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    return read_run_summaries(lines, config)
