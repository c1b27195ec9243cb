"""Column names shared by every operator."""

from pyspark.sql import types as T

KEY = ["srcip", "dstip", "sport", "dport", "proto"]
WIDTH = {"srcip": 32, "dstip": 32, "sport": 16, "dport": 16, "proto": 8}
FLOW = ["host", *KEY]
GROUP = [f"k_{c}" for c in KEY]
ORDER = ["us", "pkt_no"]

PACKETS = T.StructType(
    [
        T.StructField("pkt_no", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("host", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in KEY],
        T.StructField("len", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ack", T.LongType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("rule_id", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in KEY],
        *[T.StructField(f"len_{c}", T.IntegerType()) for c in KEY],
        *[T.StructField(f"fg_{c}", T.IntegerType()) for c in KEY],
        T.StructField("agg", T.StringType()),
        T.StructField("threshold", T.LongType()),
        T.StructField("interval_ms", T.LongType()),
        T.StructField("valid_from", T.TimestampType()),
        T.StructField("valid_to", T.TimestampType()),
    ]
)

HOSTS = T.StructType(
    [
        T.StructField("host", T.LongType()),
        T.StructField("join_epoch", T.LongType()),
        T.StructField("left_epoch", T.LongType()),
    ]
)
