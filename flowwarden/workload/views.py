"""The driver's tables seen as packets, hosts, rules and logs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.keys import long_to_ip
from ..schema import HOSTS, PACKETS, RULES
from ..sources.packets import heartbeat

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
DAY_MS = 86_400_000
CLIENTS, SERVERS = 167772160, 167837696  # 10.0.0.0 and 10.1.0.0

N_HOSTS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _built(made: Column) -> Column:
    """Made-up text as if it had been read: exploding an array keeps readers from building it again."""
    return F.explode(F.array(made))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as two-way traffic between clients and eight servers."""
    events = table(spark, sf_dir, "events")
    return _as_packets(events, events.count() // 5)


def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets as a stream over the file."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    return _as_packets(stream, events.count() // 5)


def _as_packets(events: DataFrame, back: int) -> DataFrame:
    out = F.col("event_id") % 2 == 0
    client = F.lit(CLIENTS) + F.col("user_id")
    server = F.lit(SERVERS) + F.col("user_id") % 8
    port = F.lit(50000) + F.col("user_id") % 3
    number = F.when(F.col("event_id") % 7 == 0, F.greatest(F.col("event_id") - back, F.lit(0))).otherwise(
        F.col("event_id")
    )
    steps = F.call_function("div", F.col("event_id"), F.lit(back).cast("bigint")) * back
    columns = {
        "pkt_no": F.col("event_id"),
        "ts": F.col("ts").cast("timestamp"),
        "host": F.col("user_id") % N_HOSTS,
        "srcip": F.when(out, client).otherwise(server),
        "dstip": F.when(out, server).otherwise(client),
        "sport": F.when(out, port).otherwise(2500),
        "dport": F.when(out, 2500).otherwise(port),
        "proto": F.when(F.col("event_type").isin("click", "view", "error"), 6).otherwise(17),
        "len": F.lit(64) + F.floor(F.col("value") * 3),
        "seq": number * 1460,
        "ack": steps * 1460,
    }
    return events.select(*[v.cast(PACKETS[k].dataType).alias(k) for k, v in columns.items()])


# rule_id, filter with lengths, granularity, aggregate, threshold, days: at least three mask shapes.
RULE_ROWS = [
    # id, srcip/len, dstip/len, sport/len, dport/len, proto/len, granularity, agg, threshold, days
    (0, (0, 0), (SERVERS, 24), (0, 0), (0, 0), (0, 0), (0, 0, 0, 0, 0), "volume", 1500, 1),
    (1, (0, 0), (CLIENTS, 16), (0, 0), (0, 0), (0, 0), (0, 32, 0, 0, 0), "volume", 500, 1),
    (2, (0, 0), (0, 0), (0, 0), (2500, 16), (6, 8), (0, 32, 0, 0, 0), "packet", 5, 2),
    (3, (SERVERS, 29), (CLIENTS, 28), (0, 0), (0, 0), (0, 0), (0, 0, 0, 0, 0), "packet", 4, 1),
    (4, (0, 0), (SERVERS, 16), (0, 0), (0, 0), (17, 8), (0, 0, 0, 0, 0), "packet", 1, 3),
    (5, (0, 0), (SERVERS, 24), (0, 0), (0, 0), (0, 0), (0, 32, 0, 0, 8), "loss", 1, 1),
    (6, (0, 0), (SERVERS, 24), (0, 0), (0, 0), (0, 0), (32, 0, 0, 0, 0), "congestion", 20, 1),
    (7, (0, 0), (CLIENTS, 16), (0, 0), (0, 0), (0, 0), (0, 0, 0, 0, 0), "congestion", 100, 1),
    (8, (0, 0), (SERVERS, 24), (0, 0), (0, 0), (0, 0), (0, 32, 0, 0, 0), "burstloss", 1, 1),
]


def rules(spark: SparkSession) -> DataFrame:
    rows = [
        (
            r[0],
            *[f[0] for f in r[1:6]],
            *[f[1] for f in r[1:6]],
            *r[6],
            r[7],
            r[8],
            r[9] * DAY_MS,
            None,
            None,
        )
        for r in RULE_ROWS
    ]
    return _local(spark, rows, RULES)


def hosts(spark: SparkSession) -> DataFrame:
    return _local(spark, [(h, 3 * h, None) for h in range(N_HOSTS)], HOSTS)


def changing_hosts(spark: SparkSession) -> DataFrame:
    """One host that joins on 11 January 2024, one that leaves on the 21st, and two that stay."""
    day0 = 19723
    rows = [(0, 0, None), (1, 0, day0 + 20), (2, 0, None), (3, day0 + 10, None)]
    return _local(spark, rows, HOSTS)


def packet_stream_in_files(spark: SparkSession, sf_dir: str, folder: str, files: int = 4, idle_us: int | None = None) -> DataFrame:
    """The packets as a stream over several files in order of time, give or take two hours; one in each batch.

    With `idle_us` a last file says that this long after the newest packet there was no other.
    """
    whole = packets(spark, sf_dir)
    us = F.unix_micros("ts") + F.col("pkt_no") % 3 * HOUR_US
    span = whole.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    width = (span["hi"] - span["lo"]) // files + 1
    for i in range(files):
        mine = whole.where(F.call_function("div", us - F.lit(span["lo"]), F.lit(width)) == i)
        mine.coalesce(1).write.mode("append").parquet(f"{folder}/packets")
    if idle_us is not None:
        heartbeat(spark, span["hi"] + idle_us).coalesce(1).write.mode("append").parquet(f"{folder}/packets")
    return spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/packets")


def packet_stream_in_slices(spark: SparkSession, sf_dir: str, folder: str, files: int = 4) -> DataFrame:
    """The packets as a stream over several files, dealt out by number, so each spans all time; one in each batch."""
    whole = packets(spark, sf_dir)
    for i in range(files):
        whole.where(F.col("pkt_no") % files == i).coalesce(1).write.mode("append").parquet(f"{folder}/packets")
    return spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/packets")


def _local(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Rows as part of the plan; plain createDataFrame would start Python workers to read them."""
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule line per customer; some lines are broken in different ways."""
    k = F.col("c_custkey")
    text = F.concat(
        long_to_ip(F.lit(CLIENTS) + k),
        F.lit("/"),
        (k % 40).cast("string"),
        F.lit(","),
        long_to_ip(F.lit(SERVERS) + k * 7),
        F.lit("/"),
        (k % 33).cast("string"),
        F.lit(","),
        F.when(k % 2 == 0, "6/8").otherwise("17/9"),
        F.lit(","),
        F.when(k % 19 == 0, "70000").otherwise((k % 65536).cast("string")),
        F.lit("/"),
        (k % 18).cast("string"),
        F.lit(",2500/16;sum,"),
        F.when(k % 3 == 0, "volume").when(k % 23 == 0, "median").otherwise("packet"),
        F.lit(","),
        (k * 10).cast("string"),
        F.lit(";"),
        F.when(k % 5 == 0, "0,0,0,0,0").otherwise(F.concat((k % 35).cast("string"), F.lit(",24,8,0,16"))),
        F.when(k % 29 == 0, "").otherwise(F.concat(F.lit(";"), (k % 9 * 5 + 10).cast("string"))),
    )
    return table(spark, sf_dir, "customer").select(k.alias("line_no"), _built(text).alias("value"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet as an Ethernet frame; some have IP options, some go to the broadcast address."""
    p = packets(spark, sf_dir)

    def field(c, size):
        # A header field holds the low bytes of a number; sequence numbers go round after 32 bits.
        return F.substring(F.lpad(F.hex(c), 16, "0"), -2 * size, 2 * size)

    options = F.col("pkt_no") % 5 == 0
    tcp = F.col("proto") == 6
    ip = F.concat(
        F.when(options, "46").otherwise("45"),
        F.lit("00"),
        field(F.col("len"), 2),
        F.lit("0000000040"),
        field(F.when(F.col("pkt_no") % 11 == 0, 1).otherwise(F.col("proto")), 1),
        F.lit("0000"),
        field(F.col("srcip"), 4),
        F.when(F.col("pkt_no") % 13 == 0, "FFFFFFFF").otherwise(field(F.col("dstip"), 4)),
        F.when(options, "01010101").otherwise(""),
    )
    ports = F.concat(field(F.col("sport"), 2), field(F.col("dport"), 2))
    l4 = F.when(tcp, F.concat(field(F.col("seq"), 4), field(F.col("ack"), 4), F.lit("5010FFFF00000000"))).otherwise(
        F.concat(F.lit("0010000000000000"), field(F.col("seq"), 4))
    )
    frame = F.unhex(F.concat(F.lit("000000000001000000000002"), F.lit("0800"), ip, ports, l4))
    return p.select("host", "ts", "pkt_no", _built(frame).alias("frame"))


def controller_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A controller log with a gather every ten events; some gathers lack a host's alert."""
    e, gather = F.col("event_id"), F.call_function("div", F.col("event_id"), F.lit(10).cast("bigint"))
    step = F.col("event_id") % 10
    time = (F.lit(1_000_000_000) + F.col("event_id") * 2_600_000 + F.floor(F.col("value") * 1000)).cast("string")
    tail = F.concat(F.lit(" event "), (gather % 5).cast("string"), F.lit(" ctime "), gather.cast("string"))
    when = F.concat(F.lit(" time "), gather.cast("string"))
    host = F.concat(F.lit(" serverdata "), (F.col("event_id") % 4).cast("string"), F.lit(":"))
    body = (
        F.when(step.isin(0, 2, 3), F.concat(host, F.lit(" sat"), when, tail))
        .when(step == 4, F.concat(host, F.when(gather % 6 == 0, " add_return").otherwise(" sat"), when, tail))
        .when(step.isin(1, 5), F.concat(host, F.lit(" poll"), when, tail))
        .when(step == 6, F.concat(host, F.lit(" poll_return"), when, tail))
        .when(step == 7, F.concat(F.lit(" all_data"), tail, F.lit(" 0:8 1:9 ")))
        .when(step == 8, F.concat(F.when(gather % 2 == 0, " addevent").otherwise(" delevent"), tail))
        .otherwise(
            F.when(gather % 3 == 0, F.concat(host, F.lit(" hello")))
            .when(gather % 3 == 1, F.concat(host, F.lit(" del_return"), when, tail))
            .otherwise("no number")
        )
    )
    line = F.when((step == 9) & (gather % 3 == 2), body).otherwise(F.concat(time, F.lit(":"), body))
    return table(spark, sf_dir, "events").select(e.alias("line_no"), _built(line).alias("value"))


def host_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host's log with a line per event."""
    e = F.col("event_id")
    kind = e % 5
    step = F.concat(F.lit(" step "), (e % 1000).cast("string"), F.lit(" event "), F.col("user_id").cast("string"))
    when = F.concat(F.lit(" time "), (e * 3).cast("string"))
    body = (
        F.when(kind == 0, F.concat(F.lit(" send"), when, step))
        .when(kind == 1, F.concat(F.lit(" poll"), when, step, F.lit(" seq 7")))
        .when(kind == 2, F.concat(F.lit(" add"), step))
        .when(kind == 3, F.concat(F.lit(" del"), step))
        .otherwise(" other words")
    )
    line = F.concat((e + 100).cast("string"), F.lit(":"), body)
    return table(spark, sf_dir, "events").select(_built(line).alias("value"))


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace lines of `events`, microseconds since 2024-01-01 written as seconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    million = F.lit(1_000_000).cast("bigint")
    seconds = F.concat(
        F.call_function("div", us, million).cast("string"), F.lit("."), F.lpad((us % million).cast("string"), 6, "0")
    )
    value = F.concat_ws(
        ",",
        seconds,
        F.concat(F.when(F.col("user_id") % 10 == 9, "172.16.0.").otherwise("192.168.1."), F.col("user_id") % 4),
        (F.lit(64) + F.floor(F.col("value") * 3)).cast("string"),
        F.when(F.col("event_type").isin("click", "view", "error"), "6").otherwise("17"),
    )
    return table(spark, sf_dir, "events").select(_built(value).alias("value"))


RUN_CONFIG = {"interval": 1, "flows": 2, "rules_per_flow": 3, "offered": 4, "run": 5}


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary a run would print, one run per order."""
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    name = F.concat(
        F.lit("out/feas_"),
        F.element_at(F.array(*[F.lit(x) for x in ("20", "10", "5", "1")]), (k % 4 + 1).cast("int")),
        F.lit("_"),
        (F.lit(150) * (k % 3 + 1)).cast("string"),
        F.lit("_"),
        (F.lit(4) * (k % 2 + 1)).cast("string"),
        F.lit("_"),
        (F.lit(5_000_000) + F.lit(500_000) * (k % 20)).cast("string"),
        F.lit("_"),
        (F.col("o_custkey") % 10).cast("string"),
        F.lit("_"),
        k.cast("string"),
        F.lit(".txt"),
    )
    lines = F.array(
        F.concat(F.lit("Summary1 pkts:"), cents.cast("string"), F.lit(", cycles:"), (cents * 23).cast("string"),
                 F.lit(", rate:"), (k % 97).cast("string"), F.lit(".500000, loss:"), (k % 8).cast("string"), F.lit(".250000")),
        F.concat(F.lit("Summary2 perpkttick:1.500000, readq:3, pktperq:2.000000, ticks:77 zerots:"),
                 (cents * 2).cast("string"), F.lit(".000000  flownum:12")),
        F.concat(F.lit("Summary3 notfinished "), (cents % 3).cast("string"),
                 F.lit(" loss 0.000000, steps 10, avgmstepnum 2.000000, mstepticks "), (k % 1000).cast("string"), F.lit(".750000")),
        F.concat(F.lit("|   RX Packets       : "), cents.cast("string"), F.lit("/"), (k % 50).cast("string"), F.lit(" (99 bytes)")),
        F.lit("|      RX Packet Loss: 0.25 "),
        F.concat(F.lit("match delay "), (k % 400).cast("string"), F.lit(".125000 ns")),
        F.concat(F.lit("Avg match cycles "), (k % 500).cast("string"), F.lit(".000000")),
        F.lit("-----------------------------------------------------------"),
    )
    return table(spark, sf_dir, "orders").select(name.alias("file"), F.explode(lines).alias("value"))
