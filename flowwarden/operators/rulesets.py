"""Generated rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import prefix_mask
from ..schema import KEY, RULES, WIDTH

# Addresses, ports and thresholds of the load and use-case rule sets.
LOAD_DST, LOAD_SRC = "10.0.4.0", "10.0.5.4"
LOAD_SPORT, LOAD_DPORT = 58513, 2500
LOAD_RANGE_BITS = 16
LOAD_THRESHOLD = 80_000_000
PARTITION_THRESHOLD = 8
CONGESTION_THRESHOLD = 100
UDP_PORT, UDP_THRESHOLD = 2501, 10_000
TCP, UDP = 6, 17


def _ip(text: str) -> int:
    value = 0
    for part in text.split("."):
        value = value * 256 + int(part)
    return value


def _rules(df: DataFrame, fields: dict[str, Column], lens: dict[str, Column], **rest: Column) -> DataFrame:
    """Complete a rule frame: masked filter, no grouping, always valid, unless `rest` says otherwise."""
    zero = F.lit(0)
    columns = {c: fields.get(c, zero).cast("bigint") for c in KEY}
    columns |= {f"len_{c}": lens.get(c, zero).cast("int") for c in KEY}
    columns |= {f"fg_{c}": rest.get(f"fg_{c}", zero).cast("int") for c in KEY}
    for name in ("agg", "threshold", "interval_ms", "valid_from", "valid_to"):
        columns[name] = rest.get(name, F.lit(None)).cast(RULES[name].dataType)
    out = df.select("rule_id", *[v.alias(k) for k, v in columns.items()])
    return out.withColumns({c: F.col(c).bitwiseAND(prefix_mask(F.col(f"len_{c}"), WIDTH[c])) for c in KEY})


def _power_of_two(n: int) -> int:
    if n < 1 or n & (n - 1):
        raise ValueError(f"{n} is not a power of two")
    return n.bit_length() - 1


def partition_rules(
    spark: SparkSession,
    n: int,
    base: str = LOAD_DST,
    sport: int | None = LOAD_SPORT,
    dport: int | None = LOAD_DPORT,
    interval_ms: int = 10,
    threshold: int = PARTITION_THRESHOLD,
) -> DataFrame:
    """Cut the /16 of `base` into n equal prefixes of destinations and count packets in each."""
    bits = _power_of_two(n)
    ids = spark.range(n).select(F.col("id").alias("rule_id"))
    dst = F.lit(_ip(base)).cast("bigint") + F.shiftleft(F.col("rule_id"), LOAD_RANGE_BITS - bits)
    return _rules(
        ids,
        {"dstip": dst, "sport": F.lit(sport or 0), "dport": F.lit(dport or 0)},
        {
            "dstip": F.lit(32 - LOAD_RANGE_BITS + bits),
            "sport": F.lit(0 if sport is None else 16),
            "dport": F.lit(0 if dport is None else 16),
        },
        agg=F.lit("packet"),
        threshold=F.lit(threshold),
        interval_ms=F.lit(interval_ms),
    )


def congestion_rules(
    spark: SparkSession,
    server: str,
    port: int = LOAD_DPORT,
    peer_port: int | None = None,
    interval_ms: int = 10,
    first_id: int = 0,
) -> DataFrame:
    """Congestion toward a server and from it."""
    ids = spark.range(2).select((F.col("id") + first_id).alias("rule_id"), (F.col("id") == 0).alias("to"))
    address = F.lit(_ip(server)).cast("bigint")
    to = F.col("to")
    return _rules(
        ids,
        {
            "srcip": F.when(to, 0).otherwise(address),
            "dstip": F.when(to, address).otherwise(0),
            "sport": F.when(to, 0).otherwise(port),
            "dport": F.when(to, port).otherwise(0),
            "proto": F.lit(TCP),
        },
        {
            "srcip": F.when(to, 0).otherwise(32),
            "dstip": F.when(to, 32).otherwise(0),
            "sport": F.when(to, 0).otherwise(16),
            "dport": F.when(to, 16).otherwise(0),
            "proto": F.lit(8),
        },
        agg=F.lit("congestion"),
        threshold=F.lit(CONGESTION_THRESHOLD),
        interval_ms=F.lit(interval_ms),
    )


def udp_rule(
    spark: SparkSession, server: str, rule_id: int = 2, port: int = UDP_PORT, threshold: int = UDP_THRESHOLD,
    interval_ms: int = 10,
) -> DataFrame:
    """Volume of UDP toward a server: the rule that congestion switches on."""
    return _rules(
        spark.range(rule_id, rule_id + 1).select(F.col("id").alias("rule_id")),
        {"dstip": F.lit(_ip(server)).cast("bigint"), "dport": F.lit(port), "proto": F.lit(UDP)},
        {"dstip": F.lit(32), "dport": F.lit(16), "proto": F.lit(8)},
        agg=F.lit("volume"),
        threshold=F.lit(threshold),
        interval_ms=F.lit(interval_ms),
    )


def load_rules(
    spark: SparkSession,
    n: int,
    per_flow: int = 8,
    patterns: int = 32,
    kind: str = "spread",
    dst: str = LOAD_DST,
    src: str = LOAD_SRC,
    sport: int = LOAD_SPORT,
    dport: int = LOAD_DPORT,
    aggs: tuple[str, ...] = ("packet",),
    interval_ms: int = 10,
    threshold: int = LOAD_THRESHOLD,
) -> DataFrame:
    """n rules for load tests, `per_flow` on each of n / per_flow destination prefixes.

    Mask shapes cycle through `patterns`: each step drops one bit from the ports (destination
    port first), and every 32 steps the source prefix grows by one.
    spread: as above. none: a source that never occurs. all: only the ports are masked, every
    rule on any destination. equal: the rules of a prefix are identical.
    """
    unique = n // per_flow
    host_bits = _power_of_two((1 << LOAD_RANGE_BITS) // unique) if kind != "all" else 32
    i = F.col("rule_id")
    group = F.call_function("div", i, F.lit(per_flow).cast("bigint"))
    pattern = F.pmod(group if kind == "equal" else i, F.lit(patterns))
    drop = F.pmod(pattern, F.lit(32))
    src_len = F.call_function("div", pattern, F.lit(32).cast("bigint"))
    if kind == "none":
        src_len = F.lit(32)
    number = F.pmod(i, F.lit(len(aggs))).cast("int") + 1
    return _rules(
        spark.range(n).select(F.col("id").alias("rule_id")),
        {
            "srcip": F.lit(0 if kind == "none" else _ip(src)).cast("bigint"),
            "dstip": F.lit(_ip(dst)).cast("bigint") + (F.lit(0) if kind == "all" else F.shiftleft(group, host_bits)),
            "sport": F.lit(sport),
            "dport": F.lit(dport),
        },
        {
            "srcip": src_len,
            "dstip": F.lit(32 - host_bits),
            "sport": F.least(F.lit(16), F.lit(32) - drop),
            "dport": F.greatest(F.lit(0), F.lit(16) - drop),
        },
        agg=F.element_at(F.array(*[F.lit(a) for a in aggs]), number),
        threshold=F.lit(threshold),
        interval_ms=F.lit(interval_ms),
    )
