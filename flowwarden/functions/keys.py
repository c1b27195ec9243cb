"""Scalar functions over addresses, prefixes and flow keys. All stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KEY, WIDTH


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ip_to_long(ip: Column | str) -> Column:
    """Dotted IPv4 text to its integer; null when the text is not an address."""
    ip = _col(ip)
    octets = [F.get(F.split(ip, r"\."), i).try_cast("bigint") for i in range(4)]
    value = octets[0]
    in_range = octets[0] <= 255
    for octet in octets[1:]:
        value = value * 256 + octet
        in_range = in_range & (octet <= 255)
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & in_range, value)


def long_to_ip(ip: Column | str) -> Column:
    ip = _col(ip)
    octets = [F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def mask_sql(length: str, bits: int) -> str:
    """SQL text of the mask with the top `length` of `bits` bits set, for lengths up to `bits`."""
    full = (1 << bits) - 1
    return f"(shiftleft({full}L, {bits} - {length}) & {full}L)"


def prefix_mask(length: Column | str, bits: int) -> Column:
    """Mask with the top `length` of `bits` bits set; lengths beyond the width are clamped."""
    full = F.lit((1 << bits) - 1).cast("bigint")
    clamped = F.least(_col(length).cast("int"), F.lit(bits))
    # A bigint shift leaves bits above the field; the AND drops them, and length 0 becomes 0.
    return F.call_function("shiftleft", full, F.lit(bits) - clamped).bitwiseAND(full)


def mask_flow(lens: Mapping[str, Column], flow: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """The five key fields masked to the given prefix lengths."""
    flow = flow or {c: F.col(c) for c in KEY}
    return {c: flow[c].bitwiseAND(prefix_mask(lens[c], WIDTH[c])) for c in KEY}


def pack_granularity(*lens: Column | str) -> Column:
    """Five lengths of six bits each in one integer, first length highest."""
    packed = F.lit(0).cast("bigint")
    for i, length in enumerate(lens):
        packed = packed.bitwiseOR(F.shiftleft(_col(length).cast("bigint"), 6 * (4 - i)))
    return packed


def unpack_granularity(packed: Column | str) -> list[Column]:
    packed = _col(packed)
    return [
        F.shiftright(packed, 6 * (4 - i)).bitwiseAND(F.lit(63)).cast("int").alias(f"fg_{c}")
        for i, c in enumerate(KEY)
    ]


def reverse_flow(prefix: str = "") -> list[Column]:
    """Key columns of the opposite direction."""
    swap = {"srcip": "dstip", "dstip": "srcip", "sport": "dport", "dport": "sport", "proto": "proto"}
    return [F.col(swap[c]).alias(prefix + c) for c in KEY]


def flow_hash() -> Column:
    return F.xxhash64(*KEY)


def flow_bucket(buckets: int) -> Column:
    """Which of `buckets` counters a flow shares: the key's fields as digits of one number, modulo their count."""
    number = F.lit(0).cast("bigint")
    for c in KEY:
        number = number * 31 + F.col(c)
    return F.pmod(number, F.lit(buckets).cast("bigint"))


def rule_matches(flow: str = "f", rule: str = "r") -> Column:
    """Whether the flow of alias `flow` falls in the filter of alias `rule`."""
    cond = F.lit(True)
    for c in KEY:
        mask = prefix_mask(F.col(f"{rule}.len_{c}"), WIDTH[c])
        cond = cond & (F.col(f"{flow}.{c}").bitwiseAND(mask) == F.col(f"{rule}.{c}"))
    return cond


def micros(ts: Column | str) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def epoch_of(ts: Column | str, epoch_us: int) -> Column:
    return epoch_of_us(micros(ts), epoch_us)


def epoch_of_us(us: Column | str, epoch_us: int) -> Column:
    return F.call_function("div", _col(us), F.lit(epoch_us).cast("bigint"))


def size_units(length: Column | str) -> Column:
    """Length in 64-byte units, rounded up."""
    return F.call_function("div", _col(length).cast("bigint") + 63, F.lit(64).cast("bigint"))
