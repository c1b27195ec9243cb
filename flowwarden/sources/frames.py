"""Ethernet frames to packets, decoded with binary built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header fields by byte, counted from 1 as `substring` does.
ETHERTYPE, IPV4 = (13, 2), b"\x08\x00"
PROTOCOL, TCP, UDP = (24, 1), b"\x06", b"\x11"
DESTINATION, BROADCAST = (31, 4), b"\xff\xff\xff\xff"
IP_START, IP_FIXED = 15, 20


def _bytes(place: tuple[int, int]) -> Column:
    return F.substring("frame", *place)


def _uint(text: str, byte: int, size: int) -> Column:
    """Unsigned integer at `byte` (from 0) of a hex column; null when the text ends before."""
    digits = F.substring(text, 2 * byte + 1, 2 * size)
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).cast("bigint"))


def decode_frames(frames: DataFrame) -> DataFrame:
    """host, ts, frame (+ any other columns) to packet columns + `_corrupt`.

    Frames that are not TCP or UDP over IPv4, or go to the broadcast address, are dropped. A
    frame too short for its headers is kept with `_corrupt` set. IP options are skipped by the
    header length.
    """
    kept = frames.where(
        (_bytes(ETHERTYPE) == F.lit(IPV4))
        & _bytes(PROTOCOL).isin(F.lit(TCP), F.lit(UDP))
        & (_bytes(DESTINATION) != F.lit(BROADCAST))
    )
    others = [c for c in frames.columns if c != "frame"]
    # Low digit of the first IP byte: header length in words; below five it is not a header.
    words = F.conv(F.substring(F.hex(_bytes((IP_START, 1))), 2, 1), 16, 10).cast("int")
    l4 = F.when(words >= 5, F.lit(IP_START) + words * 4)
    parts = F.struct(
        F.hex(_bytes((IP_START, IP_FIXED))).alias("ip"),
        F.hex(F.substring(F.col("frame"), l4, F.lit(16))).alias("l4"),
        (_bytes(PROTOCOL) == F.lit(TCP)).alias("tcp"),
    )
    # Exploding a one-element array cuts each header out once, not once per field.
    cut = kept.select(*others, F.inline(F.array(parts)))
    zero = F.lit(0).cast("bigint")
    fields = {
        "srcip": _uint("ip", 12, 4),
        "dstip": _uint("ip", 16, 4),
        "sport": _uint("l4", 0, 2),
        "dport": _uint("l4", 2, 2),
        "proto": _uint("ip", 9, 1),
        "len": _uint("ip", 2, 2),
        "seq": F.when(F.col("tcp"), _uint("l4", 4, 4)).otherwise(F.coalesce(_uint("l4", 12, 4), zero)),
        "ack": F.when(F.col("tcp"), _uint("l4", 8, 4)).otherwise(zero),
    }
    # Each header is whole when its last fixed field is there.
    whole = (F.length("ip") == 2 * IP_FIXED) & (F.length("l4") >= F.when(F.col("tcp"), 24).otherwise(8))
    return cut.select(
        *others, *[v.alias(c) for c, v in fields.items()], (~F.coalesce(whole, F.lit(False))).alias("_corrupt")
    )
