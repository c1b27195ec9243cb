"""Statistics per flow, session and epoch. A flow is (host, 5-tuple); state never crosses hosts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import epoch_of_us, micros
from ..plans.ordered import PIECE, before, floored_sum, is_split, islands, previous, relabel, split_hot
from ..plans.sizing import checkpointed
from ..schema import FLOW, ORDER

ACK_CREDIT = 1460  # fixed value: bytes credited per duplicate ack
BURST_GAP_US = 2  # about 5000 ticks of a 2.3 GHz clock
BURST_MIN = 4  # fixed value: a burst has more packets than this
SEEN_GENERATION = (1 << 18) + 1  # fixed value: packets per generation
SEEN_BITS = 20  # fixed value: bits of the folded sequence number
LIST_BLOCK = 32  # fixed value: entries per list block
_LOST_BLOCK = 4096

SESSION = [*FLOW, "session"]


def timed(packets: DataFrame) -> DataFrame:
    return packets if "us" in packets.columns else packets.withColumn("us", micros("ts"))


def ordered(packets: DataFrame, keys: Iterable[str] = FLOW) -> DataFrame:
    """Packets with their microsecond time and the pieces of very large keys."""
    return split_hot(timed(packets), list(keys))


def with_epoch(packets: DataFrame, epoch_us: int) -> DataFrame:
    return timed(packets).withColumn("epoch", epoch_of_us("us", epoch_us))


def flow_epochs(packets: DataFrame, epoch_us: int, stats: Iterable[str] = ("n", "bytes")) -> DataFrame:
    """Packet and byte counts per flow and epoch; only the statistics asked for are computed."""
    if "lost" in stats and "lost" not in packets.columns:
        packets = retransmissions(packets, epoch_us)
    aggs = {
        "n": F.count(F.lit(1)),
        "bytes": F.sum("len").cast("bigint"),
        "lost": F.sum(F.col("lost").cast("bigint")) if "lost" in packets.columns else None,
    }
    keys = SESSION if "session" in packets.columns else FLOW
    return with_epoch(packets, epoch_us).groupBy(*keys, "epoch").agg(*[aggs[s].alias(s) for s in stats])


def sessions(packets: DataFrame, epoch_us: int, keys: Iterable[str] = FLOW) -> DataFrame:
    """Packets + epoch + session; a session ends with a whole idle epoch and is named by its first epoch."""
    packets = with_epoch(ordered(packets, keys), epoch_us)
    return islands(packets, list(keys), ORDER, "epoch", 2, "session")


def session_epochs(packets: DataFrame, epoch_us: int) -> DataFrame:
    """flow_epochs with the session of each flow and epoch."""
    return flow_epochs(sessions(packets, epoch_us), epoch_us)


def new_flows(packets: DataFrame, epoch_us: int) -> DataFrame:
    """Flows that start in an epoch."""
    starts = sessions(packets, epoch_us).select(*SESSION).distinct()
    return starts.groupBy(F.col("session").alias("epoch")).agg(F.count(F.lit(1)).alias("n"))


def retransmissions(packets: DataFrame, epoch_us: int) -> DataFrame:
    """Packets + lost: the sequence number does not exceed the highest one seen in the session."""
    packets = packets if "session" in packets.columns else sessions(packets, epoch_us)
    top = before(packets, SESSION, ORDER, F.col("seq"), "max", "_top")
    lost = F.col("seq") <= F.greatest(F.coalesce("_top", F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    return top.withColumn("lost", lost).drop("_top")


def retransmitted_seqs(packets: DataFrame, epoch_us: int) -> DataFrame:
    """One row per retransmitted sequence number."""
    lost = retransmissions(packets, epoch_us).where("lost")
    return lost.select(*SESSION, "epoch", *ORDER, "seq", PIECE)


def retransmitted_blocks(packets: DataFrame, epoch_us: int) -> DataFrame:
    """Retransmitted sequence numbers per flow and epoch, in blocks of bounded length."""
    lost = retransmitted_seqs(packets, epoch_us)
    entry = [*SESSION, "epoch"]
    numbered = before(lost, entry, ORDER, F.lit(1).cast("bigint"), "sum", "_n")
    block = F.call_function("div", F.coalesce("_n", F.lit(0).cast("bigint")), F.lit(LIST_BLOCK).cast("bigint"))
    listed = F.sort_array(F.collect_list(F.struct(*ORDER, "seq")))
    return (
        numbered.withColumn("block", block)
        .groupBy(*entry, "block")
        .agg(F.transform(listed, lambda x: x["seq"]).alias("seqs"))
    )


def recently_seen(
    packets: DataFrame,
    gen_len: int = SEEN_GENERATION,
    bits: int = SEEN_BITS,
    exact: bool = False,
) -> DataFrame:
    """Packets + seen: the folded sequence number occurred in this generation or the one before.

    Generations count the packets of a host; the packet before in the same cell tells the rest.
    """
    out_columns = [c for c in packets.columns if c not in (PIECE, "us")]
    low = F.col("seq").bitwiseAND(F.lit(0xFFFFFFFF))
    folded = low.bitwiseXOR(F.shiftright(low, 16)).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    celled = timed(packets).withColumn("_cell", F.col("seq") if exact else folded)
    # Both cuts are found on the packets as read, before anything is computed from them.
    cell = ["host", "_cell"]
    by_cell = split_hot(celled, cell)
    by_host = split_hot(by_cell.withColumnRenamed(PIECE, "_cell_piece"), ["host"])
    count = before(by_host, ["host"], ORDER, F.lit(1).cast("bigint"), "sum", "_n")
    gen = F.call_function("div", F.coalesce("_n", F.lit(0).cast("bigint")), F.lit(gen_len).cast("bigint"))
    numbered = count.withColumn("_gen", gen).drop(PIECE).withColumnRenamed("_cell_piece", PIECE)
    last = previous(relabel(numbered, by_cell), cell, ORDER, "_gen", "_last")
    seen = F.coalesce(F.col("_last") >= F.col("_gen") - 1, F.lit(False))
    return last.select(*out_columns, seen.alias("seen"))


def seq_state(packets: DataFrame, epoch_us: int) -> DataFrame:
    """Highest sequence number at the end of each epoch (v1) and of the epoch before (v2)."""
    return _state(packets, epoch_us, with_ack=False)


def ack_state(packets: DataFrame, epoch_us: int) -> DataFrame:
    """Last ack at the end of each epoch (v1) and of the epoch before (v2), and the dup-ack credit."""
    return _state(packets, epoch_us, with_seq=False)


def dup_credit(packets: DataFrame, epoch_us: int) -> DataFrame:
    """Packets + dup: repeated acks add credit, an advancing ack uses it up; never below zero."""
    packets = packets if "session" in packets.columns else sessions(packets, epoch_us)
    zero = F.lit(0).cast("bigint")
    with_last = previous(packets, SESSION, ORDER, "ack", "_last")
    advance = F.pmod(F.col("ack") - F.coalesce("_last", zero), F.lit(1 << 32).cast("bigint"))
    step = F.when(advance == 0, F.lit(ACK_CREDIT).cast("bigint")).otherwise(-advance)
    stepped = relabel(with_last.withColumn("_step", step).drop("_last"), packets)
    return floored_sum(stepped, SESSION, ORDER, "_step", "dup").drop("_step")


def flow_state(packets: DataFrame, epoch_us: int) -> DataFrame:
    """seq_state and ack_state in one pass."""
    return _state(packets, epoch_us)


def _state(packets: DataFrame, epoch_us: int, with_seq: bool = True, with_ack: bool = True) -> DataFrame:
    packets = packets if "session" in packets.columns else sessions(packets, epoch_us)
    source = dup_credit(packets, epoch_us) if with_ack else packets
    aggs = [F.min(PIECE).alias(PIECE)]
    if with_seq:
        aggs.append(F.max("seq").alias("_seq"))
    if with_ack:
        aggs.append(F.max(F.struct(*ORDER, "ack", "dup")).alias("_ack"))
    return _epoch_state(source.groupBy(*SESSION, "epoch").agg(*aggs), packets, with_seq, with_ack)


def _epoch_state(out: DataFrame, packets: DataFrame, with_seq: bool, with_ack: bool) -> DataFrame:
    """Values at the end of each epoch and of the one before, from a row per session and epoch with `_seq` and `_ack`.

    A session has no idle epoch inside, so "the epoch before" is the row before.
    """
    columns = [c for c in out.columns if c not in (PIECE, "_seq", "_ack")]
    if is_split(packets):
        # The steps below each look at all epochs again; a row per epoch is small to keep.
        out = checkpointed(out)
    out = relabel(out, packets)
    zero = F.lit(0).cast("bigint")
    if with_seq:
        out = before(out, SESSION, ["epoch"], F.col("_seq"), "max", "_v2")
        out = out.withColumns(
            {
                "seq_v2": F.greatest(F.coalesce("_v2", zero), zero),
                "seq_v1": F.greatest(F.coalesce("_v2", zero), zero, F.col("_seq")),
            }
        )
        columns += ["seq_v1", "seq_v2"]
    if with_ack:
        out = out.withColumns({"ack_v1": F.col("_ack.ack"), "dup_v1": F.col("_ack.dup")})
        out = previous(relabel(out, packets), SESSION, ["epoch"], "ack_v1", "_a2")
        out = out.withColumn("ack_v2", F.coalesce("_a2", zero))
        columns += ["ack_v1", "ack_v2", "dup_v1"]
    return out.select(*columns)


def flow_table(
    packets: DataFrame, epoch_us: int, stats: Iterable[str], gap_us: int = BURST_GAP_US, min_n: int = BURST_MIN
) -> DataFrame:
    """A row per flow and epoch with `stats` among n, bytes, lost, unacked and burst_lost, from one pass over the packets.

    The last two are null where there is nothing to tell: no opposite direction, no lost number in a burst. Packets are
    sorted by flow once; what is looked at again is a row per flow, epoch and burst, saved.
    """
    stats = set(stats)
    rows = sessions(packets, epoch_us)
    if stats & {"lost", "burst_lost"}:
        rows = retransmissions(rows, epoch_us)
    if "unacked" in stats:
        rows = dup_credit(rows, epoch_us)
    keys = [*SESSION, "epoch"]
    aggs = [F.min(PIECE).alias(PIECE), F.count(F.lit(1)).alias("n"), F.sum("len").cast("bigint").alias("bytes"), F.max("seq").alias("_seq")]
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("n", "bytes")]
    if stats & {"lost", "burst_lost"}:
        aggs.append(F.count_if("lost").alias("lost"))
        sums.append(F.sum("lost").alias("lost"))
    if "unacked" in stats:
        aggs.append(F.max(F.struct(*ORDER, "ack", "dup")).alias("_ack"))
        sums.append(F.max("_ack").alias("_ack"))
    if "burst_lost" not in stats:
        flows = rows.groupBy(*keys).agg(*aggs)
    else:
        rows = islands(rows, FLOW, ORDER, "us", gap_us, "burst")
        rows = before(rows, SESSION, ORDER, F.col("lost").cast("bigint"), "sum", "_k")
        # lists of lost numbers come in blocks of bounded length
        block = F.call_function("div", F.coalesce("_k", F.lit(0).cast("bigint")), F.lit(_LOST_BLOCK).cast("bigint"))
        aggs += [F.min("seq").alias("_least"), F.collect_list(F.when(F.col("lost"), F.col("seq"))).alias("_lost")]
        parts = checkpointed(rows.withColumn("_block", block).groupBy(*keys, "burst", "_block").agg(*aggs))
        found = parts.groupBy(*FLOW, "burst").agg(F.min("_least").alias("seq1"), F.max("_seq").alias("seq2"), F.sum("n").alias("n"))
        lost = parts.select(*FLOW, "epoch", F.explode("_lost").alias("seq"))
        hits = in_burst(lost, found.where(F.col("n") > min_n), may_be_hot=is_split(rows)).where("hit")
        hits = hits.groupBy(*FLOW, "epoch").agg(F.count(F.lit(1)).alias("burst_lost"))
        flows = parts.groupBy(*keys).agg(F.min(PIECE).alias(PIECE), F.max("_seq").alias("_seq"), *sums)
    if "unacked" in stats:
        flows = with_reverse(_epoch_state(flows, rows, True, True), outer=True)
        flows = flows.withColumn("unacked", unacknowledged())
    if "burst_lost" in stats:
        flows = flows.join(hits, [*FLOW, "epoch"], "left")
    return flows.select(*FLOW, "epoch", *sorted(stats))


def unacknowledged() -> Column:
    """Share of the bytes in flight at the last epoch's end that this epoch did not acknowledge, in percent; null without
    an opposite direction."""
    in_air = F.col("seq_v2") - F.col("r_ack_v2")
    acked = F.col("r_ack_v1") - F.col("r_ack_v2") + F.col("r_dup_v1")
    share = 100 - F.call_function("div", 100 * acked, in_air)
    return F.when((in_air <= 0) | (acked > in_air), F.lit(0).cast("bigint")).otherwise(share)


def with_reverse(state: DataFrame, outer: bool = False) -> DataFrame:
    """Flow epochs with the opposite direction in the same epoch; its columns get `r_`. Flow epochs without one are left
    out, or have nulls with `outer`.

    Both directions meet under one name of the pair of endpoints, so `state` is computed once.
    """
    values = [c for c in state.columns if c not in (*FLOW, "epoch")]
    ends = [F.struct(F.col(f"{a}ip").alias("ip"), F.col(f"{a[0]}port").alias("port")) for a in ("src", "dst")]
    forward = ends[0] <= ends[1]
    own = F.struct(*values)
    pairs = state.groupBy(
        "host", F.least(*ends).alias("_low"), F.greatest(*ends).alias("_high"), "proto", "epoch"
    ).agg(F.any_value(F.when(forward, own), True).alias("_there"), F.any_value(F.when(~forward, own), True).alias("_back"))
    itself = F.col("_low") == F.col("_high")
    pairs = pairs.withColumn("_back", F.when(itself, F.col("_there")).otherwise(F.col("_back")))

    def direction(start: str, end: str, mine: str, other: str):
        fields = [F.col(f"{start}.ip").alias("srcip"), F.col(f"{end}.ip").alias("dstip")]
        fields += [F.col(f"{start}.port").alias("sport"), F.col(f"{end}.port").alias("dport")]
        return F.struct(*fields, F.col(mine).alias("mine"), F.col(other).alias("other"))

    there, back = direction("_low", "_high", "_there", "_back"), direction("_high", "_low", "_back", "_there")
    if not outer:
        pairs = pairs.where(F.col("_there").isNotNull() & F.col("_back").isNotNull())
    both = pairs.select(
        "host", "proto", "epoch", F.explode(F.when(itself, F.array(there)).otherwise(F.array(there, back))).alias("_d")
    ).where("_d.mine is not null")
    key = [F.col(c) if c in ("host", "proto") else F.col(f"_d.{c}").alias(c) for c in FLOW]
    columns = {c: F.col(f"_d.mine.{c}").alias(c) for c in values}
    return both.select(
        *[columns[c] if c in columns else next(k for k, f in zip(key, FLOW) if f == c) if c in FLOW else F.col(c) for c in state.columns],
        *[F.col(f"_d.other.{c}").alias(f"r_{c}") for c in values],
    )


def bursts(packets: DataFrame, gap_us: int = BURST_GAP_US, min_n: int = BURST_MIN) -> DataFrame:
    """Runs of more than `min_n` packets with gaps under `gap_us`; named by their first time."""
    runs = islands(ordered(packets), FLOW, ORDER, "us", gap_us, "burst")
    return (
        runs.groupBy(*FLOW, "burst")
        .agg(
            F.min("seq").alias("seq1"),
            F.max("seq").alias("seq2"),
            F.count(F.lit(1)).alias("n"),
            F.min("us").alias("t0"),
            F.max("us").alias("t1"),
        )
        .where(F.col("n") > min_n)
    )


def in_burst(seqs: DataFrame, found: DataFrame, may_be_hot: bool = True) -> DataFrame:
    """seqs + hit: the sequence number lies within some burst of its flow.

    Sorting bursts and numbers together, a number is inside when the highest burst end among the
    bursts that start at or before it reaches it. No pair of number and burst is formed.
    """
    columns = [c for c in seqs.columns if c != PIECE]
    marks = found.select(*FLOW, F.col("seq1").alias("_at"), F.lit(0).alias("_kind"), F.col("seq2").alias("_end"))
    # A number is asked once, however many packets of its flow carry it.
    numbers = seqs.select(*FLOW, "seq").distinct()
    asked = numbers.select(*FLOW, F.col("seq").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_end"))
    both = marks.unionByName(asked)
    if may_be_hot:
        both = split_hot(both, FLOW, at="_at")
    else:
        both = both.withColumn(PIECE, F.lit(None).cast("bigint"))
    reach = before(both, FLOW, ["_at", "_kind"], F.col("_end"), "max", "_reach").where(F.col("_kind") == 1)
    hits = reach.select(*FLOW, F.col("_at").alias("seq"), F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False)).alias("hit"))
    return seqs.select(*columns).join(hits, [*FLOW, "seq"]).select(*columns, "hit")


def seq_gaps(packets: DataFrame) -> DataFrame:
    """Packet numbers missing between consecutive arrivals of a host."""
    seen = previous(ordered(packets, ["host"]), ["host"], ORDER, "pkt_no", "_before")
    gap = F.col("pkt_no") - F.col("_before") - 1
    return seen.groupBy("host").agg(F.coalesce(F.sum(gap), F.lit(0)).cast("bigint").alias("missing"))


def time_histogram(packets: DataFrame, m: int, bin_us: int = 1) -> DataFrame:
    """At most `m` buckets of bytes over time per flow.

    While a flow has more than `m` buckets, the adjacent pair with the least bytes becomes one, the
    earlier of equal ones. Bytes are first summed in bins of `bin_us` microseconds, so a flow's answer
    depends on its own packets alone. A task goes through its flows' bins in order and holds at most
    m + 1 buckets, however long a flow is.
    """
    if m < 1 or bin_us < 1:
        raise ValueError("at least one bucket and one microsecond")
    bins = (
        timed(packets)
        .where(F.col("len") > 0)
        .withColumn("bin", epoch_of_us("us", bin_us))
        .groupBy(*FLOW, "bin")
        .agg(F.max("us").alias("ts_end"), F.sum("len").cast("bigint").alias("bytes"))
    )
    columns = [*FLOW, "bin", "ts_end", "bytes"]

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flow, ends, sizes, pairs = None, [], [], []  # pairs: bytes of adjacent buckets together
        names = [*FLOW, "bucket", "ts_end", "bytes"]

        def finished() -> list[tuple]:
            return [(*flow, i, end, size) for i, (end, size) in enumerate(zip(ends, sizes))]

        for batch in batches:
            done = []
            flows = zip(*(batch[c].tolist() for c in FLOW))
            for own, end, size in zip(flows, batch["ts_end"].tolist(), batch["bytes"].tolist()):
                if own != flow:
                    done += finished()
                    flow, ends, sizes, pairs = own, [end], [size], []
                    continue
                pairs.append(sizes[-1] + size)
                ends.append(end)
                sizes.append(size)
                if len(sizes) > m:
                    i = pairs.index(min(pairs))
                    both = pairs.pop(i)
                    sizes[i : i + 2] = [both]
                    del ends[i]
                    if i:
                        pairs[i - 1] = sizes[i - 1] + both
                    if i < len(pairs):
                        pairs[i] = both + sizes[i + 1]
            if done:
                yield pd.DataFrame(done, columns=names)
        if flow is not None:
            yield pd.DataFrame(finished(), columns=names)

    sorted_ = bins.select(*columns).repartition(*FLOW).sortWithinPartitions(*FLOW, "bin")
    fields = ", ".join(f"{c} bigint" for c in FLOW)
    return sorted_.mapInPandas(shrink, f"{fields}, bucket bigint, ts_end bigint, bytes bigint")
