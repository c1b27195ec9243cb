"""State kept in order while packets come in any order: flows, pairs of flows, and rules with their past values.

An epoch's packets are collected per flow by an event-time window, which hands them on, in order, once the watermark has
passed the epoch. So what follows sees whole epochs, one after the other, however the packets were sliced into batches and
whatever their order was within the watermark. A flow's state is a handful of numbers, dropped after an idle epoch.

Calls of keyed state are dear, so keys are dealt into buckets: a batch reads and writes the state of a bucket's keys once.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.keys import epoch_of_us, micros
from ..operators.admission import UNIT
from ..operators.evaluate import HISTORY, VALUE, epochs_per_window, keyed_values
from ..operators.flowstats import ACK_CREDIT, BURST_GAP_US, BURST_MIN
from ..schema import FLOW, GROUP

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 512  # of keys; a stream keeps the number it was started with
CHUNK = 10_000  # rows handed on at once
_LISTS = ["us", "pkt_no", "len", "seq", "ack"]
_PAIR = ["host", "low_ip", "low_port", "high_ip", "high_port", "proto"]
_FLOW_TYPES = ", ".join(f"{c} bigint" for c in FLOW)
PACKET_OUT = ["pkt_no", "session", "lost", "dup", "admitted"]
EPOCH_OUT = ["session", "n", "bytes", "lost", "burst_lost", "unacked", "seq_v1", "seq_v2", "ack_v1", "ack_v2", "dup_v1"]


def bucket_of(columns: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int").alias("bucket")


def closed_epochs(packets: DataFrame, epoch_us: int, watermark: str) -> DataFrame:
    """The packets of each flow and epoch once the epoch is closed."""
    fields = [micros("ts").alias("us"), *[F.col(c).alias(c) for c in _LISTS[1:]]]
    listed = (
        packets.withWatermark("ts", watermark)
        .groupBy(F.window("ts", f"{epoch_us} microseconds"), *FLOW)
        .agg(F.collect_list(F.struct(*fields)).alias("_p"))
    )
    epoch = epoch_of_us(F.unix_micros("window.start"), epoch_us)
    out = listed.select(F.window_time("window").alias("closed"), *FLOW, epoch.alias("epoch"), F.inline("_p"))
    return out.where("pkt_no is not null")  # a heartbeat counts for the watermark only


def advance(batch: Mapping, before: Sequence | None, epoch_us: int, needed: int) -> tuple[dict[str, list], tuple]:
    """Statistics of a flow's packets in order, continued from the state `before`."""
    last, session, top, ack, dup, units = before[:6] if before else (None, 0, 0, 0, 0, 0)
    out: dict[str, list] = {c: [] for c in ("session", "lost", "dup", "admitted", "epoch")}
    sessions, losts, dups, admitted, epochs = out.values()
    for us, seq, acked, size in zip(*(batch[c] for c in ("us", "seq", "ack", "len"))):
        epoch = us // epoch_us
        if last is None or epoch - last >= 2:
            session, top, ack, dup, units = epoch, 0, 0, 0, 0
        moved = (acked - ack) % (1 << 32)
        dup = max(dup - moved, 0) if moved else dup + ACK_CREDIT
        sessions.append(session)
        losts.append(seq <= top)
        dups.append(dup)
        admitted.append(units >= needed)
        epochs.append(epoch)
        last, top, ack, units = epoch, max(top, seq), acked, units + (size + UNIT - 1) // UNIT
    return out | {"pkt_no": batch["pkt_no"]}, (last, session, top, ack, dup, units)


def known_bursts(us: Iterable[int], seq: Iterable[int], before: dict, gap_us: int, min_n: int) -> dict:
    """The bursts of a session after more of its packets: `done`, as disjoint ranges of numbers, and the open run."""
    done, run = before["done"], before["run"]  # run: last time, least and highest number, packets
    for at, number in zip(us, seq):
        if run is not None and at - run[0] >= gap_us:
            done, run = _with_burst(done, run, min_n), None
        run = [at, number, number, 1] if run is None else [at, min(run[1], number), max(run[2], number), run[3] + 1]
    return {"done": done, "run": run}


def _with_burst(done: list, run: list | None, min_n: int) -> list:
    if run is None or run[3] <= min_n:
        return done
    out = []
    for lo, hi in sorted([*done, run[1:3]]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def plain_rows(rows: Iterable[pd.DataFrame], columns: Sequence[str]) -> Iterator[tuple]:
    """Rows as tuples of plain numbers."""
    for batch in rows:
        yield from zip(*(batch[c].tolist() for c in columns))


class Buckets(StatefulProcessor):
    """State of all keys of a bucket, as one entry, and one timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "known string")

    def known(self) -> tuple[dict[tuple, list], int | None]:
        """What is known of each key, and when the timer is due."""
        if not self.state.exists():
            return {}, None
        timer, keys = json.loads(self.state.get()[0])
        return {tuple(k): v for k, v in keys}, timer

    def keep(self, known: dict[tuple, list], timer: int | None, due: int, fired: int | None = None) -> None:
        """A timer that fires is deleted afterwards by itself, so another time is needed."""
        if fired is not None:
            due, timer = max(due, fired + 1), None if timer == fired else timer
        if timer is not None and (timer != due or not known):
            self.handle.deleteTimer(timer)
        if not known:
            self.state.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.state.update((json.dumps([due, list(known.items())]),))

    def close(self) -> None:
        pass


class _Epochs(Buckets):
    """Flows or pairs, dropped when a whole epoch after their last one has passed."""

    epoch_us: int

    def last(self, state: list) -> int:
        raise NotImplementedError

    def keep_alive(self, known: dict[tuple, list], timer: int | None, timerValues, fired: int | None = None) -> None:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ends = {k: (self.last(state) + 2) * self.epoch_us for k, state in known.items()}
        known = {k: state for k, state in known.items() if ends[k] > now}
        self.keep(known, timer, max((ends[k] for k in known), default=0) // 1000, fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.keep_alive(*self.known(), timerValues, expiredTimerInfo.getExpiryTimeInMs())
        return iter(())


class FlowState(_Epochs):
    """Packets of closed epochs in, out with session, lost, dup and admitted."""

    def __init__(self, epoch_us: int, threshold: int) -> None:
        self.epoch_us = epoch_us
        self.needed = -(-threshold // UNIT) - 1

    def last(self, state: list) -> int:
        return state[0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self.known()
        done = []
        for flow, packets in groupby(sorted(plain_rows(rows, [*FLOW, *_LISTS])), itemgetter(slice(0, len(FLOW)))):
            batch = dict(zip(_LISTS, list(zip(*packets))[len(FLOW) :]))
            out, known[flow] = advance(batch, known.get(flow), self.epoch_us, self.needed)
            done += [(*flow, *row) for row in zip(*(out[c] for c in ("epoch", *PACKET_OUT)))]
        self.keep_alive(known, timer, timerValues)
        yield pd.DataFrame(done, columns=[*FLOW, "epoch", *PACKET_OUT])


class PairState(_Epochs):
    """Packets of closed epochs of both directions of a pair of endpoints in, a row per flow and epoch with all statistics out."""

    def __init__(self, epoch_us: int, gap_us: int, min_n: int) -> None:
        self.epoch_us, self.gap_us, self.min_n = epoch_us, gap_us, min_n

    def last(self, state: list) -> int:
        return max(s[0] for s in state if s is not None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self.known()
        # Behind the watermark nothing may be sent on, so rows carry the later of it and their epoch's end.
        now = timerValues.getCurrentWatermarkInMs() * 1000
        done, n = [], len(_PAIR)
        for pair, packets in groupby(sorted(plain_rows(rows, [*_PAIR, "epoch", "way", *_LISTS])), itemgetter(slice(0, n))):
            host, *low, high_ip, high_port, proto = pair
            ends = (low[0], high_ip, low[1], high_port), (high_ip, low[0], high_port, low[1])
            states = known.setdefault(pair, [None, None])
            for epoch, both in groupby(packets, itemgetter(n)):
                own: list[dict | None] = [None, None]
                for way, mine in groupby(both, itemgetter(n + 1)):
                    batch = dict(zip(_LISTS, list(zip(*mine))[n + 2 :]))
                    own[way], states[way] = self.epoch_of_flow(batch, states[way])
                for way, stats in enumerate(own):
                    if stats is not None:
                        stats["unacked"] = _unacked(stats, stats if ends[0] == ends[1] else own[1 - way])
                        closed = max((epoch + 1) * self.epoch_us, now)
                        done.append((closed, host, *ends[way], proto, epoch, *(stats[c] for c in EPOCH_OUT)))
        self.keep_alive(known, timer, timerValues)
        out = pd.DataFrame(done, columns=["closed", *FLOW, "epoch", *EPOCH_OUT])
        yield out.assign(closed=pd.to_datetime(out["closed"], unit="us"), unacked=out["unacked"].astype("Int64"))

    def epoch_of_flow(self, batch: dict, before: list | None) -> tuple[dict, list]:
        out, after = advance(batch, before, self.epoch_us, 0)
        goes_on = before is not None and before[1] == after[1]
        top, ack = before[2:4] if goes_on else (0, 0)
        bursts = known_bursts(batch["us"], batch["seq"], before[6] if goes_on else {"done": [], "run": None}, self.gap_us, self.min_n)
        lost, hits = [s for s, again in zip(batch["seq"], out["lost"]) if again], 0
        ranges = _with_burst(bursts["done"], bursts["run"], self.min_n) if lost else []
        if ranges:
            starts = [lo for lo, _ in ranges]
            places = [(s, bisect_right(starts, s) - 1) for s in lost]
            hits = sum(i >= 0 and s <= ranges[i][1] for s, i in places)
        own = {"session": after[1], "n": len(batch["us"]), "bytes": sum(batch["len"]), "lost": len(lost), "burst_lost": hits}
        own |= {"seq_v1": after[2], "seq_v2": top, "ack_v1": after[3], "ack_v2": ack, "dup_v1": after[4]}
        return own, [*after, bursts]


def _unacked(own: dict, other: dict | None) -> int | None:
    """Share of the bytes in flight at the last epoch's end that this epoch did not acknowledge, in percent."""
    if other is None:
        return None
    in_air = own["seq_v2"] - other["ack_v2"]
    acked = other["ack_v1"] - other["ack_v2"] + other["dup_v1"]
    if in_air <= 0 or acked > in_air:
        return 0
    return 100 - 100 * acked // in_air if acked >= 0 else 100 + -100 * acked // in_air  # rounded towards zero


RULE_KEY = ["rule_id", "host", *GROUP]
RULE_OUT = ["closed", *RULE_KEY, "win", "value", "past"]


class RuleState(Buckets):
    """Values of rules, hosts and groups in, the value of each window out once it is closed, with those of the windows before.

    Windows may have any length: each brings the time of its end. A key is [open windows, past windows, when it is forgotten].
    """

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self.known()
        for row in plain_rows(rows, [*RULE_KEY, "win", "ends_us", "length_us", "top", "value"]):
            own, (win, ends, length, top, value) = row[:-5], row[-5:]
            windows = known.setdefault(own, [{}, {}, 0])[0]
            old = windows.get(str(win))
            if old is not None:
                value = max(old[0], value) if top else old[0] + value
            windows[str(win)] = [value, ends, length]
        self.keep(known, timer, self.due(known))
        return iter(())

    @staticmethod
    def due(known: dict[tuple, list]) -> int:
        ends = [w[1] for windows, *_ in known.values() for w in windows.values()]
        return min(ends) // 1000 - 1 if ends else max((state[2] for state in known.values()), default=0) // 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        known, timer = self.known()
        out = []
        for own, state in known.items():
            windows, past = state[0], {int(w): v for w, v in state[1].items()}
            closed = sorted((int(w), *v) for w, v in windows.items() if v[1] <= now)
            for win, value, ends, length in closed:
                out.append((pd.Timestamp(max(ends, now), unit="us"), *own, win, value, [past.get(win - k, 0) for k in range(1, HISTORY)]))
                past[win] = value
                del windows[str(win)]
                # no window from here on asks for this one
                state[2] = max(state[2], ends + (HISTORY - 1) * length)
            if closed:
                state[1] = {str(w): v for w, v in past.items() if w > closed[-1][0] - HISTORY}
            if len(out) >= CHUNK:
                yield pd.DataFrame(out, columns=RULE_OUT)
                out = []
        known = {own: state for own, state in known.items() if state[0] or state[2] > now}
        self.keep(known, timer, self.due(known), expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield pd.DataFrame(out, columns=RULE_OUT)


def _with_rocksdb(df: DataFrame) -> DataFrame:
    """Keyed state needs this store; the setting holds for queries that the session starts from now on."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


def stream_flow_state(packets: DataFrame, epoch_us: int, threshold: int, watermark: str) -> DataFrame:
    """Packets of closed epochs with session, lost, dup and admitted."""
    return (
        _with_rocksdb(closed_epochs(packets, epoch_us, watermark).withColumn("bucket", bucket_of(FLOW)))
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=FlowState(epoch_us, threshold),
            outputStructType=f"{_FLOW_TYPES}, epoch bigint, pkt_no bigint, session bigint, lost boolean, dup bigint, admitted boolean",
            outputMode="append",
            timeMode="eventTime",
        )
    )


def stream_flow_epochs(
    packets: DataFrame, epoch_us: int, watermark: str, gap_us: int = BURST_GAP_US, min_n: int = BURST_MIN
) -> DataFrame:
    """All statistics of a flow and closed epoch: counts, retransmissions, those within bursts of the session so far, the
    state of numbers and acks at the end of this epoch and the one before, and the share in flight that stayed
    unacknowledged, null where the opposite direction was silent."""
    ends = [F.struct(F.col(f"{a}ip").alias("ip"), F.col(f"{a[0]}port").alias("port")) for a in ("src", "dst")]
    low, high = F.least(*ends), F.greatest(*ends)
    pairs = closed_epochs(packets, epoch_us, watermark).withColumns(
        {"low_ip": low["ip"], "low_port": low["port"], "high_ip": high["ip"], "high_port": high["port"], "way": F.when(ends[0] <= ends[1], 0).otherwise(1)}
    )
    return (
        _with_rocksdb(pairs.select("closed", *_PAIR, "way", "epoch", *_LISTS, bucket_of(_PAIR)))
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=PairState(epoch_us, gap_us, min_n),
            outputStructType=f"closed timestamp, {_FLOW_TYPES}, epoch bigint, {', '.join(f'{c} bigint' for c in EPOCH_OUT)}",
            outputMode="append",
            timeMode="eventTime",
            eventTimeColumnName="closed",
        )
    )


def stream_rule_values(flow_epochs: DataFrame, rules: DataFrame, epoch_us: int, phase: str = "aligned") -> DataFrame:
    """Values of all rules, whatever their type and interval, from `stream_flow_epochs`: the columns of `evaluate`, `past`
    with the values of the windows before (the latest first, 0 where there was none), and `closed`.

    A window's value comes when it is closed, by one keyed state for all intervals.
    """
    length = (epochs_per_window(epoch_us) * epoch_us).alias("length_us")
    keyed = keyed_values(flow_epochs, rules, epoch_us, phase, ("closed", length))
    rows = keyed.where("_v is not null and (agg <> 'burstloss' or _v > 0)")
    fields = ", ".join(f"{c} bigint" for c in RULE_KEY)
    own = [*RULE_KEY, "win", "ends_us", "length_us", "top", F.col("_v").alias("value")]
    out = (
        _with_rocksdb(rows.select("closed", *own, bucket_of(RULE_KEY)))
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=RuleState(),
            outputStructType=f"closed timestamp, {fields}, win bigint, value bigint, past array<bigint>",
            outputMode="append",
            timeMode="eventTime",
            eventTimeColumnName="closed",
        )
    )
    return out.select(*VALUE, "past", "closed")


def stream_evaluate_all(
    packets: DataFrame, rules: DataFrame, epoch_us: int, watermark: str, gap_us: int = BURST_GAP_US, min_n: int = BURST_MIN, phase: str = "aligned"
) -> DataFrame:
    """Packets in, values of rules of every registered type out, window after window."""
    flows = stream_flow_epochs(packets, epoch_us, watermark, gap_us, min_n)
    return stream_rule_values(flows, rules, epoch_us, phase)
