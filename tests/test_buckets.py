"""Keyed state in buckets: many keys for a few calls, and the same answers whatever the buckets."""

import json

import pandas as pd
import pytest
from replay import EPOCH, by_flow, replay, traffic, us_of
from test_streaming import shuffled

from flowwarden.schema import FLOW
from flowwarden.sources.packets import heartbeat, stream_packets
from flowwarden.streaming import evaluate as st
from flowwarden.streaming import network, silence, states


class Handle:
    """State of one bucket that counts what is asked of it."""

    def __init__(self):
        self.calls, self.entries, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        return Value(self, name)

    getMapState = None

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)

    def listTimers(self):
        self.calls += 1
        return sorted(self.timers)


class Value:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def exists(self):
        self.handle.calls += 1
        return self.name in self.handle.entries

    def get(self):
        self.handle.calls += 1
        return self.handle.entries[self.name]

    def update(self, value):
        self.handle.calls += 1
        self.handle.entries[self.name] = value

    def clear(self):
        self.handle.calls += 1
        self.handle.entries.pop(self.name, None)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def run(processor, batches):
    """Frames with the watermark they meet, then the timer when it is over."""
    handle, out = Handle(), []
    processor.init(handle)
    for ms, batch in batches:
        if batch is not None:
            out += processor.handleInputRows((0,), iter([batch]), Clock(ms))
        for due in [t for t in sorted(handle.timers) if t < ms]:
            info = Clock(due)
            out += processor.handleExpiredTimer((0,), Clock(ms), info)
            handle.timers.discard(due)
    rows = pd.concat(out) if out else pd.DataFrame()
    return handle, rows


def keys(n, names):
    return pd.DataFrame({c: [i + 7 * k for i in range(n)] for k, c in enumerate(names)})


def packets(n, names, epoch):
    out = keys(n, names).assign(epoch=epoch, us=epoch * EPOCH + 5, pkt_no=range(n), len=100, seq=[i % 3 for i in range(n)], ack=0)
    return pd.concat([out, out.assign(us=out["us"] + 1, pkt_no=out["pkt_no"] + n)])


def window(n, names, win):
    return keys(n, names).assign(win=win, ends_us=(win + 1) * EPOCH, length_us=EPOCH, stop_us=silence.NEVER_US, top=False, value=range(n))


N = 300
MS = EPOCH // 1000
CASES = {
    "flows": (lambda: states.FlowState(EPOCH, 640), [(6 * MS, packets(N, FLOW, 5)), (9 * MS, None)], 2 * N),
    "pairs": (lambda: states.PairState(EPOCH, 100, 4), [(6 * MS, packets(N, states._PAIR, 5).assign(way=0)), (9 * MS, None)], N),
    "rules": (states.RuleState, [(6 * MS, window(N, states.RULE_KEY, 5)), (30 * MS, None)], N),
    "silence": (silence.DenseState, [(6 * MS, window(N, states.RULE_KEY, 5)), (30 * MS, None)], 15 * N),
    "punctual": (lambda: silence.Punctual(EPOCH), [(0, packets(N, FLOW, 5)), (6 * MS, None)], N),
    "gather": (
        lambda: network.GatherState([(0, None, None), (1, None, None)], 0),
        [(6 * MS, keys(N, network.GATHERED).assign(host=0, value=5, threshold=4, last_epoch=5, ends_us=6 * EPOCH)), (8 * MS, None)],
        2 * N,
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_calls_of_state_do_not_grow_with_keys(name):
    make, batches, n = CASES[name]
    handle, out = run(make(), batches)
    assert len(out) == n
    assert handle.calls <= 20
    assert not handle.entries and not handle.timers  # all keys are forgotten at last


def test_bucket_state_is_text():
    handle, _ = run(states.FlowState(EPOCH, 640), [(6 * MS, packets(2, FLOW, 5))])
    timer, known = json.loads(handle.entries["bucket"][0])
    assert timer == 7 * MS and len(known) == 2


@pytest.mark.parametrize("buckets", [1, 3])
def test_buckets_change_no_answer(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(states, "BUCKETS", buckets)
    rows = traffic(200, seed=71, span=200_000)
    shuffled(spark, rows, str(tmp_path / "in"), 3, seed=7)
    heartbeat(spark, max(us_of(r) for r in rows) + EPOCH + 60_000).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_packets(spark, str(tmp_path / "in"), files_per_trigger=1)
    out = st.run_to_table(states.stream_flow_state(stream, EPOCH, 640, "60 milliseconds")).collect()
    # after the heartbeat no epoch is open, so every packet is out
    assert {r.pkt_no: (r.epoch, r.session, r.lost, r.dup, r.admitted) for r in out} == replay(rows)
    assert len(out) == len(rows) and {tuple(r[:6]) for r in out} == set(by_flow(rows))


def test_stream_flow_state_has_all_packets(spark):
    import __spark_entry__ as entry

    out = entry.queries()["stream_flow_state"](spark, entry.SMOKE_DIR)
    assert out.select("pkt_no").distinct().count() == out.count() == spark.read.parquet(f"{entry.SMOKE_DIR}/events.parquet").count()
