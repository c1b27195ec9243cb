import random

import pytest
from pyspark.sql import functions as F
from replay import (
    EPOCH,
    by_flow,
    frame,
    packet,
    replay,
    replay_bursts,
    replay_congestion,
    replay_seen,
    traffic,
    us_of,
)

from flowwarden.functions import keys as fk
from flowwarden.operators import admission, evaluate, flowstats
from flowwarden.plans import ordered
from flowwarden.schema import FLOW

CASES = {
    "equal and lower": [packet(0, 0, 100), packet(1, 1, 200), packet(2, 2, 200), packet(3, 3, 150), packet(4, 4, 300)],
    "first seq zero": [packet(0, 0, 0), packet(1, 1, 1)],
    "acks": [
        packet(i, i, 10 + i, ack)
        for i, ack in enumerate([0, 0, 1000, 1000, 1000, 1500, 1500, 9000, 9000, 8000, 8000])
    ],
    "idle epoch ends a session": [packet(0, 0, 500), packet(1, EPOCH, 400), packet(2, 3 * EPOCH, 400)],
    "below and above the threshold": [packet(i, i, i, length=64) for i in range(12)],
}


def stats(spark, rows):
    df = frame(spark, rows)
    full = flowstats.dup_credit(flowstats.retransmissions(df, EPOCH), EPOCH)
    got = {r.pkt_no: (r.epoch, r.session, r.lost, r.dup) for r in full.collect()}
    adm = {r.pkt_no: r.admitted for r in admission.admission(df, 640, EPOCH).collect()}
    return {k: (*v, adm[k]) for k, v in got.items()}


@pytest.mark.parametrize("name", CASES)
def test_hand_made(spark, name):
    assert stats(spark, CASES[name]) == replay(CASES[name])


@pytest.mark.parametrize("cut", [False, True])
def test_random_traffic(spark, monkeypatch, cut):
    rows = traffic(400, seed=3)
    if cut:
        monkeypatch.setattr(ordered, "ROWS_PER_PIECE", 7)
    assert stats(spark, rows) == replay(rows)


def test_hot_key_is_cut_evenly(spark):
    rows = traffic(2000, seed=5, hot=0.6)
    df = flowstats.timed(frame(spark, rows))
    labelled = ordered.split_hot(df, FLOW, rows_per_piece=100)
    assert ordered.is_split(labelled)
    sizes = labelled.groupBy(*FLOW, "piece").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100
    assert labelled.where("piece is null").count() < 1000
    assert labelled.count() == len(rows)


def test_bunched_key_is_cut_again(spark):
    # Nearly all packets of the hot flow fall in a thousandth of its time span.
    rows = [packet(i, 1_000_000 + i) for i in range(1000)] + [packet(5000, 0), packet(5001, 900_000_000)]
    labelled = ordered.split_hot(flowstats.timed(frame(spark, rows)), FLOW, rows_per_piece=50)
    assert labelled.groupBy("piece").count().agg(F.max("count")).first()[0] <= 50


def test_times_that_grow_exponentially_are_cut_to_size(spark):
    rows = [packet(i, int(1.02**i)) for i in range(1200)]
    labelled = ordered.split_hot(flowstats.timed(frame(spark, rows)), FLOW, rows_per_piece=40)
    sizes = {r.piece: r["count"] for r in labelled.groupBy("piece").count().collect()}
    # Only packets of one microsecond stay together.
    same = max(sum(1 for x in rows if us_of(x) == us_of(r)) for r in rows[:200:20])
    assert max(sizes.values()) <= max(40, same) and sum(sizes.values()) == len(rows)


def test_equal_numbers_are_asked_once(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_PIECE", 50)
    rows = [packet(i, i, seq=0) for i in range(400)] + [packet(400 + i, 10_000 + i, seq=7) for i in range(10)]
    df = flowstats.ordered(frame(spark, rows))
    hits = flowstats.in_burst(flowstats.retransmitted_seqs(df, EPOCH), flowstats.bursts(df, 5))
    assert {(r.seq, r.hit) for r in hits.collect()} == {(0, True), (7, True)} and hits.count() == 409


@pytest.mark.parametrize("cut", [False, True])
def test_bursts(spark, monkeypatch, cut):
    rnd = random.Random(1)
    rows, us = [], 0
    for i in range(300):
        us += rnd.choice([1, 1, 1, 1, 4999, 5000, 7000])
        rows.append(packet(i, us, seq=rnd.randrange(10**6), flow=(rnd.choice([1, 1, 1, 2]), 2, 3, 4, 6)))
    if cut:
        monkeypatch.setattr(ordered, "ROWS_PER_PIECE", 7)
    got = {(*[r[c] for c in FLOW], r.seq1, r.seq2, r.n, r.t0, r.t1) for r in flowstats.bursts(frame(spark, rows), 5000).collect()}
    assert got == replay_bursts(rows, 5000)
    assert got


def test_burst_needs_more_than_four(spark):
    for n, found in ((4, 0), (5, 1)):
        rows = [packet(i, i, i) for i in range(n)]
        assert flowstats.bursts(frame(spark, rows), 10).count() == found


@pytest.mark.parametrize("cut", [False, True])
def test_congestion(spark, monkeypatch, cut):
    rows = traffic(500, seed=9, hot=0.5, span=150_000)
    if cut:
        monkeypatch.setattr(ordered, "ROWS_PER_PIECE", 9)
    got = {
        (tuple(r[c] for c in FLOW), r.epoch): r.unacked
        for r in evaluate.congestion_flows(frame(spark, rows), EPOCH).collect()
    }
    assert got == replay_congestion(rows)
    assert len(set(got.values())) > 3


@pytest.mark.parametrize("cut", [False, True])
def test_recently_seen(spark, monkeypatch, cut):
    rows = traffic(600, seed=11)
    if cut:
        monkeypatch.setattr(ordered, "ROWS_PER_PIECE", 9)
    got = {r.pkt_no: r.seen for r in flowstats.recently_seen(frame(spark, rows), gen_len=20).collect()}
    assert got == replay_seen(rows, 20)
    assert 0 < sum(got.values()) < len(got)


@pytest.mark.parametrize("hot", [False, True])
def test_in_burst_equals_every_pair(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(ordered, "ROWS_PER_PIECE", 5)
    rnd = random.Random(2)
    flow = dict(zip(FLOW, (0, 1, 2, 3, 4, 6)))
    spans = [(s := rnd.randrange(1000), s + rnd.randrange(30)) for _ in range(25)]
    seqs = [rnd.randrange(1000) for _ in range(200)]
    bursts = spark.createDataFrame([(*flow.values(), a, b) for a, b in spans], [*FLOW, "seq1", "seq2"])
    asked = spark.createDataFrame([(*flow.values(), i, s) for i, s in enumerate(seqs)], [*FLOW, "id", "seq"])
    got = {r.id: r.hit for r in flowstats.in_burst(asked, bursts).collect()}
    assert got == {i: any(a <= s <= b for a, b in spans) for i, s in enumerate(seqs)}


def test_blocks_hold_all_lost_numbers(spark, cut_small):
    rows = [packet(0, 0, 10**6)] + [packet(i, i, i) for i in range(1, 101)]
    blocks = flowstats.retransmitted_blocks(frame(spark, rows), 10**9).orderBy("block").collect()
    assert [len(b.seqs) for b in blocks] == [32, 32, 32, 4]
    assert [s for b in blocks for s in b.seqs] == list(range(1, 101))


def naive_histogram(ends, sizes, m):
    kept = []
    for e, s in zip(ends, sizes):
        kept.append([e, s])
        if len(kept) > m:
            i = min(range(len(kept) - 1), key=lambda i: kept[i][1] + kept[i + 1][1])
            kept[i : i + 2] = [[kept[i + 1][0], kept[i][1] + kept[i + 1][1]]]
    return [tuple(k) for k in kept]


def test_histogram_equals_packet_by_packet(spark):
    rows = traffic(300, seed=6)
    hist = flowstats.time_histogram(frame(spark, rows), 4)
    got = {}
    for r in hist.orderBy("bucket").collect():
        got.setdefault(tuple(r[c] for c in FLOW), []).append((r.ts_end, r.bytes))
    for flow, packets in by_flow(rows).items():
        per_us = {}
        for p in packets:
            per_us[us_of(p)] = per_us.get(us_of(p), 0) + p[8]
        assert got[flow] == naive_histogram(list(per_us), list(per_us.values()), 4)


def test_histogram_keeps_all_bytes(spark):
    df = frame(spark, traffic(300, seed=6))
    hist = flowstats.time_histogram(df, 4, bin_us=700)
    per_flow = {tuple(r[c] for c in FLOW): (r.n, r.b) for r in hist.groupBy(*FLOW).agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()}
    want = {tuple(r[c] for c in FLOW): r.b for r in df.groupBy(*FLOW).agg(F.sum("len").alias("b")).collect()}
    assert {k: b for k, (_, b) in per_flow.items()} == want
    assert max(n for n, _ in per_flow.values()) == 4


def test_a_far_packet_of_another_flow_changes_nothing(spark):
    rows = [packet(i, 7 * i, 100) for i in range(12)]
    far = [(99, *rows[0][1:3], *[x + 1 for x in rows[0][3:7]], *rows[0][7:])]
    far = [(*far[0][:1], rows[0][1].replace(year=2030), *far[0][2:])]
    one = flowstats.time_histogram(frame(spark, rows), 8)
    two = flowstats.time_histogram(frame(spark, rows + far), 8)
    first = {tuple(r) for r in one.collect()}
    assert len(first) == 8 and first <= {tuple(r) for r in two.collect()}


def test_hashed_admission_only_admits_more(spark):
    df = frame(spark, traffic(500, seed=8))
    exact = {r.pkt_no for r in admission.admit(df, 6400, EPOCH).collect()}
    shared = {r.pkt_no for r in admission.admit(df, 6400, EPOCH, buckets=2).collect()}
    assert exact < shared
    # The same counting by hand, with flows of a bucket sharing one counter.
    bucket = fk.flow_bucket(2)
    where = {r.pkt_no: r.b for r in df.select("pkt_no", bucket.alias("b")).collect()}
    rows = [(*r[:3], where[r[0]], 0, 0, 0, 0, *r[8:]) for r in traffic(500, seed=8)]
    assert shared == {no for no, v in replay(rows, EPOCH, 6400).items() if v[4]}
    assert admission.admit(df, 0, EPOCH).count() == 500
    assert admission.admit(df, 64, EPOCH).count() == 500


def test_histogram_of_many_flows_makes_one_table_a_batch(spark, monkeypatch):
    """The work per flow is a few rows, not a table of its own."""
    import pandas as pd

    made, kept = [], {}
    monkeypatch.setattr(type(spark.range(0)), "mapInPandas", lambda df, fn, schema: kept.update(fn=fn))
    flowstats.time_histogram(frame(spark, []), 3)
    monkeypatch.undo()
    columns = [*FLOW, "bin", "ts_end", "bytes"]
    rnd, rows = random.Random(5), []
    for flow in range(200):
        rows += [(0, flow, 2, 3, 4, 6, b, b, rnd.randrange(1, 9)) for b in range(rnd.randrange(1, 12))]
    batches = [pd.DataFrame(rows[i : i + 500], columns=columns) for i in range(0, len(rows), 500)]
    init = pd.DataFrame.__init__
    monkeypatch.setattr(pd.DataFrame, "__init__", lambda self, *a, **k: (made.append(type(a[0]) if a else None), init(self, *a, **k))[1])
    out = list(kept["fn"](iter(batches)))
    monkeypatch.undo()
    assert sum(t is list or t is dict for t in made) <= len(batches) + 1
    want = []
    for flow in range(200):
        parts = []
        for r in (r for r in rows if r[1] == flow):
            parts.append([r[7], r[8]])
            if len(parts) > 3:
                i = min(range(3), key=lambda j: parts[j][1] + parts[j + 1][1])
                parts[i : i + 2] = [[parts[i + 1][0], parts[i][1] + parts[i + 1][1]]]
        want += [(flow, i, *p) for i, p in enumerate(parts)]
    assert list(pd.concat(out)[["srcip", "bucket", "ts_end", "bytes"]].itertuples(index=False, name=None)) == want


def test_frames_hold_the_low_bytes_of_large_numbers(spark, tmp_path):
    """Sequence numbers beyond 32 bits go round, as on the wire."""
    from flowwarden.sources.frames import decode_frames
    from flowwarden.workload import views

    first = 3_000_000
    events = spark.range(first, first + 50).selectExpr(
        "id as event_id", "timestamp_micros(1704067200000000 + id) as ts", "id % 9 as user_id", "if(id % 2 = 0, 'click', 'purchase') as event_type", "1.0D as value", "'' as props"
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.pkt_no: r for r in decode_frames(views.frames(spark, str(tmp_path))).collect()}
    want = {r.pkt_no: r for r in views.packets(spark, str(tmp_path)).collect()}
    assert len(got) > 30 and all(want[n].seq >= 1 << 32 for n in got)
    for n, r in got.items():
        assert (r.seq, r.len, r.srcip, r.dport) == (want[n].seq % (1 << 32), want[n].len, want[n].srcip, want[n].dport)
        assert r.ack == (want[n].ack % (1 << 32) if r.proto == 6 else 0) and not r._corrupt
