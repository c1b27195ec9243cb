"""Plain-Python replays of the ordered statistics, packet by packet."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from flowwarden.schema import PACKETS

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EPOCH = 10_000


def packet(no, us, seq=0, ack=0, length=64, host=0, flow=(1, 2, 3, 4, 6)):
    return (no, START + timedelta(microseconds=us), host, *flow, length, seq, ack)


def frame(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


def traffic(n, seed, hot=0.4, span=400_000):
    """Random two-way traffic; one flow has a share `hot` of it."""
    rnd = random.Random(seed)
    flows = [(1, 2, 3, 4, 6), (2, 1, 4, 3, 6)] + [(i, 9, 5, 7, 17) for i in range(5)]
    rows = []
    for no in range(n):
        flow = flows[0] if rnd.random() < hot else rnd.choice(flows)
        rows.append(
            packet(
                no,
                rnd.randrange(span),
                seq=rnd.randrange(0, 60) * 100,
                ack=rnd.randrange(0, 60) * 100,
                length=rnd.randrange(40, 1500),
                host=rnd.randrange(2),
                flow=flow,
            )
        )
    return rows


def us_of(row):
    return int((row[1] - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def by_flow(rows):
    flows = {}
    for r in sorted(rows, key=lambda r: (us_of(r), r[0])):
        flows.setdefault(r[2:8], []).append(r)
    return flows


def replay(rows, epoch_us=EPOCH, threshold=640):
    """pkt_no -> (epoch, session, lost, dup, admitted)"""
    out = {}
    needed = -(-threshold // 64) - 1
    for packets in by_flow(rows).values():
        last = None
        for r in packets:
            epoch = us_of(r) // epoch_us
            if last is None or epoch - last >= 2:
                session, top, ack, dup, units = epoch, 0, 0, 0, 0
            last = epoch
            lost = not r[9] > top
            top = max(top, r[9])
            if r[10] == ack:
                dup += 1460
            else:
                moved = (r[10] - ack) % 2**32
                dup = 0 if dup < moved else dup - moved
                ack = r[10]
            admitted = units >= needed
            if not admitted:
                units += (r[8] + 63) // 64
            out[r[0]] = (epoch, session, lost, dup, admitted)
    return out


def replay_bursts(rows, gap, min_n=4):
    found = set()
    for flow, packets in by_flow(rows).items():
        run = []
        for r in [*packets, None]:
            if run and (r is None or us_of(r) - us_of(run[-1]) >= gap):
                if len(run) > min_n:
                    seqs = [x[9] for x in run]
                    found.add((*flow, min(seqs), max(seqs), len(run), us_of(run[0]), us_of(run[-1])))
                run = []
            if r is not None:
                run.append(r)
    return found


def replay_congestion(rows, epoch_us=EPOCH):
    """(flow, epoch) -> percent not acknowledged"""
    state = {}
    info = replay(rows, epoch_us)
    for flow, packets in by_flow(rows).items():
        top = ack = 0
        session = None
        for r in packets:
            epoch, ses, _, dup, _ = info[r[0]]
            if ses != session:
                session, top, ack, old = ses, 0, 0, None
                current = None
            if current != epoch:
                old = (top, ack)
                current = epoch
            top, ack = max(top, r[9]), r[10]
            state[flow, epoch] = (top, *old, ack, dup)
    out = {}
    for (flow, epoch), (_, seq_v2, _, _, _) in state.items():
        host, src, dst, sport, dport, proto = flow
        other = state.get(((host, dst, src, dport, sport, proto), epoch))
        if other is None:
            continue
        _, _, ack_v2, ack_v1, dup_v1 = other
        air, acked = seq_v2 - ack_v2, ack_v1 - ack_v2 + dup_v1
        out[flow, epoch] = 0 if air <= 0 or acked > air else 100 - int(100 * acked / air)
    return out


def replay_seen(rows, gen_len, bits=20):
    out = {}
    hosts = {}
    for r in sorted(rows, key=lambda r: (us_of(r), r[0])):
        h = hosts.setdefault(r[2], {"n": 0, "now": set(), "old": set()})
        cell = (r[9] ^ (r[9] >> 16)) & ((1 << bits) - 1)
        out[r[0]] = cell in h["now"] or cell in h["old"]
        h["now"].add(cell)
        h["n"] += 1
        if h["n"] == gen_len:
            h["n"], h["old"], h["now"] = 0, h["now"], set()
    return out
