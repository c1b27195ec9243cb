import random
from collections import Counter
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from replay import EPOCH, START, by_flow, frame, packet, replay, replay_bursts, traffic, us_of

from flowwarden import registry
from flowwarden.operators import evaluate, lifecycle
from flowwarden.schema import KEY, PACKETS, RULES
from flowwarden.sources.packets import stream_packets, write_alerts
from flowwarden.streaming import evaluate as st
from flowwarden.streaming import reactions, states


def in_files(spark, rows, folder, n):
    """Write the packets in time order, one file per slice."""
    rows = sorted(rows, key=lambda r: (us_of(r), r[0]))
    size = -(-len(rows) // n)
    for i in range(0, len(rows), size):
        frame(spark, rows[i : i + size]).coalesce(1).write.mode("append").parquet(folder)


def rules(spark, threshold=3):
    zeros = [0] * 5
    rows = [
        (0, *zeros, *zeros, *zeros, "packet", threshold, 10, None, None),
        (1, *zeros, *zeros, 32, 0, 0, 0, 0, "volume", 1500, 30, None, None),
    ]
    return spark.createDataFrame(rows, RULES)


DELAY = 60_000  # allowed for late packets


def shuffled(spark, rows, folder, n, seed):
    """Write the packets in files, each with packets up to DELAY late, none of them in order."""
    rnd = random.Random(seed)
    rows = sorted(rows, key=lambda r: us_of(r) + rnd.randrange(DELAY))
    size = -(-len(rows) // n)
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        rnd.shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)


def closed(rows, epochs=1):
    """Whether a window of so many epochs is over when all rows were seen."""
    newest = max(us_of(r) for r in rows) - DELAY
    return lambda win: (win + 1) * epochs * EPOCH <= newest


@pytest.mark.parametrize("files", [1, 5])
def test_state_across_batches(spark, tmp_path, files):
    rows = traffic(300, seed=21, span=200_000)
    rows += [packet(900, 210_000, 100), packet(902, 210_900, 200), packet(901, 210_500, 300)]
    shuffled(spark, rows, str(tmp_path / "in"), files, seed=files)
    stream = stream_packets(spark, str(tmp_path / "in"), files_per_trigger=1)
    out = st.run_to_table(states.stream_flow_state(stream, EPOCH, 640, "60 milliseconds"))
    got = {r.pkt_no: (r.epoch, r.session, r.lost, r.dup, r.admitted) for r in out.collect()}
    done = closed(rows)
    assert got == {no: x for no, x in replay(rows).items() if done(x[0])}
    assert len(got) > 150


def all_rules(spark):
    """Rules of every type, some of several epochs, one with a lifetime."""
    zeros, at = [0] * 5, lambda us: START + timedelta(microseconds=us)
    rows = []
    for i, (agg, epochs) in enumerate([("packet", 1), ("volume", 3), ("loss", 2), ("congestion", 1), ("burstloss", 1), ("packet", 4)]):
        alive = (at(45_000), at(175_000)) if i == 5 else (None, None)
        rows.append((i, *zeros, *zeros, *([32, 0, 0, 0, 0] if i % 2 else zeros), agg, 1, 10 * epochs, *alive))
    return spark.createDataFrame(rows, RULES)


def test_rules_of_all_types_online(spark, tmp_path):
    rows = traffic(400, seed=31, span=300_000)
    shuffled(spark, rows, str(tmp_path / "in"), 4, seed=4)
    rules_ = all_rules(spark)
    stream = stream_packets(spark, str(tmp_path / "in"), files_per_trigger=1)
    # no gap ends a burst and no epoch is idle: bursts of all time are those of the session so far, at its end
    got = st.run_to_table(states.stream_evaluate_all(stream, rules_, EPOCH, "60 milliseconds", gap_us=20_000))
    values = evaluate.evaluate(frame(spark, rows), rules_, EPOCH, gap_us=20_000)
    lengths = {0: 1, 1: 3, 2: 2, 3: 1, 4: 1, 5: 4}
    over = {rule: closed(rows, n) for rule, n in lengths.items()}
    want = {tuple(r)[:-1]: r.value for r in values.collect() if over[r.rule_id](r.win)}
    rest = {tuple(r[:-3]): (r.value, r.past) for r in got.collect()}
    online = {k: v[0] for k, v in rest.items() if k[0] != 4}
    assert online == {k: v for k, v in want.items() if k[0] != 4}
    assert {k[0] for k in rest} == set(lengths)
    assert {k: v[0] for k, v in rest.items() if k[0] == 4} == known_burst_losses(rows, over[4])
    for (rule, host, win, *key), (_, past) in rest.items():
        assert past == [want.get((rule, host, win - k, *key), 0) if rule != 4 else rest.get((4, host, win - k, *key), (0,))[0] for k in range(1, evaluate.HISTORY)]


def known_burst_losses(rows, done):
    """(rule 4, host, epoch, no group) -> retransmitted numbers within bursts of the session so far."""
    info, out = replay(rows), Counter()
    for flow, packets_ in by_flow(rows).items():
        for epoch in {info[r[0]][0] for r in packets_}:
            session = next(info[r[0]][1] for r in packets_ if info[r[0]][0] == epoch)
            so_far = [r for r in packets_ if info[r[0]][1] == session and info[r[0]][0] <= epoch]
            found = [(b[6], b[7]) for b in replay_bursts(so_far, 20_000)]
            lost = [r[9] for r in so_far if info[r[0]][0] == epoch and info[r[0]][2]]
            hits = sum(any(lo <= x <= hi for lo, hi in found) for x in lost)
            if hits and done(epoch):
                out[(4, flow[0], epoch, 0, 0, 0, 0, 0)] += hits
    return dict(out)


@pytest.mark.parametrize("size", [1, 4, 100])
def test_known_bursts_in_any_slices(size):
    rnd = random.Random(size)
    us = np.sort(np.array([rnd.randrange(3000) for _ in range(200)]))
    seq = np.array([rnd.randrange(500) for _ in range(200)])
    state = {"done": [], "run": None}
    for i in range(0, 200, size):
        state = states.known_bursts(us[i : i + size], seq[i : i + size], state, 20, 4)
        found = states._with_burst(state["done"], state["run"], 4)
        runs, n = np.split(np.arange(len(us[: i + size])), np.flatnonzero(np.diff(us[: i + size]) >= 20) + 1), 0
        want = {x for r in runs if len(r) > 4 for x in range(seq[r].min(), seq[r].max() + 1)}
        assert {x for lo, hi in found for x in range(lo, hi + 1)} == want


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    rows = traffic(300, seed=22, span=200_000)
    in_files(spark, rows, str(tmp_path / "in"), 4)
    stream = stream_packets(spark, str(tmp_path / "in"), files_per_trigger=1)
    got = st.run_to_table(st.stream_values(stream, rules(spark), "20 milliseconds").drop("window"))
    newest = max(us_of(r) for r in rows) - 20_000
    batch = evaluate.evaluate(frame(spark, rows), rules(spark), EPOCH)
    length = F.when(F.col("rule_id") == 0, EPOCH).otherwise(3 * EPOCH)
    closed = batch.where((F.col("win") + 1) * length <= newest)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in closed.select(got.columns).collect()}
    assert got.count() > 20


def test_late_packets_are_dropped(spark, tmp_path):
    # A packet is late once the watermark of an earlier batch has passed its window.
    for rows in [[packet(0, 0), packet(1, 500_000)], [packet(4, 600_000)], [packet(2, 1)], [packet(3, 900_000)]]:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_packets(spark, str(tmp_path / "in"), files_per_trigger=1)
    out = st.run_to_table(st.stream_flow_epochs(stream, EPOCH, "10 milliseconds").drop("window"))
    assert [r.n for r in out.collect()] == [1, 1, 1]


def test_rules_change_while_running(spark, tmp_path):
    folder = str(tmp_path)
    source, rules_path = f"{folder}/in", f"{folder}/rules"
    seen = []
    keep = registry.on_alert(lambda df: seen.append(df.count()))
    try:
        for step, threshold in enumerate((3, 1000)):
            rules(spark, threshold).write.mode("overwrite").parquet(rules_path)
            rows = [packet(step * 100 + i, step * 1_000_000 + i * 2000) for i in range(50)]
            frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
            stream = stream_packets(spark, source)
            st.stream_evaluate(stream, rules_path, EPOCH, "0 seconds", f"{folder}/out").awaitTermination()
    finally:
        registry.remove_callback(keep)
    found = spark.read.parquet(f"{folder}/out/alerts").drop("batch")
    values = spark.read.parquet(f"{folder}/out/values").drop("batch")
    first = int(START.timestamp()) * 100
    # Epochs 0-8 closed in the first run; the tenth closed in the second, under the new threshold.
    assert sorted(r.win - first for r in found.where("rule_id = 0").collect()) == list(range(9))
    assert sum(seen) == found.count()
    rolled = st.window_alerts(values, rules(spark), EPOCH)
    assert rolled.where("rule_id = 1").count() == 0
    assert rolled.where("rule_id = 0").count() == values.where("rule_id = 0 and value >= 3").count()


def test_requests_wait_for_their_window(spark, tmp_path):
    rows = [packet(i, i * 1000) for i in range(100)]
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    asked = [(0, 0, START.replace(microsecond=15_000)), (0, 1, START.replace(microsecond=15_000)), (0, 0, START.replace(microsecond=99_000))]
    spark.createDataFrame(asked, "rule_id bigint, host bigint, ts timestamp").write.parquet(str(tmp_path / "ask"))
    values = st.stream_values(stream_packets(spark, str(tmp_path / "in")), rules(spark).where("rule_id = 0"), "0 seconds")
    requests = spark.readStream.schema("rule_id bigint, host bigint, ts timestamp").parquet(str(tmp_path / "ask"))
    out = st.run_to_table(st.answer_requests(values, requests, EPOCH, "0 seconds")).collect()
    assert [(r.win - int(START.timestamp()) * 100, r.value) for r in out] == [(1, 10)]


def test_slow_batches_are_counted(spark, tmp_path):
    in_files(spark, traffic(50, seed=3), str(tmp_path / "in"), 3)
    listener = st.SlowBatches(period_ms=1)
    spark.streams.addListener(listener)
    try:
        st.run_to_table(stream_packets(spark, str(tmp_path / "in"), files_per_trigger=1))
        spark.streams.resetTerminated()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    rows = listener.metrics(spark).collect()
    assert sum(r.input_rows for r in rows) == 50
    assert all(r.skipped == max(0, r.took_ms - 1) for r in rows)
    total = listener.totals(spark).first()
    assert total.input_rows == 50 and total.batches == len(rows) and total.skipped == sum(r.skipped for r in rows)


def test_rules_in_a_stream_end_and_begin(spark, tmp_path):
    rows = [packet(i, i * 1000) for i in range(100)]
    in_files(spark, rows, str(tmp_path / "in"), 3)
    at = lambda us: F.timestamp_micros(F.lit(int(START.timestamp()) * 10**6 + us))
    always = rules(spark).where("rule_id = 0")
    for since, until in ((None, -1), (30_000, None), (20_000, 55_000), (200_000, None)):
        own = always.withColumn("valid_from", at(since) if since is not None else F.lit(None).cast("timestamp"))
        own = own.withColumn("valid_to", at(until) if until is not None else F.lit(None).cast("timestamp"))
        stream = st.run_to_table(st.stream_values(stream_packets(spark, str(tmp_path / "in")), own, "1 second").drop("window"))
        batch = evaluate.evaluate(frame(spark, rows), own, EPOCH)
        newest = batch.agg(F.max("win")).first()[0]
        closed = set() if newest is None else {tuple(r) for r in stream.collect()}
        assert closed <= {tuple(r) for r in batch.select(stream.columns).collect()}
        if until == -1:
            assert stream.count() == 0


@pytest.mark.parametrize("split", [1, 7, 50])
def test_advance_in_any_slices(split):
    import pandas as pd

    rnd = random.Random(split)
    rows = sorted((packet(i, rnd.randrange(300_000), rnd.randrange(50), rnd.randrange(20) * 500, 200) for i in range(150)), key=lambda r: (us_of(r), r[0]))
    want = replay(rows)
    state, got = None, {}
    names = [f.name for f in PACKETS]
    for i in range(0, len(rows), split):
        batch = pd.DataFrame(rows[i : i + split], columns=names)
        batch["us"] = [us_of(r) for r in rows[i : i + split]]
        out, state = states.advance(batch, state, EPOCH, 9)
        for r in pd.DataFrame(out).itertuples():
            got[r.pkt_no] = (r.epoch, r.session, r.lost, r.dup, r.admitted)
    assert got == want


def test_alert_sink_appends(spark, tmp_path):
    df = evaluate.evaluate(frame(spark, traffic(50, seed=1)), rules(spark), EPOCH)
    found = evaluate.alerts(df, rules(spark))
    for _ in range(2):
        write_alerts(found, str(tmp_path / "alerts"))
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 2 * found.count()
    assert set(KEY) <= {c.removeprefix("k_") for c in found.columns}


@pytest.mark.parametrize("files", [1, 4])
def test_reactions_do_not_depend_on_batches(spark, tmp_path, files):
    rows = traffic(400, seed=41, span=300_000)
    shuffled(spark, rows, str(tmp_path / "in"), files, seed=files)
    stream = stream_packets(spark, str(tmp_path / "in"), files_per_trigger=1)
    rules_ = all_rules(spark).where("rule_id in (0, 1, 2)").withColumn("threshold", F.expr("case rule_id when 2 then 2 else 1 end").cast("bigint"))
    wanted = spark.createDataFrame([(2, 0, None, 2), (2, 1, 1, 5)], "cause bigint, rule_id bigint, host bigint, active bigint")
    out = str(tmp_path / "out")
    reactions.stream_react(stream, rules_, wanted, EPOCH, "60 milliseconds", out, gap_us=20_000).awaitTermination()
    got = spark.read.schema(reactions.ALERTS).parquet(f"{out}/alerts").drop("batch").collect()
    done, short = closed(rows), rules_.withColumn("interval_ms", F.lit(0).cast("bigint"))
    values = evaluate.evaluate(frame(spark, rows), short, EPOCH, gap_us=20_000).withColumnRenamed("win", "epoch")
    values = [r for r in values.collect() if done(r.epoch)]
    held = sorted({r.epoch for r in values if r.rule_id == 2 and r.value >= 2})
    want = set()
    for rule, host, active in ((0, None, 2), (1, 1, 5)):
        on = []
        for e in held:
            if not on or e >= on[-1] + active:
                on.append(e)
        for r in values:
            if r.rule_id == rule and r.value >= 1 and host in (None, r.host):
                want |= {(rule, r.host, r.epoch, r.k_srcip, r.value, e) for e in on if e <= r.epoch < e + active}
    assert {(r.rule_id, r.host, r.win, r.k_srcip, r.value, r.armed_at) for r in got} == want and len(got) == len(want)
    assert len({w[5] for w in want}) > 2
    assert 0 < sum(w[0] == 1 for w in want) < sum(r.rule_id == 1 and r.host == 1 for r in values)


def test_rules_added_and_deleted_between_batches(spark, tmp_path):
    rows = traffic(300, seed=43, span=300_000)
    shuffled(spark, rows, str(tmp_path / "in"), 3, seed=2)
    stream = stream_packets(spark, str(tmp_path / "in"), files_per_trigger=1)
    rules_ = all_rules(spark).withColumn("interval_ms", F.lit(0).cast("bigint")).drop("valid_from", "valid_to")
    log = [("add", 30), ("delete", 50), ("delete", 70), ("add", 120), ("add", 130), ("delete", 180), ("sleep", 190), ("add", None)]
    changes = None
    for op, ms in log:
        ts = F.lit(None).cast("timestamp") if ms is None else F.timestamp_micros(F.lit(int(START.timestamp()) * 10**6 + ms * 1000))
        part = rules_.withColumns({"op": F.lit(op), "ts": ts})
        changes = part if changes is None else changes.unionByName(part)
    changes.write.parquet(str(tmp_path / "changes"))
    out = str(tmp_path / "out")
    reactions.stream_rule_changes(stream, str(tmp_path / "changes"), EPOCH, "60 milliseconds", out, gap_us=20_000).awaitTermination()
    got = {tuple(r[c] for c in evaluate.VALUE) for r in spark.read.schema(reactions.VALUES).parquet(f"{out}/values").collect() if r.rule_id != 4}
    done, zero = closed(rows), int(START.timestamp()) * 100
    lives = [range(zero + 3, zero + 5), range(zero + 12, zero + 18)]
    always = evaluate.evaluate(frame(spark, rows), rules_.withColumns({c: F.lit(None).cast("timestamp") for c in ("valid_from", "valid_to")}), EPOCH, gap_us=20_000)
    want = {tuple(r[c] for c in evaluate.VALUE) for r in always.collect() if r.rule_id != 4 and done(r.win) and any(r.win in x for x in lives)}
    assert got == want and len({w[0] for w in want}) == 5
    assert lifecycle.lifetimes(changes).groupBy("rule_id").count().where("count <> 2").isEmpty()
    assert lifecycle.lifetimes(changes.limit(0)).isEmpty()
