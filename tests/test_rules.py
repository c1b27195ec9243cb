import random

import pytest
from pyspark.sql import functions as F
from replay import START, frame, packet, traffic

from flowwarden import registry
from flowwarden.functions import keys as fk
from flowwarden.operators import evaluate, flowstats, lifecycle, matching, network, rulesets
from flowwarden.schema import FLOW, GROUP, HOSTS, KEY, RULES, WIDTH
from flowwarden.sources import frames, logs, rules_text


def some_rules(spark, n=60, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lens = [rnd.choice([0, 0, WIDTH[c], rnd.randrange(WIDTH[c] + 1)]) for c in KEY]
        values = [rnd.choice([1, 2, 3, 9]), rnd.choice([1, 2, 9]), rnd.choice([3, 4, 5]), rnd.choice([3, 4, 7]), rnd.choice([6, 17])]
        fg = [rnd.choice([0, WIDTH[c]]) for c in KEY]
        rows.append((i, *values, *lens, *fg, rnd.choice(["packet", "volume"]), 2, 10, None, None))
    return spark.createDataFrame(rows, RULES)


def theta(flows, rules):
    r = matching.canonical(rules).alias("r")
    joined = flows.alias("f").join(r, fk.rule_matches("f", "r"))
    return {(*[x[c] for c in FLOW], x.rule_id) for x in joined.select(*[f"f.{c}" for c in FLOW], "rule_id").collect()}


@pytest.mark.parametrize("way", ["broadcast", "few shapes", "salted", "many rules"])
def test_match_equals_theta_join(spark, monkeypatch, way):
    if way == "many rules":
        monkeypatch.setattr(matching, "few_rows", lambda df: None)
    if way == "few shapes":
        monkeypatch.setattr(matching, "MAX_SHAPES", 3)
    if way == "salted":
        monkeypatch.setattr(matching, "BROADCAST_ROWS", 2)
    flows = frame(spark, traffic(80, seed=2)).select(*FLOW).distinct()
    rules = some_rules(spark)
    got = matching.match(flows, rules).collect()
    found = [(*[x[c] for c in FLOW], x.rule_id) for x in got]
    assert len(found) == len(set(found))
    assert set(found) == theta(flows, rules)


def test_no_rules(spark):
    flows = frame(spark, traffic(10, seed=2)).select(*FLOW)
    out = matching.match(flows, spark.createDataFrame([], RULES))
    assert out.count() == 0
    assert out.columns == [*FLOW, "rule_id", *GROUP]


def test_match_plan_has_equality_join_and_no_shuffle(spark):
    flows = frame(spark, traffic(10, seed=2)).select(*FLOW)
    plan = matching.match(flows, some_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Exchange hash" not in plan


GOOD = "172.16.4.9/12,192.168.0.0/16,17/8,0/0,5353/16;sum,packet,250;16,24,8,0,16;40"
LINES = {
    GOOD: True,
    "10.20.30.40/99,10.0.0.255/24,6/9,80/20,0/0;sum,volume,5;0,0,0,0,0;20": True,
    GOOD.removesuffix("40") + "45": False,  # no multiple of ten
    GOOD.replace("packet", "median"): False,
    GOOD.replace("5353", "70000"): False,
    GOOD.replace("16,24,8,0,16;", ""): False,
    GOOD.replace("172.16", "172.300"): False,
    "x" + GOOD: False,
    "": False,
}


def test_rule_lines(spark, tmp_path):
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "n bigint, value string")
    got = {r._line: r for r in rules_text.rules_from_text(lines, id_column="n").collect()}
    assert {t: not r._corrupt for t, r in got.items()} == LINES
    second = got[list(LINES)[1]]
    assert (second.len_srcip, second.len_proto, second.len_sport) == (32, 8, 16)
    assert second.dstip == 10 * 2**24
    path = tmp_path / "rules.txt"
    path.write_text("\n".join(LINES))
    assert rules_text.read_rules(spark, str(path)).count() == 2


def eth(proto, payload, dst="0a000002", ihl=5, ethertype="0800"):
    ip = f"4{ihl}000050000000004000"[:16] + "40" + f"{proto:02x}" + "0000" + "0a000001" + dst + "00" * 4 * (ihl - 5)
    return bytes.fromhex("00" * 12 + ethertype + ip + payload)


def test_frames(spark):
    tcp = "1f90" + "0050" + "0000000a" + "0000000b" + "5010ffff00000000"
    udp = "1f90" + "0050" + "0010" + "0000" + "deadbeef" + "0000000c"
    rows = [
        (0, eth(6, tcp)),
        (1, eth(17, udp)),
        (2, eth(1, tcp)),
        (3, eth(6, tcp, dst="ffffffff")),
        (4, eth(6, tcp, ihl=6)),
        (5, eth(6, tcp)[:40]),
        (6, eth(6, tcp, ethertype="86dd")),
        (7, eth(17, "1f90005000080000")),
    ]
    got = {r.n: r for r in frames.decode_frames(spark.createDataFrame([(0, i, bytearray(b)) for i, b in rows], "host bigint, n bigint, frame binary")).collect()}
    assert set(got) == {0, 1, 4, 5, 7}
    for n in (0, 4):
        r = got[n]
        assert (r.srcip, r.dstip, r.sport, r.dport, r.proto, r.len, r.seq, r.ack, r._corrupt) == (
            0x0A000001, 0x0A000002, 8080, 80, 6, 0x50, 10, 11, False)
    assert (got[1].seq, got[1].ack, got[1]._corrupt) == (12, 0, False)
    assert got[5]._corrupt
    assert (got[7].seq, got[7]._corrupt) == (0, False)


def test_logs(spark):
    text = """123: serverdata 0: sat time 5 event 2 ctime 105
124: serverdata 1: poll time 5 event 2 ctime 105
125: serverdata 1: poll_return time 5 event 2 ctime 105
126: all_data event 2 ctime 105 0:8 1:9
90: addevent event 2 ctime 100
91: serverdata 0: add_return time 1 event 2 ctime 101
99: delevent event 2 ctime 140
100: serverdata 0: del_return time 41 event 2 ctime 141
101: serverdata 0: hello
no number""".splitlines()
    lines = spark.createDataFrame([(t,) for t in text], "value string")
    got = [tuple(r) for r in logs.read_controller_log(lines).orderBy("time").collect()]
    assert got == [
        (90, 0, 6, 0, 2, 100),
        (91, 0, 4, 1, 2, 101),
        (99, 0, 7, 0, 2, 140),
        (100, 0, 8, 41, 2, 141),
        (123, 0, 2, 5, 2, 105),
        (124, 1, 1, 5, 2, 105),
        (125, 1, 3, 5, 2, 105),
        (126, 0, 5, 0, 2, 105),
    ]
    text = ["123: send time 5 step 5 event 2", "124: poll time 5 step 5 event 2 seq 7", "125: add step 5 event 2", "x"]
    lines = spark.createDataFrame([(t,) for t in text], "value string")
    got = [tuple(r) for r in logs.read_host_log(lines).orderBy("time").collect()]
    assert got == [(123, 1, 5, 5, 2), (124, 2, 5, 5, 2), (125, 3, 0, 5, 2)]


def hosts(spark, n=2):
    return spark.createDataFrame([(h, 0, None) for h in range(n)], HOSTS)


def test_lenient_gather_total_is_the_global_total(spark):
    df = frame(spark, traffic(400, seed=12))
    rules = some_rules(spark, 20).withColumn("threshold", F.lit(40).cast("bigint"))
    values = evaluate.evaluate(df, rules, 10_000)
    got = network.network_alerts(values, rules, hosts(spark))
    total = values.groupBy("rule_id", "win", *GROUP).agg(F.sum("value").alias("value")).where("value >= 40")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in total.select(got.columns).collect()}
    assert got.count() > 0


def test_strict_gather_waits_for_every_host(spark):
    values = spark.createDataFrame(
        [(0, 0, 1, 0, 0, 0, 0, 0, 9), (0, 1, 1, 0, 0, 0, 0, 0, 1), (0, 0, 2, 0, 0, 0, 0, 0, 9)],
        evaluate.VALUE,
    )
    rules = some_rules(spark, 1).withColumn("threshold", F.lit(10).cast("bigint"))
    strict = network.gather(values, rules, hosts(spark), "strict").collect()
    lenient = network.gather(values, rules, hosts(spark), "lenient").orderBy("win").collect()
    assert sorted((r.win, r.host, r.value) for r in strict) == [(1, 0, 9), (1, 1, 1)]
    assert sorted((r.win, r.host, r.value) for r in lenient) == [(1, 0, 9), (1, 1, 1), (2, 0, 9), (2, 1, 0)]
    assert network.gather(values, rules, hosts(spark), "lenient", "all_half").count() == 0
    assert {r.win for r in network.gather(values, rules, hosts(spark), "lenient", "sum").collect()} == {1}


def test_hosts_that_left_or_join_later_have_no_share(spark):
    rules = some_rules(spark, 1).withColumn("threshold", F.lit(6).cast("bigint"))
    inventory = spark.createDataFrame([(0, 0, None), (1, 0, 5), (2, 0, None), (3, 8, None)], HOSTS)
    assert {(r.host, r.local_threshold) for r in network.place(rules, inventory).collect()} == {(0, 2), (2, 2), (3, 2)}
    assert {(r.host, r.local_threshold) for r in network.place(rules, inventory, at=6).collect()} == {(0, 3), (2, 3)}
    rows = [(0, h, w, 0, 0, 0, 0, 0, 3) for w in (2, 6, 9) for h in (0, 1, 2) if not (h == 1 and w > 4)]
    values = spark.createDataFrame(rows, evaluate.VALUE)
    strict = network.gather(values, rules, inventory, "strict").collect()
    # Epoch 2: hosts 0-2 answered. Epoch 6: 1 has left. Epoch 9: 3 has joined and is silent.
    assert sorted((r.win, r.host) for r in strict) == [(2, 0), (2, 1), (2, 2), (6, 0), (6, 2)]
    lenient = network.gather(values, rules, inventory, "lenient").where("win = 9").collect()
    assert {(r.host, r.value) for r in lenient} == {(0, 3), (2, 3), (3, 0)}


@pytest.mark.parametrize("way", ["few rules", "many shapes", "salted"])
def test_cap_is_the_same_on_every_way_and_for_repeated_rows(spark, monkeypatch, way):
    if way == "many shapes":
        monkeypatch.setattr(matching, "MAX_SHAPES", 3)
        monkeypatch.setattr(matching, "few_rows", lambda df: None)
    if way == "salted":
        monkeypatch.setattr(matching, "BROADCAST_ROWS", 2)
        monkeypatch.setattr(matching, "CELL_ROWS", 5)
    flows = frame(spark, traffic(60, seed=2)).select(*FLOW).distinct()
    rules = some_rules(spark)
    lens = [f"len_{c}" for c in KEY]
    first = {}
    for r in matching.canonical(rules).orderBy("rule_id").collect():
        first.setdefault(tuple(r[c] for c in lens), r.rule_id)
    shape = {r.rule_id: first[tuple(r[c] for c in lens)] for r in matching.canonical(rules).collect()}
    hits = {}
    for *flow, rule in theta(flows, rules):
        hits.setdefault(tuple(flow), []).append(rule)
    want = {f: sorted(sorted(found, key=lambda r: (shape[r], r))[:2] * 2) for f, found in hits.items()}
    got = {}
    for r in matching.match(flows.union(flows), rules, cap=2).collect():
        got.setdefault(tuple(r[c] for c in FLOW), []).append(r.rule_id)
    assert {f: sorted(x) for f, x in got.items()} == want


def test_one_evaluation_for_all_rule_types(spark):
    df = frame(spark, traffic(400, seed=12))
    kinds = ["packet", "volume", "loss", "congestion", "burstloss"]
    rules = some_rules(spark, 10).withColumn("agg", F.element_at(F.array(*map(F.lit, kinds)), (F.col("rule_id") % 5 + 1).cast("int")))
    rules = rules.withColumns({**{f"len_{c}": F.lit(0) for c in KEY}, **{f"fg_{c}": F.lit(0) for c in KEY}})
    rules = matching.canonical(rules)
    got = evaluate.evaluate(df, rules, 10_000, gap_us=5_000)
    parts = [evaluate.evaluate(df, rules.where(F.col("agg") == k), 10_000, gap_us=5_000) for k in kinds]
    want = [tuple(r) for p in parts for r in p.select(got.columns).collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    accepted, rejects = lifecycle.add_rules(rules.limit(0), rules)
    assert accepted.count() == 10 and rejects.count() == 0
    with pytest.raises(ValueError):
        evaluate.evaluate(df, rules.withColumn("agg", F.lit("median")), 10_000)


def test_reverse_without_a_join(spark):
    rows = [packet(0, 0, 1), packet(1, 5, 2)]
    flows = flowstats.flow_epochs(frame(spark, traffic(200, seed=3) + rows), 10_000)
    both = flowstats.with_reverse(flows)
    seen = {(*[r[c] for c in FLOW], r.epoch): (r.n, r.bytes) for r in flows.collect()}
    want = {}
    for k, v in seen.items():
        host, src, dst, sp, dp, proto, epoch = k
        other = (host, dst, src, dp, sp, proto, epoch)
        if other in seen:
            want[k] = (*v, *seen[other])
    got = {(*[r[c] for c in FLOW], r.epoch): (r.n, r.bytes, r.r_n, r.r_bytes) for r in both.collect()}
    assert got == want


@pytest.mark.parametrize("active", [1, 3, 10])
def test_rearm(spark, active, cut_small):
    rnd = random.Random(active)
    points = sorted(rnd.sample(range(300), 120))
    want, until = [], None
    for p in points:
        if until is None or p >= until:
            want.append(p)
            until = p + active
    got = network.rearm(spark.createDataFrame([(p,) for p in points], "epoch bigint"), active)
    assert sorted(r.epoch for r in got.collect()) == want


def test_rule_lifetimes(spark):
    rules = some_rules(spark, 6)
    new = some_rules(spark, 8).where("rule_id >= 6").withColumn("agg", F.expr("if(rule_id = 6, 'median', agg)"))
    kept, rejects = lifecycle.add_rules(rules, new)
    assert sorted(r.rule_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert [r.rule_id for r in rejects.collect()] == [6]
    gone = rules.where("rule_id = 2")
    assert lifecycle.delete_rules(rules, gone).count() == 5
    ended = lifecycle.delete_rules(rules, gone, F.timestamp_micros(F.lit(10**15)))
    assert [r.rule_id for r in ended.where("valid_to is not null").collect()] == [2]


def test_history(spark):
    values = spark.createDataFrame([(0, 0, w, 0, 0, 0, 0, 0, w * 10) for w in (1, 2, 4)], evaluate.VALUE)
    assert {r.win: r.past_value for r in evaluate.value_ago(values, 1).collect()} == {1: 0, 2: 10, 4: 0}
    with pytest.raises(ValueError):
        evaluate.value_ago(values, 15)


def test_install_phase(spark):
    # Installed in epoch 5 with windows of three epochs: epoch 5 alone, then 6-8, 9-11.
    first = int(START.timestamp()) * 100
    rows = [packet(i, e * 10_000) for i, e in enumerate([4, 5, 6, 8, 9, 11, 12])]
    at = F.timestamp_micros(F.lit((first + 5) * 10_000))
    rules = some_rules(spark, 1).withColumns(
        {**{f"len_{c}": F.lit(0) for c in KEY}, **{f"fg_{c}": F.lit(0) for c in KEY}, "agg": F.lit("packet"),
         "interval_ms": F.lit(30).cast("bigint"), "valid_from": at}
    )
    got = evaluate.evaluate(frame(spark, rows), rules, 10_000, phase="install")
    assert {r.win: r.value for r in got.collect()} == {0: 1, 1: 2, 2: 2, 3: 1}


def test_registry(spark):
    registry.register_stat("big", lambda: F.count_if(F.col("len") > 1000))
    registry.register_rule_type("big", registry.RuleType("big", predicate=lambda value, threshold: value > threshold))
    try:
        df = frame(spark, traffic(100, seed=1))
        rules = some_rules(spark, 1).withColumns(
            {**{f"len_{c}": F.lit(0) for c in KEY}, **{f"fg_{c}": F.lit(0) for c in KEY}, "agg": F.lit("big")}
        )
        values = evaluate.evaluate(df, rules, 10**9)
        assert values.agg(F.sum("value")).first()[0] == df.where("len > 1000").count()
        assert evaluate.alerts(values, rules.withColumn("threshold", F.lit(10**6).cast("bigint"))).count() == 0
    finally:
        registry.unregister_stat("big")
        registry.unregister_rule_type("big")


def test_load_rules_shapes(spark):
    for patterns in (1, 4, 16, 64):
        rules = rulesets.load_rules(spark, 256, 8, patterns)
        lens = [f"len_{c}" for c in KEY]
        assert rules.count() == 256
        assert rules.select(*lens).distinct().count() == patterns


def test_unmatched_reverse_gives_no_congestion(spark):
    rows = [packet(0, 0, 100), packet(1, 10_000, 200)]
    assert evaluate.congestion_flows(frame(spark, rows), 10_000).count() == 0
    assert flowstats.seq_state(frame(spark, rows), 10_000).count() == 2


def test_spread_in_blocks(spark, monkeypatch):
    from flowwarden.plans import grid

    keys = spark.createDataFrame([(1,), (2,)], "k int")
    monkeypatch.setattr(grid, "BLOCK", 7)
    got = sorted(tuple(r) for r in grid.spread(keys, "n", 3, 40).collect())
    assert got == [(k, n) for k in (1, 2) for n in range(3, 41)]
    assert grid.spread(keys, "n", 3, 2).count() == 0
