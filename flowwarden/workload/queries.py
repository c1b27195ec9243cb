"""Every operator as a query over the driver's tables. Oracle SQL for them is in `oracles`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as fk
from ..operators import admission, analytics, flowstats, lifecycle, matching, network, rulesets
from ..operators import evaluate as ev
from .. import registry
from ..plans import ordered
from ..plans.sizing import checkpointed, ensure_checkpoint_dir
from ..schema import FLOW, GROUP, KEY
from ..sources import frames, logs, rules_text
from ..sources.packets import write_alerts as write_alerts_to
from ..streaming import evaluate as st
from ..streaming import network as online
from ..streaming import reactions, silence, states
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GAP_US = 12 * v.HOUR_US
BURST_US = 2 * v.DAY_US
DAY0 = 19723  # 2024-01-01 as a day number


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _timed_rules(spark: SparkSession) -> DataFrame:
    """The rules, each installed on its own day for ten days."""
    start = (F.lit(DAY0) + F.col("rule_id") * 2) * F.lit(v.DAY_US)
    return v.rules(spark).withColumns(
        {"valid_from": F.timestamp_micros(start), "valid_to": F.timestamp_micros(start + 10 * v.DAY_US)}
    )


def _customer_rules(spark: SparkSession, sf: str) -> DataFrame:
    parsed = rules_text.rules_from_text(v.rule_lines(spark, sf), id_column="line_no")
    return parsed.where(~F.col("_corrupt")).drop("_corrupt", "_line")


def _flow_days(spark: SparkSession, sf: str) -> DataFrame:
    return flowstats.flow_epochs(v.packets(spark, sf), v.DAY_US)


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return ev.evaluate(v.packets(spark, sf), v.rules(spark), v.DAY_US, gap_us=BURST_US)


# Sources and sinks


@query
def rules_from_text(spark, sf):
    return rules_text.rules_from_text(v.rule_lines(spark, sf), id_column="line_no").drop(
        "valid_from", "valid_to", "_line"
    )


@query
def read_trace(spark, sf):
    return logs.trace_from_lines(v.trace_lines(spark, sf))


@query
def decode_frames(spark, sf):
    decoded = frames.decode_frames(v.frames(spark, sf))
    return decoded.select("host", "pkt_no", *KEY, "len", "seq", "ack", "_corrupt")


@query
def read_controller_log(spark, sf):
    return logs.read_controller_log(v.controller_lines(spark, sf))


@query
def read_host_log(spark, sf):
    return logs.read_host_log(v.host_lines(spark, sf))


@query
def read_run_summaries(spark, sf):
    return logs.read_run_summaries(v.run_lines(spark, sf), v.RUN_CONFIG)


# Scalar functions


@query
def ip_to_long(spark, sf):
    p = v.packets(spark, sf).select("pkt_no", fk.long_to_ip("srcip").alias("ip"))
    return p.select("pkt_no", "ip", fk.ip_to_long("ip").alias("srcip"))


@query
def prefix_mask(spark, sf):
    length = F.col("pkt_no") % 40
    return v.packets(spark, sf).select(
        "pkt_no",
        fk.prefix_mask(length, 32).alias("m32"),
        fk.prefix_mask(length, 16).alias("m16"),
        fk.prefix_mask(length, 8).alias("m8"),
    )


@query
def mask_flow(spark, sf):
    lens = {c: F.col("pkt_no") % (w + 1) for c, w in (("srcip", 32), ("dstip", 32), ("sport", 16), ("dport", 16), ("proto", 8))}
    masked = fk.mask_flow(lens)
    return v.packets(spark, sf).select("pkt_no", *[masked[c].alias(f"k_{c}") for c in KEY])


@query
def pack_granularity(spark, sf):
    lens = [F.col("pkt_no") % m for m in (33, 33, 17, 17, 9)]
    packed = v.packets(spark, sf).select("pkt_no", fk.pack_granularity(*lens).alias("packed"))
    return packed.select("pkt_no", "packed", *fk.unpack_granularity("packed"))


@query
def group_masks(spark, sf):
    lens = matching.group_lengths()
    return _customer_rules(spark, sf).select("rule_id", *[lens[c].alias(f"g_{c}") for c in KEY])


@query
def reverse_flow(spark, sf):
    return v.packets(spark, sf).select("pkt_no", *fk.reverse_flow("r_"))


@query
def flow_hash(spark, sf):
    hashed = v.packets(spark, sf).select("host", fk.flow_hash().alias("h")).distinct()
    return hashed.groupBy("host").agg(F.count(F.lit(1)).alias("n_flows"))


@query
def rule_matches(spark, sf):
    p = v.packets(spark, sf)
    # One rule against every packet: a boolean column, no join.
    r = v.RULE_ROWS[3]
    rule = F.struct(
        *[F.lit(r[i + 1][0]).cast("bigint").alias(c) for i, c in enumerate(KEY)],
        *[F.lit(r[i + 1][1]).alias(f"len_{c}") for i, c in enumerate(KEY)],
    )
    both = p.select("pkt_no", F.struct(*KEY).alias("f"), rule.alias("r"))
    return both.select("pkt_no", fk.rule_matches("f", "r").alias("matches"))


@query
def epoch_of(spark, sf):
    p = v.packets(spark, sf)
    return p.select(
        "pkt_no", fk.epoch_of("ts", 10_000).alias("epoch"), fk.size_units("len").alias("units")
    )


@query
def any_match(spark, sf):
    rules = rulesets.partition_rules(spark, 256, base="10.0.0.0", sport=2500, dport=None, interval_ms=v.DAY_MS)
    return matching.any_match(v.packets(spark, sf), rules).select("pkt_no")


# Matching and rule lifetimes


@query
def match(spark, sf):
    return matching.match(_flow_days(spark, sf), v.rules(spark))


@query
def match_cap(spark, sf):
    matched = matching.match(_flow_days(spark, sf), v.rules(spark), cap=2)
    return matched.select(*FLOW, "epoch", "rule_id")


@query
def match_mask(spark, sf):
    mask = {"srcip": 0, "dstip": 24, "sport": 0, "dport": 0, "proto": 0}
    return matching.match_mask(_flow_days(spark, sf), v.rules(spark), mask)


@query
def match_live(spark, sf):
    return matching.match_live(_flow_days(spark, sf), _timed_rules(spark), v.DAY_US)


@query
def matched_flows(spark, sf):
    flows = flowstats.session_epochs(v.packets(spark, sf), v.DAY_US)
    return matching.matched_flows(matching.match(flows, v.rules(spark)))


@query
def add_rules(spark, sf):
    rules = _customer_rules(spark, sf)
    new = rules.where("rule_id % 2 = 1").withColumn(
        "agg", F.when(F.col("rule_id") % 3 == 1, "median").otherwise(F.col("agg"))
    )
    kept, rejects = lifecycle.add_rules(rules.where("rule_id % 2 = 0"), new)
    return kept.select("rule_id", F.lit(True).alias("accepted")).unionByName(
        rejects.select("rule_id", F.lit(False).alias("accepted"))
    )


@query
def delete_rules(spark, sf):
    rules = _customer_rules(spark, sf)
    gone = rules.where("rule_id % 4 = 0").withColumn(
        "len_proto", F.when(F.col("rule_id") % 8 == 0, 0).otherwise(F.col("len_proto"))
    )
    return lifecycle.delete_rules(rules, gone).select("rule_id", *KEY)


@query
def lookup(spark, sf):
    placed = network.place(v.rules(spark), v.hosts(spark)).where((F.col("rule_id") + F.col("host")) % 2 == 0)
    return lifecycle.with_known(_values(spark, sf), placed).select(*ev.VALUE, "known")


@query
def place(spark, sf):
    return network.place(_customer_rules(spark, sf), v.hosts(spark))


# Flow statistics


@query
def flow_epochs(spark, sf):
    return _flow_days(spark, sf)


@query
def sessions(spark, sf):
    return flowstats.sessions(v.packets(spark, sf), v.DAY_US).select("pkt_no", "epoch", "session")


@query
def new_flows(spark, sf):
    return flowstats.new_flows(v.packets(spark, sf), v.DAY_US)


@query
def retransmissions(spark, sf):
    return flowstats.retransmissions(v.packets(spark, sf), 3 * v.DAY_US).select("pkt_no", "lost")


@query
def retransmitted_seqs(spark, sf):
    return flowstats.retransmitted_seqs(v.packets(spark, sf), 3 * v.DAY_US).select(*FLOW, "session", "epoch", "seq")


@query
def retransmitted_blocks(spark, sf):
    blocks = flowstats.retransmitted_blocks(v.packets(spark, sf), 3 * v.DAY_US)
    return blocks.select(*FLOW, "epoch", "block", F.concat_ws(",", F.col("seqs").cast("array<string>")).alias("seqs"))


@query
def recently_seen(spark, sf):
    # The generation length is a share of the traffic here, since the tables are short.
    return flowstats.recently_seen(v.packets(spark, sf), gen_len=500).select("pkt_no", "seen")


@query
def recently_seen_exact(spark, sf):
    return flowstats.recently_seen(v.packets(spark, sf), gen_len=500, exact=True).select("pkt_no", "seen")


@query
def seq_state(spark, sf):
    return flowstats.seq_state(v.packets(spark, sf), 2 * v.DAY_US)


@query
def ack_state(spark, sf):
    return flowstats.ack_state(v.packets(spark, sf), 2 * v.DAY_US)


@query
def dup_credit(spark, sf):
    return flowstats.dup_credit(v.packets(spark, sf), 3 * v.DAY_US).select("pkt_no", "dup")


@query
def with_reverse(spark, sf):
    both = flowstats.with_reverse(_flow_days(spark, sf))
    return both.select(*FLOW, "epoch", "n", "bytes", "r_n", "r_bytes")


@query
def bursts(spark, sf):
    return flowstats.bursts(v.packets(spark, sf), 2 * v.DAY_US)


@query
def in_burst(spark, sf):
    p = flowstats.ordered(v.packets(spark, sf))
    lost = flowstats.retransmitted_seqs(p, 3 * v.DAY_US)
    hits = flowstats.in_burst(lost, flowstats.bursts(p, 2 * v.DAY_US))
    return hits.select("pkt_no", "hit")


@query
def seq_gaps(spark, sf):
    return flowstats.seq_gaps(v.packets(spark, sf))


@query
def time_histogram(spark, sf):
    return flowstats.time_histogram(v.packets(spark, sf), 8)


# Rule values and alerts


@query
def evaluate(spark, sf):
    return _values(spark, sf)


@query
def evaluate_install_phase(spark, sf):
    return ev.evaluate(v.packets(spark, sf), _timed_rules(spark), v.DAY_US, phase="install", gap_us=BURST_US)


def _alerts(spark: SparkSession, sf: str, agg: str) -> DataFrame:
    rules = v.rules(spark).where(F.col("agg") == agg)
    return ev.alerts(ev.evaluate(v.packets(spark, sf), rules, v.DAY_US), rules)


@query
def packet_alerts(spark, sf):
    return _alerts(spark, sf, "packet")


@query
def volume_alerts(spark, sf):
    return _alerts(spark, sf, "volume")


@query
def loss_alerts(spark, sf):
    return _alerts(spark, sf, "loss")


@query
def congestion(spark, sf):
    return ev.congestion(v.packets(spark, sf), v.rules(spark), v.DAY_US)


@query
def congestion_alerts(spark, sf):
    rules = v.rules(spark)
    return ev.alerts(ev.congestion(v.packets(spark, sf), rules, v.DAY_US), rules)


@query
def burst_loss(spark, sf):
    return ev.burst_loss(v.packets(spark, sf), v.rules(spark), v.DAY_US, gap_us=2 * v.DAY_US)


@query
def host_alerts(spark, sf):
    return ev.host_alerts(_values(spark, sf), network.place(v.rules(spark), v.hosts(spark)))


@query
def value_ago(spark, sf):
    return ev.value_ago(_values(spark, sf), 2)


@query
def dense_values(spark, sf):
    return ev.dense_values(_values(spark, sf), v.rules(spark), v.hosts(spark))


@query
def rule_report(spark, sf):
    flows = flowstats.session_epochs(v.packets(spark, sf), v.DAY_US)
    matched = matching.matched_flows(matching.match(flows, v.rules(spark)))
    return ev.rule_report(v.rules(spark), _values(spark, sf), matched)


# Admission


@query
def admit(spark, sf):
    return admission.admit(v.packets(spark, sf), 640, 3 * v.DAY_US).select("pkt_no")


@query
def admit_hashed(spark, sf):
    return admission.admit(v.packets(spark, sf), 640, 3 * v.DAY_US, buckets=64).select("pkt_no")


@query
def admission_counts(spark, sf):
    return admission.admission_counts(v.packets(spark, sf), 640, 3 * v.DAY_US)


def _prediction_params(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return v.table(spark, sf, "part").select(
        F.call_function("shiftleft", F.lit(8), (k % 4).cast("int")).alias("patterns"),
        (F.lit(607) + k % 4 * 300).cast("int").alias("match_cycles"),
        ((k % 97) / F.lit(100.0)).alias("dos_share"),
        (F.lit(1.0e9) + F.col("p_retailprice") * 100000).alias("budget"),
        F.lit(100).alias("sweep"),
        F.lit(10).alias("flowlen"),
        F.lit(8).alias("matches_per_flow"),
    )


@query
def predict_threshold(spark, sf):
    return admission.predict_threshold(_prediction_params(spark, sf))


# Across hosts


def _gather(spark: SparkSession, sf: str, mode: str, require: str | None = None) -> DataFrame:
    return network.gather(_values(spark, sf), v.rules(spark), v.hosts(spark), mode, require)


@query
def gather(spark, sf):
    return _gather(spark, sf, "strict")


@query
def gather_lenient(spark, sf):
    return _gather(spark, sf, "lenient")


@query
def gather_sum(spark, sf):
    return _gather(spark, sf, "lenient", "sum")


@query
def gather_all_half(spark, sf):
    return _gather(spark, sf, "lenient", "all_half")


def _changing(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return network.gather(_values(spark, sf), v.rules(spark), v.changing_hosts(spark), mode, epoch_us=v.DAY_US)


@query
def gather_changing(spark, sf):
    """Hosts that join late and leave early: shares and completeness follow the hosts of the window."""
    return _changing(spark, sf, "strict")


@query
def gather_changing_lenient(spark, sf):
    return _changing(spark, sf, "lenient")


@query
def place_changing(spark, sf):
    return network.place(_customer_rules(spark, sf), v.changing_hosts(spark))


@query
def all_data(spark, sf):
    gathered = network.gather(_values(spark, sf), v.rules(spark), v.hosts(spark), "strict")
    return network.all_data(gathered, v.hosts(spark))


@query
def network_alerts(spark, sf):
    return network.network_alerts(_values(spark, sf), v.rules(spark), v.hosts(spark))


@query
def with_code(spark, sf):
    values = checkpointed(_values(spark, sf))
    asked = values.select("rule_id", "host", (F.col("win") - 1).alias("win"), *GROUP)
    return network.with_code(asked, values)


@query
def align(spark, sf):
    return network.align(_values(spark, sf), v.hosts(spark))


@query
def expire(spark, sf):
    daily = v.rules(spark).withColumn("interval_ms", F.lit(v.DAY_MS))
    return network.expire(ev.evaluate(v.packets(spark, sf), daily, v.DAY_US, gap_us=BURST_US))


@query
def schedule(spark, sf):
    rules = _customer_rules(spark, sf)
    joined = F.timestamp_micros(F.col("rule_id") * 5_000_000)
    timed = network.schedule(rules, 1_000_000, joined)
    return timed.select("rule_id", F.unix_micros("valid_from").alias("valid_from"))


def _event_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Every user as a monitor, present from its first day until its last."""
    days = fk.epoch_of("ts", v.DAY_US)
    return (
        v.table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("host"))
        .agg(F.min(days).alias("join_epoch"), F.max(days).alias("left_epoch"))
    )


@query
def active_hosts(spark, sf):
    return network.active_hosts(_event_hosts(spark, sf), DAY0 + 1)


@query
def reset_on_leave(spark, sf):
    ended = network.reset_on_leave(
        _customer_rules(spark, sf), _event_hosts(spark, sf), (DAY0 + 40) * v.DAY_US, v.DAY_US
    )
    return ended.select("rule_id", F.unix_micros("valid_to").alias("valid_to"))


@query
def rearm(spark, sf):
    hours = v.table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("host"), fk.epoch_of("ts", v.HOUR_US).alias("epoch")
    )
    return network.rearm(hours, 9, ["host"])


HALF_DAY_US = 12 * v.HOUR_US


def _reaction(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, dict]:
    rules = v.rules(spark).withColumn("interval_ms", F.lit(v.DAY_MS // 2))
    p = v.packets(spark, sf)
    causes = ev.congestion(p, rules.where("rule_id = 7"), HALF_DAY_US)
    held = network.gather(causes, rules, v.hosts(spark), "lenient", "all_half")
    triggers = held.select(F.col("win").alias("epoch")).distinct()
    reacting = rules.where("rule_id = 0")
    values = ev.evaluate(p, reacting, HALF_DAY_US).withColumnRenamed("win", "epoch")
    return triggers, values, {"rule_id": 0, "host": 2, "threshold": 300}


@query
def reactive(spark, sf):
    triggers, values, template = _reaction(spark, sf)
    return network.reactive(triggers, values, template, 3)


@query
def proactive(spark, sf):
    _, values, template = _reaction(spark, sf)
    return network.proactive(values, template)


# Rule sets, each evaluated on the traffic


@query
def partition_rules(spark, sf):
    rules = rulesets.partition_rules(
        spark, 256, base="10.0.0.0", sport=2500, dport=None, interval_ms=v.DAY_MS
    )
    return ev.evaluate(v.packets(spark, sf), rules, v.DAY_US)


@query
def congestion_rules(spark, sf):
    rules = rulesets.congestion_rules(spark, "10.1.0.3", interval_ms=v.DAY_MS)
    return ev.congestion(v.packets(spark, sf), rules, v.DAY_US)


@query
def udp_rule(spark, sf):
    rules = rulesets.udp_rule(spark, "10.1.0.3", port=2500, interval_ms=v.DAY_MS)
    return ev.evaluate(v.packets(spark, sf), rules, v.DAY_US)


def load_rule_matches(spark, sf, n, patterns, kind="spread"):
    rules = rulesets.load_rules(
        spark, n, 8, patterns, kind, dst="10.0.0.0", src="10.1.0.3", sport=2500, dport=50001, interval_ms=v.DAY_MS
    )
    return matching.match(_flow_days(spark, sf), rules)


def _load_values(spark, sf, kind):
    matched = load_rule_matches(spark, sf, 4096, 32, kind)
    return matched.groupBy("rule_id").agg(F.sum("n").cast("bigint").alias("value"))


@query
def load_rules(spark, sf):
    return _load_values(spark, sf, "spread")


@query
def load_rules_equal(spark, sf):
    return _load_values(spark, sf, "equal")


@query
def load_rules_all(spark, sf):
    return _load_values(spark, sf, "all")


@query
def load_rules_none(spark, sf):
    """Rules that nothing matches: a zero for each."""
    rules = rulesets.load_rules(
        spark, 4096, 8, 32, "none", dst="10.0.0.0", src="10.1.0.3", sport=2500, dport=50001, interval_ms=v.DAY_MS
    )
    found = rules.select("rule_id").join(_load_values(spark, sf, "none"), "rule_id", "left")
    return found.select("rule_id", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))


# Logs and traces


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return logs.read_controller_log(v.controller_lines(spark, sf))


@query
def gather_latency(spark, sf):
    return analytics.gather_latency(_log(spark, sf))


@query
def latency_stats(spark, sf):
    stats = analytics.latency_stats(analytics.gather_latency(_log(spark, sf)), ["event"])
    return stats.select("event", *[F.round(c, 6).alias(c) for c in stats.columns if c != "event"])


@query
def latency_cdf(spark, sf):
    return analytics.latency_cdf(analytics.gather_latency(_log(spark, sf)))


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.throughput(logs.trace_from_lines(v.trace_lines(spark, sf)), bin_ms=3_600_000)


@query
def throughput(spark, sf):
    return _series(spark, sf)


@query
def normalise(spark, sf):
    return analytics.normalise(_series(spark, sf), bias_ms=250.0, bin_ms=3_600_000)


@query
def alert_timeline(spark, sf):
    return analytics.alert_timeline(_log(spark, sf))


def _dos_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Attack runs: one per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return v.table(spark, sf, "orders").select(
        F.call_function("shiftleft", F.lit(8), (c % 4).cast("int")).alias("patterns"),
        ((k % 97) / F.lit(100.0)).alias("dos_share"),
        (k % 61 + 1).alias("dos_len"),
        (k % 10).alias("ran"),
        (c * 7 % 300).alias("loss"),
        (c % 5).alias("unfinished"),
    )


@query
def min_feasible_threshold(spark, sf):
    return analytics.min_feasible_threshold(_dos_runs(spark, sf))


def _measured(spark, sf):
    return analytics.min_feasible_threshold(_dos_runs(spark, sf), ("patterns", "dos_share"), max_loss=1e5)


@query
def min_feasible_threshold_by_pattern(spark, sf):
    return _measured(spark, sf)


@query
def threshold_error(spark, sf):
    predicted = admission.predict_threshold(_prediction_params(spark, sf))
    per_setting = predicted.groupBy("patterns", "dos_share").agg(F.min("threshold").alias("threshold"))
    error = analytics.threshold_error(_measured(spark, sf), per_setting)
    return error.select("patterns", F.round("mean_error_kb", 6).alias("mean_error_kb"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = logs.read_run_summaries(v.run_lines(spark, sf), v.RUN_CONFIG)
    return runs.withColumn("rate", F.col("offered").cast("bigint"))


@query
def max_feasible_rate(spark, sf):
    return analytics.max_feasible_rate(_runs(spark, sf))


@query
def min_feasible_size(spark, sf):
    sized = _runs(spark, sf).withColumn("size", F.lit(350) + F.pmod("pkts", F.lit(14)) * 50)
    return analytics.min_feasible_size(sized)


@query
def cycle_use(spark, sf):
    used = analytics.cycle_use(_runs(spark, sf), ["interval", "flows"])
    return used.select("interval", "flows", *[F.round(c, 3).alias(c) for c in ("cycles", "free_cycles", "sweep_cycles")])


@query
def loss_pct(spark, sf):
    k = F.col("o_orderkey")
    counters = v.table(spark, sf, "orders").select(
        k.alias("run"),
        (k + 1000).alias("pkts"),
        (k + 1000 + F.col("o_custkey")).alias("target"),
        F.lit(2_300_000_000).cast("bigint").alias("hz"),
        ((k + 1) * 1000).alias("cycles"),
        ((k + 1) * 90).alias("work_cycles"),
        (k % 100 + 1).alias("reads"),
        (k % 7).alias("rx_errors"),
        (k + 1000).alias("rx_packets"),
    )
    return analytics.loss_pct(counters)


@query
def shard_load(spark, sf):
    return analytics.shard_load(v.packets(spark, sf), 7)


# Sinks and streams. Streams run over the file once and what they wrote is returned.


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/runs/{uuid.uuid4().hex}"


@query
def write_alerts(spark, sf):
    folder = _folder(spark)
    write_alerts_to(_alerts(spark, sf, "packet"), folder)
    return spark.read.parquet(folder)


@query
def stream_packets(spark, sf):
    return st.run_to_table(v.packet_stream(spark, sf).select("pkt_no", "host", *KEY, "len", "seq", "ack"))


@query
def stream_values(spark, sf):
    values = st.stream_values(v.packet_stream(spark, sf), v.rules(spark), "6 hours")
    return st.run_to_table(values.drop("window"))


@query
def stream_alerts(spark, sf):
    return st.run_to_table(st.stream_alerts(v.packet_stream(spark, sf), v.rules(spark), "6 hours"))


@query
def stream_evaluate(spark, sf):
    folder = _folder(spark)
    v.rules(spark).write.parquet(f"{folder}/rules")
    packets = v.packet_stream(spark, sf)
    st.stream_evaluate(packets, f"{folder}/rules", v.DAY_US, "6 hours", folder).awaitTermination()
    values = spark.read.parquet(f"{folder}/values").drop("batch")
    return st.window_alerts(values, v.rules(spark).where(F.col("agg").isin("packet", "volume")), v.DAY_US)


@query
def stream_bursts(spark, sf):
    return st.run_to_table(st.stream_bursts(v.packet_stream(spark, sf), "6 hours", gap_us=2 * v.DAY_US))


@query
def stream_flow_state(spark, sf):
    """Over several files with packets out of order between them, to the end: all packets come out."""
    stream = v.packet_stream_in_files(spark, sf, _folder(spark), idle_us=4 * v.DAY_US)
    packets = states.stream_flow_state(stream, 3 * v.DAY_US, 640, "6 hours")
    return st.run_to_table(packets).select("pkt_no", "session", "lost", "dup", "admitted")


@query
def stream_flow_epochs(spark, sf):
    """Each flow's numbers and acks at the end of closed epochs, and what its opposite left unacknowledged."""
    stream = v.packet_stream_in_files(spark, sf, _folder(spark))
    flows = states.stream_flow_epochs(stream, v.DAY_US, "6 hours", gap_us=BURST_US)
    return st.run_to_table(flows).drop("closed")


def _values_online(spark: SparkSession, sf: str) -> DataFrame:
    stream = v.packet_stream_in_files(spark, sf, _folder(spark))
    return states.stream_evaluate_all(stream, v.rules(spark), v.DAY_US, "6 hours", gap_us=BURST_US)


@query
def stream_evaluate_all(spark, sf):
    """Rules of all types and intervals while the stream runs, with the value two windows before."""
    values = _values_online(spark, sf)
    return st.run_to_table(values.select(*ev.VALUE, F.col("past")[1].alias("past_value")))


@query
def stream_alerts_all(spark, sf):
    return st.run_to_table(ev.alerts(_values_online(spark, sf), v.rules(spark)))


@query
def stream_dense_values(spark, sf):
    """A value for every closed window of ungrouped rules, on every host, and for groups as long as they are remembered."""
    stream = v.packet_stream_in_files(spark, sf, _folder(spark))
    flows = states.stream_flow_epochs(stream, v.DAY_US, "6 hours", gap_us=BURST_US)
    values = silence.stream_dense_values(flows, v.rules(spark), v.hosts(spark), v.DAY_US, DAY0)
    return st.run_to_table(values.select(*ev.VALUE))


@query
def stream_punctual(spark, sf):
    """Four files that each span all time, so most packets of the later ones are late; late ones come with their delay."""
    stream = v.packet_stream_in_slices(spark, sf, _folder(spark))
    return st.run_to_table(silence.stream_punctual(stream, v.DAY_US, "6 hours"))


@query
def stream_gather(spark, sf):
    """All hosts' values while the stream runs, hosts joining and leaving; missing ones are waited for one day."""
    values = _values_online(spark, sf)
    return st.run_to_table(online.stream_gather(values, v.rules(spark), v.changing_hosts(spark), v.DAY_US, v.DAY_US).drop("closed"))


@query
def stream_react(spark, sf):
    """A congestion rule that switches on a rule for traffic of one host while the stream runs."""
    folder = _folder(spark)
    rules = v.rules(spark).withColumn("threshold", F.when(F.col("rule_id") == 0, 300).otherwise(F.col("threshold")).cast("bigint"))
    wanted = spark.range(1).selectExpr("7L as cause", "0L as rule_id", "2L as host", "3L as active")
    packets = v.packet_stream_in_files(spark, sf, _folder(spark))
    reactions.stream_react(packets, rules, wanted, HALF_DAY_US, "6 hours", folder, gap_us=BURST_US).awaitTermination()
    return spark.read.schema(reactions.ALERTS).parquet(f"{folder}/alerts").drop("batch")


def _changes(spark: SparkSession) -> DataFrame:
    """Each rule is added on its own day for ten days, and again for a day two days later; some changes change nothing."""
    log = [(0, "add"), (5, "add"), (10, "delete"), (11, "delete"), (12, "add"), (13, "delete"), (13, "delete")]
    changes = F.array(*[F.struct(F.lit(d).alias("day"), F.lit(op).alias("op")) for d, op in log])
    rows = v.rules(spark).drop("valid_from", "valid_to").select("*", F.inline(changes))
    return rows.withColumn("ts", F.timestamp_micros((F.lit(DAY0) + F.col("rule_id") * 2 + F.col("day")) * F.lit(v.DAY_US))).drop("day")


@query
def rule_changes(spark, sf):
    rules = lifecycle.lifetimes(_changes(spark))
    return rules.select("rule_id", F.unix_micros("valid_from").alias("since"), F.unix_micros("valid_to").alias("until"))


@query
def stream_rule_changes(spark, sf):
    """Counting rules added and deleted in event time, each file of packets a batch."""
    folder = _folder(spark)
    _changes(spark).where("agg in ('packet', 'volume')").write.parquet(f"{folder}/changes")
    packets = v.packet_stream_in_files(spark, sf, _folder(spark))
    reactions.stream_rule_changes(packets, f"{folder}/changes", v.DAY_US, "6 hours", folder, gap_us=BURST_US).awaitTermination()
    return spark.read.schema(reactions.VALUES).parquet(f"{folder}/values").drop("batch")


@query
def answer_requests(spark, sf):
    rules = v.rules(spark).where(F.col("rule_id").isin(0, 3))
    values = st.stream_values(v.packet_stream(spark, sf), rules, "6 hours")
    # Every event asks for the one-day, ungrouped rules on its host, in the window of its own time.
    events = v.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    asked = stream.select(
        F.explode(F.array(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("rule_id"),
        (F.col("user_id") % 4).alias("host"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return st.run_to_table(st.answer_requests(values, asked, v.DAY_US, "6 hours"))


@query
def stream_lifetimes(spark, sf):
    """Rules with lifetimes in a stream over several files, one at a time."""
    packets = v.packet_stream_in_files(spark, sf, _folder(spark))
    rules = _timed_rules(spark).withColumn("interval_ms", F.lit(v.DAY_MS))
    return st.run_to_table(st.stream_values(packets, rules, "6 hours").drop("window"))


@query
def slow_batches(spark, sf):
    """Input rows of all batches of a stream, as the listener counted them."""
    listener = st.SlowBatches(period_ms=1_000)
    spark.streams.addListener(listener)
    try:
        packets = v.packet_stream_in_files(spark, sf, _folder(spark))
        st.run_to_table(packets.select("pkt_no"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return listener.totals(spark).select("input_rows")


@query
def custom_rule_type(spark, sf):
    """A statistic and a rule type of the user's own."""
    registry.register_stat("large", lambda: F.count_if(F.col("len") > 200))
    registry.register_rule_type("large", registry.RuleType("large", predicate=lambda value, threshold: value > threshold))
    try:
        rules = v.rules(spark).withColumns({"agg": F.lit("large"), "interval_ms": F.lit(v.DAY_MS)})
        values = ev.evaluate(v.packets(spark, sf), rules, v.DAY_US)
        return ev.alerts(values, rules)
    finally:
        registry.unregister_stat("large")
        registry.unregister_rule_type("large")


@query
def alert_hooks(spark, sf):
    """What hooks at all four events were given, written by the hooks."""
    folder = _folder(spark)

    def writer(event):
        return lambda rows: rows.agg(F.lit(event).alias("event"), F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/{event}")

    fns = {event: registry.hook(event)(writer(event)) for event in registry.HOOKS}
    try:
        rules = v.rules(spark).where(F.col("agg") == "packet")
        registry.fire("start", rules)
        registry.fire("host_join", v.hosts(spark))
        registry.notify(_alerts(spark, sf, "packet"))
        registry.fire("finish", rules)
    finally:
        for event, fn in fns.items():
            registry.unhook(event, fn)
    return spark.read.parquet(f"{folder}/*")


# The same answers with every key of more than a few rows cut into pieces

CUT = ["sessions", "retransmissions", "recently_seen", "dup_credit", "bursts", "in_burst", "admit", "seq_gaps", "latency_cdf"]
CUT_ROWS = 40


def _cut(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        usual, ordered.ROWS_PER_PIECE = ordered.ROWS_PER_PIECE, CUT_ROWS
        try:
            return QUERIES[name](spark, sf)
        finally:
            ordered.ROWS_PER_PIECE = usual

    return run


QUERIES |= {f"{name}_cut": _cut(name) for name in CUT}
