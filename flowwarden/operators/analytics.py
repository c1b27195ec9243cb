"""Tables over monitoring logs, traces and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.grid import spread
from ..plans.ordered import before, split_hot

# Message codes used below, controller clock in cycles per millisecond.
ASK, SATISFIED, RETURNED, ALL_DATA = 1, 2, 3, 5
CYCLES_PER_MS = 2.6e6
DELTAS = ["first_ask", "last_ask", "last_sat", "last_return"]


def gather_latency(log: DataFrame, n_hosts: int = 4) -> DataFrame:
    """Cycles from the first alert to each later step, for gathers in which every host alerted."""

    def at(kind: int) -> Column:
        return F.when(F.col("type") == kind, F.col("time"))

    groups = log.groupBy("event", "epoch").agg(
        F.count_if(F.col("type") == SATISFIED).alias("_n"),
        F.min(at(SATISFIED)).alias("_t0"),
        F.min(at(ASK)).alias("_first_ask"),
        F.max(at(ASK)).alias("_last_ask"),
        F.max(at(SATISFIED)).alias("_last_sat"),
        F.min(at(ALL_DATA)).alias("_ready"),
        F.max(at(RETURNED)).alias("_last_return"),
    )
    whole = F.col("_n") == n_hosts
    for c in ("_first_ask", "_ready", "_last_return"):
        whole = whole & F.col(c).isNotNull()
    return groups.where(whole).select(
        "event", "epoch", *[(F.col(f"_{c}") - F.col("_t0")).alias(c) for c in DELTAS]
    )


def latency_stats(latencies: DataFrame, by: Sequence[str] = (), cycles_per_ms: float = CYCLES_PER_MS) -> DataFrame:
    """Mean and sample standard deviation of each delta in milliseconds."""
    ms = {c: F.col(c) / F.lit(cycles_per_ms) for c in DELTAS}
    return latencies.groupBy(*by).agg(
        *[F.avg(v).alias(f"mean_{c}") for c, v in ms.items()],
        *[F.stddev_samp(v).alias(f"std_{c}") for c, v in ms.items()],
    )


def latency_cdf(latencies: DataFrame, column: str = "last_return") -> DataFrame:
    """Share of gathers at or below each value; counted per value, then summed along the values."""
    counts = latencies.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    keyed = split_hot(counts.withColumn("_all", F.lit(0)), ["_all"], at="value")
    below = before(keyed, ["_all"], ["value"], F.col("_n"), "sum", "_below")
    total = F.lit(counts.agg(F.sum("_n").alias("n")).first()["n"] or 0).cast("bigint")
    upto = F.coalesce("_below", F.lit(0).cast("bigint")) + F.col("_n")
    return below.select("value", (upto / total).alias("cdf"))


def throughput(trace: DataFrame, bin_ms: int = 10, pad_bins: int = 20, without_src: int | None = 3) -> DataFrame:
    """Bytes per time bin, source and protocol, with the empty bins.

    Bins start at the first packet and run `pad_bins` beyond the last. `without_src` drops the
    receiver's own packets.
    """
    if without_src is not None:
        trace = trace.where(F.col("src") != without_src)
    us = F.round(F.col("t") * 1e6).cast("bigint")
    trace = trace.withColumn("_us", us)
    span = trace.agg(F.min("_us").alias("lo"), F.max("_us").alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    width = bin_ms * 1000
    binned = (
        trace.withColumn("bin", F.call_function("div", F.col("_us") - F.lit(lo), F.lit(width).cast("bigint")))
        .groupBy("bin", "src", "proto")
        .agg(F.sum("len").cast("bigint").alias("bytes"))
    )
    bins = (hi - lo) // width + 1 + pad_bins
    grid = spread(trace.select("src", "proto").distinct(), "bin", 0, bins - 1)
    joined = grid.join(binned, ["bin", "src", "proto"], "left")
    return joined.select("bin", "src", "proto", F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes"))


def normalise(series: DataFrame, bias_ms: float = 0.0, bin_ms: int = 10, start_ms: float = 0.0) -> DataFrame:
    """Series + mid_ms (bin middle, shifted to the other clock) + level (share of 1.1 times the peak)."""
    peak = series.agg(F.max("bytes").alias("m")).first()["m"] or 1
    middle = (F.col("bin") + F.lit(0.5)) * F.lit(float(bin_ms)) + F.lit(float(start_ms)) + F.lit(float(bias_ms))
    return series.withColumns({"mid_ms": middle, "level": F.col("bytes") / F.lit(peak * 1.1)})


def alert_timeline(log: DataFrame, cycles_per_ms: float = CYCLES_PER_MS, last_fixed_event: int = 2) -> DataFrame:
    """Alerts in milliseconds since the log began; events beyond the fixed ones were set off by others."""
    start = log.agg(F.min("time").alias("t")).first()["t"] or 0
    return log.where(F.col("type") == SATISFIED).select(
        ((F.col("time") - F.lit(start)) / F.lit(cycles_per_ms)).alias("ms"),
        "server",
        "event",
        F.when(F.col("event") > last_fixed_event, "reactive").otherwise("fixed").alias("kind"),
    )


def min_feasible_threshold(
    runs: DataFrame,
    keys: Sequence[str] = ("dos_share",),
    max_loss: float = 100,
    max_unfinished: int = 2,
    ran: str = "ran",
    value: str = "dos_len",
) -> DataFrame:
    """Smallest threshold per setting that ran without notable loss or unfinished sweeps."""
    fine = (F.col(ran) > 0) & (F.col("loss") < max_loss) & (F.col("unfinished") < max_unfinished)
    return runs.where(fine).groupBy(*keys).agg(F.min(value).alias("threshold"))


def threshold_error(measured: DataFrame, predicted: DataFrame, unit_kb: float = 64 / 1000) -> DataFrame:
    """Mean of measured minus predicted threshold per pattern count, in kilobytes."""
    pred = predicted.select("patterns", "dos_share", F.col("threshold").alias("_predicted"))
    both = measured.join(pred, ["patterns", "dos_share"])
    diff = F.avg(F.col("threshold") - F.col("_predicted")) * F.lit(unit_kb)
    return both.groupBy("patterns").agg(diff.alias("mean_error_kb"))


def max_feasible_rate(runs: DataFrame, keys: Sequence[str] = ("interval", "flows", "rules_per_flow", "run")) -> DataFrame:
    """Highest rate without an unfinished sweep."""
    return runs.where(F.col("notfinished") == 0).groupBy(*keys).agg(F.max("rate").alias("rate"))


def min_feasible_size(runs: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Smallest packet size without an unfinished sweep."""
    return runs.where(F.col("notfinished") == 0).groupBy(*keys).agg(F.min("size").alias("size"))


def loss_pct(counters: DataFrame) -> DataFrame:
    """Loss percentages and per-packet rates of a run from its raw counters."""
    pkts = F.col("pkts").cast("double")
    return counters.select(
        "run",
        (100 * (1 - pkts / F.col("target"))).alias("loss_pct"),
        (F.col("hz") * pkts / F.col("cycles")).alias("rate"),
        (F.col("work_cycles") / pkts).alias("cycles_per_pkt"),
        (pkts / F.col("reads")).alias("pkts_per_read"),
        (100 * (F.col("rx_errors") / (F.col("rx_errors") + F.col("rx_packets") + 1).cast("double"))).alias("rx_loss_pct"),
    )


def shard_load(packets: DataFrame, n: int) -> DataFrame:
    """Packets per worker when workers are chosen by destination."""
    return packets.groupBy(F.pmod("dstip", F.lit(n).cast("bigint")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def cycle_use(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean total, free and sweep cycles per setting."""
    return runs.groupBy(*keys).agg(
        F.avg("cycles").alias("cycles"), F.avg("zerots").alias("free_cycles"), F.avg("sweep_ticks").alias("sweep_cycles")
    )
