"""Rule values per window and group, and the alerts that follow from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import epoch_of
from ..plans.grid import spread, spread_between
from ..plans.sizing import checkpointed, few_rows, fits
from ..registry import RULE_TYPES, STATS
from ..schema import FLOW, GROUP, KEY
from .flowstats import (
    BURST_GAP_US,
    BURST_MIN,
    flow_state,
    flow_table,
    retransmissions,
    timed,
    unacknowledged,
    with_epoch,
    with_reverse,
)
from .matching import match

HISTORY = 15  # fixed value: window values a rule remembers
VALUE = ["rule_id", "host", "win", *GROUP, "value"]
SPECIAL = ("unacked", "burst_lost")  # statistics that are no plain aggregates over a flow's packets
SUMMED = {s: STATS[s] for s in ("n", "bytes", "lost")}  # as they come, unless registered anew


def epochs_per_window(epoch_us: int) -> Column:
    """Length of a rule's window in epochs, at least one."""
    n = F.call_function("div", F.col("interval_ms").cast("bigint") * 1000, F.lit(epoch_us).cast("bigint"))
    return F.greatest(n, F.lit(1).cast("bigint"))


def window_of(epoch_us: int, phase: str) -> Column:
    """Window number of an epoch.

    "aligned" counts windows from epoch 0. "install" counts from the epoch a rule came in: that
    epoch alone is window 0, full windows follow it.
    """
    n = epochs_per_window(epoch_us)
    if phase == "aligned":
        return F.call_function("div", F.col("epoch"), n)
    since = F.coalesce(epoch_of("valid_from", epoch_us), F.lit(0).cast("bigint"))
    return F.call_function("div", F.col("epoch") - since + n - 1, n)


def _live(epoch_us: int) -> Column:
    since, until = epoch_of("valid_from", epoch_us), epoch_of("valid_to", epoch_us)
    return (since.isNull() | (F.col("epoch") >= since)) & (until.isNull() | (F.col("epoch") < until))


def needed_stats(rules: DataFrame) -> list[str]:
    """Statistics that the rules present ask for. A rule type that nobody registered is an error."""
    few = few_rows(rules.select("agg"))
    kinds = {r["agg"] for r in few} if few is not None else {r["agg"] for r in rules.select("agg").distinct().collect()}
    unknown = sorted(str(k) for k in kinds if k not in RULE_TYPES)
    if unknown:
        raise ValueError(f"unknown rule types: {', '.join(unknown)}")
    return sorted({RULE_TYPES[k].needs for k in kinds})


def evaluate(
    packets: DataFrame,
    rules: DataFrame,
    epoch_us: int,
    phase: str = "aligned",
    gap_us: int = BURST_GAP_US,
    min_n: int = BURST_MIN,
) -> DataFrame:
    """Values of all rules, whatever their type: rule_id, host, win, group key, value.

    Packets shrink to one row per flow and epoch before any rule is looked at, and a hot flow or
    hot group is summed before it is shuffled. `gap_us` and `min_n` say what a burst is.
    """
    stats = needed_stats(rules)
    missing = [s for s in stats if s not in STATS and s not in SPECIAL]
    if missing:
        raise ValueError(f"nobody registered the statistics {', '.join(missing)}")
    special = [s for s in stats if s in SPECIAL and s not in STATS]
    counted = [s for s in stats if s not in special]
    packets, sources = timed(packets), []
    if special:
        # the sums that come with the special statistics come from the same pass
        summed = [s for s in counted if s in SUMMED and STATS[s] is SUMMED[s]]
        counted = [s for s in counted if s not in summed]
        sources.append(flow_table(packets, epoch_us, [*special, *summed], gap_us, min_n))
    if counted or not sources:
        if "lost" in counted:
            packets = retransmissions(packets, epoch_us)
        flows = with_epoch(packets, epoch_us).groupBy(*FLOW, "epoch")
        sources.append(flows.agg(*[STATS[s]().alias(s) for s in counted or ["n"]]))
    return reduce(DataFrame.unionByName, [rule_values(flows, rules, epoch_us, phase) for flows in sources])


def keyed_values(
    flows: DataFrame, rules: DataFrame, epoch_us: int, phase: str = "aligned", carry: tuple[str, ...] = ()
) -> DataFrame:
    """What each flow and epoch adds to the windows of the rules it matches: rule_id, host, win, group, agg, `_v`, whether
    the highest value counts (`top`) or the sum, the end of the window (`ends_us`), and the columns `carry`."""
    usable = [a for a, spec in RULE_TYPES.items() if spec.needs in flows.columns]
    chosen = rules.where(F.col("agg").isin(usable))
    matched = match(flows, chosen, extra=("agg", "interval_ms", "valid_from", "valid_to")).where(_live(epoch_us))
    value, top = F.lit(None).cast("bigint"), F.lit(False)
    for agg in usable:
        value = F.when(F.col("agg") == agg, F.col(RULE_TYPES[agg].needs)).otherwise(value)
        top = top | (F.col("agg") == agg) if RULE_TYPES[agg].combine == "max" else top
    win = window_of(epoch_us, phase)
    return matched.select(
        "rule_id", "host", win.alias("win"), *GROUP, "agg", value.alias("_v"), top.alias("top"), window_ends(epoch_us, phase, win).alias("ends_us"), *carry
    )


def window_ends(epoch_us: int, phase: str, win: Column) -> Column:
    """When a window ends, in microseconds."""
    n = epochs_per_window(epoch_us)
    if phase == "aligned":
        return (win + 1) * n * epoch_us
    since = F.coalesce(epoch_of("valid_from", epoch_us), F.lit(0).cast("bigint"))
    return (since + win * n + 1) * epoch_us


def rule_values(flows: DataFrame, rules: DataFrame, epoch_us: int, phase: str = "aligned") -> DataFrame:
    """Fold the per-flow statistics in `flows` by rule, window and group."""
    keyed = keyed_values(flows, rules, epoch_us, phase)
    if set(SPECIAL) & set(flows.columns):
        keyed = keyed.where(F.col("_v").isNotNull())
    total, highest = F.sum(F.when(~F.col("top"), F.col("_v"))).cast("bigint"), F.max(F.when(F.col("top"), F.col("_v")))
    return keyed.groupBy("rule_id", "host", "win", *GROUP).agg(F.coalesce(total, highest).alias("value"))


def congestion_flows(packets: DataFrame, epoch_us: int) -> DataFrame:
    """Share of bytes in flight at the last epoch's end that this epoch did not acknowledge, in percent."""
    return with_reverse(flow_state(packets, epoch_us)).select(*FLOW, "epoch", unacknowledged().alias("unacked"))


def congestion(packets: DataFrame, rules: DataFrame, epoch_us: int) -> DataFrame:
    """Values of congestion rules: the worst flow of each group."""
    return rule_values(
        congestion_flows(packets, epoch_us), rules.where(F.col("agg") == "congestion"), epoch_us
    )


def burst_loss(
    packets: DataFrame, rules: DataFrame, epoch_us: int, gap_us: int = BURST_GAP_US, min_n: int = BURST_MIN
) -> DataFrame:
    """Values of burst-loss rules."""
    return evaluate(packets, rules.where(F.col("agg") == "burstloss"), epoch_us, gap_us=gap_us, min_n=min_n)


def with_thresholds(values: DataFrame, limits: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join the small table of thresholds; broadcast while it is known to be small."""
    return values.join(F.broadcast(limits) if fits(limits) else limits, list(on))


def alerts(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Values that reach the threshold of their rule."""
    joined = with_thresholds(values, rules.select("rule_id", "threshold", "agg"), ["rule_id"])
    return joined.where(_predicate()).select(*VALUE, "threshold")


def host_alerts(values: DataFrame, placed: DataFrame) -> DataFrame:
    """Values that reach the share of the threshold their host was given."""
    limits = placed.select("rule_id", "host", "local_threshold")
    joined = with_thresholds(values, limits, ["rule_id", "host"])
    return joined.where(F.col("value") >= F.col("local_threshold")).select(*VALUE, "local_threshold")


def _predicate() -> Column:
    """Each rule type's own test; types that do not set one share the usual comparison."""
    value, threshold = F.col("value"), F.col("threshold")
    test = value >= threshold
    for name, spec in RULE_TYPES.items():
        test = F.when(F.col("agg") == name, spec.predicate(value, threshold)).otherwise(test)
    return test


def value_ago(values: DataFrame, k: int) -> DataFrame:
    """values + past_value: the value of the same rule, host and group `k` windows earlier, 0 if none."""
    if not 0 <= k < HISTORY:
        raise ValueError(f"a rule remembers {HISTORY} windows")
    then = Window.partitionBy("rule_id", "host", *GROUP).orderBy("win").rangeBetween(-k, -k)
    return values.withColumn("past_value", F.coalesce(F.max("value").over(then), F.lit(0).cast("bigint")))


def dense_values(
    values: DataFrame, rules: DataFrame, hosts: DataFrame, wins: tuple[int, int] | None = None
) -> DataFrame:
    """Values with a row for every window: ungrouped rules on every host, grouped rules per group seen.

    Without `wins` a rule's windows go from its first value to its last.
    """
    from .network import place

    ungrouped = F.lit(True)
    for c in KEY:
        ungrouped = ungrouped & (F.col(f"fg_{c}") <= F.col(f"len_{c}"))
    always = place(rules.where(ungrouped), hosts, ("rule_id", *KEY)).select(
        "rule_id", "host", *[F.col(c).alias(f"k_{c}") for c in KEY]
    )
    kept = checkpointed(values if wins is None else values.where(F.col("win").between(*wins)))
    keys = always.unionByName(kept.select("rule_id", "host", *GROUP)).distinct()
    if wins is None:
        bounds = kept.groupBy("rule_id").agg(F.min("win").alias("_lo"), F.max("win").alias("_hi"))
        grid = spread_between(with_thresholds(keys, bounds, ["rule_id"]), "win", "_lo", "_hi")
    else:
        grid = spread(keys, "win", *wins)
    joined = grid.join(kept, ["rule_id", "host", "win", *GROUP], "left")
    return joined.select("rule_id", "host", "win", *GROUP, F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))


def rule_report(rules: DataFrame, values: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """One line per rule: filter, lengths, threshold, latest window and its total value, flows matched."""
    per_win = values.groupBy("rule_id", "win").agg(F.sum("value").cast("bigint").alias("value"))
    latest = per_win.groupBy("rule_id").agg(
        F.max("win").alias("win"), F.max_by("value", "win").alias("value")
    )
    out = rules.select("rule_id", *KEY, *[f"len_{c}" for c in KEY], "agg", "threshold").join(latest, "rule_id", "left")
    if matched is not None:
        out = out.join(matched, "rule_id", "left").withColumn(
            "n_flows", F.coalesce("n_flows", F.lit(0).cast("bigint"))
        )
    return out
