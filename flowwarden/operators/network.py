"""Rules across hosts: placing them, splitting thresholds and gathering every host's value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import islands, split_hot
from ..plans.sizing import checkpointed, fits
from ..schema import GROUP
from .evaluate import epochs_per_window

KEEP_EPOCHS = 10  # fixed value: epochs a history is kept

GATHERED = ["rule_id", "win", *GROUP]


def _inventory(hosts: DataFrame) -> DataFrame:
    """All monitors in one row, by id: machine inventory, not data."""
    return hosts.agg(F.sort_array(F.collect_set(F.struct("host", "join_epoch", "left_epoch"))).alias("_all"))


def _present(at: Column) -> Column:
    """Ids of the hosts of the inventory that are joined at an epoch."""
    here = F.filter(
        "_all",
        lambda h: (h["join_epoch"].isNull() | (h["join_epoch"] <= at)) & (h["left_epoch"].isNull() | (h["left_epoch"] > at)),
    )
    return F.transform(here, lambda h: h["host"])


def place(
    rules: DataFrame, hosts: DataFrame, columns: Sequence[str] = ("rule_id", "threshold"), at: int | None = None
) -> DataFrame:
    """A row per rule and active host, with the rule's threshold split evenly (integer division).

    Active are the hosts joined at epoch `at`, or by default those that have not left.
    """
    staying = F.transform(F.filter("_all", lambda h: h["left_epoch"].isNull()), lambda h: h["host"])
    ids = staying if at is None else _present(F.lit(at))
    one_row = _inventory(hosts).select(ids.alias("_ids"))
    joined = rules.select(*columns).join(F.broadcast(one_row))
    placed = joined.select(*columns, F.size("_ids").alias("_n"), F.explode("_ids").alias("host"))
    if "threshold" not in columns:
        return placed.drop("_n")
    share = F.call_function("div", F.col("threshold"), F.col("_n").cast("bigint"))
    return placed.withColumn("local_threshold", share).drop("_n")


def gather(
    values: DataFrame,
    rules: DataFrame,
    hosts: DataFrame,
    mode: str = "strict",
    require: str | None = None,
    epoch_us: int | None = None,
) -> DataFrame:
    """A row (key, host, value) for every active host and each (rule, window, group) on which some
    host reached its share of the threshold.

    strict: emitted only when all active hosts have a value. lenient: a missing value is 0.
    require="sum": the hosts' total must reach the whole threshold; "all_half": each of the first
    two hosts must reach half of it. Active are the hosts joined in the window's last epoch; without
    `epoch_us` a window is one epoch.
    """
    if require not in (None, "sum", "all_half"):
        raise ValueError(require)
    values = checkpointed(values)  # rows per window, looked at three times below
    n = epochs_per_window(epoch_us) if epoch_us else F.lit(1).cast("bigint")
    limits = rules.select("rule_id", "threshold", n.alias("_epochs"))
    windows = values.select("rule_id", "win").distinct()
    windows = windows.join(F.broadcast(limits) if fits(limits) else limits, "rule_id").join(F.broadcast(_inventory(hosts)))
    last = (F.col("win") + 1) * F.col("_epochs") - 1
    windows = checkpointed(windows.select("rule_id", "win", "threshold", _present(last).alias("_hosts")))
    windows = F.broadcast(windows) if fits(windows) else windows

    own = values.join(windows, ["rule_id", "win"]).where(F.array_contains("_hosts", F.col("host")))
    per_key = own.groupBy(*GATHERED).agg(F.max("value").alias("_top"), F.count(F.lit(1)).alias("_n"))
    keys = per_key.join(windows, ["rule_id", "win"])
    keys = keys.where(F.col("_top") >= F.call_function("div", F.col("threshold"), F.size("_hosts").cast("bigint")))
    if mode == "strict":
        keys = keys.where(F.col("_n") == F.size("_hosts"))
    grid = keys.select(*GATHERED, "threshold", F.slice("_hosts", 1, 2).alias("_two"), F.explode("_hosts").alias("host"))
    out = grid.join(values.select(*GATHERED, "host", "value"), [*GATHERED, "host"], "left")
    out = out.withColumn("value", F.coalesce("value", F.lit(0).cast("bigint")))
    per_key = Window.partitionBy(*GATHERED)  # as many rows as hosts
    if require == "sum":
        out = out.withColumn("_total", F.sum("value").over(per_key)).where(F.col("_total") >= F.col("threshold"))
    elif require == "all_half":
        half = F.call_function("div", F.col("threshold"), F.lit(2).cast("bigint"))
        least = F.min(F.when(F.array_contains("_two", F.col("host")), F.col("value"))).over(per_key)
        out = out.withColumn("_least", least).where(F.col("_least") >= half)
    return out.select(*GATHERED, "host", "value")


def all_data(gathered: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row per gathered key with a column per host; null where the host was not active."""
    ids = sorted({r["host"] for r in hosts.select("host").distinct().collect()})  # columns need names
    wide = gathered.groupBy(*GATHERED).pivot("host", ids).agg(F.max("value"))
    return wide.select(*GATHERED, *[F.col(f"`{h}`").alias(f"host_{h}") for h in ids])


def network_alerts(values: DataFrame, rules: DataFrame, hosts: DataFrame, epoch_us: int | None = None) -> DataFrame:
    """Keys whose total over all active hosts reaches the threshold."""
    found = gather(values, rules, hosts, "lenient", "sum", epoch_us)
    return found.groupBy(*GATHERED).agg(F.sum("value").cast("bigint").alias("value"))


def schedule(rules: DataFrame, delay_us: int, joined_at: Column) -> DataFrame:
    """Rules that become valid a fixed delay after `joined_at`."""
    start = F.timestamp_micros(F.unix_micros(joined_at.cast("timestamp")) + delay_us)
    return rules.withColumn("valid_from", start)


def with_code(requests: DataFrame, values: DataFrame) -> DataFrame:
    """Answer requests for values: code 0 with the value, or code 1 where there is none."""
    key = ["rule_id", "host", "win", *GROUP]
    got = requests.join(values.select(*key, "value"), key, "left")
    return got.withColumn("code", F.when(F.col("value").isNull(), 1).otherwise(0))


def align(values: DataFrame, hosts: DataFrame, column: str = "win") -> DataFrame:
    """Turn host epochs into network epochs by adding the epoch at which the host joined."""
    offsets = hosts.select("host", "join_epoch")
    joined = values.join(F.broadcast(offsets) if fits(offsets) else offsets, "host")
    return joined.withColumn(column, F.col(column) + F.col("join_epoch")).drop("join_epoch")


def expire(values: DataFrame, n: int = KEEP_EPOCHS, now: int | None = None, column: str = "win") -> DataFrame:
    """Keep the last `n` epochs."""
    if now is not None:
        return values.where(F.lit(now) - F.col(column) < n)
    values = checkpointed(values)
    newest = values.agg(F.max(column).alias("_now"))
    return values.join(F.broadcast(newest)).where(F.col("_now") - F.col(column) < n).drop("_now")


def active_hosts(hosts: DataFrame, epoch: int) -> DataFrame:
    """How many hosts are joined at an epoch."""
    present = (F.col("join_epoch") <= epoch) & (F.col("left_epoch").isNull() | (F.col("left_epoch") > epoch))
    return hosts.agg(F.count_if(present).alias("n"))


def reset_on_leave(rules: DataFrame, hosts: DataFrame, now_us: int, epoch_us: int) -> DataFrame:
    """When any host has left, every rule ends at the first leaving."""
    left = hosts.where(F.col("left_epoch") * epoch_us <= now_us).agg(F.min("left_epoch").alias("_left"))
    end = F.timestamp_micros(F.col("_left") * epoch_us)
    ended = F.least(F.coalesce("valid_to", end), F.coalesce(end, "valid_to"))
    return rules.join(F.broadcast(left)).withColumn("valid_to", ended).drop("_left")


def rearm(triggers: DataFrame, active: int, keys: Sequence[str] = (), at: str = "epoch") -> DataFrame:
    """Triggers that take effect when one in effect suppresses all others for `active` epochs.

    Each trigger's successor is the first one at least `active` later. Those in effect are the
    ones reachable from a trigger that nothing can suppress, found by doubling the reach of the
    successor links, so the number of rounds is logarithmic in the longest chain.
    """
    keys = list(keys) or ["_all"]
    points = triggers
    if keys == ["_all"]:
        points = points.withColumn("_all", F.lit(0))
    points = checkpointed(points.select(*keys, at).distinct())
    runs = islands(split_hot(points, keys, at=at), keys, [at], at, active, "_run")
    roots = runs.where(F.col(at) == F.col("_run")).select(*keys, at)
    links = checkpointed(_successors(points, keys, active, at))
    reached = checkpointed(roots)
    fresh = reached
    while not links.isEmpty():
        step = reached.join(links, [*keys, at]).select(*keys, F.col("_next").alias(at))
        fresh = checkpointed(step.join(reached, [*keys, at], "left_anti").distinct())
        if fresh.isEmpty():
            break
        reached = checkpointed(reached.unionByName(fresh))
        second = links.select(*keys, F.col(at).alias("_next"), F.col("_next").alias("_after"))
        links = checkpointed(links.join(second, [*keys, "_next"]).select(*keys, at, F.col("_after").alias("_next")))
    return reached.drop("_all")


def _successors(points: DataFrame, keys: list[str], active: int, at: str) -> DataFrame:
    """First point at least `active` and less than 2 * `active` later.

    A point and the place it looks up are sorted together within one bucket of `active` epochs;
    when that bucket has nothing later, the first point of the next bucket is taken.
    """
    size = F.lit(active).cast("bigint")
    bucket = F.call_function("div", F.col("_pos"), size)
    there = points.select(*keys, F.col(at).alias("_pos"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias(at))
    asked = points.select(*keys, (F.col(at) + size).alias("_pos"), F.lit(0).alias("_kind"), F.col(at).cast("bigint"))
    marks = there.unionByName(asked).withColumn("_bucket", bucket)
    w = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(F.desc("_pos"), F.desc("_kind"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # Sorted downwards, the latest point passed is the first one at or after the place asked for.
    found = marks.withColumn("_here", F.min(F.when(F.col("_kind") == 1, F.col("_pos"))).over(w))
    firsts = there.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(F.min("_pos").alias("_there"))
    later = firsts.withColumn("_bucket", F.col("_bucket") - 1)
    return (
        found.where(F.col("_kind") == 0)
        .join(later, [*keys, "_bucket"], "left")
        .withColumn("_next", F.coalesce("_here", "_there"))
        .where(F.col("_next").isNotNull() & (F.col("_next") - F.col(at) < 2 * size))
        .select(*keys, at, "_next")
    )


def reactive(triggers: DataFrame, values: DataFrame, template: dict, active: int) -> DataFrame:
    """Alerts of a rule that a trigger switches on for `active` epochs.

    triggers: `epoch`s at which the causing alert held. values: rule_id, host, epoch, group key,
    value of the reacting rule as if it were always on. template: `rule_id`, `host`, `threshold`.
    """
    armed = rearm(triggers, active)
    chosen = values.where(
        (F.col("rule_id") == template["rule_id"])
        & (F.col("host") == template["host"])
        & (F.col("value") >= template["threshold"])
    )
    # Active periods do not overlap, so an epoch has at most one, and it started in the epoch's
    # bucket or the one before.
    size = F.lit(active).cast("bigint")
    spans = armed.select(
        F.col("epoch").alias("armed_at"),
        F.explode(
            F.sequence(
                F.call_function("div", F.col("epoch"), size),
                F.call_function("div", F.col("epoch") + size - 1, size),
            )
        ).alias("_bucket"),
    )
    on = chosen.withColumn("_bucket", F.call_function("div", F.col("epoch"), size)).join(spans, "_bucket")
    return on.where((F.col("epoch") >= F.col("armed_at")) & (F.col("epoch") < F.col("armed_at") + size)).drop("_bucket")


def proactive(values: DataFrame, template: dict) -> DataFrame:
    """Alerts of the same rule when it is always on."""
    return values.where(
        (F.col("rule_id") == template["rule_id"])
        & (F.col("host") == template["host"])
        & (F.col("value") >= template["threshold"])
    )
