"""Rules that come and go while the stream runs: switched on by alerts, or changed by a log of additions and deletions.

Epochs are closed as a whole and in order, so a batch knows all alerts up to its last epoch before it asks which rules
were in effect in it. What a rule does therefore depends on the times of packets and changes only, not on the batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluate import VALUE, alerts, rule_values, with_thresholds
from ..operators.flowstats import BURST_GAP_US, BURST_MIN
from ..operators.lifecycle import lifetimes
from ..plans.sizing import checkpointed, few_rows
from ..registry import notify
from ..schema import GROUP
from .states import stream_flow_epochs

ARMED = "rule_id bigint, host bigint, active bigint, last bigint, starts array<bigint>"
VALUES = ", ".join(f"{c} bigint" for c in VALUE)
ALERTS = f"{VALUES}, threshold bigint, armed_at bigint"


def armed_epochs(triggers: DataFrame, before: DataFrame) -> DataFrame:
    """The epochs at which reactions are switched on: those of a trigger when the reaction is not in effect.

    triggers: rule_id, host, active, epoch (null: none). before: the table this returned for the epochs before. A row per
    rule and host, with the `starts` among the triggers and the `last` start of all; `starts` has an entry per epoch at most.
    """
    both = triggers.withColumn("last", F.lit(None).cast("bigint")).unionByName(
        before.drop("starts").withColumn("epoch", F.lit(None).cast("bigint"))
    )
    keys = both.groupBy("rule_id", "host").agg(
        F.max("active").alias("active"), F.max("last").alias("_before"), F.sort_array(F.collect_set("epoch")).alias("_epochs")
    )
    start = F.struct(F.col("_before").alias("last"), F.array().cast("array<bigint>").alias("starts"))

    def step(known, epoch):
        off = known["last"].isNull() | (epoch >= known["last"] + F.col("active"))
        return F.when(off, F.struct(epoch.alias("last"), F.concat(known["starts"], F.array(epoch)).alias("starts"))).otherwise(known)

    done = keys.withColumn("_done", F.aggregate("_epochs", start, step))
    return done.select("rule_id", "host", "active", F.col("_done.last").alias("last"), F.col("_done.starts").alias("starts"))


def in_effect(found: DataFrame, armed: DataFrame, before: DataFrame) -> DataFrame:
    """found + armed_at, of the rows whose rule was switched on for their host in their window."""
    spans = armed.select("rule_id", "host", "active", F.explode("starts").alias("armed_at"))
    spans = spans.unionByName(before.where("last is not null").select("rule_id", "host", "active", F.col("last").alias("armed_at")))
    spans = spans.withColumnRenamed("host", "_host")
    on = with_thresholds(found, spans, ["rule_id"])
    there = F.col("_host").isNull() | (F.col("_host") == F.col("host"))
    then = (F.col("win") >= F.col("armed_at")) & (F.col("win") < F.col("armed_at") + F.col("active"))
    return on.where(there & then).select(*found.columns, "armed_at")


def _each_batch(
    flows: DataFrame, out: str, work: Callable[[SparkSession, DataFrame, Callable[[str, int], str], int], None], trigger: dict | None
) -> StreamingQuery:
    """Run `work` on the closed epochs of each batch, from a folder of that batch."""

    def folder(name: str, batch_id: int) -> str:
        return f"{out}/{name}/batch={batch_id}"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.drop("closed").write.mode("overwrite").parquet(folder("flows", batch_id))
        work(spark, spark.read.schema(batch.drop("closed").schema).parquet(folder("flows", batch_id)), folder, batch_id)

    writer = flows.writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(run)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_react(
    packets: DataFrame, rules: DataFrame, reactions: DataFrame, epoch_us: int, watermark: str, out: str,
    gap_us: int = BURST_GAP_US, min_n: int = BURST_MIN, trigger: dict | None = None,
) -> StreamingQuery:
    """Rules that an alert switches on for some epochs, from the epoch of the alert on.

    reactions: cause (a rule's number), rule_id (of the rule it switches on), host (null: on all hosts), active (epochs). An
    alert while the rule is on starts nothing; after `active` epochs the rule is off until the next alert. A rule that is
    off is not matched. All rules here have windows of one epoch. `out`/causes has the causing alerts, `out`/armed what was
    switched on, `out`/alerts those of the rules switched on with `armed_at`, each in a folder per batch: a repeated
    batch replaces its own output and continues from the batch before.
    """
    # Batches ask for these again and again, so they are made once.
    rules = checkpointed(rules.withColumn("interval_ms", F.lit(0).cast("bigint")))
    reactions = checkpointed(reactions)
    causes = checkpointed(rules.join(reactions.select(F.col("cause").alias("rule_id")).distinct(), "rule_id", "left_semi"))
    base = reactions.select("rule_id", "host", "active", F.lit(None).cast("bigint").alias("epoch")).distinct()

    def work(spark: SparkSession, flows: DataFrame, folder: Callable[[str, int], str], batch_id: int) -> None:
        def kept(df: DataFrame, name: str, schema: str) -> DataFrame:
            df.write.mode("overwrite").parquet(folder(name, batch_id))
            return spark.read.schema(schema).parquet(folder(name, batch_id))

        held = kept(alerts(rule_values(flows, causes, epoch_us), causes), "causes", f"{VALUES}, threshold bigint")
        asked = held.select(F.col("rule_id").alias("cause"), F.col("win").alias("epoch")).distinct()
        triggers = asked.join(reactions, "cause").select("rule_id", "host", "active", "epoch").unionByName(base)
        before = spark.read.schema(ARMED).parquet(folder("armed", batch_id - 1)) if batch_id else spark.createDataFrame([], ARMED)
        armed = kept(armed_epochs(triggers, before), "armed", ARMED)
        first = flows.agg(F.min("epoch")).first()[0]
        on = armed.where((F.size("starts") > 0) | (F.col("last") + F.col("active") > F.lit(first))).select("rule_id").distinct()
        few = few_rows(on)
        reacting = rules.join(on, "rule_id", "left_semi") if few is None else rules.where(F.col("rule_id").isin([r[0] for r in few]))
        found = kept(in_effect(alerts(rule_values(flows, reacting, epoch_us), reacting), armed, before), "alerts", ALERTS)
        notify(found)

    return _each_batch(stream_flow_epochs(packets, epoch_us, watermark, gap_us, min_n), out, work, trigger)


def stream_rule_changes(
    packets: DataFrame, changes_path: str, epoch_us: int, watermark: str, out: str,
    gap_us: int = BURST_GAP_US, min_n: int = BURST_MIN, trigger: dict | None = None,
) -> StreamingQuery:
    """Values per epoch of rules that are added and deleted by a log, in the epochs in which they were installed.

    `changes_path` is a table (see `lifecycle.lifetimes`) that may grow while the stream runs. It is read when epochs are closed, so
    a change counts from its own time on if it is there by the time the watermark passes its epoch, whatever the batches; one
    that comes later counts in the epochs closed after it came. Only rules with a lifetime in the batch's epochs are matched.
    `out`/values has a folder per batch.
    """

    def work(spark: SparkSession, flows: DataFrame, folder: Callable[[str, int], str], batch_id: int) -> None:
        rules = lifetimes(spark.read.parquet(changes_path)).withColumn("interval_ms", F.lit(0).cast("bigint"))
        span = flows.agg(F.min("epoch").alias("lo"), (F.max("epoch") + 1).alias("hi"))
        since, until = F.unix_micros("valid_from"), F.unix_micros("valid_to")
        alive = (since < F.col("hi") * epoch_us) & (until.isNull() | (until > F.col("lo") * epoch_us))
        rules = rules.join(F.broadcast(span), alive).drop("lo", "hi")
        rule_values(flows, rules, epoch_us).select("rule_id", "host", "win", *GROUP, "value").write.mode("overwrite").parquet(folder("values", batch_id))

    return _each_batch(stream_flow_epochs(packets, epoch_us, watermark, gap_us, min_n), out, work, trigger)
