"""Rules over packet streams: event-time windows, changing rules, requests for values."""

from __future__ import annotations

import uuid
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.keys import epoch_of_us
from ..operators.evaluate import VALUE, alerts, rule_values, with_thresholds
from ..operators.flowstats import BURST_GAP_US, BURST_MIN
from ..operators.matching import match
from ..plans.sizing import ensure_checkpoint_dir
from ..registry import STATS, notify
from ..schema import FLOW, GROUP

STREAMABLE = ("packet", "volume")  # other rule types need the order of packets: see `states`


def _micros(n: int) -> str:
    return f"{n} microseconds"


def stream_flow_epochs(packets: DataFrame, epoch_us: int, watermark: str) -> DataFrame:
    """Counts per flow and closed epoch. Packets behind the watermark are dropped."""
    return (
        packets.withWatermark("ts", watermark)
        .groupBy(F.window("ts", _micros(epoch_us)), *FLOW)
        .agg(STATS["n"]().alias("n"), STATS["bytes"]().alias("bytes"))
    )


def stream_values(packets: DataFrame, rules: DataFrame, watermark: str) -> DataFrame:
    """Values of counting rules, emitted when their window closes; one aggregation per interval in use.

    Packets become one row per flow and window first, so rules are matched per flow.
    """
    rules = rules.where(F.col("agg").isin(*STREAMABLE))
    parts = []
    for interval_ms in sorted(r["interval_ms"] for r in rules.select("interval_ms").distinct().collect()):
        flows = stream_flow_epochs(packets, interval_ms * 1000, watermark)
        mine = rules.where(F.col("interval_ms") == interval_ms)
        statistic = F.when(F.col("agg") == "packet", F.col("n")).otherwise(F.col("bytes"))
        end = F.unix_micros("window.end")
        since, until = F.unix_micros("valid_from"), F.unix_micros("valid_to")
        # A rule counts in the windows that lie within its lifetime, rounded down to whole windows as in batch.
        alive = (since.isNull() | (end > since)) & (until.isNull() | (end <= until))
        values = (
            match(flows, mine, extra=("agg", "valid_from", "valid_to"))
            .where(alive)
            .groupBy("window", "rule_id", "host", *GROUP)
            .agg(F.sum(statistic).cast("bigint").alias("value"))
        )
        win = epoch_of_us(F.unix_micros("window.start"), interval_ms * 1000)
        parts.append(values.select("rule_id", "host", win.alias("win"), *GROUP, "value", "window"))
    if not parts:
        raise ValueError("no rule of a streamable type")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stream_alerts(packets: DataFrame, rules: DataFrame, watermark: str) -> DataFrame:
    values = stream_values(packets, rules, watermark)
    joined = with_thresholds(values, rules.select("rule_id", "threshold"), ["rule_id"])
    return joined.where(F.col("value") >= F.col("threshold")).select(*VALUE, "threshold")


def stream_evaluate(
    packets: DataFrame,
    rules_path: str,
    epoch_us: int,
    watermark: str,
    out: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Evaluate rules that may change while the stream runs.

    Every batch of closed epochs reads the rules afresh. Epoch values go to `out`/values and the
    alerts of one-epoch rules to `out`/alerts, in a folder per batch, so a repeated batch
    replaces its own output. `window_alerts` rolls the values up for longer intervals.
    """

    def evaluate_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rules = spark.read.parquet(rules_path)
        flows = batch.withColumn("epoch", epoch_of_us(F.unix_micros("window.start"), epoch_us)).drop("window")
        per_epoch = rules.withColumn("interval_ms", F.lit(0).cast("bigint"))
        values = rule_values(flows, per_epoch, epoch_us)
        values.write.mode("overwrite").parquet(f"{out}/values/batch={batch_id}")
        written = spark.read.parquet(f"{out}/values/batch={batch_id}")
        single = rules.where(F.col("interval_ms") * 1000 <= epoch_us)
        found = alerts(written, single)
        found.write.mode("overwrite").parquet(f"{out}/alerts/batch={batch_id}")
        notify(spark.read.parquet(f"{out}/alerts/batch={batch_id}"))

    writer = stream_flow_epochs(packets, epoch_us, watermark).writeStream.outputMode("append")
    writer = writer.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(evaluate_batch)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def window_alerts(values: DataFrame, rules: DataFrame, epoch_us: int) -> DataFrame:
    """Alerts of rules with intervals of several epochs from the epoch values a stream wrote."""
    n = F.call_function("div", F.col("interval_ms") * 1000, F.lit(epoch_us).cast("bigint"))
    lengths = rules.select("rule_id", F.greatest(n, F.lit(1).cast("bigint")).alias("_n"))
    rolled = (
        with_thresholds(values, lengths, ["rule_id"])
        .withColumn("win", F.call_function("div", F.col("win"), F.col("_n")))
        .groupBy("rule_id", "host", "win", *GROUP)
        .agg(F.sum("value").cast("bigint").alias("value"))
    )
    return alerts(rolled, rules)


def stream_bursts(
    packets: DataFrame, watermark: str, gap_us: int = BURST_GAP_US, min_n: int = BURST_MIN
) -> DataFrame:
    """Bursts as sessions. A session window also takes a packet exactly one gap later, hence gap - 1."""
    return (
        packets.withWatermark("ts", watermark)
        .groupBy(F.session_window("ts", _micros(gap_us - 1)).alias("session"), *FLOW)
        .agg(
            F.min("seq").alias("seq1"),
            F.max("seq").alias("seq2"),
            F.count(F.lit(1)).alias("n"),
            F.min(F.unix_micros("ts")).alias("t0"),
            F.max(F.unix_micros("ts")).alias("t1"),
        )
        .where(F.col("n") > min_n)
        .select(*FLOW, F.col("t0").alias("burst"), "seq1", "seq2", "n", "t0", "t1")
    )


def answer_requests(values: DataFrame, requests: DataFrame, interval_us: int, watermark: str) -> DataFrame:
    """Answer requests for values of windows that may not be closed yet.

    requests: rule_id, host, ts (any time inside the window asked for). A request waits in state
    until the window closes; both sides are dropped behind the watermark.
    """
    asked = requests.withWatermark("ts", watermark).select(
        "rule_id", "host", F.window("ts", _micros(interval_us)).alias("window")
    )
    return asked.join(values, ["rule_id", "host", "window"]).select(*VALUE)


class SlowBatches(StreamingQueryListener):
    """Counts trigger periods missed because a batch took longer than one period.

    Totals are kept for every run, and the latest `recent` batches of it.
    """

    def __init__(self, period_ms: int, recent: int = 1_000) -> None:
        self.period_ms = period_ms
        self.recent = recent
        self.runs: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = int(p.durationMs.get("triggerExecution", 0))
        skipped = max(0, took - 1) // self.period_ms
        run = self.runs.setdefault(str(p.runId), {"totals": [0, 0, 0, 0], "rows": deque(maxlen=self.recent)})
        run["totals"] = [a + b for a, b in zip(run["totals"], (1, int(p.numInputRows), took, skipped))]
        run["rows"].append((str(p.runId), int(p.batchId), int(p.numInputRows), took, skipped))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def metrics(self, spark: SparkSession) -> DataFrame:
        """The latest batches of all runs."""
        rows = [r for run in self.runs.values() for r in run["rows"]]
        return spark.createDataFrame(rows, "run string, batch bigint, input_rows bigint, took_ms bigint, skipped bigint")

    def totals(self, spark: SparkSession) -> DataFrame:
        """All batches of each run, summed."""
        rows = [(name, *run["totals"]) for name, run in self.runs.items()]
        return spark.createDataFrame(rows, "run string, batches bigint, input_rows bigint, took_ms bigint, skipped bigint")


def run_to_table(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now and return what it wrote."""
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
