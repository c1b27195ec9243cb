"""Gathering between hosts while the stream runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import epochs_per_window
from ..operators.network import GATHERED
from ..plans.sizing import few_rows, fits
from .states import CHUNK, Buckets, _with_rocksdb, bucket_of, plain_rows

MAX_HOSTS = 100_000  # monitors whose times of joining and leaving go to the tasks: machine inventory, not data
_OUT = ["closed", *GATHERED, "host", "value", "code", "complete"]


class GatherState(Buckets):
    """Hosts' values of rules, windows and groups in; all active hosts' out once one of them reached its share.

    Rows go out as soon as every active host has answered. What is still missing when `timeout_us` have passed since the
    window's end is said with code 1. A key is [hosts' values, threshold, last epoch, window's end].
    """

    def __init__(self, inventory: list[tuple], timeout_us: int) -> None:
        self.inventory, self.timeout_us = inventory, timeout_us
        self.active: dict[int, list] = {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self.known()
        told = {}
        for row in plain_rows(rows, [*GATHERED, "host", "value", "threshold", "last_epoch", "ends_us"]):
            own, (host, value, *window) = row[:-5], row[-5:]
            state = told[own] = known.setdefault(own, [{}, *window])
            state[0][str(host)] = value
            state[1:] = window
        yield from self.answers(known, timer, list(told), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, timer = self.known()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        over = [own for own, state in known.items() if state[3] + self.timeout_us <= now]
        yield from self.answers(known, timer, over, timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def answers(self, known: dict[tuple, list], timer: int | None, asked: list[tuple], timerValues, fired: int | None = None) -> Iterator[pd.DataFrame]:
        """Rows of the keys `asked` that are complete, or timed out if a timer `fired`; these are forgotten."""
        now, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        for own in asked:
            found, threshold, last, ends = known[own]
            active = self.active_at(last)
            values = [found.get(str(h)) for h in active]
            there = [v for v in values if v is not None]
            complete = len(there) == len(active)
            if there and max(there) >= threshold // len(active) and (complete or fired is not None):
                at = pd.Timestamp(max(ends, now), unit="us")
                out += [(at, *own, h, v or 0, int(v is None), complete) for h, v in zip(active, values)]
                if complete and fired is None:
                    del known[own]
            if fired is not None:
                del known[own]
            if len(out) >= CHUNK:
                yield pd.DataFrame(out, columns=_OUT)
                out = []
        due = min((state[3] for state in known.values()), default=0) + self.timeout_us
        self.keep(known, timer, due // 1000 - 1, fired)
        if out:
            yield pd.DataFrame(out, columns=_OUT)

    def active_at(self, epoch: int) -> list:
        if epoch not in self.active:
            self.active = {epoch: [h for h, since, until in self.inventory if (since is None or since <= epoch) and (until is None or until > epoch)]}
        return self.active[epoch]


def stream_gather(values: DataFrame, rules: DataFrame, hosts: DataFrame, epoch_us: int, timeout_us: int) -> DataFrame:
    """rule_id, win, group, host, value, code, complete of every (rule, window, group) on which some host reached its share
    of the threshold, a row per host active in the window's last epoch; `values` come from `stream_rule_values`.

    Where all active hosts had a value, rows come at once and `complete` is true: these are the rows of a strict gather. A
    host without a value has code 1 and value 0, and the rows wait for `timeout_us` after the window's end: with these it
    is the lenient gather.
    """
    inventory = few_rows(hosts.select("host", "join_epoch", "left_epoch").distinct().orderBy("host"), MAX_HOSTS)
    if inventory is None:
        raise ValueError(f"more than {MAX_HOSTS} hosts")
    limits = rules.select("rule_id", "threshold", epochs_per_window(epoch_us).alias("_n"))
    last = (F.col("win") + 1) * F.col("_n") - 1
    rows = values.join(F.broadcast(limits) if fits(limits) else limits, "rule_id")
    rows = rows.select("closed", *GATHERED, "host", "value", "threshold", last.alias("last_epoch"), ((last + 1) * epoch_us).alias("ends_us"), bucket_of(GATHERED))
    fields = ", ".join(f"{c} bigint" for c in GATHERED)
    return (
        _with_rocksdb(rows)
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=GatherState([tuple(r) for r in inventory], timeout_us),
            outputStructType=f"closed timestamp, {fields}, host bigint, value bigint, code int, complete boolean",
            outputMode="append",
            timeMode="eventTime",
            eventTimeColumnName="closed",
        )
    )
