"""Registries through which users add statistics, rule types and alert callbacks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RuleType:
    """How a rule folds the per-flow statistic `needs` over the flows of a group."""

    needs: str
    combine: str = "sum"
    predicate: Callable[[Column, Column], Column] = field(default=lambda value, threshold: value >= threshold)


# Each statistic is an aggregate over the packets of a flow and epoch.
STATS: dict[str, Callable[[], Column]] = {
    "n": lambda: F.count(F.lit(1)),
    "bytes": lambda: F.sum("len").cast("bigint"),
    "lost": lambda: F.count_if("lost"),
}

RULE_TYPES: dict[str, RuleType] = {
    "packet": RuleType("n"),
    "volume": RuleType("bytes"),
    "loss": RuleType("lost"),
    "congestion": RuleType("unacked", "max"),
    "burstloss": RuleType("burst_lost"),
}

# What a user of the monitor can hook into: its start and end, a host that joins, a batch of alerts.
HOOKS: dict[str, list[Callable[[DataFrame], None]]] = {"start": [], "host_join": [], "alert": [], "finish": []}


def register_stat(name: str, fn: Callable[[], Column]) -> None:
    """`fn` returns an aggregate Column; a GROUPED_AGG pandas_udf works where no built-in does."""
    STATS[name] = fn


def unregister_stat(name: str) -> None:
    STATS.pop(name, None)


def register_rule_type(name: str, spec: RuleType) -> None:
    RULE_TYPES[name] = spec


def unregister_rule_type(name: str) -> None:
    RULE_TYPES.pop(name, None)


def hook(event: str) -> Callable[[Callable[[DataFrame], None]], Callable[[DataFrame], None]]:
    """Call a function at an event of HOOKS: with the rules at start and finish, the new hosts when hosts join, and
    every batch of alerts."""

    def add(fn: Callable[[DataFrame], None]) -> Callable[[DataFrame], None]:
        HOOKS[event].append(fn)
        return fn

    return add


def unhook(event: str, fn: Callable[[DataFrame], None]) -> None:
    HOOKS[event].remove(fn)


def fire(event: str, rows: DataFrame) -> None:
    for fn in list(HOOKS[event]):
        fn(rows)


def on_alert(fn: Callable[[DataFrame], None]) -> Callable[[DataFrame], None]:
    """Call `fn` with every batch of alerts."""
    return hook("alert")(fn)


def remove_callback(fn: Callable[[DataFrame], None]) -> None:
    unhook("alert", fn)


def notify(alerts: DataFrame) -> None:
    fire("alert", alerts)
