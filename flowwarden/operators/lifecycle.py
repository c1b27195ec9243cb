"""Installing, removing and looking up rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import fits
from ..registry import RULE_TYPES
from ..schema import KEY
from .matching import canonical

IDENTITY = ["rule_id", *KEY, *[f"len_{c}" for c in KEY]]


def add_rules(rules: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules with the new ones, rejected rules): an unknown rule type is refused."""
    known = F.col("agg").isin(list(RULE_TYPES))
    accepted = new.where(known)
    rejects = new.where(~known | F.col("agg").isNull())
    return rules.unionByName(accepted), rejects


def delete_rules(rules: DataFrame, gone: DataFrame, at: Column | None = None) -> DataFrame:
    """Drop rules with the same id, filter and mask; with `at` they end there instead."""
    gone = canonical(gone).select(*IDENTITY).distinct()
    if at is None:
        return canonical(rules).join(gone, IDENTITY, "left_anti")
    marked = canonical(rules).join(gone.withColumn("_gone", F.lit(True)), IDENTITY, "left")
    end = F.when(F.col("_gone"), F.least(F.coalesce("valid_to", at), at)).otherwise(F.col("valid_to"))
    return marked.withColumn("valid_to", end).select(*rules.columns)


def lifetimes(changes: DataFrame) -> DataFrame:
    """Rules with valid_from and valid_to from a log of changes: ts, op ("add" or "delete") and the columns of rules.

    A rule's identity is its number, filter and mask. An addition of a rule that is installed and a deletion of one that
    is not change nothing; of changes with the same time, additions come first. A rule has a row per lifetime.
    """
    log = canonical(changes.where(F.col("op").isin("add", "delete") & F.col("ts").isNotNull()))
    then = Window.partitionBy(*IDENTITY).orderBy("ts", "op")
    later = then.rowsBetween(1, Window.unboundedFollowing)
    marked = log.withColumns(
        {"_before": F.lag("op").over(then), "_until": F.min(F.when(F.col("op") == "delete", F.col("ts"))).over(later)}
    )
    starts = marked.where((F.col("op") == "add") & ~F.col("_before").eqNullSafe("add"))
    return starts.withColumns({"valid_from": F.col("ts"), "valid_to": F.col("_until")}).drop("ts", "op", "_before", "_until")


def with_known(alerts: DataFrame, placed: DataFrame) -> DataFrame:
    """alerts + known: whether the rule is placed on the reporting host."""
    where = placed.select("rule_id", "host").distinct().withColumn("known", F.lit(True))
    where = F.broadcast(where) if fits(where) else where
    joined = alerts.join(where, ["rule_id", "host"], "left")
    return joined.select(*alerts.columns, F.coalesce("known", F.lit(False)).alias("known"))


def lookup(alerts: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts of rules placed on the reporting host, the others)."""
    marked = with_known(alerts, placed)
    return marked.where("known").drop("known"), marked.where("not known").drop("known")
