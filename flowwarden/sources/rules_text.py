"""Rule lines: `filter;sum,(volume|packet),threshold;granularity;interval`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import ip_to_long
from ..operators.matching import canonical
from ..schema import RULES, WIDTH

# Fixed format: five address and length pairs, predicate, granularity, multiple of 10 ms.
_IP = r"\d+\.\d+\.\d+\.\d+/\d{1,4}"
_NUM = r"\d{1,6}/\d{1,4}"
LINE = (
    rf"^{_IP},{_IP},{_NUM},{_NUM},{_NUM};"
    r"sum,(volume|packet),\d{1,18};"
    r"\d{1,4},\d{1,4},\d{1,4},\d{1,4},\d{1,4};"
    r"[1-9]\d{0,12}0\s*$"
)

_FIELDS = ["srcip", "dstip", "proto", "sport", "dport"]  # order within a line


def rules_from_text(lines: DataFrame, first_id: int = 0, id_column: str | None = None) -> DataFrame:
    """Parse a frame with a `value` column into rules + `_corrupt` + `_line`.

    Lines that do not parse are kept and marked, with null rule columns. Rules are numbered by
    `id_column` where given, else by Spark's monotonically increasing id.
    """
    number = F.col(id_column) if id_column else F.monotonically_increasing_id()
    # A line of the right shape has its values at fixed places between the separators.
    token = F.split(F.when(F.col("value").rlike(LINE), F.trim("value")), "[/,;]")
    raw = lines.select((number + first_id).alias("rule_id"), F.col("value").alias("_line"), token.alias("_t"))

    def at(i: int, kind: str = "int") -> Column:
        return F.get("_t", i).try_cast(kind)

    cols = {}
    for i, c in enumerate(_FIELDS):
        cols[c] = ip_to_long(F.get("_t", 2 * i)) if c.endswith("ip") else at(2 * i, "bigint")
        cols[f"len_{c}"] = at(2 * i + 1)
        cols[f"fg_{c}"] = at(13 + i)
    cols["agg"] = F.get("_t", 11)
    cols["threshold"] = at(12, "bigint")
    cols["interval_ms"] = at(18, "bigint")
    # Exploding a one-element array gives the parsed values as plain columns; filters and joins
    # on them then do not repeat the parsing.
    fields = F.struct(*[expr.alias(name) for name, expr in cols.items()])
    split = raw.select("rule_id", "_line", F.explode(F.array(fields)).alias("_r"))
    good = F.lit(True)
    for c in _FIELDS:
        good = good & (F.col(f"_r.{c}") < (1 << WIDTH[c]))
    split = split.withColumn("_corrupt", ~F.coalesce(good, F.lit(False)))
    nothing = F.lit(None).cast("timestamp")
    parsed = split.select(
        "rule_id",
        *[F.when(~F.col("_corrupt"), F.col(f"_r.{f.name}")).alias(f.name) for f in RULES if f.name in cols],
        nothing.alias("valid_from"),
        nothing.alias("valid_to"),
        "_corrupt",
        "_line",
    )
    return canonical(parsed)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of the good lines of a text file."""
    parsed = rules_from_text(spark.read.text(path))
    return parsed.where(~F.col("_corrupt")).drop("_corrupt", "_line")
