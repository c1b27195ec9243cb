"""Matching flows to prefix rules.

`key & mask(rule) = filter` mixes both sides, which leaves a planner only a nested loop. Rules
share few distinct mask shapes, so each flow is masked once per shape and looked up by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import epoch_of, mask_sql
from ..plans.sizing import BROADCAST_ROWS, checkpointed, few_rows, fits
from ..schema import GROUP, KEY, WIDTH

MAX_SHAPES = 2_048
CELL_ROWS = 1_000_000  # probes of one cell that one task may get
CAP = 16  # fixed value: rules kept per flow by a bounded match list

_LENS = [f"len_{c}" for c in KEY]
_IP_LENS = ["len_srcip", "len_dstip"]


def canonical(rules: DataFrame) -> DataFrame:
    """Clamp prefix lengths to the field widths and mask the filter."""
    lens = {p + c: f"if({p}{c} > {WIDTH[c]}, {WIDTH[c]}, cast({p}{c} as int))" for p in ("len_", "fg_") for c in KEY}
    clamped = rules.selectExpr(*[f"{lens[c]} as {c}" if c in lens else c for c in rules.columns])
    masked = {c: f"{c} & {mask_sql('len_' + c, WIDTH[c])}" for c in KEY}
    return clamped.selectExpr(*[f"{masked[c]} as {c}" if c in masked else c for c in rules.columns])


def group_lengths() -> dict[str, Column]:
    """Effective grouping lengths: the longer of granularity and filter; all-zero granularity means the filter."""
    return {c: F.greatest(F.col(f"fg_{c}"), F.col(f"len_{c}")) for c in KEY}


def _shapes(rules: DataFrame, lens: list[str], limit: int) -> tuple[list[tuple], int] | None:
    """Distinct mask shapes in order of first rule and the number of rules; None beyond `limit` shapes."""
    few = few_rows(rules.select("rule_id", *lens))
    if few is not None:
        first: dict[tuple, int] = {}
        for row in few:
            first[tuple(row[1:])] = min(row[0], first.get(tuple(row[1:]), row[0]))
        n_rules = len(few)
    else:
        per_shape = rules.groupBy(*lens).agg(F.min("rule_id"), F.count(F.lit(1)))
        found = per_shape.limit(limit + 1).collect()
        first = {tuple(row[: len(lens)]): row[len(lens)] for row in found}
        n_rules = sum(row[len(lens) + 1] for row in found)
    if len(first) > limit:
        return None
    return sorted(first, key=first.get), n_rules


def _literal_mask(length: int, bits: int) -> int:
    return ((1 << length) - 1) << (bits - length)


def _shape_number(lens: tuple) -> int:
    number = 0
    for length in lens:
        number = number * 64 + length
    return number


def _probe(flows: DataFrame, shapes: list[tuple], fields: list[str]) -> DataFrame:
    """One row per flow and mask shape, with the key masked to the shape."""
    names = ["_shape", *[f"_m_{c}" for c in fields]]
    cells = []
    for lens in shapes:
        cell = [_shape_number(lens), *[_literal_mask(n, WIDTH[c]) for n, c in zip(lens, fields)]]
        cells.append("named_struct(" + ", ".join(f"'{n}', {x}L" for n, x in zip(names, cell)) + ")")
    masked = [f"{c} & _m_{c} as _c_{c}" for c in fields]
    return flows.selectExpr("*", f"inline(array({', '.join(cells)}))").selectExpr(
        *flows.columns, "_shape", *masked
    )


def match(flows: DataFrame, rules: DataFrame, cap: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """flows + rule_id + group key, one row per flow and matching rule.

    `extra` names rule columns to carry along. `cap` keeps the first rules of each row of `flows`,
    in order of the first rule of their mask shape and of their own number; the default keeps all.
    """
    rules = canonical(rules)
    if cap:
        return _capped(flows, rules, cap, extra)
    summary = _shapes(rules, _LENS, MAX_SHAPES)
    fields = KEY
    if summary is None:
        # Address prefixes alone have at most 33 * 33 shapes; ports and protocol become a filter.
        fields = ["srcip", "dstip"]
        summary = _shapes(rules, _IP_LENS, 33 * 33)
    shapes, n_rules = summary
    if not shapes:
        # No rules: keep the schema, no rows.
        empty = flows.where(F.lit(False)).withColumns({c: F.lit(None).cast("bigint") for c in ["rule_id", *GROUP]})
        kept = [F.lit(None).cast(rules.schema[c].dataType).alias(c) for c in extra]
        return empty.select(*empty.columns, *kept)
    number = "0L"
    for c in fields:
        number = f"({number} * 64 + len_{c})"
    rest = [c for c in KEY if c not in fields]
    side = rules.selectExpr(
        f"{number} as _shape",
        "rule_id",
        *[f"{c} as _c_{c}" for c in fields],
        *[f"{c} as _f_{c}" for c in rest],
        *[f"{mask_sql('len_' + c, WIDTH[c])} as _m_{c}" for c in rest],
        *[f"{mask_sql(f'greatest(fg_{c}, len_{c})', WIDTH[c])} as _g_{c}" for c in KEY],
        *extra,
    )
    on = ["_shape", *[f"_c_{c}" for c in fields]]
    probed = _probe(flows, shapes, fields)
    if n_rules <= BROADCAST_ROWS:
        joined = probed.join(F.broadcast(side), on)
    else:
        joined = _salted_join(probed, side, on, flows.columns)
    for c in rest:
        joined = joined.where(f"{c} & _m_{c} = _f_{c}")
    out = joined.selectExpr(
        *flows.columns,
        "rule_id",
        *[f"{c} & _g_{c} as k_{c}" for c in KEY],
        *extra,
    )
    return out


def _salted_join(probed: DataFrame, side: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Probes joined with the rules of their cell. A wide rule puts every flow in one cell, so the probes of a
    cell are spread over as many salts as its size asks for, and only such cells' rules are copied."""
    cells = probed.join(side.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hot = cells.where(F.col("_n") > CELL_ROWS).select(*on, F.ceil(F.col("_n") / CELL_ROWS).cast("int").alias("_salts"))
    hot = checkpointed(hot)
    few = F.broadcast(hot) if fits(hot) else hot
    salts = F.coalesce("_salts", F.lit(1))
    spread = probed.join(few, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*columns), salts).cast("int"))
    copies = side.join(few, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return spread.drop("_salts").join(copies.drop("_salts"), [*on, "_salt"])


def _capped(flows: DataFrame, rules: DataFrame, cap: int, extra: tuple[str, ...]) -> DataFrame:
    """The first `cap` rules of every row; equal rows are matched once and repeated afterwards."""
    shapes = rules.groupBy(*_LENS).agg(F.min("rule_id").alias("_first"))
    ranked = rules.join(F.broadcast(shapes) if fits(shapes) else shapes, _LENS)
    rows = flows.groupBy(*flows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    matched = match(rows, ranked.select(*rules.columns, "_first"), extra=("_first", *extra))
    w = Window.partitionBy(*flows.columns).orderBy("_first", "rule_id")
    kept = matched.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
    kept = kept.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")))
    return kept.select(*flows.columns, "rule_id", *GROUP, *extra)


def match_mask(flows: DataFrame, rules: DataFrame, mask: dict[str, int]) -> DataFrame:
    """Flows in a cell of one mask shape, with every rule of that cell."""
    same = F.lit(True)
    for c in KEY:
        same = same & (F.col(f"len_{c}") == mask[c])
    return match(flows, canonical(rules).where(same)).drop(*GROUP)


def match_live(flow_epochs: DataFrame, rules: DataFrame, epoch_us: int) -> DataFrame:
    """Matches restricted to the epochs in which a rule is installed."""
    matched = match(flow_epochs, rules, extra=("valid_from", "valid_to"))
    since, until = epoch_of("valid_from", epoch_us), epoch_of("valid_to", epoch_us)
    live = (since.isNull() | (F.col("epoch") >= since)) & (until.isNull() | (F.col("epoch") < until))
    return matched.where(live).drop("valid_from", "valid_to")


def any_match(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """Packets that fall in at least one rule."""
    # Each distinct key is tested once, however many packets carry it.
    hits = checkpointed(match(packets.select(*KEY).distinct(), rules).select(*KEY).distinct())
    return packets.join(F.broadcast(hits) if fits(hits) else hits, KEY, "left_semi")


def matched_flows(matched: DataFrame) -> DataFrame:
    """Flow entries matched per rule; a flow that died and came back counts again."""
    entries = matched.select("rule_id", "host", *KEY, "session").distinct()
    return entries.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_flows"))
