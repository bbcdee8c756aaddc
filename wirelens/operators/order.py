"""Ordinals and running sums over whole tables: range partitions in order, each numbered on its own, then offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.functions.storage import materialize

#: The part and the place within it, as monotonically_increasing_id() has them.
PLACE_BITS = 33


def _unused(names: list[str], *wanted: str) -> list[str]:
    taken = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _placed(df: DataFrame, order: list[Column], part: str, place: str) -> DataFrame:
    """df in ranges of order, with the number of each row's range and its place in it; written, so that both stay."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = materialize(sorted_.withColumn(place, F.monotonically_increasing_id()), "ordered")
    return marked.withColumns({part: F.shiftright(place, PLACE_BITS), place: F.col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})


def _before(totals: DataFrame, part: str, sums: dict[str, str]) -> DataFrame:
    """For each range what all ranges before it add up to. A range is a task, so this has a row for each task."""
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select(part, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(out) for c, out in sums.items()]))


def numbered(df: DataFrame, order: list[Column], name: str = "ordinal", start: int = 0) -> DataFrame:
    """df with the place of each row in the order, from start on, without gaps.

    One shuffle by ranges; no task gets more than a range. Rows that order does not tell apart are numbered in no fixed
    order, and stay in one range however many they are: give columns that tell them apart.
    """
    part, place, n, before = _unused(df.columns, "part", "place", "n", "before")
    placed = _placed(df, order, part, place)
    offsets = _before(placed.groupBy(part).agg(F.count(F.lit(1)).alias(n)), part, {n: before})
    return placed.join(offsets, part).withColumn(name, F.col(before) + F.col(place) + start).drop(part, place, before)


def running(df: DataFrame, sums: dict[str, Column], order: list[Column], name: str | None = None) -> DataFrame:
    """df with running sums (each row's value included; null counts as nothing), and with ordinals under name if given.

    Sums run inside each range, and the totals of the ranges before are added. Values should be of an exact type.
    """
    part, place, n, before = _unused([*df.columns, *sums, *([name] if name else [])], "part", "place", "n", "before")
    placed = _placed(df, order, part, place)
    totals = placed.groupBy(part).agg(F.count(F.lit(1)).alias(n), *[F.sum(c).alias(f"{before}{k}") for k, c in enumerate(sums.values())])
    offsets = _before(totals, part, {n: before} | {f"{before}{k}": f"{before}{k}" for k in range(len(sums))})
    upto = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    # all sums see df's own columns, so one may have the name of another's source
    made = [(F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"{before}{k}")).alias(out) for k, (out, c) in enumerate(sums.items())]
    if name:
        made.append((F.col(before) + F.col(place)).alias(name))
    return placed.join(offsets, part).select(*[c for c in df.columns if c not in sums and c != name], *made)
