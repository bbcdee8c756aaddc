"""Shared building blocks: tables in the shared folder, skew-proof joins, run-wise grouping, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions.storage import materialize, new_path, shared_dir
from wirelens.operators.graph import components

__all__ = ["components", "fresh", "grouped_runs", "local_roots", "materialize", "new_path", "runs", "shared_dir", "skew_join"]

#: A key with at least this share of all rows counts as heavy, so that there are at most 1 / share heavy keys.
HEAVY_SHARE = 1 / 500
HEAVY_LEAST = 50


def fresh(name: str, taken: list[str]) -> str:
    """A column name that clashes with none of those taken."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def skew_join(big: DataFrame, small: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """Join big to small (one row for each key, with the key's row count in big) without one task getting a heavy key.

    Keys with at least HEAVY_SHARE of the rows go by broadcast: there are at most 1 / HEAVY_SHARE of them,
    whatever the input's size. All others go by an ordinary shuffled join. small must be cheap to read twice.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    bound = max(HEAVY_LEAST, total * HEAVY_SHARE)
    heavy = F.broadcast(small.where(F.col(count) >= bound).drop(count))
    light = small.where(F.col(count) < bound).drop(count)
    marks = heavy.select(key)
    hot = big.join(heavy, key, "inner")
    cold = big.join(marks, key, "left_anti").join(light, key, how)
    return hot.unionByName(cold)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole runs of equal keys from batches sorted by key (long, not null): tables with each run's start and end.

    A run that spans batches is held until it ends, so memory holds a batch and the longest run.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut == 0 and held and keys[0] == last:
            held.append(batch)
            continue
        if whole := [*held, *([batch.slice(0, cut)] if cut else [])]:
            yield _marked(pa.Table.from_batches(whole), key)
        held, last = [batch.slice(cut)], keys[-1]
    if held:
        yield _marked(pa.Table.from_batches(held), key)


def _marked(table: pa.Table, key: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    keys = table.column(key).to_numpy()
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return table, start, np.r_[start[1:], len(keys)] if len(keys) else start


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indices over the links a-b (within one bounded group)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def grouped_runs(df: DataFrame, key: str, order: list[str], function: Callable, schema: str) -> DataFrame:
    """Deal rows out by key, sort, and give function the whole runs of each key as runs() does."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start, end in runs(batches, key):
            yield from function(table, start, end)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(over, schema)
