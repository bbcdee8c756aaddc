"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample of vectors serves as pivots. Every vector is described by its PREFIX nearest pivots; two vectors are
candidates if they share at least two of them, so inverted lists are kept by pairs of pivots. Within a list candidates
are verified by their cosine. A verified pair is counted only in the list of the two least pivots that it shares, so
links are counted without ever writing pairs; for components a list emits a spanning forest of its links.

The number of pivots grows with the square root of the vectors (up to MAX_PIVOTS), which keeps lists short. A list of
more than LIST_BLOCK vectors is dealt out as pairs of blocks, so no list is compared in one task and none is cut.

Where vectors are dense, many pivots lie among them and noise decides which are nearest; so that no link is lost there,
dense places have centres, pivots with over DENSE others within the cosine CORE. A vector within CORE of a centre belongs
to the core of its nearest one, and is in no pivot list; a centre's list holds its core and, by the triangle inequality of
angles, every vector that a core's vector could link to. Links of core vectors are all found. Other vectors are described
by the centres and the pivots outside of cores.

Equal vectors are one class from the start. Links between vectors outside of cores are approximate: README has measured
recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import components, grouped_runs, local_roots, materialize, skew_join

THRESHOLD = 0.95
PREFIX = 7
LEAST_PIVOTS, MAX_PIVOTS = 256, 65_536
LIST_BLOCK = 2048
#: A centre has over DENSE pivots within the cosine CORE: DENSE pivots are so few that two prefixes of them share two.
CORE, DENSE = 0.7, 12
#: Blocks of a centre's list grow up to this size, so that a large list is written in fewer copies.
CORE_BLOCK = 8192


def n_pivots(n: int) -> int:
    return max(LEAST_PIVOTS, min(MAX_PIVOTS, math.isqrt(4 * n)))


def unit_rows(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of length 1 in double precision; shorter ones are filled with zeros."""
    rows = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        rows[k, : len(v)] = v
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key) of every row and (key, cid, n, embedding) of every distinct usable vector, both written.

    A vector is usable if it is not null, not empty, has only finite components and is not all zero; key is null for
    the others.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    keyed = materialize(vectors.select("vec_id", "embedding", F.when(F.coalesce(finite, F.lit(False)), F.sha2(e.cast("string"), 256)).alias("key")), "vectors")
    found = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n"), F.any_value("embedding").alias("embedding"))
    return keyed.select("vec_id", "key"), materialize(found, "vector-classes")


def dense_centres(pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pivots that are centres, the densest first, and of those that are within CORE of no centre."""
    near = lambda own, other: pivots[own] @ pivots[other].T >= CORE
    left = np.arange(len(pivots))
    counts = np.concatenate([near(left[i : i + 1024], left).sum(axis=1) for i in range(0, len(left), 1024)])
    centres = []
    while len(left) and counts[left].max() > DENSE:
        centre = left[counts[left].argmax()]
        centres.append(centre)
        inside = (pivots[left] @ pivots[centre] >= CORE) | (left == centre)
        gone, left = left[inside], left[~inside]
        for i in range(0, len(gone), 1024):
            counts[left] -= near(gone[i : i + 1024], left).sum(axis=0)
    return np.array(centres, np.int64), left


def describe(classes: DataFrame, pivots: np.ndarray, prefix: int = PREFIX, centres: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """cid, n, vector (unit length, 64-bit floats as bytes), nearest (ascending pivot numbers), home (the number of the
    centre that it is in the core of, or how many centres there are) and lists of every class; those of centres are negative."""
    centres = np.zeros((0, pivots.shape[1])) if centres is None else centres
    shared = classes.sparkSession.sparkContext.broadcast((pivots, centres))
    reach = np.cos(min(np.pi, np.arccos(CORE) + np.arccos(threshold))) - 1e-9

    def homes(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        if not len(centres):
            return np.zeros(len(rows), np.int64), [np.zeros(0, np.int64)] * len(rows)
        alike, number = rows @ centres.T, np.arange(len(centres))
        home = np.where(alike.max(axis=1) >= CORE, alike.argmax(axis=1), len(centres))
        # a link is counted at the lesser of its two homes, so a vector is only in lists before its own home
        there = (alike >= reach) & (number < home[:, None]) | (number == home[:, None])
        return home, [-1 - np.flatnonzero(own) for own in there]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, centres = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # bounds the matrix of distances
                part = batch.slice(at, 1024)
                rows = unit_rows(part.column("embedding").to_pylist(), points.shape[1])
                own = np.sort(np.argpartition(-(rows @ points.T), prefix - 1, axis=1)[:, :prefix], axis=1).astype(np.int64)
                lists = np.stack([own[:, i] * MAX_PIVOTS + own[:, j] for i, j in combinations(range(own.shape[1]), 2)] or [own[:, 0]], axis=1)
                home, cores = homes(rows, centres)
                lists = [c if h < len(centres) else np.r_[own_lists, c] for own_lists, h, c in zip(lists, home, cores, strict=True)]
                yield pa.record_batch(
                    [part.column("cid"), part.column("n"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([r.astype("<i4").tobytes() for r in own], pa.binary()), pa.array(home, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    ["cid", "n", "vector", "nearest", "home", "lists"],
                )

    return classes.mapInArrow(nearest, "cid bigint, n bigint, vector binary, nearest binary, home bigint, lists array<bigint>")


def blocks(described: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """One row for each vector and list, and for lists of over block vectors one for each pair of blocks it is in."""
    dealt = described.select("cid", "n", "vector", "nearest", "home", F.explode("lists").alias("list"))
    sizes = materialize(described.select(F.explode("lists").alias("list")).groupBy("list").count().where(F.col("count") > block), "long-lists")
    at_once = F.when(F.col("list") < 0, F.least(F.greatest(F.col("count") / 16, F.lit(block)), F.lit(max(block, CORE_BLOCK)))).otherwise(block)
    parts = F.coalesce(F.ceil(F.col("count") / at_once), F.lit(1)).cast("int")
    if sizes.isEmpty():
        return dealt.withColumns({"part": F.lit(0), "other": F.lit(0), "block": F.xxhash64("list")})
    joined = dealt.join(sizes, "list", "left").withColumn("parts", parts).drop("count")
    own = joined.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return paired.withColumn("block", F.xxhash64("list", F.least("part", "other"), F.greatest("part", "other"))).drop("parts")


def core_links(rows: np.ndarray, n: np.ndarray, part: np.ndarray, inside: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """links and roots of the vectors of a centre's block or pair of blocks: of all pairs with one of the core (inside)
    and, in a pair of blocks, one of each."""
    links, root, weight = np.zeros(len(rows)), np.arange(len(rows)), n.astype(float)

    def connect(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        apart = root[a] != root[b]
        if apart.any():
            root = local_roots(len(root), np.r_[root[a[apart]], np.arange(len(root))], np.r_[root[b[apart]], root])

    def compare(x: np.ndarray, y: np.ndarray, once: bool) -> None:
        for at in range(0, len(x) if len(y) else 0, 512):
            own = x[at : at + 512]
            linked = rows[own] @ rows[y].T >= threshold
            if once:
                linked &= own[:, None] < y[None, :]
            links[own] += linked @ weight[y]
            links[y] += weight[own] @ linked
            some, any_ = linked.any(axis=1), linked.any(axis=0)
            connect(own[some], y[linked.argmax(axis=1)[some]])
            connect(own[linked.argmax(axis=0)[any_]], y[any_])
            a, b = np.nonzero(linked & (root[own][:, None] != root[y][None, :]))
            connect(own[a], y[b])

    if (part == part[0]).all():
        core = np.flatnonzero(inside)
        compare(core, core, True)
        compare(core, np.flatnonzero(~inside), False)
    else:
        left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
        compare(left[inside[left]], right, False)
        compare(left[~inside[left]], right[inside[right]], False)
    return links.astype(np.int64), root


def verify(dealt: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a (a cid), b (a cid that links connect it to, or null) and links (how many vectors it links to, as counted here)."""

    def within(table: pa.Table, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        cid, n, part, other, lists, home = (table.column(c).to_numpy() for c in ("cid", "n", "part", "other", "list", "home"))
        start = np.union1d(start, np.flatnonzero(lists[1:] != lists[:-1]) + 1)  # two lists may share a block's number
        end = np.r_[start[1:], len(cid)]
        keep = np.flatnonzero(end - start > 1)
        vector, near = table.column("vector").combine_chunks(), table.column("nearest").combine_chunks()
        left, right, links = [], [], np.zeros(len(cid), np.int64)
        forest = np.arange(len(cid))
        for s, e in zip(start[keep], end[keep], strict=True):
            rows = np.frombuffer(b"".join(vector.slice(s, e - s).to_pylist()), "<f8").reshape(e - s, -1)
            if lists[s] < 0:
                links[s:e], roots = core_links(rows, n[s:e], part[s:e], home[s:e] == -1 - lists[s], threshold)
                forest[s:e] = roots + s
                continue
            for i in range(0, e - s, LIST_BLOCK):
                a, b = np.nonzero(rows[i : i + LIST_BLOCK] @ rows[i:].T >= threshold)
                ok = a < b
                a, b = a[ok] + i + s, b[ok] + i + s
                # in a pair of two blocks only pairs across them are new
                ok = (cid[a] != cid[b]) & ((part[a] != part[b]) | (part[a] == other[a]) & (part[b] == other[b]))
                left.append(a[ok]), right.append(b[ok])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        total = len(a)
        for at in range(0, total, 100_000):
            x, y = a[at : at + 100_000], b[at : at + 100_000]
            p, q = (np.frombuffer(b"".join(near.take(pa.array(i)).to_pylist()), "<i4").reshape(len(i), -1) for i in (x, y))
            common = (p[:, :, None] == q[:, None, :]).any(axis=2)
            first = common.argmax(axis=1)
            common[np.arange(len(x)), first] = False
            least = p[np.arange(len(x)), first].astype(np.int64) * MAX_PIVOTS + p[np.arange(len(x)), common.argmax(axis=1)]
            own = least == lists[x]
            np.add.at(links, x[own], n[y[own]])
            np.add.at(links, y[own], n[x[own]])
        root = np.minimum(local_roots(len(cid), a, b), forest)  # a run has links of one of the two kinds
        told = np.flatnonzero((root != np.arange(len(cid))) | (links > 0))
        alone = root[told] == told
        yield pa.record_batch([pa.array(cid[told]), pa.array(cid[root[told]], mask=alone), pa.array(links[told])], ["a", "b", "links"])

    return grouped_runs(dealt, "block", ["list", "cid"], within, "a bigint, b bigint, links bigint")


def vector_near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: their component is
    their own id. Equal vectors link with each other. Shorter vectors are compared as if filled with zeros. Rows with
    a null vec_id are counted as links but get a null component unless another id is in it. Repeated rows stay; other
    columns are ignored.
    """
    rows, classes = vector_classes(vectors)
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if not size["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.orderBy(F.xxhash64("key")).limit(n_pivots(size["n"])).select("embedding").collect()  # at most MAX_PIVOTS
    pivots = unit_rows([r["embedding"] for r in sample], size["width"])
    numbered = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "numbered")
    centre, outside = dense_centres(pivots)
    centres, pivots = pivots[centre], pivots[np.r_[centre, outside]]
    described = materialize(describe(numbered.select(F.col("class").alias("cid"), "n", "embedding"), pivots, min(prefix, len(pivots)), centres, threshold), "described")
    found = materialize(verify(blocks(described), threshold), "vector-links")
    counts = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "class")
    reached = components(found.select("a", "b")).withColumnRenamed("node", "class")
    slim = numbered.select("class", "key", "cid", "n")
    least = materialize(reached.join(slim, "class").groupBy("root").agg(F.min("cid").alias("component")), "least")
    inside = reached.join(least, "root").select("class", "component")
    whole = materialize(
        slim.join(counts, "class", "left").join(inside, "class", "left").select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id")),
        "vector-results",
    )
    usable = skew_join(rows.where("key is not null"), whole, "key", "n").drop("key")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = usable.select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
