"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit for each bit of the 64-bit hashes of its word shingles, set where over half the hashes
have it. Two fingerprints link if they differ in at most RADIUS bits.

Covering family: bit i gets a non-zero vector m(i) of RADIUS + 1 bits; table v (every non-zero v) looks at the bits with
<v, m(i)> = 1. Whatever RADIUS bits two fingerprints differ in, some v is orthogonal to all their vectors, so that table
v looks at none of them and the two share a bucket there. No link is missed, and a bucket's fingerprints agree on about
half of all bits.

Equal fingerprints are one node from the start. A bucket emits a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions.storage import freeing_shuffles
from wirelens.llm import bitmaps
from wirelens.llm.common import components, grouped_runs, local_roots, materialize, skew_join

BITS, RADIUS, SEED = 64, 3, 42
#: Buckets up to this size are compared at once; larger ones by parts, of which two linked fingerprints share one.
BLOCK = 1024


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each run of n words (repeats included), A-Z in lower case, words joined by a space.

    A text of fewer words is one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(line, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - n]]
    return np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[n - 1 :], strict=True)), np.uint64, len(starts))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of the hashes; 0 of none."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


def fingerprint_udf(n: int) -> Callable[[Column], Column]:
    @F.arrow_udf("bigint")
    def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([fingerprint_of(shingle_hashes(t, n)) for t in batch.to_pylist()], pa.int64())

    return fingerprints.asNondeterministic()


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering family's masks: 2 ** (radius + 1) - 1 of them, each over about half the bits."""
    top = 2 ** (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (v & m).bit_count() % 2) for v in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(prints: np.ndarray, start: np.ndarray, end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs, as index pairs that connect what is linked: all links of small runs, forests of large ones."""
    size = end - start
    left, right = [], []
    small = (size > 1) & (size <= BLOCK)
    step = 1
    while True:
        alive = small & (size > step)
        if not alive.any():
            break
        counts = size[alive] - step
        a = np.repeat(start[alive] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        good = np.bitwise_count(prints[a] ^ prints[a + step]) <= radius
        left.append(a[good]), right.append(a[good] + step)
        step += 1
    for s, e in zip(start[size > BLOCK], end[size > BLOCK], strict=True):
        a, b = _close_in_large(prints[s:e], radius)
        left.append(a + s), right.append(b + s)
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))


def _close_in_large(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in a large bucket as a forest: two linked fingerprints agree on one of radius + 1 parts of their bits."""
    n, width, root = len(prints), -(-BITS // (radius + 1)), np.arange(len(prints))
    for part in range(radius + 1):
        value = prints >> np.uint64(width * part) & np.uint64((1 << width) - 1)
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1], True])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[s:e]
            for i in range(0, len(own), BLOCK):
                for j in range(i, len(own), BLOCK):
                    x, y = own[i : i + BLOCK], own[j : j + BLOCK]
                    if len(x) == len(y) == 1 and i == j:
                        continue
                    a, b = np.nonzero(np.bitwise_count(prints[x][:, None] ^ prints[y][None, :]) <= radius)
                    again = np.minimum(root[x[a]], root[y[b]]) != np.maximum(root[x[a]], root[y[b]])
                    if again.any():
                        root = np.minimum(root, local_roots(n, np.r_[root[x[a[again]]], np.arange(n)], np.r_[root[y[b[again]]], root]))
    at = np.flatnonzero(root != np.arange(n))
    return root[at], at


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of column fp that connect all within radius of each other."""
    tables = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks(radius))]
    dealt = nodes.select("fp", F.explode(F.array(*tables)).alias("bucket"))

    def edges(table: pa.Table, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        prints = table.column("fp").to_numpy()
        a, b = close_pairs(prints.view(np.uint64), start, end, radius)
        root = local_roots(len(prints), a, b)
        own = np.flatnonzero(root != np.arange(len(prints)))
        yield pa.record_batch([pa.array(prints[root[own]]), pa.array(prints[own])], ["a", "b"])

    return grouped_runs(dealt, "bucket", ["fp"], edges, "a bigint, b bigint")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (signed) of every document, written to the shared folder."""
    return materialize(docs.select("doc_id", fingerprint_udf(shingle)(F.col("text")).alias("fp")), "prints")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, n (its documents) and component (the least doc_id that its links reach), written."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    joined = components(links(nodes, radius))
    linked = joined.join(nodes.select(F.col("fp").alias("node"), "first"), "node")
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("component")), "least")
    found = joined.join(least, "root").select(F.col("node").alias("fp"), F.col("component").alias("reached"))
    return materialize(nodes.join(found, "fp", "left").select("fp", "n", F.coalesce("reached", "first").alias("component")), "classes")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay, in one component.
    A null doc_id is never a component_id unless all of the component are null. Other columns are ignored.
    """
    prints = fingerprints(docs, shingle)
    found = skew_join(prints, classes(prints, radius), "fp", "n")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# ---------------------------------------------------------------- by similarity

#: Least shingle hashes of a text that its sketch holds (the upper half of each), and those whose pairs are keys too.
SKETCH, LEADERS = 128, 6
#: Buckets of the second pass up to this size are compared side by side, larger ones in blocks.
FULL = 32
SIMILARITY = 0.8
#: Pairs are compared by whole sets unless their sketches are this far under the similarity: seven standard errors.
MARGIN = 0.25
#: The shingles' frequencies are learnt from one text of so many; so many frequent ones, at most, are told apart (16 bytes
#: each). Only cost depends on it.
EVERY, FREQUENT = 8, 400_000
#: Bits of a set's parities, which go along with its frequent shingles; a multiple of 64. Only cost depends on it.
PARITIES = 1024
#: Sets of more hashes than this have a sketch too, as the parities of such tell less. Only cost depends on it.
SKETCHED = 1024
#: Bits for each document in the filter of those whose sets are asked for. Only cost depends on it.
ASKED_BITS = 16

TRAITS = "struct<node:bigint,size:bigint,fp:bigint,keys:array<bigint>,odd:binary,sketch:binary>"
_TRAITS_ARROW = pa.struct([("node", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("odd", pa.binary()), ("sketch", pa.binary())])


def similarity(a: bytes, b: bytes) -> float:
    """An estimate of the Jaccard similarity of two texts' sets of shingles."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    union = np.union1d(x, y)
    if len(x) >= SKETCH - 1 or len(y) >= SKETCH - 1:
        union = union[:SKETCH]
    return float(np.isin(union, np.intersect1d(x, y, assume_unique=True), assume_unique=True).mean())


def _node(whole: np.ndarray) -> int:
    """The number of a set of shingle hashes."""
    return signed(xxhash.xxh64_intdigest(whole.tobytes(), SEED))


def _traits(n: int) -> Callable:
    def traits(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = [np.uint64(m) for m in masks()]
        for batch in texts:
            found = []
            for text in batch.to_pylist():
                hashes = shingle_hashes(text, n)
                whole = np.unique(hashes)
                fp, least = fingerprint_of(hashes), whole[:SKETCH]
                pairs = [int(least[i] * np.uint64(3) ^ least[j]) for i in range(min(LEADERS, len(least))) for j in range(i + (len(least) > 1), min(LEADERS, len(least)))]
                keys = [signed(k) for k in pairs] + [signed((fp & int(m)) * 31 + k + 1 & (1 << 64) - 1) for k, m in enumerate(tables)]
                sketch = np.unique((least >> np.uint64(32)).astype(np.uint32)).tobytes() if len(whole) > SKETCHED else None
                found.append({"node": _node(whole), "size": len(whole), "fp": fp, "keys": keys, "odd": parities(whole), "sketch": sketch})
            yield pa.array(found, _TRAITS_ARROW)

    return F.arrow_udf(traits, TRAITS).asNondeterministic()


def _pairs(table: pa.Table, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each bucket every text with the first and with the next by fingerprint: likely links, which join most groups."""
    node, size = table.column("node").to_numpy(), end - start
    first = np.repeat(start, size)
    own = np.flatnonzero(np.arange(len(node)) > first)
    a, b = node[np.r_[first[own], own - 1]], node[np.r_[own, own]]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
    yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _asked_sets(docs: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """node and whole set of shingle hashes (as bytes) of the texts of asked (doc_id, node); written.

    Texts stay where they are read: the bits of a filter (at most 16 MB) tell there which may be asked for, and only the
    sets of these are shuffled.
    """
    width = bitmaps.width_for(asked.count() * ASKED_BITS)
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(width - 1))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bitmaps.Counts(width, 1)
        for batch in batches:
            counts.add(batch.column(0).to_numpy())
        yield from counts.slices()

    bits = docs.sparkSession.sparkContext.broadcast(bitmaps.reached(asked.select(place.alias("place")).mapInArrow(slices, bitmaps.SLICES), width, 1))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.filter(pa.array(bitmaps.has(bits.value, batch.column("place").to_numpy().astype(np.uint64))))
            own = [np.unique(shingle_hashes(t, n)) for t in held.column("text").to_pylist()]
            yield pa.record_batch([held.column("doc_id"), pa.array([_node(w) for w in own], pa.int64()), pa.array([w.tobytes() for w in own], pa.binary())], ["doc_id", "node", "whole"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text", place.alias("place")).mapInArrow(sets, f"doc_id {kind}, node bigint, whole binary")
    return materialize(found.join(asked, ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"]).select("node", "whole"), "sets")


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of pairs (a, b) whose whole sets are at least so similar; written."""

    @F.arrow_udf("boolean")
    def possible(n: pa.Array, m: pa.Array, x: pa.Array, y: pa.Array, s: pa.Array, t: pa.Array) -> pa.Array:
        n, m = n.to_numpy().astype(np.int64), m.to_numpy().astype(np.int64)
        told = ~_too_far(_odd_rows(x), _odd_rows(y), n, m, least)
        told &= np.minimum(n, m) >= least * np.maximum(n, m) - 1e-6
        for k, (a, b) in enumerate(zip(s.to_pylist(), t.to_pylist(), strict=True)):
            if told[k] and a is not None and b is not None:
                told[k] = similarity(a, b) >= least - MARGIN
        return pa.array(told)

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        told = []
        for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True):
            common = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
            union = len(a) // 8 + len(b) // 8 - common
            told.append(not union or common / union >= least)
        return pa.array(told, pa.bool_())

    def both(pairs: DataFrame, values: DataFrame) -> DataFrame:
        of = lambda c: values.select(F.col("node").alias(c), *[F.col(v).alias(f"{c}_{v}") for v in values.columns if v != "node"])
        return pairs.join(of("a"), "a").join(of("b"), "b")

    traits = both(pairs, nodes.select("node", "size", "odd", "sketch"))
    near = materialize(traits.where(possible("a_size", "b_size", "a_odd", "b_odd", "a_sketch", "b_sketch")).select("a", "b"), "near")
    asked = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    asked = materialize(nodes.join(asked, "node", "left_semi").select(F.col("first").alias("doc_id"), "node"), "asked")
    sets = _asked_sets(docs, asked, shingle)
    return materialize(both(near, sets).where(alike("a_whole", "b_whole")).select("a", "b"), "alike")


def parities(whole: np.ndarray) -> bytes:
    """A bit for each class of hashes: whether the set has an odd number of them. Two sets differ in at least as many hashes
    as their parities differ in bits."""
    odd = np.bincount((whole % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _odd_rows(odd: pa.Array) -> np.ndarray:
    """Parities (none is null) as rows of numbers."""
    return np.frombuffer(b"".join(odd.to_pylist()), np.uint64).reshape(-1, PARITIES // 64)


def _too_far(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of sets (parities and sizes) differ in too many hashes to be so similar."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * (1 + least) > (1 - least) * (n + m) + 1e-6


def _prefixes(n: int, least: float, shared, sample: int, texts: int) -> Callable:
    """node, size and prefix of texts: the shingles, rarest first, of which any text that is alike shares one.

    traits: place in that order * 4 + side. A shingle that many texts have is dealt out as pairs of blocks; side tells
    the lower (1) from the upper (2) in a pair of two blocks. often: which keys are of shingles
    that the sample found frequent; odd: parities of a text that has such, which go along with these alone.
    """

    def prefixes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, count = shared.value
        for batch in batches:
            found = []
            for text in batch.to_pylist():
                whole = np.unique(shingle_hashes(text, n))
                node, size = _node(whole), len(whole)
                at = np.minimum(np.searchsorted(known, whole), max(len(known) - 1, 0))
                often = np.where(known[at] == whole, count[at], 0) if len(known) else np.zeros(size, np.int64)
                order = np.argsort(often, kind="stable")[: size - int(np.ceil(least * size - 1e-9)) + 1 if size else 0]
                keys, traits, frequent = [], [], []
                for place, (token, times) in enumerate(zip(whole[order].view(np.int64).tolist(), often[order].tolist(), strict=True)):
                    parts = -(-times * texts // (sample * BLOCK)) if times else 1
                    own = node % parts
                    for other in range(parts) if parts > 1 else (own,):
                        keys.append(token if parts == 1 else hash((token, min(own, other), max(own, other))))
                        traits.append(place * 4 + (0 if own == other else 1 if own < other else 2))
                        frequent.append(bool(times))
                found.append({"node": node, "size": size, "keys": keys, "traits": traits, "often": frequent, "odd": parities(whole) if any(frequent) else None})
            yield pa.array(found, pa.struct([("node", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())), ("traits", pa.list_(pa.int64())), ("often", pa.list_(pa.bool_())), ("odd", pa.binary())]))

    return F.arrow_udf(prefixes, "struct<node:bigint,size:bigint,keys:array<bigint>,traits:array<bigint>,often:array<boolean>,odd:binary>").asNondeterministic()


def _possible(least: float) -> Callable:
    """Pairs in a bucket that may be alike and are not known to be of one group."""

    def pairs(table: pa.Table, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, root, size, traits = (table.column(c).to_numpy() for c in ("node", "root", "size", "trait"))
        rest, side, left, right = size - traits // 4, traits % 4, [], []
        given = table.column("odd").combine_chunks()
        told = given.is_valid().to_numpy(zero_copy_only=False)
        odd = np.zeros((len(node), PARITIES // 64), np.uint64)
        if told.any():
            odd[told] = _odd_rows(given.drop_null())

        def keep(a: np.ndarray, b: np.ndarray) -> None:
            ok = (root[a] != root[b]) & ((side[a] != side[b]) | (side[a] == 0))
            a, b = a[ok], b[ok]
            # at the first shingle that two texts share, all that they share is still to come
            ok = np.minimum(rest[a], rest[b]) * (1 + least) >= least * (size[a] + size[b]) - 1e-6
            a, b = a[ok], b[ok]
            near = np.ones(len(a), bool)
            # alike sets differ in few hashes, and their parities in no more
            for at in range(0, len(a), 1 << 16) if told.any() else ():
                x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                near[at : at + (1 << 16)] = ~(told[x] & told[y] & _too_far(odd[x], odd[y], size[x], size[y], least))
            left.append(node[a[near]]), right.append(node[b[near]])

        length = end - start
        for step in range(1, FULL):
            s, e = start[(length > step) & (length <= FULL)], end[(length > step) & (length <= FULL)]
            if not len(s):
                break
            counts = e - s - step
            a = np.repeat(s - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            keep(a, a + step)
        for s, e in zip(start[length > FULL], end[length > FULL], strict=True):
            if (root[s:e] == root[s]).all():
                continue
            for i in range(s, e, 256):
                for j in range(i, e, 4096):
                    x, y = np.arange(i, min(i + 256, e)), np.arange(j, min(j + 4096, e))
                    a, b = np.nonzero((root[x][:, None] != root[y][None, :]) & (x[:, None] < y[None, :]))
                    keep(x[a], y[b])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.record_batch([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    return pairs


def _remaining(docs: DataFrame, nodes: DataFrame, joined: DataFrame, shingle: int, least: float) -> DataFrame:
    """Candidates (a, b) among nodes of different groups: every pair that is alike is one of them; written.

    Two sets of which one has n hashes can only be alike if they share least * n, so they share one of the first
    n - least * n + 1 in any fixed order. Shingles that are frequent in a sample come last, which keeps buckets short. In
    the buckets of these, pairs are left out whose parities tell that they differ in too many hashes.
    """
    spark, n = docs.sparkSession, nodes.count()
    every = min(EVERY, max(1, n))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # numbers of the task's texts, so that its copies count once
        for batch in batches:
            for text in batch.column(0).to_pylist():
                whole = np.unique(shingle_hashes(text, shingle))
                if (node := _node(whole)) not in seen:
                    seen.add(node)
                    yield pa.record_batch([pa.array(whole.view(np.int64))], ["token"])

    counted = sample.select("text").mapInArrow(tokens, "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    with freeing_shuffles(spark):
        often = counted.where("times > 2").orderBy(F.desc("times"), "token").limit(FREQUENT).toPandas()
    known, times = often["token"].to_numpy(np.int64).view(np.uint64), often["times"].to_numpy(np.int64)
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], times[order]))
    # copies go where their node's group is joined: texts themselves are never shuffled
    dealt = docs.select(_prefixes(shingle, least, shared, -(-n // every), n)(F.col("text")).alias("t")).select("t.*").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "keys", "traits", "often", "odd")])
    rooted = materialize(dealt.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), "prefixes")
    return materialize(grouped_runs(_met(rooted), "bucket", ["size", "node"], _possible(least), "a bigint, b bigint").distinct(), "remaining")


def _met(rooted: DataFrame) -> DataFrame:
    """A row for each text and key of its prefix that another text may have too.

    Most shingles of a prefix are in one text alone. Of those keys whose bits (at most 16 MB) tell that no other text has
    them, no rows are made; several keys may share a bit, so none that two texts have is left out.
    """
    width = bitmaps.width_for((rooted.agg(F.sum(F.size("keys"))).first()[0] or 0) * 8)

    def buckets(keys: pa.Array) -> np.ndarray:
        return keys.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - width.bit_length())

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bitmaps.Counts(width, 2)
        for batch in batches:
            counts.add(buckets(batch.column(0).flatten()))
        yield from counts.slices()

    bits = rooted.sparkSession.sparkContext.broadcast(bitmaps.reached(rooted.select("keys").mapInArrow(slices, bitmaps.SLICES), width, 2))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, traits, often = (batch.column(c).flatten() for c in ("keys", "traits", "often"))
            text = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("keys").offsets.to_numpy()))
            at = np.flatnonzero(bitmaps.has(bits.value, buckets(keys)))
            own, often = pa.array(text[at]), often.to_numpy(zero_copy_only=False)[at]
            odd = batch.column("odd").take(pa.array(np.where(often, text[at], 0), mask=~often))
            yield pa.record_batch([keys.take(pa.array(at)), *[batch.column(c).take(own) for c in ("node", "root", "size")], traits.take(pa.array(at)), odd], ["bucket", "node", "root", "size", "trait", "odd"])

    return rooted.mapInArrow(rows, "bucket bigint, node bigint, root bigint, size bigint, trait bigint, odd binary")


def representatives(docs: DataFrame, shingle: int = 5, least: float = SIMILARITY) -> DataFrame:
    """doc_id of one document (the least id) of each group of texts that links of at least this similarity connect.

    A first pass takes texts that share a bucket of the covering family or two of their LEADERS least shingle hashes,
    which joins large groups without writing all their pairs. A second pass finds, by prefixes, every other pair that
    may be alike and is not yet in one group. Links are verified on whole sets of shingle hashes. Texts without words
    are one group. Null ids are left out.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    found = docs.select("doc_id", _traits(shingle)(F.col("text")).alias("t")).select("doc_id", "t.*")
    nodes = materialize(found.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.any_value(c).alias(c) for c in ("size", "fp", "keys", "odd", "sketch")]), "texts")
    dealt = nodes.select("node", "fp", F.explode("keys").alias("bucket"))
    pairs = materialize(grouped_runs(dealt, "bucket", ["fp", "node"], _pairs, "a bigint, b bigint").distinct(), "pairs")
    early = _alike(pairs, nodes, docs, shingle, least)
    late = _alike(_remaining(docs, nodes, components(early), shingle, least), nodes, docs, shingle, least)
    joined = components(early.unionByName(late))
    inside = nodes.select("node", "first").join(joined, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    return inside.groupBy("root").agg(F.min("first").alias("doc_id")).select("doc_id")
