"""Bottom-k fingerprints of texts: the k least hashes of a text's word shingles.

Two fingerprints are merged by keeping the k least of both, so texts may be read in parts, and collections summed up,
in any order. The k least hashes of a union are a fair sample of its shingles: the share of them that both sides have
estimates resemblance, and containment and the number of distinct shingles follow in the same way. A fingerprint of
fewer than k hashes holds all its shingles, and is exact.

Fingerprints are arrays of ascending longs (63 bits), so that all but the hashing of texts is work for Spark's own
functions.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm.common import fresh
from wirelens.llm.simhash import shingle_hashes

K, SHINGLE = 128, 5
#: Documents of a stretch that is read in order, and stretches at most: their first ids go through the driver.
STRETCH_ROWS, STRETCHES = 2048, 1 << 16


def least_hashes(text: str | None, shingle: int = SHINGLE, k: int = K) -> np.ndarray:
    """The k least distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle, or none."""
    return np.unique(shingle_hashes(text, shingle) >> np.uint64(1))[:k]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated resemblance of two fingerprints; two empty ones are alike."""
    union = np.union1d(a, b)
    if len(a) >= k or len(b) >= k:
        union = union[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right") / len(union)) if len(union) else 1.0


def rendered(hashes: np.ndarray) -> str:
    """A fingerprint as text: its hashes as big-endian 64-bit numbers in base64."""
    return base64.b64encode(hashes.astype(">u8").tobytes()).decode()


def fingerprint_udf(shingle: int = SHINGLE, k: int = K) -> Callable[[Column], Column]:
    """A column of texts to one of fingerprints (array of long). Null and empty texts: an empty one."""

    @F.arrow_udf("array<bigint>")
    def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([least_hashes(t, shingle, k).astype(np.int64) for t in batch.to_pylist()], pa.list_(pa.int64()))

    return fingerprints.asNondeterministic()


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, keys: list[str], name: str = "fingerprint", k: int = K) -> DataFrame:
    """keys and the fingerprint of all the parts (rows with a fingerprint) of each.

    Each task sends at most k hashes of a key, so that a key with any number of parts is no burden. A key whose parts
    are all empty or null has an empty fingerprint.
    """
    hash_ = fresh("hash", [*keys, name])
    rows = parts.select(*keys, F.explode_outer(name).alias(hash_)).distinct()
    place = fresh("place", [*keys, name, hash_])
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(hash_))
    least = rows.withColumn(place, F.row_number().over(order)).where(F.col(place) <= k)
    return least.groupBy(*keys).agg(F.array_sort(F.collect_list(hash_)).alias(name))


def _sample(a: Column, b: Column, k: int) -> Column:
    union = F.array_sort(F.array_union(a, b))
    return F.when((F.size(a) >= k) | (F.size(b) >= k), F.slice(union, 1, k)).otherwise(union)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of the shingles of both that are in either; 1 of two empty fingerprints."""
    sample = _sample(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), sample))
    return F.when(F.size(sample) > 0, both / F.size(sample)).otherwise(1.0)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that are in b; 1 for an empty a."""
    sample = _sample(a, b, k)
    own = F.array_intersect(a, sample)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own)).otherwise(F.when(F.size(a) > 0, 0.0).otherwise(1.0))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact under k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << 63) / F.element_at(a, -1))


def in_descending_order(docs: DataFrame, rows: int = STRETCH_ROWS, most: int = STRETCHES) -> DataFrame:
    """docs (doc_id, text) dealt into stretches of descending ids (nulls last), in order within them: stretch, guest,
    doc_id, text. A stretch ends with a guest, the first document of the next one (after the last: of the first).

    Texts are shuffled once. Equal ids stay in one stretch, by text.
    """
    ids = docs.select("doc_id")
    parts = min(most, -(-ids.count() // rows))
    if not parts:
        return docs.select(F.lit(0).alias("stretch"), F.lit(0).alias("guest"), "doc_id", "text")
    firsts = ids.repartitionByRange(parts, F.desc_nulls_last("doc_id")).groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("first")).collect()
    # keys rise where ids fall, and a null comes last
    key = lambda i: (i is None, -(i or 0))
    starts = sorted(key(r["first"]) for r in firsts)

    @F.arrow_udf("array<struct<stretch:int,guest:int>>")
    def dealt(ids: pa.Array) -> pa.Array:
        found = []
        for i in ids.to_pylist():
            own = key(i)
            at = max(bisect_right(starts, own) - 1, 0)
            found.append([{"stretch": at, "guest": 0}, *([{"stretch": (at - 1) % len(starts), "guest": 1}] if starts[at] == own else [])])
        return pa.array(found, pa.list_(pa.struct([("stretch", pa.int32()), ("guest", pa.int32())])))

    rows_ = docs.select(F.explode(dealt("doc_id")).alias("d"), "doc_id", "text").select("d.*", "doc_id", "text")
    return rows_.repartition("stretch").sortWithinPartitions("stretch", "guest", F.desc_nulls_last("doc_id"), "text")


EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_with_next(text: str, after: str) -> str:
    """text with its last half (rounded down) replaced by the first as many characters of after, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_with_edits(docs: DataFrame, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """EDITED: for each document (doc_id, text) its fingerprint, that of the text edited with the next document by
    descending id, and the estimated resemblance of its own to that and to the next document's.

    A null text is an empty one. Texts without words have an empty fingerprint, which is alike to another empty one
    (1.0) and to no other (0.0). Equal ids follow each other by text; null ids come last. Repeated rows each get a row.
    A single document is its own next. Texts of any length are read whole; other columns are ignored; no documents, no
    rows.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("guest", "doc_id", "text")), strict=True):
                text = text or ""
                own = least_hashes(text, shingle, k)
                if held is not None:
                    i, before, its = held
                    new = edited_with_next(before, text)
                    new_hashes = least_hashes(new, shingle, k)
                    out.append((i, len(before), hashlib.sha256(new.encode()).hexdigest(), rendered(its), rendered(new_hashes), likeness(its, new_hashes, k), likeness(its, own, k)))
                held = None if guest else (doc_id, text, own)
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in EDITED.split(", ")])

    ordered = in_descending_order(docs.select(F.col("doc_id").cast("long"), "text"))
    return ordered.mapInArrow(compare, EDITED)
