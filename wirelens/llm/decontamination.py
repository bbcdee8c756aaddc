"""Benchmark decontamination by a prefix-filtered set join, verified word by word.

Every benchmark item is cut into windows of WINDOW consecutive words (a shorter item is one window), and a window into
shingles of SHINGLE words. A text contains a window only if it contains all its shingles, so under the order by rarity
(occurrences in all texts) a prefix of one shingle is what exact containment needs: the window's rarest. Windows of an
item that share their rarest shingle make one row, an anchor, with the item's words around that shingle.

Texts and anchors meet in a join on the shingle's hash. A shingle's place in the window bounds where the window can
start in the text, and the window's length where it must end; the words that a text's row brings along are then compared
one by one. Only a filter of bounded size (FILTER_BITS) goes to the tasks with the texts; benchmark, frequencies and
anchors stay rows. A shingle that many texts hold is dealt over SALTS parts. Equal texts are found once in a task, and
their spans are summed up once.

Nulls and texts without words hit nothing, and neither do items without id or words; a repeated item counts once. Texts
of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm import bitmaps
from wirelens.llm.common import fresh, materialize

WINDOW, SHINGLE = 13, 3
#: Bits of the filter for each shingle; in all at least 2**22 and at most bitmaps.WIDEST (16 MB).
FILTER_BITS, FILTER_LEAST = 64, 1 << 22
#: Places of a hash that give a shingle's bits.
FILTER_SHIFTS = (0, 19, 37)
#: Parts that the rows of each shingle are dealt over.
SALTS = 16
#: Text that a task looks at in one step, words whose hashes it remembers, and counts that it adds up before it passes them on.
CHUNK, KNOWN, HELD = 4 << 20, 400_000, 1 << 20

#: A-Z in lower case; every other byte of \x00-\x2F, \x3A-\x60 and \x7B-\x7F ends a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Odd factors that mix the hashes of a shingle's words.
_FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

HITS = "struct<n_words:bigint,n_hit:bigint,items:array<bigint>,spans:array<struct<start:int,end:int>>>"
SPANS = "array<struct<start:int,end:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
SHINGLES = "item_id bigint, key binary, place int, k int, n int, whole int, h bigint, at int, words array<binary>"
PLACES = "h bigint, key binary, place int, at int, words array<binary>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _WordHashes(dict):
    """Hashes of words, remembered up to KNOWN."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


class Chunk:
    """The words of several texts, and the hashes of all shingles within them."""

    def __init__(self, texts: list[str | None], known: _WordHashes):
        own = [words_of(t) for t in texts]
        self.sizes = np.array([len(w) for w in own], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.words = [w for words in own for w in words]
        self.text = np.repeat(np.arange(len(own)), self.sizes)
        self.hashes = np.fromiter(map(known.__getitem__, self.words), np.uint64, len(self.words))

    def shingles(self, sizes: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size: the places where a shingle of so many words starts, and the shingles' hashes."""
        hashes = self.hashes
        for k in range(1, SHINGLE + 1):
            if k > 1:
                hashes = (hashes[:-1] ^ (hashes[:-1] >> np.uint64(29))) * _FACTORS[0] + self.hashes[k - 1 :]
            if not len(hashes):
                return
            if k in sizes:
                at = np.flatnonzero(self.ends[self.text[: len(hashes)]] >= np.arange(len(hashes)) + k)
                mixed = (hashes[at] ^ (hashes[at] >> np.uint64(31))) * _FACTORS[1] + np.uint64(k)
                yield k, at, mixed ^ (mixed >> np.uint64(30))


def _chunks(texts: Iterator[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str | None]:
    for batch in batches:
        yield from (x.as_py() for x in batch.column(0))


def shingles_of_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """A row for each place of a shingle in an item (item_id, text), with the item's words that a window around it can reach."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunk = Chunk([text], known)
                words, whole = chunk.words, len(chunk.words)
                if not whole:
                    continue
                n, k = min(size, whole), min(SHINGLE, whole)
                key = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                for _, at, hashes in chunk.shingles({k}):
                    for a in range(0, len(at), 4096):
                        places, own = at[a : a + 4096], hashes[a : a + 4096].view(np.int64)
                        first = np.maximum(places - (n - k), 0)
                        m = len(places)
                        yield pa.record_batch(
                            [
                                pa.array([item] * m, pa.int64()),
                                pa.array([key] * m, pa.binary()),
                                pa.array(places, pa.int32()),
                                *(pa.array(np.full(m, v), pa.int32()) for v in (k, n, whole)),
                                pa.array(own, pa.int64()),
                                pa.array(places - first, pa.int32()),
                                pa.array([words[f : p + n] for f, p in zip(first, places, strict=True)], pa.list_(pa.binary())),
                            ],
                            names=["item_id", "key", "place", "k", "n", "whole", "h", "at", "words"],
                        )

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return items.mapInArrow(rows, SHINGLES)


def _in_filter(bits: np.ndarray, width: int, hashes: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set."""
    left = np.arange(len(hashes))
    for shift in FILTER_SHIFTS:
        left = left[bitmaps.has(bits, (hashes[left] >> np.uint64(shift)) & np.uint64(width - 1))]
    return left


def filter_bits(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the column h; its bits alone go through the driver, at most 16 MB."""
    width = bitmaps.width_for(hashes.agg(F.approx_count_distinct("h")).first()[0] * FILTER_BITS, FILTER_LEAST)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bitmaps.Counts(width, 1)
        for batch in batches:
            own = np.unique(batch.column(0).to_numpy()).view(np.uint64)
            for shift in FILTER_SHIFTS:
                counts.add((own >> np.uint64(shift)) & np.uint64(width - 1))
        yield from counts.slices()

    return bitmaps.reached(hashes.select("h").mapInArrow(slices, bitmaps.SLICES), width, 1), width


def frequencies(docs: DataFrame, shared, width: int, sizes: set[int]) -> DataFrame:
    """h and its occurrences in all texts, for the shingles that pass the filter; added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits, parts, held = _WordHashes(), shared.value, [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return found, np.bincount(at, np.concatenate([p[1] for p in parts]), len(found)).astype(np.int64)

        def batch_of(found: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(found.view(np.int64), pa.int64()), pa.array(total, pa.int64())], names=["h", "f"])

        for texts in _chunks(_texts(batches)):
            for _, _, hashes in Chunk(texts, known).shingles(sizes):
                found, total = np.unique(hashes[_in_filter(bits, width, hashes)], return_counts=True)
                parts.append((found, total))
                held += len(found)
            if held > HELD:
                parts = [summed()]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield batch_of(*parts[0])
                    parts, held = [], 0
        if parts:
            yield batch_of(*summed())

    return docs.select("text").mapInArrow(count, "h bigint, f bigint").groupBy("h").agg(F.sum("f").alias("f"))


def anchors(shingles: DataFrame, frequency: DataFrame, size: int = WINDOW) -> DataFrame:
    """h, n, at, words, starts, owners: windows under their rarest shingle.

    words: those of the item around the shingle, which starts at the place at; starts: where in words windows of n words
    start; owners: the items that have all this. Windows with a shingle that no text holds are left out.
    """
    reach = Window.partitionBy("item_id", "key").orderBy("place").rowsBetween(0, size - SHINGLE)
    known = shingles.join(frequency, "h", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    windows = known.withColumn("best", F.min(F.struct("f", "h", "place", "at", "words")).over(reach)).where("place + n <= whole and best.f > 0")
    own = windows.groupBy("item_id", "key", "n", "best").agg(F.sort_array(F.collect_list(F.expr("place - best.place + best.at"))).alias("starts"))
    return own.groupBy("best.h", "n", "best.at", "best.words", "starts").agg(F.collect_set("item_id").alias("owners"))


def places_in_texts(docs: DataFrame, shared, width: int, sizes: set[int], size: int = WINDOW) -> DataFrame:
    """h, key (of the text), place, at, words: where shingles of the filter are in texts, with the words around them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits, seen = _WordHashes(), shared.value, set()
        for texts in _chunks(_texts(batches)):
            chunk, keys = Chunk(texts, known), {}
            found: list[tuple] = []
            for k, at, hashes in chunk.shingles(sizes):
                for i in _in_filter(bits, width, hashes).tolist():
                    place = int(at[i])
                    text = int(chunk.text[place])
                    if text not in keys:
                        key = hashlib.md5(texts[text].encode("utf-8", "surrogatepass")).digest()
                        keys[text] = None if key in seen else key
                        seen.add(key)
                    if keys[text] is not None:
                        end = int(chunk.ends[text])
                        begin = end - int(chunk.sizes[text])
                        first = max(begin, place - (size - k))
                        found.append((int(hashes[i : i + 1].view(np.int64)[0]), keys[text], place - begin, place - first, chunk.words[first : min(end, place + size)]))
            for a in range(0, len(found), 4096):
                columns = zip(*found[a : a + 4096], strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.binary())), strict=True)], names=["h", "key", "place", "at", "words"])

    return docs.select("text").mapInArrow(rows, PLACES)


def verified(places: DataFrame, anchor: DataFrame) -> DataFrame:
    """key, spans, owners: places of texts joined with anchors, whose windows hold word for word.

    A window starts as far before the shingle in the text as in the item (position), and must end within the text (length).
    """
    salts = anchor.withColumnsRenamed({"at": "own_at", "words": "own_words"}).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = places.withColumn("salt", F.pmod(F.xxhash64("key", "place"), F.lit(SALTS)).cast("int"))

    def holds(start: Column) -> Column:
        begin = start - F.col("own_at") + F.col("at")
        return (begin >= 0) & (begin + F.col("n") <= F.size("words")) & (F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.col("n")) == F.slice("own_words", start + 1, F.col("n")))

    def span(start: Column) -> Column:
        begin = start - F.col("own_at") + F.col("place")
        return F.struct(begin.cast("int").alias("start"), (begin + F.col("n")).cast("int").alias("end"))

    found = dealt.join(salts, ["h", "salt"]).withColumn("held", F.filter("starts", holds)).where(F.size("held") > 0)
    return found.select("key", F.transform("held", span).alias("spans"), "owners")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, ascending."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def _merged(spans: pa.Array) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in merge_spans([(s["start"], s["end"]) for s in own])] for own in spans.to_pylist()], _SPANS_ARROW)


def _n_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(words_of(x.as_py())) for x in texts], pa.int64())


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """key (MD5 of the text), items and spans of each different text that holds a window."""
    context = docs.sparkSession.sparkContext
    shingles = materialize(shingles_of_windows(benchmark, size), "shingles")
    sizes = {r["k"] for r in shingles.select("k").distinct().collect()}
    bits, width = filter_bits(shingles)
    frequency = materialize(frequencies(docs, context.broadcast(bits), width, sizes), "frequencies")
    anchor = materialize(anchors(shingles, frequency, size), "anchors")
    bits, width = filter_bits(anchor)
    found = verified(places_in_texts(docs, context.broadcast(bits), width, sizes, size), anchor)
    each = found.groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items"))
    return materialize(each.select("key", "items", F.arrow_udf(_merged, SPANS)("spans").alias("spans")), "hits")


def mark_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, str]:
    """docs with a struct column of n_words, n_hit, items (ascending) and merged word spans; and that column's name.

    Null and empty texts have no words and no hits. Repeated rows each get their result; other columns are kept,
    whatever their names. An empty benchmark hits nothing, and empty docs give no rows. The hits, one row for each
    different text that has any, are joined to docs by the text's MD5.
    """
    name, key, n_words = (fresh(x, docs.columns) for x in ("contamination", "text_key", "n_words_of_text"))
    found = hits(docs, benchmark, size).select(F.col("key").alias(key), F.struct("items", "spans").alias(name))
    out = docs.withColumn(key, F.unhex(F.md5(F.col("text").cast("binary")))).withColumn(n_words, F.arrow_udf(_n_words, "bigint")("text")).join(found, key, "left")
    items, spans = F.coalesce(F.col(name)["items"], F.array().cast("array<bigint>")), F.coalesce(F.col(name)["spans"], F.array().cast(SPANS))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    marked = F.struct(F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), spans.alias("spans")).cast(HITS)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], marked.alias(name)), name


def is_contaminated(n_hit, n_words):
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and spans of every document.

    items_sha256 is of the item ids as strings, sorted as strings and joined by commas; of the empty string for none.
    """
    marked, c = mark_contamination(docs.select("doc_id", "text"), benchmark, size)
    found = F.col(c)
    ids = F.array_join(F.array_sort(F.transform(found["items"], lambda x: x.cast("string"))), ",")
    return marked.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        is_contaminated(found["n_hit"], found["n_words"]).alias("contaminated"),
        found["items"].alias("items"),
        found["spans"].alias("spans"),
    )


