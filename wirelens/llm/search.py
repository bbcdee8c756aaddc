"""Ranked lexical search with MaxScore in each shard.

Documents are cut into shards of bounded size, and each becomes one row of an index: its documents in order of their ids
and the postings (document, times) of its terms. For a query, a shard's terms are ordered by the most that each can add
to a score. The essential ones are those without which no document can pass the least of the best so far; only their
postings are walked, a stretch of documents at a time, and the postings of the others are probed, strongest first, only
for documents that can still qualify. The best of all shards are then ranked.

Scores follow from the number of documents and terms in the whole corpus and from each term's document frequency, which
are added up from the index. The index holds the terms that the queries may use, as told by a bitmap of fixed size, so
that neither texts nor rare words are shuffled. Queries go to the shards in blocks of QUERY_BYTES; the index is read
once for each block, and only one block is held at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm import bitmaps
from wirelens.llm.common import materialize, new_path
from wirelens.llm.decontamination import words_of

#: A shard's documents and bytes of text, at most (one longer text is a shard of its own).
SHARD_ROWS, SHARD_BYTES = 8192, 32 << 20
#: Text of the queries that one reading of the index takes along, and documents that are walked between two looks at the best.
QUERY_BYTES, STRETCH = 4 << 20, 2048
#: Buckets of the bitmap of query terms (2 MB), and words that a task remembers.
TERM_BUCKETS, REMEMBERED = 1 << 24, 1 << 20
TOP = 10

INDEX = "n_docs bigint, n_terms bigint, ids array<bigint>, lengths array<bigint>, terms array<string>, found array<bigint>, postings binary, times binary"
#: Fixed values of the score: scales of weights and of impacts, and the share of a document's length in its norm (percent).
WEIGHT, IMPACT, LENGTH_SHARE, NORM = 1000, 1_000_000_000, 75, 8


def _bucket(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) % TERM_BUCKETS


def query_terms(queries: DataFrame) -> DataFrame:
    """query (a number), item_id, term and times of the distinct (item_id, text) of queries; written."""

    @F.arrow_udf("array<struct<term:string,times:bigint>>")
    def terms(texts: pa.Array) -> pa.Array:
        found = [[{"term": w.decode(), "times": n} for w, n in Counter(words_of(t)).items()] for t in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("term", pa.string()), ("times", pa.int64())])))

    items = materialize(queries.select("item_id", "text").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    return materialize(items.select("query", "item_id", F.explode(terms("text")).alias("t")).select("query", "item_id", "t.*"), "query_terms")


def term_bits(terms: DataFrame) -> np.ndarray:
    """The bitmap of the terms."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bitmaps.Counts(TERM_BUCKETS, 1)
        for batch in batches:
            if batch.num_rows:
                counts.add(np.array([_bucket(t.encode()) for t in batch.column(0).to_pylist()], np.uint32))
        yield from counts.slices()

    return bitmaps.reached(terms.select("term").mapInArrow(hashed, bitmaps.SLICES), TERM_BUCKETS, 1)


class _Known(dict):
    """Whether a word's bucket is set; remembered for a bounded number of words."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        at = _bucket(word)
        self[word] = told = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return told


def build_index(docs: DataFrame, bits: np.ndarray, rows: int = SHARD_ROWS, size: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard of docs (doc_id, text): INDEX; written. Texts without terms are in no shard."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        own: list[tuple[tuple, int, Counter]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                own.append(((doc_id is None, doc_id or 0), len(words), Counter(filter(known.__getitem__, words))))
                held += len(text)
                if len(own) >= rows or held >= size:
                    yield _packed(own)
                    own, held = [], 0
        if own:
            yield _packed(own)

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(shards, INDEX), "index")


def _packed(own: list[tuple[tuple, int, Counter]]) -> pa.RecordBatch:
    own.sort(key=lambda x: x[0])
    lists: dict[bytes, tuple[list[int], list[int]]] = {}
    for at, (_, _, counts) in enumerate(own):
        for word, n in counts.items():
            places, times = lists.setdefault(word, ([], []))
            places.append(at), times.append(n)
    found = [len(p) for p, _ in lists.values()]
    join = lambda k: np.fromiter((x for pair in lists.values() for x in pair[k]), np.int32, sum(found)).tobytes()
    columns = [[len(own)], [sum(n for _, n, _ in own)], [[None if none else i for (none, i), _, _ in own]], [[n for _, n, _ in own]], [[w.decode() for w in lists]], [found], [join(0)], [join(1)]]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["n_docs", "n_terms", "ids", "lengths", "terms", "found", "postings", "times"])


def weight(n_docs: Column | int, frequency: Column) -> Column:
    """A term's weight by its document frequency."""
    return F.floor(WEIGHT * F.ln((2 * F.lit(n_docs) + 2).cast("double") / (2 * frequency + 1).cast("double"))).cast("long")


class Shard:
    """A row of the index, ready to be searched: postings with their impacts, and the largest impact of each term."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids, lengths = row["ids"], np.array(row["lengths"], np.int64)
        self.norm = 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * n_docs // n_terms
        self.ends = dict(zip(row["terms"], np.cumsum(row["found"]).tolist(), strict=True))
        self.found = dict(zip(row["terms"], row["found"], strict=True))
        self.postings, self.times = (np.frombuffer(row[c], np.int32) for c in ("postings", "times"))
        self.lists: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}
        self.walked = self.probed = 0

    def term(self, term: str) -> tuple[np.ndarray, np.ndarray, int] | None:
        if term not in self.ends:
            return None
        if term not in self.lists:
            end = self.ends[term]
            own = slice(end - self.found[term], end)
            at, times = self.postings[own], self.times[own].astype(np.int64)
            impact = IMPACT * times // (WEIGHT * times + NORM * self.norm[at])
            self.lists[term] = at, impact, int(impact.max())
        return self.lists[term]

    def best(self, terms: list[tuple[str, int]], k: int = TOP, stretch: int = STRETCH) -> list[tuple[int, int]]:
        """(place, score) of the k best documents for terms and their weights; equal scores by place."""
        lists = [(own[2] * w, own[0], own[1] * w) for t, w in terms if w > 0 and (own := self.term(t)) is not None]
        lists.sort(key=lambda x: x[0])
        bound = np.cumsum([x[0] for x in lists])  # the most that a document gets from the first lists alone
        places, scores, least, first = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        for low in range(0, len(self.ids), stretch):
            while first < len(lists) and bound[first] <= least:
                first += 1  # those before first are not essential
            if first == len(lists):
                break  # later documents lose ties too
            total = np.zeros(min(stretch, len(self.ids) - low), np.int64)
            for _, at, gain in lists[first:]:
                a, b = np.searchsorted(at, (low, low + stretch))
                total[at[a:b] - low] += gain[a:b]
                self.walked += int(b - a)
            own = np.flatnonzero(total)
            for i in range(first - 1, -1, -1):
                own = own[total[own] + bound[i] > least]
                if not len(own):
                    break
                _, at, gain = lists[i]
                where = np.minimum(np.searchsorted(at, own + low), len(at) - 1)
                hit = at[where] == own + low
                total[own[hit]] += gain[where[hit]]
                self.probed += len(own)
            own = own[total[own] > least]
            if len(own):
                places, scores = np.r_[places, own + low], np.r_[scores, total[own]]
                order = np.lexsort((places, -scores))[:k]
                places, scores = places[order], scores[order]
                least = int(scores[-1]) if len(scores) == k else 0
        return list(zip(places.tolist(), scores.tolist(), strict=True))


def _searcher(shared: Broadcast, n_docs: int, n_terms: int, k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, n_docs, n_terms)
                found = [(q, shard.ids[at], score) for q, terms in shared.value for at, score in shard.best(terms, k)]
                yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["query", "doc_id", "score"])

    return search


def ranked(docs: DataFrame, queries: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (doc_id, text) for each of queries (item_id, text).

    Null and empty texts have no terms: such documents are never found, such queries find nothing. Every row of docs is a
    document, so rows that share an id may share a result; a null id comes after all others of its score. Queries that
    repeat both id and text are one; those that share an id only are ranked apart. Other columns are ignored, texts are
    whole. Without documents or queries the result is empty.
    """
    spark = docs.sparkSession
    terms = query_terms(queries)
    index = build_index(docs, term_bits(terms))
    whole = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = whole["n"] or 0, whole["l"] or 0
    frequency = index.select(F.explode(F.arrays_zip("terms", "found")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.found").alias("frequency"))
    weighted = terms.join(frequency, "term").withColumn("weight", weight(n_docs, F.col("frequency")) * F.col("times"))
    whole_queries = materialize(weighted.groupBy("query").agg(F.collect_list(F.struct("term", "weight")).alias("terms"), F.sum(F.octet_length("term") + 8).alias("bytes")), "weighted")
    total = whole_queries.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-total // query_bytes))
    path = new_path(spark, "best")
    for block in range(blocks):
        own = [(r["query"], [tuple(t) for t in r["terms"]]) for r in whole_queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()]
        shared = spark.sparkContext.broadcast(own)
        found = index.mapInArrow(_searcher(shared, n_docs, n_terms, k), "query bigint, doc_id bigint, score bigint")
        _best(found, k).write.mode("append").parquet(path)
        shared.destroy()
    best = spark.read.schema("query bigint, doc_id bigint, score bigint, rank int").parquet(path)
    return best.join(terms.select("query", "item_id").distinct(), "query").select("item_id", "rank", "doc_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; Spark cuts each task's rows to k before it shuffles them."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
