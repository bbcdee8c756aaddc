"""Sequence packing by minimum bin slack.

Documents are tokenized where they lie; only their pieces' lengths matter for packing. The histogram of lengths has
SEQUENCE entries whatever the corpus, so the plan is made from it alone: the largest length left opens a bin, a
bitset over the sums that the lengths left can reach (bounded by their counts) finds the fullest combination for the
rest, and the combination is taken as often as the counts allow. The plan, a few thousand rows at most, says which
ranks of a length go where. Ranks come from counts of small blocks of rows, so no length is gathered in one task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.llm.common import materialize

SEQUENCE = 2048
END_ID = 0
#: Rows of a task that share a block; ranks within a block are given where the rows are made.
BLOCK_ROWS = 4096
#: Words whose ids a worker remembers: as many new ones, and as many from before that.
CACHE_WORDS = 200_000

#: Texts of these characters only are cut into words here; all others, and those with _SPECIAL, go whole to the tokenizer.
_KNOWN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ɏ¡¿«»‘’“”–—…€£§°]*")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: The byte-level vocabulary's word pattern, for those characters.
_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t\n\r {_LETTERS}0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
_SPECIAL = "<|"
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class _Words(dict):
    """ids of words by word, made when asked for; of more than CACHE_WORDS those used since then stay."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        ids = self[word] = self.older.get(word) or self.make(word)
        return ids


class FastTokenizer:
    """ids of a text as little-endian 32-bit integers, equal to the tokenizer's own.

    Common texts are cut into words here; the tokenizer's model makes each word's ids once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.words = self.tokenizer.model, _Words(self.word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTES))]).tobytes()

    def __call__(self, text: str) -> bytes:
        if _SPECIAL in text or not _KNOWN.fullmatch(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, _WORD.findall(text)))


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> FastTokenizer:
    """A worker's tokenizer, loaded once for all the tasks that it runs."""
    return FastTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, block, rank (and ids).

    A document's ids are its text's and END_ID; longer ones than sequence are cut so that only the first piece is
    shorter. A null text is empty. rank counts the equal lengths before it in its block.
    """
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "block", "rank"))]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = tokenizer_of(tokenizer), 0
        block, ranks = TaskContext.get().partitionId() << 32, Counter()
        for batch in batches:
            source, own, starts, lengths, crcs, blocks, places, ids = [], [], [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                data = encode(text or "") + end
                total = len(data) // 4
                start, number = 0, 0
                size = total % sequence or sequence
                while start < total:
                    if rows == BLOCK_ROWS:
                        rows, block, ranks = 0, block + 1, Counter()
                    part = data[4 * start : 4 * (start + size)]
                    source.append(k), own.append(number), starts.append(start), lengths.append(size), crcs.append(zlib.crc32(part)), blocks.append(block), places.append(ranks[size])
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
                    ranks[size] += 1
                    rows, start, number, size = rows + 1, start + size, number + 1, sequence
            columns = [batch.column("doc_id").take(pa.array(source, pa.int64())), pa.array(own, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, blocks, places))]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.record_batch(columns, [f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many alike, [(length, how many of it in each)]) for so many pieces of each length.

    The largest length left opens each bin; the rest is the fullest sum that the other lengths can make in the space
    left, found in a bitset of reachable sums, larger lengths first.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    bins = []
    while left:
        first = max(left)
        left[first] -= 1
        space, reached, steps = capacity - first, 1, []
        mask, full = (1 << (space + 1)) - 1, 1 << space
        for n in sorted((n for n, c in left.items() if c and n <= space), reverse=True):
            copies, power = min(left[n], space // n), 1
            while copies and not reached & full:
                take = min(power, copies)
                steps.append((n, take, reached))
                reached = (reached | reached << n * take) & mask
                copies, power = copies - take, power * 2
            if reached & full:
                break
        rest, own = reached.bit_length() - 1, Counter({first: 1})
        for n, take, before in reversed(steps):
            if not before >> rest & 1:
                rest -= n * take
                own[n] += take
        left[first] += 1
        times = min(left[n] // c for n, c in own.items())
        for n, c in own.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        bins.append((times, sorted(own.items(), reverse=True)))
    return bins


class Plan:
    """For each length and rank: the sequence and the place in it."""

    def __init__(self, bins: list[tuple[int, list[tuple[int, int]]]]):
        used: Counter = Counter()
        rows, base = [], 0
        for times, own in bins:
            offset = 0
            for n, each in own:
                rows.append(((n << 40) + used[n], base, each, offset, n))
                used[n] += times * each
                offset += n * each
            base += times
        rows.sort()
        self.key, self.base, self.each, self.offset, self.length = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        self.sequences = base

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = (length << 40) + rank
        at = np.searchsorted(self.key, wanted, side="right") - 1
        own = wanted - self.key[at]
        return self.base[at] + own // self.each[at], self.offset[at] + own % self.each[at] * length


def pack(found: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to the rows of pieces(), which must be a written table."""
    blocks = materialize(found.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "blocks")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most sequence rows
    plan = found.sparkSession.sparkContext.broadcast(Plan(minimum_bin_slack(counts, sequence)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    first = blocks.select("length", "block", F.coalesce(before, F.lit(0)).alias("first"))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        at = plan.value.place(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)) if len(length) else (np.zeros(0, int),) * 2
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in at], ["sequence_id", "offset"])

    return found.join(first, ["length", "block"]).withColumn("at", place(F.col("length"), F.col("first") + F.col("rank"))).select(*[c for c in found.columns if c not in ("block", "rank")], "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents packed into as few sequences as minimum bin slack finds.

    doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset. Null and empty texts give a piece of END_ID
    alone; repeated rows are packed each for itself; null ids are kept; other columns are ignored; no rows give none.
    tokenizer: the tokenizer's file, the same on all machines.
    """
    return pack(materialize(pieces(docs, tokenizer, sequence, with_ids), "pieces"), sequence)
