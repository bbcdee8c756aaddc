"""Phrase collocations: candidates from sketches, counted exactly by automata.

1. Every task adds up its words by hash bucket; a word whose bucket stays under the least count is too rare to be in any
   candidate. 2. The same for runs of two to five words that are not too rare. Both give bits of fixed size (bitmaps).
3. Texts are read once more in chunks. The runs of a chunk whose bits are set, and those of all runs inside them, are
   its candidates; they are compiled into an automaton, each between delimiters, so that only whole words match, and the
   chunk is scanned for all their occurrences, overlaps included. What chunks count is summed, and the threshold is
   applied to the sums. Automata are bounded by the chunk, not by the corpus's candidates, and a text meets one automaton
   only. Sketches decide what is counted, never what a count is: results are exact.

All is by language: buckets are of the language and the words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm import bitmaps
from wirelens.llm.common import materialize

LONGEST, LEAST, SCALE, TOP = 5, 100, 1000, 2000
#: A candidate falls to a longer one around it that occurs at least this often, in percent of its own count.
INSIDE = 100
#: Text (characters) that is tokenized, and compiled into one automaton, at a time.
CHUNK = 4 << 20
#: Phrases that a task adds up over its chunks before it passes them on.
SUMMED = 400_000
#: Parts into which phrases are dealt to be summed: this many, or one for so many bytes of text in large corpora.
PARTS, PART_BYTES = 256, 16 << 20
#: Parts in which a language's best are looked for before they are ranked.
SALT = 64
UNKNOWN = "und"
#: Odd numbers by which hashes of runs are mixed.
FACTORS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)

BREAK = b"."
#: A-Z in lower case; characters that end a piece become BREAK, tabs blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language at a time (columns lang and text), of about size characters at most but for longer texts."""
    held: dict[str, list[str]] = defaultdict(list)
    chars: dict[str, int] = defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                held[lang].append(text)
                chars[lang] += len(text)
                if chars[lang] >= size:
                    yield lang, held.pop(lang)
                    chars.pop(lang)
        if sum(chars.values()) >= 2 * size:  # many languages
            yield from held.items()
            held.clear(), chars.clear()
    yield from held.items()


class Words:
    """The words of a chunk: ids in order (0 for a break), the distinct words, and their hashes by language."""

    def __init__(self, lang: str, texts: list[str]):
        spaced = b" . ".join(t.encode().translate(_FOLD) for t in texts).replace(BREAK, b" . ")
        self.words = spaced.split()
        vocabulary = defaultdict(count().__next__)
        vocabulary[BREAK]
        self.ids = np.fromiter(map(vocabulary.__getitem__, self.words), np.int64, len(self.words))
        self.distinct, seed = list(vocabulary), xxhash.xxh64_intdigest(lang) & 0xFFFFFFFF
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.distinct), np.uint64, len(self.distinct))
        self.times = np.bincount(self.ids, minlength=len(self.distinct))
        self.times[0] = 0

    def buckets(self, width: int) -> np.ndarray:
        return self.hashes & np.uint64(width - 1)

    def runs(self, often: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of words: the places where a run of words starts that are all marked in often, and buckets."""
        own, single = self.hashes[self.ids], often[self.ids] & (self.ids > 0)
        hashes, good = own, single
        for n in range(2, LONGEST + 1):
            if len(good) < 2:
                return
            good = good[:-1] & single[n - 1 :]
            hashes = (hashes[:-1] ^ (hashes[:-1] >> np.uint64(29))) * FACTORS[0] + own[n - 1 :]
            at = np.flatnonzero(good)
            mixed = hashes[at]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * FACTORS[1]
            yield n, at, (mixed >> np.uint64(20)) & np.uint64(width - 1)


def candidates(chunk: Words, often: np.ndarray, bits: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct runs of a chunk that may occur often enough, and which words stand in such runs of two.

    Runs are told apart by the words' numbers, not by hashes: the name of a run is that of all but its last word and the
    last word.
    """
    found: list[str] = []
    covered = np.zeros(len(chunk.ids) + 1, bool)
    names = np.where(chunk.ids > 0, chunk.ids, -1)
    for n, at, buckets in chunk.runs(often, len(bits) * 8):
        at = at[bitmaps.has(bits, buckets)]
        if n > 2:
            at = at[(names[at] >= 0) & (names[at + 1] >= 0)]  # both runs inside it
        if not len(at):
            break
        pairs = names[at] << 32 | chunk.ids[at + n - 1]
        _, first, named = np.unique(pairs, return_index=True, return_inverse=True)
        found += [b" ".join(chunk.words[i : i + n]).decode() for i in at[first].tolist()]
        names = np.full(len(chunk.ids) + 1, -1)
        names[at] = named
        if n == 2:
            covered[at] = covered[at + 1] = True
    return found, covered[:-1]


def count_matches(chunk: Words, found: list[str], covered: np.ndarray) -> np.ndarray:
    """How often each of found occurs in the chunk: one scan, delimiters around each phrase."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, phrase in enumerate(found):
        automaton.add_word(f" {phrase} ", k)
    automaton.make_automaton()
    # words outside of all candidates are left out; a break stands for each such stretch
    keep = np.flatnonzero(covered | np.r_[False, covered[:-1]])
    text = b" ".join([b"", *[chunk.words[i] if c else BREAK for i, c in zip(keep.tolist(), covered[keep].tolist(), strict=True)], b""]).decode()
    return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(found))


DEALT = "part int, lang array<string>, phrase array<string>, f array<bigint>"


def _dealt(sums: dict[tuple[str, str], int], parts: int) -> Iterator[pa.RecordBatch]:
    """A task's sums, by parts of the phrases' hashes: a row for each part, so that no phrase is a row of its own."""
    by_part: dict[int, list[tuple[str, str, int]]] = defaultdict(list)
    for (lang, phrase), n in sums.items():
        by_part[xxhash.xxh64_intdigest(phrase) % parts].append((lang, phrase, n))
    for part, own in by_part.items():
        lists = [pa.array([list(c)], t) for c, t in zip(zip(*own, strict=True), (pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)]
        yield pa.record_batch([pa.array([part], pa.int32()), *lists], ["part", "lang", "phrase", "f"])


def _summed(least: int):
    """Rows sorted by part to sums of at least least, and the number of words of each language. Memory holds a part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = None, defaultdict(int)

        def told() -> pa.RecordBatch:
            kept = [(lang, phrase, n) for (lang, phrase), n in sums.items() if n >= least or not phrase]
            columns = list(zip(*kept, strict=True)) or [()] * 3
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "phrase", "f"])

        for batch in batches:
            for k, langs, phrases, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != part:
                    yield told()
                    part = k
                    sums.clear()
                for lang, phrase, n in zip(langs, phrases, counts, strict=True):
                    sums[lang, phrase] += n
        yield told()

    return add


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase and f: every word and run of up to LONGEST words that occurs at least least times in a language, and
    under an empty phrase the language's number of words; written. docs: lang, text."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").where(F.length("text") > 0)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a bucket holds a third of the least count on average, if words have six bytes
    words_width, runs_width = bitmaps.width_for(size / 6 * 3 / least), bitmaps.width_for(size / 6 * (LONGEST - 1) * 3 / least)

    parts = max(PARTS, size // PART_BYTES)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bitmaps.Counts(words_width, least)
        for lang, own in chunks(batches):
            chunk = Words(lang, own)
            counts.add(chunk.buckets(words_width)[1:], chunk.times[1:])
        yield from counts.slices()

    words = context.broadcast(bitmaps.reached(texts.mapInArrow(of_words, bitmaps.SLICES), words_width, least))

    def of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bitmaps.Counts(runs_width, least)
        for lang, own in chunks(batches):
            chunk = Words(lang, own)
            for _, _, buckets in chunk.runs(bitmaps.has(words.value, chunk.buckets(words_width)), runs_width):
                counts.add(buckets)
        yield from counts.slices()

    runs = context.broadcast(bitmaps.reached(texts.mapInArrow(of_runs, bitmaps.SLICES), runs_width, least))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], int] = defaultdict(int)
        for lang, own in chunks(batches):
            chunk = Words(lang, own)
            often = bitmaps.has(words.value, chunk.buckets(words_width))
            found, covered = candidates(chunk, often, runs.value)
            for phrase, n in zip(found, count_matches(chunk, found, covered).tolist() if found else (), strict=True):
                sums[lang, phrase] += n
            for i in np.flatnonzero(often & (chunk.times > 0)).tolist():
                sums[lang, chunk.distinct[i].decode()] += int(chunk.times[i])
            sums[lang, ""] += int(chunk.times.sum())
            if len(sums) > SUMMED:
                yield from _dealt(sums, parts)
                sums.clear()
        yield from _dealt(sums, parts)

    counted = texts.mapInArrow(scan, DEALT).repartition("part").sortWithinPartitions("part").mapInArrow(_summed(least), "lang string, phrase string, f bigint")
    return materialize(counted, "phrases")


def _whole(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of two to LONGEST words.

    A null lang is `und`, a null or empty text has no words. Texts are whole, of any length; repeated rows count each;
    equal scores go by count, then by phrase. Other columns are ignored. No documents, no rows. Products are decimals of
    38 digits, and exact; the quotient fits a long, as no part is rarer than the phrase.
    """
    counts = phrase_counts(docs, least)
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    found = counts.where("instr(phrase, ' ') > 0").withColumn("words", F.split("phrase", " "))
    size = F.size("words")

    own = F.col("words")
    cuts = found.join(totals, "lang").withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "n", "k", F.array_join(F.slice(own, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(own, F.col("k") + 1, size), " ").alias("right"))
    part = lambda name, f: counts.where("phrase <> ''").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    both = both.withColumns({"above": _whole(F.col("a")) * _whole(F.lit(SCALE)) * _whole(F.col("n")), "below": _whole(F.col("l")) * _whole(F.col("r"))})
    scored = both.withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = found.where(size > 2).withColumn("i", F.explode(F.sequence(F.lit(1), size - 1))).withColumn("m", F.explode(F.sequence(F.lit(2), F.least(size - 1, size - F.col("i") + 1))))
    around = longer.groupBy("lang", F.array_join(F.slice(own, F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("f").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(SALT)).alias("salt"))
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
