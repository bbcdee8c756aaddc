"""URL filters: path and host rules, and a Bloom filter cascade that answers membership in a key list exactly.

Level 0 of the cascade holds the listed keys, level 1 the other keys of the universe that level 0 lets through, level 2
the listed keys that level 1 lets through, and so on until a level lets nothing wrong through. The first level that
does not hold a key decides: not listed at an even level, listed at an odd one. For every key of the universe the
answer is exact. A query needs a few bit tests per row and no join with keys, however long the key list is.

Keys are dealt out by a hash into parts, each with levels of its own of about PART_BYTES. One part's levels go along with
the query as scalars; of several, each row meets the bits of its part by the part's number.

All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import fresh, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits and hash functions for each key, at the first level and at those above it.
FIRST_BITS, FIRST_HASHES = 10, 7
LATER_BITS, LATER_HASHES = 4, 3

#: Bytes that a part's levels have about.
PART_BYTES = 1 << 20
MAX_LEVELS = 60


def host_of(url: Column) -> Column:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path: after the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


@dataclass(frozen=True)
class Rule:
    """verdict for a host, its subdomains, and the paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The text of the longest rule that fits (of equally long ones the longest host), else null.

    rules is a short, hand-kept list (hundreds); it becomes one CASE expression.
    """
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        found = F.when(rule.fits(host, path), rule.text).otherwise(found)
    return found


@dataclass(frozen=True)
class Level:
    words: DataFrame  # a row for each part: part, words array<bigint>
    n_words: int  # of each part
    hashes: int
    seed: int

    def holds(self, key: Column, words: Column) -> Column:
        at = places(key, self.n_words, self.hashes, self.seed)
        return _all([F.bit_get(F.element_at(words, F.shiftright(p, 6).cast("int") + 1), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in at])


def _all(tests: list[Column]) -> Column:
    whole = tests[0]
    for t in tests[1:]:
        whole = whole & t
    return whole


def places(key: Column, n_words: int, hashes: int, seed: int) -> list[Column]:
    """Bit places of a key by double hashing of two 64-bit hashes."""
    m = n_words * 64
    first, second = F.pmod(F.xxhash64(F.lit(2 * seed), key), F.lit(m)), F.pmod(F.xxhash64(F.lit(2 * seed + 1), key), F.lit(m - 1)) + 1
    return [F.pmod(first + second * i, F.lit(m)) for i in range(hashes)]


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts)).cast("int")


def build_level(keys: DataFrame, n: int, number: int, parts: int = 1) -> Level:
    """Bloom filters over the n keys of column key, one for each part. Bits are combined by word before the shuffle."""
    bits, hashes = (FIRST_BITS, FIRST_HASHES) if number == 0 else (LATER_BITS, LATER_HASHES)
    n_words = max(1, -(-n * bits // (64 * parts)))
    spark = keys.sparkSession
    ones = (
        keys.select(part_of(F.col("key"), parts).alias("part"), F.explode(F.array(*places(F.col("key"), n_words, hashes, number))).alias("p"))
        .select((F.col("part") * F.lit(n_words).cast("long") + F.expr("p div 64")).alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
        .groupBy("w")
        .agg(F.bit_or("bit").alias("bits"))
    )
    filled = spark.range(parts * n_words).join(ones, F.col("id") == F.col("w"), "left").select(F.expr(f"cast(id div {n_words} as int)").alias("part"), "id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    words = filled.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("words"))
    return Level(materialize(words, f"level{number}"), n_words, hashes, number)


class Cascade:
    """Exact membership of the universe's keys in the listed keys. Null keys are not listed."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        """universe: column key, every key to be asked for. listed: column key. Repeats do no harm."""
        listed = listed.select("key").where("key is not null").distinct().withColumn("listed", F.lit(True))
        keys = universe.select("key").where("key is not null").distinct().join(listed, "key", "full").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
        keys = materialize(keys, "keys")
        self.levels: list[Level] = []
        encoded, other = keys.where("listed").select("key"), keys.where("not listed").select("key")
        n = encoded.count()
        self.parts = max(1, -(-n * FIRST_BITS * 2 // (8 * PART_BYTES)))
        while n:
            if len(self.levels) == MAX_LEVELS:
                raise RuntimeError("the cascade does not end")
            self.levels.append(level := build_level(encoded, n, len(self.levels), self.parts))
            wrong = materialize(self._with(other, "key", [level], "held").where("held").select("key"), "wrong")
            encoded, other, n = wrong, encoded, wrong.count()

    def _with(self, df: DataFrame, key: str, levels: list[Level], into: str) -> DataFrame:
        """df with column into: what the levels say of its keys, with their bits at hand."""
        value = F.col(key)
        if self.parts == 1:
            return df.withColumn(into, self._says(value, levels, [x.words.select("words").scalar() for x in levels]))
        part, bits = fresh("part", df.columns), [fresh(f"level{k}", df.columns) for k in range(len(levels))]
        held = None
        for level, name in zip(levels, bits, strict=True):
            own = level.words.select(F.col("part").alias(part), F.col("words").alias(name))
            held = own if held is None else held.join(own, part)
        rows = df.withColumn(part, F.coalesce(part_of(value, self.parts), F.lit(0))).join(held, part)
        return rows.select(*df.columns, self._says(value, levels, [F.col(b) for b in bits]).alias(into))

    @staticmethod
    def _says(key: Column, levels: list[Level], words: list[Column]) -> Column:
        found = F.lit(bool(len(levels) % 2))
        for number in range(len(levels) - 1, -1, -1):
            found = F.when(levels[number].holds(key, words[number]), found).otherwise(F.lit(bool(number % 2)))
        return F.coalesce(F.when(key.isNotNull(), found), F.lit(False))

    def mark(self, df: DataFrame, key: str, into: str) -> DataFrame:
        """df with a boolean column into: whether column key, a key of the universe or null, is listed."""
        return self._with(df, key, self.levels, into) if self.levels else df.withColumn(into, F.lit(False))


def judge_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page: the longest fitting rule's, else block for listed hosts.

    listed: column key, hosts to block. The universe of the cascade is all hosts of pages.
    Null urls and urls without :// have an empty host and path, fit no rule here, and are judged by the empty host.
    Empty and repeated rows are judged like any other; other columns of pages are ignored.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    cascade = Cascade(parts.select(F.col("host").alias("key")), listed)
    judged = cascade.mark(parts.withColumn("rule", longest_rule(rules, F.col("host"), F.col("path"))), "host", "listed")
    by_rule = F.lit(None).cast("string")
    for rule in rules:
        by_rule = F.when(F.col("rule") == rule.text, rule.verdict).otherwise(by_rule)
    return judged.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
