"""Event fingerprints and their comparison, similar titles, and what a history keeps."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.functions.storage import materialize
from wirelens.functions.rulepacks import RulePack
from wirelens.functions.text import extract_all, first_present, fold, once, sorted_set, stem

#: How much text and time is compared, and the thresholds.
TEXT_LIMIT, LEAD_LIMIT = 1600, 300
WINDOW_SECONDS = 36 * 3600
SHARED, OVERLAP, DENSE_SHARED, JACCARD, LEAD_SHARED = 5, 0.45, 7, 0.20, 7
TITLE = 0.75
#: Titles in a block, from and to; into how many blocks titles are cut between these; the characters that take the room of
#: one title; tasks at most, and tasks that take ratios. A task holds two blocks. Only cost depends on these.
TITLE_BLOCKS, TITLE_PARTS, TITLE_ROOM, TITLE_TASKS, RATIO_TASKS = (2048, 8192), 24, 512, 4000, 64
#: From this length on the ratio leaves out frequent characters of its second title.
LONG = 200
#: Characters of the runs by which long titles are compared, how many must be shared at least for that, and how many pairs
#: or meetings are counted at once.
RUN, MET, CELLS = 6, 16, 1 << 22
#: Titles of a side of a tile of pairs that are compared by letters, rows of it that stay near.
TILE, ROWS = 1024, 32
#: Up to which length 32 bits do for a group's characters, how full they are, and the part of a tile's pairs under which
#: they are looked at one by one.
SHORT, FULL, SPARSE = 96, 0.78, 0.08
#: Pairs whose common subsequences are found side by side; up to FEW pairs, and patterns over WIDE, one by one.
PAIRS, FEW, WIDE = 8192, 64, 2048
#: Titles over this length are not held against common subsequences before the ratio is taken.
ALIGNED = 1024
#: Classes of characters by which titles are compared before their letters are aligned.
LETTERS = 61
PAIR = "l_id long, r_id long, forward boolean, backward boolean"

FINGERPRINT = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("topics", "tokens", "locations", "lead_tokens", "local_locations")])


def families(strong_topics: Column, pack: RulePack) -> Column:
    """Names of the families of which a stem is anywhere in the strong topics."""
    text = fold(F.array_join(strong_topics, " "))
    found = [F.when(F.exists(F.array(*map(F.lit, stems)), lambda s: F.contains(text, s)), F.lit(name)) for name, stems in pack.families.items()]
    return sorted_set(F.filter(F.array(*found), lambda x: x.isNotNull()))


def tokens(text: Column, pack: RulePack) -> Column:
    """Stems of a text's words that may tell one event from another, sorted."""
    words = F.filter(F.array_distinct(extract_all(fold(text), pack.token)), lambda w: (F.length(w) >= 4) & ~w.isin(*pack.stop_words))
    stems = F.array_distinct(F.transform(words, lambda w: stem(w, pack.suffixes, pack.role_suffixes)))
    noise = [rf"^(?:{'|'.join(map(re.escape, pack.noise_prefixes))})"] if pack.noise_prefixes else []
    noise += [re.escape(s) for own in pack.families.values() for s in own]
    telling = lambda s: (F.length(s) >= 4) & (~s.rlike("|".join(noise)) if noise else F.lit(True))
    return F.array_sort(F.filter(stems, telling))


def locations(text: Column, pack: RulePack) -> Column:
    return sorted_set(F.transform(extract_all(text, pack.place, 1), lambda w: stem(w, pack.suffixes, pack.role_suffixes)))


def local_locations(text: Column, pack: RulePack) -> Column:
    found = [extract_all(text, p, 1) for p in pack.local_places] or [F.array().cast("array<string>")]
    return sorted_set(F.transform(F.flatten(F.array(*found)), lambda w: stem(w, pack.suffixes, pack.role_suffixes)))


def fingerprint(items: DataFrame, pack: RulePack, name: str = "event_fingerprint") -> DataFrame:
    """Items (title, description, article_text, strong_topics) with their FINGERPRINT."""
    body = first_present(F.col("article_text"), F.col("description"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(body, 1, TEXT_LIMIT))
    own = once(items, _text=text)
    t = F.col("_text")
    parts = {"topics": families(F.col("strong_topics"), pack), "tokens": tokens(t, pack), "locations": locations(t, pack), "lead_tokens": tokens(F.substring(t, 1, LEAD_LIMIT), pack), "local_locations": local_locations(t, pack)}
    return once(own, **{name: F.struct(*[c.alias(n) for n, c in parts.items()])}).drop("_text")


def title_ratio(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two normalized titles; the order of the two can matter."""

    def ratio(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(ratio, "double")(a, b)


def _or_empty(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def compare(a: Column, b: Column, a_at: Column, b_at: Column, lead_noise: tuple[str, ...] = ()) -> Column:
    """How two fingerprints of items published at two times compare: a struct with is_duplicate and its grounds.

    A fingerprint without local_locations is an old one; its places are looked for among its tokens.
    """
    shared = {f: F.array_intersect(_or_empty(a[f]), _or_empty(b[f])) for f in ("topics", "tokens", "locations")}
    n = F.size(shared["tokens"])
    a_tokens, b_tokens = _or_empty(a["tokens"]), _or_empty(b["tokens"])
    smaller = F.least(F.size(a_tokens), F.size(b_tokens))
    hours = F.abs(F.unix_micros(a_at) - F.unix_micros(b_at)) / 3.6e9
    comparable = a_at.isNotNull() & b_at.isNotNull() & (hours * 3600 <= WINDOW_SECONDS) & (F.size(shared["topics"]) > 0) & (smaller > 0)
    overlap = F.when(smaller > 0, n / smaller).otherwise(0.0)
    jaccard = F.when(smaller > 0, n / F.size(F.array_union(a_tokens, b_tokens))).otherwise(0.0)
    enough = (n >= SHARED) & (overlap >= OVERLAP) & ((F.size(shared["locations"]) > 0) | ((n >= DENSE_SHARED) & (jaccard >= JACCARD)))
    noise = F.array(*map(F.lit, lead_noise)) if lead_noise else F.array().cast("array<string>")

    def lead(own: Column, other: Column, other_tokens: Column) -> tuple[Column, Column]:
        words = F.array_except(_or_empty(own["lead_tokens"]), noise)
        places = F.array_union(_or_empty(own["local_locations"]), F.array_intersect(_or_empty(own["locations"]), _or_empty(other["local_locations"])))
        there = F.when(other["local_locations"].isNull(), other_tokens).otherwise(F.array_union(_or_empty(other["local_locations"]), _or_empty(other["locations"])))
        both = F.size(F.array_intersect(words, other_tokens))
        usable = (F.size(words) > 0) & F.arrays_overlap(places, there)
        ratio = F.when(usable, both / F.greatest(F.size(words), F.lit(1))).otherwise(0.0)
        return usable & (both >= LEAD_SHARED) & (ratio >= OVERLAP), ratio

    (one, one_ratio), (two, two_ratio) = lead(a, b, b_tokens), lead(b, a, a_tokens)
    lead_match = comparable & F.coalesce(one | two, F.lit(False))
    when = lambda c, otherwise: F.when(comparable, c).otherwise(otherwise)
    empty = F.array().cast("array<string>")
    return F.struct(
        (comparable & (enough | lead_match)).alias("is_duplicate"),
        lead_match.alias("lead_match"),
        when(F.greatest(one_ratio, two_ratio), F.lit(0.0)).alias("lead_overlap"),
        when(F.array_sort(shared["tokens"]), empty).alias("shared_tokens"),
        when(F.array_sort(shared["topics"]), empty).alias("shared_topics"),
        when(F.array_sort(shared["locations"]), empty).alias("shared_locations"),
        when(overlap, F.lit(0.0)).alias("token_overlap"),
        when(jaccard, F.lit(0.0)).alias("token_jaccard"),
        hours.alias("time_delta_hours"),
    )


def longest_common(masks: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence of text and another text of n characters, given as masks: each character's
    places as bits. Row by row of the table, a row's steps being the zeros of one number."""
    row = full = (1 << n) - 1
    for c in text:
        here = row & masks.get(c, 0)
        row = ((row + here) | (row - here)) & full
    return n - row.bit_count()


def _codes(title: str) -> np.ndarray:
    return np.frombuffer(title.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classes(title: str) -> np.ndarray:
    return (_codes(title) % LETTERS).astype(np.int64)


def common_lengths(texts: list[str], patterns: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same as longest_common for many pairs (numbers of a text and a pattern) side by side, a number being some words of
    64 bits with carries. Characters of a class are taken for equal, so a length is never too small."""
    own_a, a = np.unique(a, return_inverse=True)
    own_b, b = np.unique(b, return_inverse=True)
    steps = np.array([len(texts[i]) for i in own_a])
    words = -(-max(len(patterns[j]) for j in own_b) // 64)
    codes = np.full((max(1, steps.max()), len(own_a)), LETTERS, np.int64)
    for k, i in enumerate(own_a):
        codes[: steps[k], k] = _classes(texts[i])
    masks = np.zeros((words, len(own_b), LETTERS + 1), np.uint64)
    for k, j in enumerate(own_b):
        at = np.arange(len(patterns[j]))
        np.bitwise_or.at(masks, (at // 64, k, _classes(patterns[j])), np.uint64(1) << (at % 64).astype(np.uint64))
    masks = masks.reshape(words, -1)
    base = b * (LETTERS + 1)
    rows = [np.full(len(a), ~np.uint64(0)) for _ in range(words)]
    for t in range(int(steps.max())):
        here, carry = base + codes[t][a], None
        for w in range(words):
            row = rows[w]
            met = row & masks[w].take(here)
            up = row + met
            over = up < row
            if carry is not None:
                up += carry
                over |= up < carry
            carry = over.astype(np.uint64)
            rows[w] = up | (row ^ met)
    return sum(np.bitwise_count(~row).astype(np.int64) for row in rows)


def long_common(texts: list[str], patterns: list[str], a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (numbers of a text and a pattern, in the order of patterns) have a common subsequence that is long enough
    for the ratio."""
    out = np.zeros(len(a), bool)
    sizes, others = np.array([len(t) for t in patterns])[b], np.array([len(t) for t in texts])[a]
    rest = np.flatnonzero(sizes <= WIDE)
    order = rest[np.lexsort((others[rest], sizes[rest]))]  # pairs of about the same lengths go together
    for at in range(0, len(order), PAIRS):
        part = order[at : at + PAIRS]
        if len(part) < FEW:
            break
        out[part] = 2 * common_lengths(texts, patterns, a[part], b[part]) >= least * (sizes[part] + others[part]) - 1e-6
        rest = np.setdiff1d(rest, part, assume_unique=True)
    last, masks = -1, {}
    for k in np.sort(np.r_[rest, np.flatnonzero(sizes > WIDE)]):
        if b[k] != last:
            last, masks = b[k], {}
            for place, c in enumerate(patterns[last]):
                masks[c] = masks.get(c, 0) | 1 << place
        out[k] = 2 * longest_common(masks, int(sizes[k]), texts[a[k]]) >= least * (sizes[k] + others[k]) - 1e-6
    return out


def letter_counts(titles: list[str]) -> np.ndarray:
    """How often each title has the characters of each of LETTERS classes."""
    out = np.zeros((len(titles), LETTERS), np.int32)
    for i, t in enumerate(titles):
        out[i] = np.bincount(_classes(t), minlength=LETTERS)
    return out


class Second:
    """A second title whose ratio with others is told as SequenceMatcher tells it: by the block that holds the longest run
    of characters that are not left out, then those to its left and right; only until it is clear which side of a bound
    the ratio is on."""

    def __init__(self, title: str):
        self.title, self.codes = title, _codes(title)
        self.matcher = None
        if len(title) < LONG:
            self.matcher = SequenceMatcher(None)
            self.matcher.set_seq2(title)
            return
        kinds, inverse, times = np.unique(self.codes, return_inverse=True, return_counts=True)
        self.places = np.flatnonzero((times <= len(title) // 100 + 1)[inverse])
        order = np.argsort(self.codes[self.places], kind="stable")
        self.places = self.places[order]
        self.held = self.codes[self.places]

    def _segments(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where runs of equal characters that are not left out begin in the first title and in this one; how long they are."""
        low, high = np.searchsorted(self.held, first, "left"), np.searchsorted(self.held, first, "right")
        times = high - low
        i = np.repeat(np.arange(len(first)), times)
        j = self.places[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(len(i))]
        width = len(self.codes) + 1
        at = np.sort((i - j + width) * (len(first) + width) + i)  # along the diagonals
        begin = np.flatnonzero(np.r_[True, np.diff(at) != 1][: len(at)])
        i = at[begin] % (len(first) + width)
        return i, i - (at[begin] // (len(first) + width) - width), np.diff(np.r_[begin, len(at)])

    def has_ratio(self, first: str, least: float) -> bool:
        length = len(first) + len(self.title)
        if not length:
            return 1.0 >= least
        codes = segments = None
        if self.matcher:
            self.matcher.set_seq1(first)
        else:
            codes = _codes(first)
            segments = self._segments(codes)
        matched, possible = 0, min(len(first), len(self.title))
        todo = [(0, len(first), 0, len(self.title))]
        while todo:
            if 2.0 * matched / length >= least:
                return True
            if 2.0 * (matched + possible) / length < least:
                return False
            k = max(range(len(todo)), key=lambda k: min(todo[k][1] - todo[k][0], todo[k][3] - todo[k][2]))
            alo, ahi, blo, bhi = todo.pop(k)
            possible -= min(ahi - alo, bhi - blo)
            if self.matcher:
                i, j, size = self.matcher.find_longest_match(alo, ahi, blo, bhi)
            else:
                i, j, size = self._longest(codes, segments, alo, ahi, blo, bhi)
            if size:
                matched += size
                for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                    if part[0] < part[1] and part[2] < part[3]:
                        todo.append(part)
                        possible += min(part[1] - part[0], part[3] - part[2])
        return 2.0 * matched / length >= least

    def _longest(self, first: np.ndarray, segments: tuple[np.ndarray, np.ndarray, np.ndarray], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        i, j, size = segments
        skip = np.maximum(0, np.maximum(alo - i, blo - j))
        left = np.minimum(size, np.minimum(ahi - i, bhi - j)) - skip
        most = int(left.max(initial=0))
        at, other, size = alo, blo, 0
        if most > 0:
            best = np.flatnonzero(left == most)
            starts = i[best] + skip[best]
            best = best[starts == starts.min()]
            at, other = int(starts.min()), int((j[best] + skip[best]).min())
            size = most
        back = min(at - alo, other - blo)
        if back:
            apart = np.flatnonzero(first[at - back : at] != self.codes[other - back : other])
            back = back - 1 - int(apart[-1]) if len(apart) else back
            at, other, size = at - back, other - back, size + back
        ahead = min(ahi - at - size, bhi - other - size)
        if ahead:
            apart = np.flatnonzero(first[at + size : at + size + ahead] != self.codes[other + size : other + size + ahead])
            size += int(apart[0]) if len(apart) else ahead
        return at, other, size


def _slack(titles: list[str]) -> np.ndarray:
    """How many matching characters of each as a second title may begin no run of RUN that the first has: RUN - 1 in each
    block. A block of a long title is found by one of its seeds, but for one that begins both titles: the ratio leaves out
    those characters of its second title, if that is of 200 or more, that are more than a hundredth of it and one; they
    only lengthen a block."""
    sizes = np.array([len(t) for t in titles], np.int64)
    owner = np.repeat(np.arange(len(titles)), sizes)
    both = np.sort(owner << 21 | _codes("".join(titles)))
    first = _first_ones(both)
    times, whose = np.diff(np.r_[first, len(both)]), both[first] >> 21
    seeds = np.bincount(whose, np.where(times <= sizes[whose] // 100 + 1, times, 0), len(titles))
    return np.where(sizes >= LONG, (1 + seeds) * (RUN - 1), np.inf)


def _runs(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each run of RUN characters of the titles (equal runs have equal ones), and whose it is."""
    sizes = np.array([len(t) for t in titles], np.int64)
    codes = _codes("".join(titles)).astype(np.uint64)
    owner = np.repeat(np.arange(len(titles)), sizes)
    n = max(0, len(codes) - RUN + 1)
    value = np.zeros(n, np.uint64)
    for k in range(RUN):
        value *= np.uint64(1_000_003)
        value += codes[k : k + n]
    value *= np.uint64(0x9E3779B97F4A7C15)
    inside = np.flatnonzero(owner[:n] == owner[RUN - 1 :]) if n else np.zeros(0, np.int64)
    return value[inside], owner[inside]


def _counted(titles: list[str], bits: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The titles' different runs in order, whose they are, and how often that title has them. bits: of a run's number so
    many give way to a title's."""
    value, owner = _runs(titles)
    both = np.sort((value >> bits) << bits | owner.astype(np.uint64))
    first = _first_ones(both)
    return both[first] >> bits, (both[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), np.diff(np.r_[first, len(both)])


def _first_ones(values: np.ndarray) -> np.ndarray:
    """Where in sorted values a new one begins."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])


def share_runs(firsts: list[str], seconds: list[str], slack: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (numbers of a first and a second title) that can have the ratio; both sides in the order of their lengths.
    slack: the seconds' _slack, all finite.

    Of m matching characters m - slack begin a run that the first title has too. Of so many, half may be runs that most
    first titles have: these are not looked up, and the other half must still be met among the rest.
    """
    n, m = (np.array([len(t) for t in side], np.float64) for side in (firsts, seconds))
    far = least / (2 - least)  # the lengths' least proportion
    shortest = np.maximum(far * m, n[np.minimum(np.searchsorted(n, far * m - 1e-6), len(n) - 1)])
    left_out = np.floor(np.maximum(least * (shortest + m) / 2 - slack, 0) / 2)
    bits = np.uint64(max(len(firsts), len(seconds)).bit_length())
    runs, has, _ = _counted(firsts, bits)
    start = _first_ones(runs)
    own, often = runs[start], np.diff(np.r_[start, len(runs)])
    value, whose, times = _counted(seconds, bits)
    at = np.minimum(np.searchsorted(own, value), max(0, len(own) - 1))
    met = np.flatnonzero(own[at] == value) if len(own) else np.zeros(0, np.int64)
    at, whose, times = at[met], whose[met], times[met]
    order = np.argsort((whose << 32) - often[at])  # a title's most frequent ones first
    at, whose, times = at[order], whose[order], times[order]
    upto = np.cumsum(times)
    begin = np.searchsorted(whose, np.arange(len(seconds) + 1))
    before = np.r_[0, upto][begin[:-1]]
    kept = np.flatnonzero(upto - before[whose] > left_out[whose])
    at, whose, times = at[kept], whose[kept], times[kept].astype(np.float32)
    begin, size = np.searchsorted(whose, np.arange(len(seconds) + 1)), often[at]
    entries = np.r_[0, np.cumsum(size)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    row = 0
    while row < len(seconds):
        low = int(np.searchsorted(n, far * m[row] - 1e-6))
        end = min(len(seconds), row + max(1, CELLS // max(1, len(firsts) - low)))
        high = int(np.searchsorted(n, m[end - 1] / far + 1e-6, "right"))
        width = high - low
        if width > 0:
            counts = np.zeros((end - row) * width, np.float32)
            k, stop = begin[row], begin[end]
            while k < stop:  # so many runs at once that what they meet is at most CELLS, or one
                upper = min(stop, max(k + 1, int(np.searchsorted(entries, entries[k] + CELLS, "right")) - 1))
                many = size[k:upper]
                place = np.repeat(start[at[k:upper]] - (entries[k:upper] - entries[k]), many) + np.arange(entries[upper] - entries[k])
                first, second = has[place], np.repeat(whose[k:upper] - row, many)
                weight = np.repeat(times[k:upper], many)
                if low or high < len(firsts):
                    fits = (first >= low) & (first < high)
                    first, second, weight = first[fits], second[fits], weight[fits]
                counts += np.bincount(second * width + first - low, weight, len(counts)).astype(np.float32)
                k = upper
            rest = (least * m[row:end] / 2 - slack[row:end] - left_out[row:end] - 1e-3).astype(np.float32)
            second, first = np.nonzero(counts.reshape(-1, width) >= rest[:, None] + (least * n[low:high] / 2).astype(np.float32)[None, :])
            first, second = first + low, second + row
            fits = 2 * np.minimum(n[first], m[second]) >= least * (n[first] + m[second]) - 1e-6
            found.append((first[fits], second[fits]))
        row = end
    return tuple(np.concatenate(side) for side in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _projections(titles: list[str], groups: np.ndarray, local: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of classes the titles' characters of it: the class's number in the group, whose, and which in order."""
    codes = _classes("".join(titles))
    owner = np.repeat(np.arange(len(titles)), [len(t) for t in titles])
    out = []
    for g in range(groups.max() + 1):
        held = np.flatnonzero(groups[codes] == g)
        own = owner[held]
        out.append((local[codes[held]], own, np.arange(len(own)) - np.searchsorted(own, own)))
    return out


def _grouped(often: np.ndarray, room: float) -> np.ndarray:
    """The number of a group for each class; often: a title's characters of it. A group has room characters at most, groups
    of many classes come first. -1 for classes that nobody has or that are alone: these match as often as both have them."""
    groups, load = np.full(len(often), -1), np.zeros(0)
    for c in np.argsort(-often, kind="stable"):
        if often[c] <= 0:
            break
        fits = np.flatnonzero(load + often[c] <= room)
        if not len(fits):
            fits, load = [len(load)], np.r_[load, 0.0]
        groups[c] = fits[0]
        load[fits[0]] += often[c]
    sizes = np.bincount(groups[groups >= 0], minlength=1)
    number = np.full(len(sizes), -1)
    order = [g for g in np.argsort(-sizes, kind="stable") if sizes[g] > 1]
    number[order] = np.arange(len(order))
    return np.where(groups >= 0, number[groups], -1)


def in_order(texts: list[str], patterns: list[str], near: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """Which of the near pairs of texts and patterns can have the ratio, by the common subsequences of their characters of a
    few classes at a time: what two titles match is at most what these add up to. common: the characters that they share
    in any order, which is what classes that are not looked at count for. A pattern's characters of a group are the bits of
    one number; those that it has no bits for are taken for matched.
    """
    a, b = letter_counts(texts), letter_counts(patterns)
    mean = b.sum() / max(1, len(b))
    kind, size = (np.uint32, 32) if mean <= SHORT else (np.uint64, 64)
    groups = _grouped((a.sum(axis=0) + b.sum(axis=0)) * mean / max(1, a.sum() + b.sum()), FULL * size)
    local = np.zeros(len(groups), np.int64)
    for g in range(groups.max() + 1):
        local[groups == g] = np.arange((groups == g).sum())
    lengths = [np.array([len(t) for t in side]) for side in (texts, patterns)]
    asked = least / 2 * (lengths[0][:, None] + lengths[1][None, :]) - 1e-3
    live, bound, full = near.copy(), common.astype(np.int32), ~kind(0)
    order = _alike_first(a)
    for g, ((codes, own, place), (kinds, whose, bit)) in enumerate(zip(_projections(texts, groups, local), _projections(patterns, groups, local), strict=True)):
        many = int(live.sum())
        if many <= FEW:
            break
        own_classes = np.flatnonzero(groups == g)
        step = np.full((int(place.max(initial=-1)) + 1, len(texts)), len(own_classes), np.int64)
        step[place, own] = codes
        mask = np.zeros((len(own_classes) + 1, len(patterns)), kind)
        fits = bit < size
        np.bitwise_or.at(mask, (kinds[fits], whose[fits]), kind(1) << bit[fits].astype(kind))
        over = np.bincount(whose[~fits], minlength=len(patterns))
        steps = np.bincount(own, minlength=len(texts))
        if many < live.size * SPARSE:  # pair by pair
            rows, cols = np.nonzero(live)
            rank = np.argsort(steps[rows], kind="stable")
            for at in range(0, many, PAIRS):
                i, j = rows[rank[at : at + PAIRS]], cols[rank[at : at + PAIRS]]
                row = np.full(len(i), full)
                for t in range(int(steps[i].max())):
                    met = mask.take(step[t][i] * len(patterns) + j)
                    met &= row
                    row = (row + met) | (row ^ met)
                shared = np.minimum(a[i][:, own_classes], b[j][:, own_classes]).sum(axis=1)
                bound[i, j] -= np.maximum(0, shared - (np.bitwise_count(~row) + over[j]))
                live[i, j] = bound[i, j] >= asked[i, j]
            continue
        for at in range(0, len(order), ROWS):
            rows = order[at : at + ROWS]
            cols = np.flatnonzero(live[rows].any(axis=0))
            if not len(cols):
                continue
            part = np.ascontiguousarray(mask[:, cols])
            row = np.full((len(rows), len(cols)), full)
            met, up = np.empty_like(row), np.empty_like(row)
            for codes_at in step[: int(steps[rows].max()), rows]:
                part.take(codes_at, axis=0, out=met, mode="clip")
                np.bitwise_and(met, row, out=met)
                np.add(row, met, out=up)
                np.bitwise_xor(row, met, out=row)
                np.bitwise_or(row, up, out=row)
            shared = np.zeros(row.shape, np.int32)
            for k in own_classes:
                shared += np.minimum(a[rows, k][:, None], b[cols, k][None, :])
            here = np.ix_(rows, cols)
            now = bound[here] - np.maximum(0, shared - (np.bitwise_count(~row) + over[cols][None, :]))
            bound[here] = now
            live[here] &= now >= asked[here]
    return live


def _alike_first(counts: np.ndarray) -> np.ndarray:
    """An order in which titles of alike letters follow each other. Only cost depends on it."""
    share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    share -= share.mean(axis=0)
    ways = np.linalg.eigh(share.T @ share)[1][:, -3:]
    sides = share @ ways
    return np.lexsort((sides[:, 2], sides[:, 0] > 0, sides[:, 1] > 0, sides[:, 2] > 0))


def may_match(texts: list[str], others: list[str], least: float, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (numbers of a text and another) that can have the ratio whatever their lengths, tile by tile; both sides in the
    order of their lengths. wanted: for each number of a text the first number of the others that it is compared with."""
    n, m = (np.array([len(t) for t in side], np.float64) for side in (texts, others))
    far = least / (2 - least)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    i = 0
    while i < len(texts):
        end_i = min(len(texts), i + max(16, int(TILE * min(1, 400 / max(1, n[min(len(n), i + TILE) - 1])))))
        first = int(np.searchsorted(m, far * n[i] - 1e-6))
        if wanted is not None:
            first = max(first, int(wanted[i:end_i].min()))
        last = int(np.searchsorted(m, n[end_i - 1] / far + 1e-6, "right"))
        j = first
        while j < last:
            end_j = min(last, j + max(16, int(TILE * min(1, 400 / max(1, m[min(len(m), j + TILE) - 1])))))
            left, right = texts[i:end_i], others[j:end_j]
            apart = letters_apart(left, right)
            both = n[i:end_i, None] + m[None, j:end_j]
            near = apart <= (1 - least) * both + 1e-6
            if wanted is not None:
                near &= np.arange(j, end_j)[None, :] >= wanted[i:end_i, None]
            if near.any():
                common = ((both - apart) / 2).astype(np.int32)
                if n[i:end_i].sum() * len(right) <= m[j:end_j].sum() * len(left):
                    near = in_order(left, right, near, common, least)
                else:
                    near = in_order(right, left, np.ascontiguousarray(near.T), np.ascontiguousarray(common.T), least).T
                a, b = np.nonzero(near)
                found.append((a + i, b + j))
            j = end_j
        i = end_i
    return tuple(np.concatenate(side) for side in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_titles(left: list[tuple[int, str]], right: list[tuple[int, str]], least: float, once: bool = False) -> np.ndarray:
    """Ids of the first and the second title of pairs of left and right, in either order, that can have a ratio of at least
    least. once: left and right are the same.

    Pairs are left out by bounds that the ratio never passes. Where the second title is long (and not nearly all of rare
    characters) these are its runs that the first has too, which are looked up, so that pairs that share few cost next to
    nothing; elsewhere shared letters and common subsequences of a few letters, for tiles of pairs at once, then the whole
    longest common subsequence.
    """
    left, right = sorted(left, key=lambda x: len(x[1])), sorted(right, key=lambda x: len(x[1]))
    texts, others = [t for _, t in left], [t for _, t in right]
    l_ids, r_ids = np.array([i for i, _ in left], np.int64), np.array([i for i, _ in right], np.int64)
    if not left or not right:
        return np.zeros((2, 0), np.int64)
    # titles that their runs tell as second ones, whatever the first
    far = least / (2 - least)
    l_slack = _slack(texts)
    r_slack = l_slack if once else _slack(others)
    of_runs = lambda side, slack: far * np.array([len(t) for t in side]) - slack >= MET
    pick = lambda side, which: [side[k] for k in which]
    l_runs, r_runs = of_runs(texts, l_slack), of_runs(others, r_slack)
    l_long, r_long, l_rest, r_rest = (np.flatnonzero(x) for x in (l_runs, r_runs, ~l_runs, ~r_runs))
    # pairs that may have the ratio as left, right (ahead) and as right, left, as numbers; by runs, and by common subsequences
    none = np.zeros(0, np.int64)
    by_runs, by_letters = {True: none, False: none}, {True: none, False: none}
    width = len(others)
    if len(r_long):
        a, b = share_runs(texts, pick(others, r_long), r_slack[r_long], least)
        b = r_long[b]
        by_runs[True] = (a * width + b)[(a < b) | (not once)]
        if once:
            by_runs[False] = (b * width + a)[b < a]
    if len(l_long) and not once:
        b, a = share_runs(others, pick(texts, l_long), l_slack[l_long], least)
        by_runs[False] = l_long[a] * width + b
    if len(l_rest):
        a, b = may_match(pick(texts, l_rest), others, least, l_rest + 1 if once else None)
        by_letters[False] = l_rest[a] * width + b
        by_letters[True] = by_letters[False][~r_runs[b]]
    if len(l_long) and len(r_rest):
        a, b = may_match(pick(texts, l_long), pick(others, r_rest), least, np.searchsorted(r_rest, l_long) if once else None)
        by_letters[True] = np.concatenate([by_letters[True], l_long[a] * width + r_rest[b]])
    near = np.unique(np.concatenate([*by_letters.values(), *by_runs.values()]))
    near = near[np.argsort(near % width, kind="stable")]
    long = np.array([len(t) > ALIGNED for t in others])[near % width]  # for these the ratio costs no more
    short = near[~long]
    near = np.r_[near[long], short[long_common(texts, others, short // width, short % width, least)]]
    found = []
    for ahead in (True, False):
        asked = np.intersect1d(np.concatenate([by_runs[ahead], by_letters[ahead]]), near)
        a, b = l_ids[asked // width], r_ids[asked % width]
        found.append(np.stack([a, b] if ahead else [b, a])[:, a != b])
    return np.concatenate(found, axis=1)


def alike_titles(left: list[tuple[int, str]], right: list[tuple[int, str]], least: float, once: bool = False) -> list[tuple[int, int, bool, bool]]:
    """Ids (the lesser first) of titles of left and right with a ratio of at least least in either order, and in which:
    the lesser first, the lesser second. once: left and right are the same, and each pair is compared once."""
    titles = dict([*left, *right])
    told: dict[tuple[int, int], set[bool]] = {}
    for i, j in near_titles(left, right, least, once).T.tolist():
        if Second(titles[j]).has_ratio(titles[i], least):
            told.setdefault((min(i, j), max(i, j)), set()).add(i < j)
    return [(i, j, True in ways, False in ways) for (i, j), ways in told.items()]


def _have_ratio(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """l_id, r_id and whether it is the ratio of the lesser id's title as the first one, of rows that have the ratio."""
    last, second = None, None
    for batch in batches:
        first_ids, second_ids, titles, others = (batch[c].to_pylist() for c in ("first", "second", "first_title", "second_title"))
        kept = []
        for i, j, title, other in zip(first_ids, second_ids, titles, others, strict=True):
            if second is None or j != last:
                last, second = j, Second(other)
            if second.has_ratio(title, least):
                kept.append((min(i, j), max(i, j), i < j))
        columns = list(zip(*kept, strict=True)) or [()] * 3
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["l_id", "r_id", "ahead"])


def letters_apart(left: list[str], right: list[str]) -> np.ndarray:
    """By how much the counts of characters of each pair of titles differ."""
    a, b = letter_counts(left), letter_counts(right)
    n, m = a.sum(axis=1), b.sum(axis=1)
    kind = np.int16 if max(n.max(initial=0), m.max(initial=0)) < 1 << 14 else np.int32  # a difference is at most both lengths
    a, b = np.ascontiguousarray(a.T, kind), np.ascontiguousarray(b.T, kind)
    out = np.zeros((len(n), len(m)), kind)
    held = np.flatnonzero(a.any(axis=1) | b.any(axis=1))
    for at in range(0, len(n), ROWS):  # so few rows at once that they stay near
        for k in held:
            out[at : at + ROWS] += np.abs(a[k, at : at + ROWS, None] - b[k, None, :])
    return out


def may_be_alike(left: list[str], right: list[str], least: float) -> np.ndarray:
    """Which pairs can have the ratio: what two titles match is at most what their counts of characters share, so these
    differ by at most 1 - least of both lengths together."""
    n, m = np.array([len(t) for t in left]), np.array([len(t) for t in right])
    return letters_apart(left, right) <= (1 - least) * (n[:, None] + m[None, :]) + 1e-6


def title_pairs(titles: DataFrame, least: float = TITLE, block: int | None = None) -> DataFrame:
    """l_id and r_id of titles (id, title; distinct normalized ones) with a ratio of at least least in either order, and
    whether l compared with r (forward) and r with l (backward) have it.

    No match is lost: titles are numbered by length and cut into blocks of about block titles (fewer of long ones), and each
    block meets those blocks whose lengths the ratio allows. No task holds more than two blocks, however many titles have
    one length. Without block, the more titles there are the larger are the blocks, within bounds: a title is sent once to
    each block that its own meets.
    """
    spark = titles.sparkSession
    if least >= 1:  # only equal titles have that ratio
        return spark.createDataFrame([], PAIR)
    sized = materialize(titles.where("title is not null").select("id", "title", F.length("title").cast("long").alias("n")), "titles")
    # a long title takes the room of several
    room = F.ceil(F.greatest(F.col("n"), F.lit(1)) / TITLE_ROOM)
    longest, rooms = sized.agg(F.max("n"), F.sum(room)).first()
    if longest is None:
        return spark.createDataFrame([], PAIR)
    if block is None:
        block = min(max(TITLE_BLOCKS[0], rooms // TITLE_PARTS), TITLE_BLOCKS[1])
    far = (2 - least) / least  # how many times as long a partner can be
    # a row for each length up to the longest title's longest partner, with how much room titles take that are no longer
    lengths = spark.range(int(longest * far) + 2).withColumnRenamed("id", "n").join(sized.groupBy("n").agg(F.count(F.lit(1)).alias("own")), "n", "left")
    known = materialize(lengths.select("n", F.coalesce("own", F.lit(0)).alias("own"), room.alias("room")).withColumn("upto", F.sum(F.col("own") * F.col("room")).over(Window.orderBy("n"))), "lengths")
    upto = lambda c, name: known.select(F.col("n").alias(c), F.col("upto").alias(name))
    ranged = sized.withColumns({"up": F.floor(F.col("n") * far + 1e-9), "down": F.greatest(F.ceil(F.col("n") / far - 1e-9) - 1, F.lit(0))})
    told = ranged.join(known, "n").join(upto("up", "last"), "up").join(upto("down", "before"), "down")
    number = F.col("upto") + (F.pmod(F.xxhash64("id"), "own") - F.col("own")) * F.col("room")
    part = lambda c: F.floor(c / block)
    placed = told.select("id", "title", part(number).alias("part"), F.explode(F.sequence(F.least(part(F.col("before")), part(number)), F.greatest(part(F.col("last") - 1), part(number)))).alias("other"))
    dealt = placed.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        side = lambda k: list(rows.loc[rows["part"] == rows[k].iloc[0], ["id", "title"]].itertuples(index=False, name=None))
        found = near_titles(side("low"), side("high"), least, once=bool(rows["low"].iloc[0] == rows["high"].iloc[0]))
        return pd.DataFrame({"first": found[0], "second": found[1]})

    blocks = rooms // block + 1
    met = dealt.repartition(min(TITLE_TASKS, blocks * (blocks + 1) // 3 + 1), "low", "high").groupBy("low", "high").applyInPandas(compare, "first long, second long")
    # ratios are taken apart from blocks: those of titles that are nearly all alike would be one task's work
    side = lambda c: sized.select(F.col("id").alias(c), F.col("title").alias(f"{c}_title"))
    both = materialize(met, "near").join(side("first"), "first").join(side("second"), "second")
    told = both.repartition(min(RATIO_TASKS, 4 * blocks), "second").sortWithinPartitions("second").mapInArrow(lambda batches: _have_ratio(batches, least), "l_id long, r_id long, ahead boolean")
    return told.groupBy("l_id", "r_id").agg(F.max("ahead").alias("forward"), F.max(~F.col("ahead")).alias("backward"))


def history_rows(items: DataFrame) -> DataFrame:
    """What is kept of published items: no texts, and dates as ISO text."""
    return items.select("title", "url", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("published_at"), "source", "event_fingerprint")


