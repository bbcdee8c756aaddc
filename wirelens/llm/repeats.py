"""Removal of long repeated byte strings with run-length suffix indexes over shards of anchored text.

Every window of LENGTH bytes has an anchor: its least-hashed run of ANCHOR bytes. Equal windows have equal anchors, so
consecutive windows with one anchor are kept together as a segment (their common text) and dealt out by the anchor's
hash: windows that can be equal meet in one shard, and no shard needs more than its part of the text. Anchors that a
sample shows to be hot are dealt out further: equal windows agree on their anchor and, to its right or to its left, on
half of their other bytes, so a hot anchor's segments go by the hash of either side.

Equal segments (by 64-bit names, then byte by byte) are one variant from the start, already in the task that cuts the
texts: all but those of the least document are repeats as a whole. Anchors with several variants go into the shard's
index: the Burrows-Wheeler transform of the variants' text, run-length compressed, with the text positions at run starts
and the run ends before them as samples. Between samples, in text order, the preceding suffix moves along with the
position and the length of its match shrinks by one; so matching statistics stream through the text from the samples
alone. Chains of matches of at least LENGTH bytes are classes of equal windows, and a window is a repeat if its class has
a smaller document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import grouped_runs, materialize

LENGTH, ANCHOR = 50, 12
#: Bytes of text that are hashed at once, that a shard has about, and that one index has about.
CHUNK_BYTES, SHARD_BYTES, INDEX_BYTES = 256 << 10, 6 << 20, 1 << 20
#: Bytes of text whose segments are combined before they are sent, and bytes of documents that are settled together.
COMBINE_BYTES, HOME_BYTES = 10 << 20, 16 << 20
#: Effort of the compression of segments.
LEVEL = 5
#: An anchor is hot if its variants have more than a shard's bytes, by the rows of which the hash is 0 modulo SAMPLE.
SAMPLE = 32

#: Equal windows agree on their anchor and, on one side of it at least, on half of the window's other bytes.
SIDE = ANCHOR + (LENGTH - ANCHOR) // 2
#: Windows with one anchor cover at most so many bytes.
MOST = 2 * LENGTH - ANCHOR

_U8 = np.uint64
#: Odd multipliers of the hashes.
_MIX = [_U8(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_PLACE_BITS = 24  # places within a chunk
_HALF = _U8(32)


def _mixed(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    x = a * _MIX[k]
    x += b
    x ^= x >> _U8(31)
    x *= _MIX[(k + 1) % len(_MIX)]
    return x


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers, without a copy."""
    return np.ndarray((max(0, len(text) - 7),), "<u8", text, strides=(1,))


def anchors_at(words: np.ndarray, at: np.ndarray | slice, further: np.ndarray | slice) -> np.ndarray:
    """Hashes of the runs of ANCHOR bytes whose first and last eight bytes are words at these places."""
    return _mixed(words[at], words[further], 0)


def names_of(words: np.ndarray, at: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Names of segments: half of their anchor's hash, then half of that of all their bytes."""
    found = size.astype(_U8)
    for k in range(0, MOST, 8):
        found = _mixed(found, words[at + np.minimum(k, size - 8)], 1 + k // 8 % 4)
    return anchor >> _HALF << _HALF | found >> _HALF


def sides_of(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes (odd) of the SIDE bytes from places on."""
    found = _mixed(words[at], words[at + 8], 2)
    return _mixed(_mixed(found, words[at + 16], 3), words[at + SIDE - 8], 4) | _U8(1)


class Segments:
    """Columns of segments: doc and row (of the document), start, size, place (of the anchor in it), name, and where each
    is in text."""

    NAMES = ("doc", "row", "start", "size", "place", "name", "at")

    def __init__(self, doc, row, start, size, place, name, at, text: np.ndarray):
        self.doc, self.row, self.start, self.size, self.place, self.name, self.at, self.text = doc, row, start, size, place, name, at, text

    def anchor(self) -> np.ndarray:
        return self.name >> _HALF

    def take(self, which: np.ndarray) -> Segments:
        return Segments(*(getattr(self, n)[which] for n in self.NAMES), self.text)

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchor with its right and with its left side; 0 where the segment is too short for it."""
        words, first = eights(self.text), self.at + self.place
        right, left = self.place + SIDE <= self.size, self.place + ANCHOR >= SIDE
        out = np.zeros(len(first), _U8), np.zeros(len(first), _U8)
        out[0][right], out[1][left] = sides_of(words, first[right]), sides_of(words, first[left] + ANCHOR - SIDE)
        return out

    def pack(self) -> bytes:
        """Compressed; a document's numbers are there once, and hashes are left out."""
        new = np.flatnonzero(np.r_[True, (self.row[1:] != self.row[:-1]) | (self.doc[1:] != self.doc[:-1])])
        counts = np.diff(np.r_[new, len(self.row)])
        parts = [np.array([len(new), len(self.row)], "<i8"), self.doc[new].astype("<i8"), self.row[new].astype("<i8"), counts.astype("<i4"), np.diff(self.start, prepend=0).astype("<i8"), self.size.astype("u1"), self.place.astype("u1"), gather(self.text, self.at, self.size)]
        return zstandard.compress(b"".join(x.tobytes() for x in parts), LEVEL)

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> Segments:
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for blob in blobs:
            raw, at = zstandard.decompress(blob), 16
            docs, n = np.frombuffer(raw, "<i8", 2).tolist()
            found = []
            for kind, count in (("<i8", docs), ("<i8", docs), ("<i4", docs), ("<i8", n), ("u1", n), ("u1", n)):
                found.append(np.frombuffer(raw, kind, count, at))
                at += found[-1].nbytes
            doc, row, counts, steps, size, place = found
            for x, y in zip(parts, (np.repeat(doc, counts), np.repeat(row, counts), np.cumsum(steps), size.astype(np.int64), place.astype(np.int64), np.frombuffer(raw, np.uint8, -1, at)), strict=True):
                x.append(y)
        doc, row, start, size, place, text = (np.concatenate(x) for x in parts)
        at, words = np.cumsum(size) - size, eights(text)
        return cls(doc, row, start, size, place, names_of(words, at, size, anchors_at(words, at + place, at + place + ANCHOR - 8)), at, text)


def gather(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of text of these places and sizes, one after another."""
    ends = np.cumsum(size)
    step = np.ones(int(ends[-1]) if len(ends) else 0, np.int32)
    step[np.r_[0, ends[:-1]][: len(ends)]] = np.r_[at[:1], at[1:] - at[:-1] - size[:-1] + 1]
    return text[np.cumsum(step, out=step)]


def cut(text: np.ndarray, ends: np.ndarray, docs: np.ndarray, rows: np.ndarray) -> Segments:
    """Segments of documents that lie one after another in text, each up to its end."""
    n, width, words = len(text), LENGTH - ANCHOR + 1, eights(text)
    parts: list[list[np.ndarray]] = [[] for _ in range(4)]
    for low in range(0, n - LENGTH + 1, CHUNK_BYTES):
        m = min(CHUNK_BYTES + LENGTH - 1, n - low)
        own = anchors_at(words, slice(low, low + m - ANCHOR + 1), slice(low + ANCHOR - 8, low + m - 7))
        key = own >> _U8(_PLACE_BITS) << _U8(_PLACE_BITS) | np.arange(len(own), dtype=_U8)
        reach = 1
        while 2 * reach <= width:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
        place = (key & _U8((1 << _PLACE_BITS) - 1)).astype(np.int64)
        good = np.ones(len(place) + 2, bool)  # windows within one document; a place more on either side
        good[[0, -1]] = False
        for e in ends[np.searchsorted(ends, low, "right") : np.searchsorted(ends, low + m, "left")].tolist():
            good[max(1, e - low - LENGTH + 2) : e - low + 1] = False
        turn = np.r_[True, place[1:] != place[:-1], True]
        first, last = (np.flatnonzero(good[1:-1] & (x | ~y)) for x, y in ((turn[:-1], good[:-2]), (turn[1:], good[2:])))
        for x, y in zip(parts, (first + low, last - first + LENGTH, place[first] - first, own[place[first]]), strict=True):
            x.append(y)
    at, size, place, anchor = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)
    which = np.searchsorted(ends, at, "right")
    return Segments(docs[which], rows[which], at - np.r_[0, ends[:-1]][which], size, place, names_of(words, at, size, anchor.astype(_U8)), at, text)


def split_repeats(s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the segments by name; where each variant starts in it, and its least document; and, of all in that order,
    whether a smaller document has the same segment."""
    order = np.argsort(s.name)
    name, doc = s.name[order], s.doc[order]
    new = np.r_[True, name[1:] != name[:-1]][: len(name)]
    if len(odd := unequal(s, order, np.flatnonzero(~new))):
        exact: dict[bytes, int] = {}
        for k in np.flatnonzero(np.isin(s.name, name[odd])):
            own = exact.setdefault(s.text[s.at[k] : s.at[k] + s.size[k]].tobytes(), len(exact))
            s.name[k] = s.name[k] >> _HALF << _HALF | _U8(own)
        return split_repeats(s)
    start = np.flatnonzero(new)
    least = np.minimum.reduceat(doc, start) if len(start) else start
    return order, start, least, doc > np.repeat(least, np.diff(np.r_[start, len(order)]))


def unequal(s: Segments, order: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of these numbers in order those whose segments' bytes differ from those before them, although names are equal."""
    words, x, y = eights(s.text), order[which], order[which - 1]
    differ = s.size[x] != s.size[y]
    for k in range(0, MOST, 8):
        step = np.minimum(k, np.minimum(s.size[x], s.size[y]) - 8)
        differ |= words[s.at[x] + step] != words[s.at[y] + step]
    return which[differ]


def may_share(anchor: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of variants: whether another one has the same anchor with the same right or left side."""
    found = np.zeros(len(anchor), bool)
    for side in (right, left):
        own = np.flatnonzero(side)
        _, back, count = np.unique(_mixed(anchor[own], side[own], 1), return_inverse=True, return_counts=True)
        found[own] |= count[back] > 1
    return found


class RunLengthIndex:
    """The run-length compressed Burrows-Wheeler transform of some texts, sampled at run ends.

    Suffixes are in full order; each text ends in a symbol of its own, greater than all bytes and ordered as the texts.
    """

    def __init__(self, text: np.ndarray, size: np.ndarray):
        ends = np.cumsum(size + 1) - 1
        n = int(ends[-1]) + 1
        body = np.ones(n, bool)
        body[ends] = False
        self.symbols = np.full(n, 255, np.uint8)  # no byte of UTF-8 text is 255
        self.symbols[body] = text
        self.left = np.repeat(ends, size + 1) - np.arange(n)  # bytes up to the text's end
        order = self._sort(int(size.max()) + 1)
        before = self.symbols[order - 1].astype(np.int16)
        before[(order == 0) | (self.left[order - 1] == 0)] = -1  # a text's first suffix: a run of its own
        head = np.r_[True, (before[1:] != before[:-1]) | (before[1:] < 0)]
        self.run_symbols, at = before[head], np.flatnonzero(head)
        self.run_lengths = np.diff(np.r_[at, n])
        place = order[at]  # text places at run starts
        above = np.r_[-1, order[at[1:] - 1]]  # and at the run ends before them
        by_place = np.argsort(place)
        self.sample, self.above = place[by_place], above[by_place]
        self.match = self._common(self.sample, self.above)

    def _sort(self, depth: int) -> np.ndarray:
        """All suffixes in order, by doubling the compared length from five bytes on."""
        n, padded = len(self.symbols), np.r_[self.symbols, np.zeros(8, np.uint8)].astype(_U8)
        key = np.zeros(n, _U8)
        for j in range(8):
            key = key << _U8(8) | np.where(self.left >= j, padded[j : n + j], _U8(0))
        self.eight, bits, places = key, n.bit_length(), np.arange(n, dtype=_U8)

        def ordered(key: np.ndarray, width: int) -> np.ndarray:
            """Places by key (of so many bits), then by place: as one sort of numbers where both fit into one."""
            if width + bits > 64:
                return np.argsort(key, kind="stable")
            return (np.sort(key << _U8(bits) | places) & _U8((1 << bits) - 1)).astype(np.int64)

        h, key = 5, key >> _U8(24)
        order = ordered(key, 40)
        while True:
            k = key[order]
            same = (k[1:] == k[:-1]) & (self.left[order[1:]] >= h)  # those that have ended differ by their ends
            if h >= depth or not same.any():
                return order
            rank = np.empty(n, _U8)
            rank[order] = np.cumsum(np.r_[0, ~same]).astype(_U8)
            key = rank << _U8(bits)
            key[:-h] |= np.where(self.left[:-h] >= h, rank[h:], _U8(0))
            order, h = ordered(key, 2 * bits), 2 * h

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common text from places p and q on, within their texts; 0 where q is negative."""
        most = np.where(q >= 0, np.minimum(self.left[p], self.left[q]), 0)
        found, open_ = np.zeros(len(p), np.int64), np.flatnonzero(most > 0)
        while len(open_):
            a, b = p[open_] + found[open_], q[open_] + found[open_]
            x = self.eight[a] ^ self.eight[b]
            equal = np.full(len(x), 8, np.int64)
            odd = x > 0
            equal[odd] = _leading_bytes(x[odd])
            found[open_] += equal
            open_ = open_[~odd & (found[open_] < most[open_])]
        return np.minimum(found, most)

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics in text order: for each place the preceding suffix's place and the length of their match."""
        n = len(self.symbols)
        gap = np.diff(np.r_[self.sample, n])
        ahead = np.arange(n) - np.repeat(self.sample, gap)
        return np.repeat(self.above, gap) + ahead, np.repeat(self.match, gap) - ahead


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the top of each (non-zero) number."""
    found = np.zeros(len(x), np.int64)
    for shift in (32, 16, 8):
        zero = x >> _U8(64 - shift) == 0
        found[zero] += shift // 8
        x = np.where(zero, x << _U8(shift), x)
    return found


def repeated_windows(text: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of variants with text, size and (least) document: variant and start of each window that a smaller document has."""
    index = RunLengthIndex(text, size.astype(np.int64))
    above, match = index.stream()
    n = len(index.symbols)
    root = np.where(match >= length, above, np.arange(n))
    while True:
        further = root[root]
        if (further == root).all():
            break
        root = further
    owner = np.repeat(np.arange(len(size)), size + 1)
    least = np.full(n, np.iinfo(np.int64).max)
    windows = np.flatnonzero(index.left >= length)
    np.minimum.at(least, root[windows], doc[owner[windows]])
    hit = windows[doc[owner[windows]] > least[root[windows]]]
    first = np.r_[0, np.cumsum(size + 1)[:-1]]
    return owner[hit], hit - first[owner[hit]]


def shard_spans(s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, row, start and end of the repeats among a shard's segments."""
    order, start, least, repeat = split_repeats(s)
    whole = order[repeat]
    out = [(s.doc[whole], s.row[whole], s.start[whole], s.start[whole] + s.size[whole])]
    variants = s.take(order[start])
    chosen = np.flatnonzero(may_share(variants.anchor(), *variants.sides()))
    anchor, doc = variants.anchor()[chosen], least[chosen]
    group = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(chosen) else chosen
    if len(chosen):
        several = np.minimum.reduceat(doc, group) != np.maximum.reduceat(doc, group)
        chosen = chosen[np.repeat(several, np.diff(np.r_[group, len(chosen)]))]
        anchor = variants.anchor()[chosen]
    if len(chosen):
        # indexes of bounded size; an anchor's variants stay together
        part = (np.cumsum(variants.size[chosen] + 1) - 1) // INDEX_BYTES
        fresh = np.r_[True, anchor[1:] != anchor[:-1]]
        part = part[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        length = np.diff(np.r_[start, len(order)])
        for p in np.unique(part):
            own = chosen[part == p]
            v = variants.take(own)
            which, at = repeated_windows(gather(v.text, v.at, v.size), v.size, least[own])
            if not len(which):
                continue
            new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)])
            which, low, high = which[new], at[new], at[np.r_[new[1:], len(at)] - 1] + LENGTH
            # every place where the least document has the variant
            many = length[own][which]
            place = np.repeat(start[own][which] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            low, high = np.repeat(low, many), np.repeat(high, many)
            keep = ~repeat[place]
            i = order[place[keep]]
            out.append((s.doc[i], s.row[i], s.start[i] + low[keep], s.start[i] + high[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spans_batch(doc: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, homes: int) -> pa.RecordBatch:
    """(home, data): spans packed for each home, the bucket of documents that they go to."""
    home = row % homes
    order = np.lexsort((low, row, home))
    home, packed = home[order], np.stack([doc[order], row[order], low[order], high[order]]).astype("<i8")
    new = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if len(home) else np.zeros(0, int)
    squeeze = zstandard.ZstdCompressor(1).compress
    data = [squeeze(packed[:, a:b].tobytes()) for a, b in zip(new, np.r_[new[1:], len(home)], strict=True)] if len(home) else []
    return pa.record_batch([pa.array(home[new]), pa.array(data, pa.binary())], ["home", "data"])


def batches_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """text, ends, doc_id (0 for null), row and whether there is a doc_id, of batches' documents (null texts are empty),
    about most bytes at a time."""
    held, have = [], 0

    def joined() -> tuple[np.ndarray, ...]:
        text, sizes, docs, rows, known = (np.concatenate(x) for x in zip(*held, strict=True))
        return text, np.cumsum(sizes), docs, rows, known

    for batch in batches:
        for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
            texts = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            held.append((data, np.diff(ends), pc.fill_null(part.column("doc_id"), 0).to_numpy(), part.column("row").to_numpy(), pc.is_valid(part.column("doc_id")).to_numpy(zero_copy_only=False)))
            have += len(data)
            if have > most:
                yield joined()
                held, have = [], 0
    if held:
        yield joined()


def hot_anchors(rows: DataFrame) -> np.ndarray:
    """Anchors whose variants have more than a shard's bytes, as estimated from every SAMPLE-th row; sorted.

    There are at most as many as there are shards' bytes in all segments. They only decide where segments go.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, ends, doc, row, _ in batches_of(batches, COMBINE_BYTES):
            s = cut(text, ends, doc, row)
            name, variant = np.unique(s.name, return_index=True)
            anchor, back = np.unique(name >> _HALF, return_inverse=True)
            yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(np.bincount(back, s.size[variant], len(anchor)).astype(np.int64))], ["anchor", "bytes"])

    counted = rows.where(F.pmod("row", F.lit(SAMPLE)) == 0).mapInArrow(count, "anchor bigint, bytes bigint").groupBy("anchor").agg(F.sum("bytes").alias("bytes"))
    found = counted.where(F.col("bytes") * SAMPLE > SHARD_BYTES).select("anchor").toPandas()
    return np.sort(found["anchor"].to_numpy(np.int64).view(_U8))


def dealer(hot: np.ndarray, shards: int, homes: int):
    """A function from batches of (doc_id, text, row) to rows of shard and data (packed segments), or of home and data
    (packed spans of what a smaller document of the task has as a whole)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, ends, doc, row, _ in batches_of(batches, COMBINE_BYTES):
            s = cut(text, ends, doc, row)
            order, _, _, repeat = split_repeats(s)
            done = order[repeat]
            covered = spans_batch(s.doc[done], s.row[done], s.start[done], s.start[done] + s.size[done], homes)
            kept = s.take(np.sort(order[~repeat]))
            goes, hashes = np.arange(len(kept.at)), kept.anchor()
            if (warm := np.isin(hashes, hot)).any():
                right, left = kept.take(goes[warm]).sides()
                ways = [(goes[~warm], hashes[~warm]), *((goes[warm][side > 0], side[side > 0] >> _HALF) for side in (right, left))]
                goes, hashes = (np.concatenate(x) for x in zip(*ways, strict=True))
            shard = (hashes % _U8(shards)).astype(np.int64)
            by = np.lexsort((goes, shard))
            shard, goes = shard[by], goes[by]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else goes
            blobs = [kept.take(goes[a:b]).pack() for a, b in zip(cuts, np.r_[cuts[1:], len(goes)], strict=True)] if len(cuts) else []
            yield pa.record_batch([pa.array(shard[cuts]), pa.nulls(len(cuts)).cast(pa.int64()), pa.array(blobs, pa.binary())], ["shard", "home", "data"])
            if covered.num_rows:
                yield pa.record_batch([covered.column(0), *covered.columns], ["shard", "home", "data"])

    return deal


def find_repeats(rows: DataFrame, shards: int, homes: int) -> DataFrame:
    """home and data (packed spans) of the repeats in rows of (doc_id, row, text)."""
    hot = rows.sparkSession.sparkContext.broadcast(hot_anchors(rows) if shards > 1 else np.zeros(0, _U8))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from dealer(hot.value, shards, homes)(batches)

    def gathered(table: pa.Table, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in zip(start, end, strict=True):
            own = table.slice(a, b - a)
            placed = pc.is_valid(own.column("home"))
            yield from own.filter(placed).select(["home", "data"]).to_batches()
            if blobs := own.filter(pc.invert(placed)).column("data").to_pylist():
                yield spans_batch(*shard_spans(Segments.unpack(blobs)), homes)

    dealt = rows.mapInArrow(deal, "shard bigint, home bigint, data binary")
    return grouped_runs(dealt, "shard", [], gathered, "home bigint, data binary")


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def merged(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    if not len(low):
        return []
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    return list(zip(low[new].tolist(), high[np.r_[new[1:], len(low)] - 1].tolist(), strict=True))


def remaining(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def carried(rows: DataFrame, homes: int) -> DataFrame:
    """home and data (packed documents) of rows of (doc_id, row, text): all that go to one home from a task in one piece."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress
        for text, ends, doc, row, known in batches_of(batches, COMBINE_BYTES):
            home, size = row % homes, np.diff(ends, prepend=0)
            by = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.r_[True, home[by][1:] != home[by][:-1]])
            packed = []
            for a, b in zip(cuts, np.r_[cuts[1:], len(by)], strict=True):
                own = by[a:b]
                packed.append(squeeze(b"".join([np.array([len(own)], "<i8").tobytes(), *(x[own].astype("<i8").tobytes() for x in (doc, known, row, size)), *(text[ends[i] - size[i] : ends[i]].tobytes() for i in own)])))
            yield pa.record_batch([pa.array(home[by[cuts]]), pa.array(packed, pa.binary())], ["home", "data"])

    return rows.mapInArrow(carry, "home bigint, data binary").withColumn("kind", F.lit(1))


def _settle(table: pa.Table, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The results of each home's documents, from their spans; a task's share of them at a time."""
    for s, e in zip(start, end, strict=True):
        own = table.slice(s, e - s)
        is_doc = pc.equal(own.column("kind"), 1)
        parts = [np.frombuffer(zstandard.decompress(d), "<i8").reshape(4, -1) for d in own.filter(pc.invert(is_doc)).column("data").to_pylist()]
        doc, row, low, high = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
        order = np.argsort(row, kind="stable")
        doc, row, low, high = doc[order], row[order], low[order], high[order]
        for blob in own.filter(is_doc).column("data"):
            raw = zstandard.decompress(blob.as_py())
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            ids, known, keys, sizes = np.frombuffer(raw, "<i8", 4 * n, 8).reshape(4, n).tolist()
            at, found = 8 + 32 * n, []
            for doc_id, there, key, size in zip(ids, known, keys, sizes, strict=True):
                data, at = raw[at : at + size], at + size
                a, b = np.searchsorted(row, key, "left"), np.searchsorted(row, key, "right")
                mine = np.arange(a, b)[doc[a:b] == doc_id] if there else np.arange(0)
                ranges = merged(low[mine], high[mine])
                found.append({"doc_id": doc_id if there else None, "n_bytes": size, "n_removed": sum(y - x for x, y in ranges), "n_spans": len(ranges), "kept_sha256": hashlib.sha256(remaining(data, ranges)).hexdigest(), "spans": [{"start": x, "end": y} for x, y in ranges]})
            yield pa.RecordBatch.from_pylist(found, _RESULT_ARROW)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (of bytes, removed) of every document.

    A byte is removed if a string of LENGTH bytes over it also starts in a document with a smaller doc_id. Null texts
    are empty. Rows of one doc_id are never smaller than each other and each keep what the others hold; a row with a
    null doc_id is left whole and takes nothing from others. Texts of any length are cut whole; other columns are
    ignored; no rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"))
    usable = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, homes = max(1, -(-volume // SHARD_BYTES)), max(1, -(-volume // HOME_BYTES))
    spans = materialize(find_repeats(usable, shards, homes), "spans").withColumn("kind", F.lit(0))
    return grouped_runs(carried(rows, homes).unionByName(spans), "home", ["kind"], _settle, RESULT)
