"""Toxicity scores from a lexicon that is learned from labels and matched with tolerance for misspellings.

Lexicon: of all words and word beginnings of the labelled training documents, those that mark toxic documents beyond
chance. A word of a text matches a term exactly, by its beginning, or within one edit: the word's Levenshtein automaton
is run against the lexicon's trie, so all terms are tried at once and a branch ends as soon as it can't be reached any
more. Each hit is weighed by its term's precision and by the window around it: in quotation marks or next to words of
reporting it counts less. A logistic model over the hits' sum, their greatest and their density gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import fresh, materialize
from wirelens.llm.simhash import shingle_hashes

CUT = 0.7
#: Labelled rows that the lexicon is learned from, at most, of each label; the choice is by a hash of the id.
TRAINING_ROWS = 20_000
PREFIXES = range(3, 9)
#: A term must mark toxic documents with at least this precision, over chance by this margin (in nats), and be in so many.
PRECISION, MARGIN, LEAST_DOCS = 0.8, 4.0, 4
#: A hit weighs the logarithm of its term's likelihood ratio, at most this.
MOST_WEIGHT = 5.0
#: Misspellings: edits, and the least length of a term that they are allowed for.
EDITS, LEAST_FUZZY = 1, 5
#: Characters on either side of a hit that are looked at, and what a quoted or reported hit counts.
WINDOW, QUOTED, REPORTED = 60, 0.5, 0.7
#: Words that a task remembers to match nothing.
CACHE_WORDS = 400_000

#: Marks that open and close quotations, and words of reporting in the corpus's languages.
QUOTES = {"“": "”", "«": "»", "„": "“", '"': '"'}
REPORTING = frozenset("said says wrote writes called quoted quote according alleged allegedly dit écrit selon cité sagte schrieb laut zitiert dijo escribió según citado".split())

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str | None) -> list[str]:
    """Lower-case words between white space; their edges may hold punctuation."""
    return (text or "").lower().split()


def bare(word: str) -> str:
    """The word without punctuation at its edges."""
    return word if word.isalnum() else _EDGE.sub("", word)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 3, is 1: such rows are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


@dataclass
class Trie:
    """Terms as a trie of dicts; '' holds a node's term."""

    root: dict = field(default_factory=dict)

    def add(self, term: str) -> None:
        node = self.root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = term

    def within(self, word: str, edits: int) -> dict[str, int]:
        """Terms within so many edits of word, and how many: the word's automaton run along the trie.

        A state is a place in the trie, a place in the word and the edits left. A letter of both moves on at no cost;
        leaving out a letter of the word, taking an extra one of the trie, or one for the other costs an edit.
        """
        found: dict[str, int] = {}
        states, n = [(self.root, 0, edits)], len(word)
        while states:
            node, i, left = states.pop()
            if i == n:
                if "" in node:
                    found[node[""]] = min(found.get(node[""], edits), edits - left)
            elif (child := node.get(word[i])) is not None:
                states.append((child, i + 1, left))
            if left:
                if i < n:
                    states.append((node, i + 1, left - 1))
                for c, child in node.items():
                    if c:
                        states.append((child, i, left - 1))
                        if i < n and c != word[i]:
                            states.append((child, i + 1, left - 1))
        return found


@dataclass
class Lexicon:
    """Whole words and word beginnings with their weights; fuzzy: weights of misspellings of a word."""

    words: dict[str, float]
    starts: dict[str, float]
    fuzzy: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.trie = Trie()
        self.lengths = sorted({len(s) for s in self.starts})
        self.heads, self.tails = set(), set()  # halves of terms, with the lengths that a word one edit away can have
        for w in self.words:
            if len(w) >= LEAST_FUZZY:
                self.trie.add(w)
                half = len(w) // 2
                for n in range(len(w) - EDITS, len(w) + EDITS + 1):
                    self.heads.add((w[:half], n)), self.tails.add((w[half:], n))
        self.head_sizes, self.tail_sizes = (sorted({len(x) for x, _ in s}) for s in (self.heads, self.tails))

    def match(self, word: str) -> tuple[str, float] | None:
        """The term that a bare word matches, and its weight."""
        if word in self.words:
            return word, self.words[word]
        for n in self.lengths:
            if word[:n] in self.starts:
                return word[:n], self.starts[word[:n]]
        # one edit leaves the first or the second half of a term as it is
        size = len(word)
        if any((word[:n], size) in self.heads for n in self.head_sizes) or any((word[-n:], size) in self.tails for n in self.tail_sizes):
            near = [(self.fuzzy.get(t, 0.0), t) for t, d in self.trie.within(word, EDITS).items() if d]
            if near and max(near)[0] > 0:
                p, t = max(near)
                return t, p
        return None


class Scorer:
    """Scores texts; remembers which words match nothing."""

    def __init__(self, lexicon: Lexicon, model: tuple[float, ...] = ()):
        self.lexicon, self.model, self.clean, self.known = lexicon, model, set(), {}

    def matches(self, words: list[str]) -> dict[str, tuple[str, float]]:
        found = {}
        for raw in set(words).difference(self.clean):
            if raw in self.known:
                found[raw] = self.known[raw]
            elif hit := self.lexicon.match(bare(raw)):
                self.known[raw] = found[raw] = hit
            else:
                self.clean.add(raw)
        for seen in (self.clean, self.known):
            if len(seen) > CACHE_WORDS:
                seen.clear()
        return found

    def hits(self, text: str | None) -> tuple[list[dict], list[float]]:
        """The hits, each with its term, place, weight and kind of context; and what the model looks at."""
        words = words_of(text)
        found = self.matches(words)
        if not found:
            return [], [0.0, 0.0, 0.0]
        lower, hits, at = text.lower(), [], 0
        for word in words:
            at = lower.index(word, at)
            if word in found:
                term, weight = found[word]
                kind, factor = self.context(lower, at, at + len(word))
                hits.append({"term": term, "word": word, "start": at, "weight": weight * factor, "context": kind})
            at += len(word)
        weights = [h["weight"] for h in hits]
        return hits, [math.log1p(sum(weights)), max(weights), math.log1p(1000 * sum(weights) / len(words))]

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        hits, x = self.hits(text)
        if not self.model:
            return 0.0, hits
        z = self.model[0] + sum(w * v for w, v in zip(self.model[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), hits

    @staticmethod
    def context(text: str, start: int, end: int) -> tuple[str, float]:
        """Whether the window around a hit quotes it or reports it."""
        before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
        own = text[start:end]
        for left, right in QUOTES.items():
            opened = (before + own[:1]).count(left) % 2 == 1 if left == right else (before + own[:1]).rfind(left) > before.rfind(right)
            if opened and right in own[1:] + after:
                return "quoted", QUOTED
        if REPORTING.intersection(map(bare, before.split()[-4:] + after.split()[:4])):
            return "reported", REPORTED
        return "plain", 1.0


def features(word: str) -> list[str]:
    """A bare word and its beginnings; beginnings end in a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """text and toxic of at most so many labelled documents of each label, none of them held out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    sample = None
    for toxic in (0, 1):
        part = own.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    bounded = F.broadcast(sample.withColumnsRenamed({"doc_id": "labelled", "toxic": "toxic_label"}))  # 2 * most rows of two numbers
    rows = docs.select("doc_id", "text").join(bounded, F.col("doc_id") == F.col("labelled")).select("doc_id", "text", F.col("toxic_label").alias("toxic"))
    return without_copies(rows)


def without_copies(rows: DataFrame, signatures: int = 3) -> DataFrame:
    """The rows without most copies, whose words would pass for evidence: of rows that share the least hash of their
    five-word runs, under one of some orders of the hashes, one is kept."""
    masks = [np.uint64(0), *(np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1) for k in range(1, signatures))]
    names = [f"s{k}" for k in range(signatures)]

    def sign(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            own = [shingle_hashes(t, 5) for t in batch.to_pylist()]
            found = np.array([[int((h ^ m).min().view(np.int64)) if len(h) else 0 for m in masks] for h in own], np.int64).reshape(-1, signatures)
            yield pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(signatures)], names)

    kind = "struct<" + ",".join(f"{n}:bigint" for n in names) + ">"
    rows = rows.withColumn("signed", F.arrow_udf(sign, kind).asNondeterministic()(F.col("text"))).select("doc_id", "text", "toxic", "signed.*")
    for n in names:
        rows = rows.groupBy(n).agg(F.min_by(F.struct("doc_id", "text", "toxic", *names), "doc_id").alias("kept")).select("kept.*")
    return rows.select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> tuple[Lexicon, tuple[float, ...]]:
    """A lexicon and a model from the training rows. Without toxic or without clean rows both are empty."""
    rows = materialize(training_rows(docs, labels, most), "training")
    counted = materialize(rows.mapInArrow(count_features, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "features")
    totals = counted.where("feature = ''").first()
    if totals is None or not totals["toxic"] or not totals["clean"]:
        return Lexicon({}, {}), ()
    lexicon = choose_terms(counted, totals["toxic"], totals["clean"])
    return lexicon, fit(rows, lexicon)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many clean and toxic texts each feature is, and (as feature '') how many texts there are."""
    found: dict[str, list[int]] = {}

    def give() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(found), pa.string()), *(pa.array([v[y] for v in found.values()], pa.int64()) for y in (0, 1))], ["feature", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = {""}
            own.update(f for w in {bare(w) for w in set(words_of(text))} if w for f in features(w))
            for f in own:
                found.setdefault(f, [0, 0])[toxic] += 1
        if len(found) > 500_000:
            yield give()
            found = {}
    yield give()


def weigh(toxic: float, clean: float, all_toxic: int, all_clean: int) -> float:
    """Logarithm of the likelihood ratio, with half a document more than seen on either side."""
    return min(MOST_WEIGHT, math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1)))


def choose_terms(counted: DataFrame, all_toxic: int, all_clean: int) -> Lexicon:
    base = all_toxic / (all_toxic + all_clean)
    n, k = F.col("toxic") + F.col("clean"), F.col("toxic")
    share = k / n
    # beyond chance: n times the divergence of the share from the base rate, against the number of features tried
    nats = n * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
    precision = (k / all_toxic) / (k / all_toxic + F.col("clean") / all_clean)
    marked = counted.where((F.col("feature") != "") & (k >= LEAST_DOCS)).where((precision >= PRECISION) & (nats >= math.log(counted.count()) + MARGIN))
    # of about equal evidence, a whole word before a beginning and a long beginning before a short one
    worth = nats * F.when(F.col("feature").endswith("*"), 1.0).otherwise(1.1)
    found = marked.select("feature", "toxic", "clean", F.round(worth, 6).alias("worth")).orderBy(F.desc("worth"), F.desc(F.length("feature")), "feature").collect()  # no more than words of the bounded training rows
    words, starts, covering = {}, {}, set()  # covering: the beginnings of all chosen terms
    for r in found:  # the best evidence first; what a beginning or word of better evidence covers is left out
        f, own = r["feature"], r["feature"].removesuffix("*")
        if any(own[:n] in starts for n in range(1, len(own) + 1)):
            continue
        if f != own and own in covering:
            continue
        covering.update(own[:n] for n in range(1, len(own) + 1))
        (words if f == own else starts)[own] = weigh(r["toxic"], r["clean"], all_toxic, all_clean)
    return Lexicon(words, starts, misspellings(counted, words, all_toxic, all_clean))


def misspellings(counted: DataFrame, words: dict[str, float], all_toxic: int, all_clean: int) -> dict[str, float]:
    """For each word the weight of other words within one edit of it: half the word's own, and as their counts have it."""
    trie_of = Lexicon(words, {}, dict.fromkeys(words, 1.0))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(hit[0], c, t) for f, c, t in zip(*(batch.column(x).to_pylist() for x in ("feature", "clean", "toxic")), strict=True) if f not in words and (hit := trie_of.match(f))]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["term", "clean", "toxic"])

    own = counted.where("feature <> '' and feature not like '%*'").mapInArrow(near, "term string, clean bigint, toxic bigint")
    seen = {r["term"]: r for r in own.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()}  # a row for each term at most
    return {w: p / 2 if w not in seen else max(0.0, min(p, weigh(seen[w]["toxic"], seen[w]["clean"], all_toxic, all_clean))) for w, p in words.items()}


def fit(rows: DataFrame, lexicon: Lexicon, steps: int = 50, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps over three numbers of each training row (a bounded sample)."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            x = np.array([scorer.hits(t)[1] for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.record_batch([*(pa.array(x[:, i]) for i in range(3)), batch.column("toxic").cast(pa.float64())], ["a", "b", "c", "y"])

    sample = rows.mapInArrow(look, "a double, b double, c double, y double").groupBy("a", "b", "c", "y").count().toPandas()
    x, y, n = sample[["a", "b", "c"]].to_numpy(), sample["y"].to_numpy(), sample["count"].to_numpy(float)
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-3] + [ridge] * 3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + keep, x.T @ (n * (y - p)) - keep @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


SCORE = "struct<score:double,hits:array<struct<term:string,word:string,start:int,weight:double,context:string>>>"
_SCORE_ARROW = pa.struct([("score", pa.float64()), ("hits", pa.list_(pa.struct([("term", pa.string()), ("word", pa.string()), ("start", pa.int32()), ("weight", pa.float64()), ("context", pa.string())])))])


def mark_toxicity(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """docs with a struct column of score and hits, and that column's name. Other columns stay, whatever their names."""
    name = fresh("toxicity", docs.columns)
    learned = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(*learned.value)
        for batch in texts:
            yield pa.array([{"score": s, "hits": h} for s, h in map(scorer.score, batch.to_pylist())], _SCORE_ARROW)

    return docs.withColumn(name, F.arrow_udf(score, SCORE).asNondeterministic()(F.col("text"))), name


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and hits of every document.

    Null, empty and wordless texts score as texts without hits. A document with contradicting labels is learned from as both. Labels that
    are null or not 0 or 1, or have no document, are not learned from. Repeated rows get equal scores; with nothing to
    learn from all scores are 0. A null doc_id has a null held_out.
    """
    marked, name = mark_toxicity(docs.select("doc_id", "text"), labels)
    score = F.col(name)["score"]
    return marked.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"), F.col(name)["hits"].alias("hits"))
