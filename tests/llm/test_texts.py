"""Ranked search, fingerprints and phrases against brute force; their SQL is compared in test_operators.py."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelens.llm import bitmaps, fingerprints, phrases, queries, search, simhash

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- bitmaps


def test_bits_are_of_the_buckets_that_reach_the_count(spark):
    rng = np.random.default_rng(1)
    keys = rng.zipf(1.3, 20_000) % 5000

    def count(batches):
        counts = bitmaps.Counts(1 << 13, 40)
        for batch in batches:
            counts.add(batch.column(0).to_numpy().astype(np.uint32))
            counts.add(np.array([7, 7], np.uint32), np.array([3, 4]))
        yield from counts.slices()

    rows = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(5).mapInArrow(count, bitmaps.SLICES)
    bits = bitmaps.reached(rows, 1 << 13, 40)
    true = np.bincount(keys, minlength=1 << 13)
    true[7] += 7 * 5
    assert (bitmaps.has(bits, np.arange(1 << 13, dtype=np.uint64)) == (true >= 40)).all() and (true >= 40).sum() > 20
    assert not bitmaps.reached(rows.where("false"), 1 << 13, 40).any()


# ---------------------------------------------------------------- op11

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def best_by_scan(docs, items, k):
    """Scores of all documents for all items, term by term."""
    own = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, n_terms = len(own), sum(len(w) for _, w in own)
    df = Counter(t for _, w in own for t in set(w))
    out = set()
    for item, text in set(items):
        found = []
        for i, w in own:
            tf, m = Counter(w), 25 + 75 * len(w) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out |= {(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["the", "of", *[f"w{int(rng.paretovariate(0.7))}" for _ in range(400)], "Köln", "naïve"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(300)]
    docs += [(1000 + i, "the same text, again and AGAIN!") for i in range(150)]  # a third are copies
    docs += [(None, "the w1 w2"), (7, "the w1 w2"), (7, docs[7][1]), (2001, None), (2002, ""), (2003, " .,- "), (2004, "w1 w2 the " * 30_000)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 15)))) for i in range(25)]
    items += [(100, "again"), (101, "The the of of"), (102, None), (103, ""), (104, "nowhere else"), (100, "again"), (None, "w1")]
    return docs, items


@pytest.mark.parametrize("shard,query_bytes", [(8192, 1 << 20), (37, 200), (3, 1 << 20)])
def test_ranked_equals_a_scan(spark, corpus, monkeypatch, shard, query_bytes):
    docs, items = corpus
    monkeypatch.setattr(search.build_index, "__defaults__", (shard, 1 << 16))
    table = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, score long").repartition(3)
    found = [tuple(r) for r in search.ranked(table, spark.createDataFrame(items, "item_id long, text string"), 10, query_bytes).collect()]
    assert set(found) == best_by_scan(docs, items, 10) and len(found) == len(set(found))


def test_search_skips_documents_that_cannot_qualify():
    """Bounds leave most postings of common terms unread, and the best stay the same with any length of stretch."""
    rng = random.Random(2)
    lists = {"common": sorted(rng.sample(range(20_000), 15_000)), "rare": sorted(rng.sample(range(20_000), 60))}
    row = {"ids": list(range(20_000)), "lengths": [rng.randrange(5, 400) for _ in range(20_000)], "terms": list(lists), "found": [len(x) for x in lists.values()]}
    row |= {"postings": np.concatenate([np.array(x, np.int32) for x in lists.values()]).tobytes(), "times": np.concatenate([np.ones(len(x), np.int32) for x in lists.values()]).tobytes()}
    shard = search.Shard(row, 20_000, sum(row["lengths"]))
    found = shard.best([("common", 300), ("rare", 5000), ("absent", 9), ("common", 0)], 10, 512)
    read = shard.walked
    assert found == shard.best([("common", 300), ("rare", 5000)], 10, 50_000) and len(found) == 10
    assert read < 4000 and shard.probed < 1000  # of 15,060


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    ask = some.withColumnRenamed("doc_id", "item_id")
    assert search.ranked(none, ask).count() == 0 and search.ranked(some, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert search.ranked(some, ask).count() == 1 and search.ranked(none, ask).columns == ["item_id", "rank", "doc_id", "score"]


# ---------------------------------------------------------------- op12


def check_edits(found, docs):
    """Rows against whole shingle sets and plain code; docs: (doc_id, text) in their order."""
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] is not None, (d[1] or "").encode()))
    expected, shingles = [], lambda t: set(simhash.shingle_hashes(t, 5).tolist())
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        expected.append((i, text, new, after))
    assert len(found) == len(expected)
    errors, prints = [], defaultdict(set)
    of = defaultdict(list)
    for r in found:
        of[r.doc_id].append(r)
    for i, text, new, after in expected:
        (row,) = [r for r in of[i] if r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()][:1]
        prints[text].add(row.fingerprint)
        for near, other in ((row.near_edited, new), (row.near_next, after)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            errors.append(abs(near - true))
            if max(len(a), len(b)) < fingerprints.K:
                assert near == pytest.approx(true)
    assert all(len(x) == 1 for x in prints.values())
    return errors


def test_fingerprints_of_the_query(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    errors = check_edits(queries.op12_bottom_k(spark, SF).collect(), docs)
    assert max(errors) < 0.2 and np.mean(errors) < 0.02


def test_fingerprints_of_odd_rows_in_many_stretches(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(rng.randrange(-500, 500), " ".join(rng.choices("äb c d e f gé 😀".split(), k=rng.randrange(0, 30)))) for _ in range(300)]
    docs += [(5, "copy of a text that is the same " * 3)] * 40 + [(None, "no id"), (None, None), (None, "b"), (9001, None), (9002, ""), (9003, "x"), (9000, "long " * 40_000)]
    table = spark.createDataFrame([(t, i, "x") for i, t in docs], "text string, doc_id long, stretch string").repartition(4)
    monkeypatch.setattr(fingerprints.in_descending_order, "__defaults__", (25, 1000))
    check_edits(fingerprints.compare_with_edits(table).collect(), docs)
    assert fingerprints.compare_with_edits(table.where("false")).count() == 0
    (one,) = fingerprints.compare_with_edits(table.where("doc_id = 9003")).collect()
    assert (one.near_edited, one.near_next, one.n_chars) == (1.0, 1.0, 1)


def test_parts_merge_to_the_whole_and_estimate(spark):
    rng = random.Random(4)
    draw = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, a, b = draw(3000), draw(1500), draw(500)
    texts = {"a": [shared, a], "b": [shared, b], "small": ["one two three four five six"], "none": ["", None]}
    rows = spark.createDataFrame([(k, t) for k, own in texts.items() for t in own], "k string, text string")
    parts = rows.withColumn("fingerprint", fingerprints.fingerprint_udf()(F.col("text")))
    whole = {r.k: r.fingerprint for r in fingerprints.merge_parts(parts, ["k"]).collect()}
    for k, own in texts.items():
        hashes = np.unique(np.concatenate([simhash.shingle_hashes(t, 5) for t in own]) >> np.uint64(1))
        assert whole[k] == hashes[: fingerprints.K].astype(np.int64).tolist()
    pair = spark.createDataFrame([(whole["a"], whole["b"], whole["small"], whole["none"])], "a array<long>, b array<long>, s array<long>, z array<long>")
    c = F.col
    got = pair.select(
        (fingerprints.merged(c("a"), c("b")) == fingerprints.merged(c("b"), c("a"))).alias("commutes"), fingerprints.resemblance(c("a"), c("b")).alias("r"), fingerprints.containment(c("b"), c("a")).alias("in"),
        fingerprints.distinct_shingles(c("a")).alias("n"), fingerprints.distinct_shingles(c("s")).alias("ns"), fingerprints.resemblance(c("z"), c("z")).alias("rz"), fingerprints.resemblance(c("s"), c("z")).alias("sz"), fingerprints.containment(c("z"), c("a")).alias("cz"),
    ).first()
    assert got.commutes and abs(got.r - 0.6) < 0.15 and abs(got["in"] - 3000 / 3500) < 0.15 and abs(got.n - 4492) < 1300
    assert (got.ns, got.rz, got.sz, got.cz) == (2.0, 1.0, 0.0, 1.0)
    a, b = (np.array(whole[k], np.uint64) for k in "ab")
    assert fingerprints.likeness(a, b) == pytest.approx(got.r)
    assert np.frombuffer(base64.b64decode(fingerprints.rendered(a)), ">u8").tolist() == whole["a"]


# ---------------------------------------------------------------- op13


def phrases_by_counting(docs, least, inside, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            counts[lang or "und"].update(tuple(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = set()
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * f >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in found.items()):
                continue
            score, k = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out |= {(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}
    return out


@pytest.mark.parametrize("chunk,inside,top", [(1 << 22, 100, 2000), (300, 90, 7)])
def test_collocations_equal_plain_counts(spark, monkeypatch, chunk, inside, top):
    rng = random.Random(6)
    words = "the The of á é new york city 😀 a-b \x1c \x85z".split(" ") + [f"w{i}" for i in range(30)]
    docs = [(rng.choice(["en", "en", "de", None, "und", ""]), rng.choice(["", " "]).join([" ".join(rng.choices(words, k=rng.randrange(0, 9))) + rng.choice([".", ", ", "\n", "\x0b", "\t", "  "]) for _ in range(rng.randrange(1, 12))])) for _ in range(200)]
    docs += [("en", "New York City\tis. not york city is")] * 80 + [("en", None), ("fr", ""), ("fr", " . "), ("it", "la la la la la la la la la la la la la la la")]
    docs += [("en", "of the " * 20_000)]
    monkeypatch.setattr(phrases.chunks, "__defaults__", (chunk,))
    table = spark.createDataFrame([(t, lang, 1) for lang, t in docs], "text string, lang string, n long").repartition(4)
    found = [tuple(r) for r in phrases.collocations(table, 12, inside, top).collect()]
    assert len(found) == len(set(found)) and set(found) == phrases_by_counting(docs, 12, inside, top)
    assert {r[0] for r in found} >= {"en", "it"}


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocation_products_pass_64_bits(spark):
    """One phrase in a language of so many words that a times n passes 64 bits: counts are put in, only scores are made."""
    counts = [("en", "", 10**15), ("en", "x y", 10**13), ("en", "x", 3 * 10**13), ("en", "y", 10**13 + 7)]
    table = spark.createDataFrame(counts, "lang string, phrase string, f long")
    original = phrases.phrase_counts
    phrases.phrase_counts = lambda docs, least: table
    try:
        (row,) = phrases.collocations(spark.range(1)).collect()
    finally:
        phrases.phrase_counts = original
    assert row.score == 1000 * 10**13 * 10**15 // (3 * 10**13 * (10**13 + 7))
