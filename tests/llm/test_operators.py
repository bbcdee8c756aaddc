"""The numbered operators against brute force, round trips and held-out rows, on small fixtures and the smallest tables."""

import datetime
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import oracle
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from wirelens.llm import chat, common, decontamination, packing, pseudonyms, queries, repeats, simhash, toxicity, url_filter, vector_dedup, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def texts(n=60, seed=1, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(80)]
    out = []
    for _ in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(0, words))]
        if out and rng.random() < 0.5:
            own = rng.choice(out).split()
            for _ in range(rng.randrange(3)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert oracle.check(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF) > 0


# ---------------------------------------------------------------- common


def test_components_of_long_chains(spark):
    """A chain of ordered ids, longer than there could be rounds."""
    found = common.components(spark.range(300).selectExpr("id AS a", "id + 1 AS b"))
    assert found.where("root <> 0").count() == 0 and found.count() == 301


def test_components_and_skew_join(spark):
    links = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 4)] + [(100, i) for i in range(101, 140)]
    found = by_id(common.components(spark.createDataFrame(links, "a long, b long")), "node")
    assert {n: r.root for n, r in found.items()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **{i: 100 for i in range(100, 140)}}
    big = spark.createDataFrame([(i % 3 if i < 300 else i, i) for i in range(400)], "k long, v long")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))
    assert common.skew_join(big, small, "k", "n").count() == 400
    assert common.skew_join(big, small.where("k < 3"), "k", "n", "left").count() == 400


# ---------------------------------------------------------------- op1


LEGAL = re.compile("s?(ua)+")


def best_cost(roles):
    """Cheapest legal repair, by trying every label, merge and inserted turn for every turn, and every ending."""
    best = 1 << 60
    for choice in itertools.product(itertools.product((1, 2, 3), ("merge", "", "s", "u", "a")), repeat=len(roles)):
        out, cost = "", 0
        for role, (label, way) in zip(roles, choice, strict=True):
            letter = "-sua"[label]
            cost += 0 if role == label else 2 if role else 1
            if way == "merge":
                if not out.endswith(letter):
                    break
                cost += 1
            else:
                out, cost = out + way + letter, cost + 3 * len(way)
        else:
            best = min([best, *(cost + 3 * len(end) for end in ("", "a", "ua") if LEGAL.fullmatch(out + end))])
    return best


def cost_of(roles, chosen):
    """What the chosen actions cost; their outcome must be legal."""
    out, cost = "", 0
    for role, (label, action, between) in zip(roles, chosen, strict=True):
        cost += 0 if role == label else 2 if role else 1
        assert action.startswith("relabel") == (role != label)
        if action.endswith("merge"):
            assert out.endswith("-sua"[label])
            cost += 1
        else:
            out, cost = out + ("-sua"[between] if between else "") + "-sua"[label], cost + 3 * bool(between)
    end = {"s": "ua", "u": "a", "a": ""}[out[-1]]
    assert LEGAL.fullmatch(out + end)
    return cost + 3 * len(end)


def test_chat_repair_is_cheapest():
    rng = random.Random(2)
    for roles in [*itertools.product(range(4), repeat=2), *([rng.randrange(4) for _ in range(rng.randrange(3, 5))] for _ in range(12))]:
        assert cost_of(roles, chat.decide(list(roles), chat.START, None)) == best_cost(roles)


def test_chat_borders_equal_one_pass():
    rng = random.Random(4)
    for _ in range(100):
        roles = [rng.randrange(4) for _ in range(12)]
        cuts = sorted(rng.sample(range(1, 12), 3))
        parts = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, 12], strict=True)]
        ends = chat.borders([(i, 0, 7, chat.matrix(p)) for i, p in enumerate(parts)])
        joined = [c for i, p in enumerate(parts) for c in chat.decide(p, ends[i, 0][0], ends[i, 0][1])]
        assert cost_of(roles, joined) == cost_of(roles, chat.decide(roles, chat.START, None))


def legal(roles):
    state = chat.START
    for r in roles:
        s = chat.ROLES.index(r) + 1
        assert s in chat.NEXT[state]
        state = s
    assert state == chat.ASSISTANT


def test_chat_rows(spark):
    rows = [(1, 0, "human", "hi"), (1, 1, "user", "more"), (1, 2, None, None), (2, 0, "assistant", "x"), (None, None, "tool", ""), (3, 0, "system", "s"), *[(9, i, "user", f"t{i}") for i in range(500)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    found = chat.format_chats(df.repartition(7)).collect()
    assert len(found) == len(rows)
    for conv in (1, 2, 3, 9, None):
        own = sorted((r for r in found if r.conv_id == conv), key=lambda r: (r.turn is not None, r.turn))
        legal([x for r in own for x in [*r.inserted, *([] if r.action.endswith("merge") else [r.role]), *r.appended]])
        whole = "".join(r.piece for r in own)
        assert whole.startswith(chat.OPEN) and whole.endswith(chat.CLOSE) and whole.count(chat.OPEN) == whole.count(chat.CLOSE)
    assert chat.format_chats(df.limit(0)).count() == 0


# ---------------------------------------------------------------- op2


def test_trie_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(40)}
    trie = toxicity.Trie()
    for t in terms:
        trie.add(t)
    for _ in range(200):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 6)))
        assert trie.within(w, 1) == {t: d for t in terms if (d := distance(w, t)) <= 1}


def test_toxicity_context_and_misspelling():
    scorer = toxicity.Scorer(toxicity.Lexicon({"moron": 4.0}, {"lowe": 3.0}, {"moron": 2.0}), (-4.0, 2.0, 1.0, 0.0))
    assert [h["weight"] for h in scorer.hits("You moron, loweiß! m0ron")[0]] == [4.0, 3.0, 2.0]
    assert scorer.hits('He was called "a moron" there')[0][0]["context"] == "quoted"
    assert scorer.hits("someone said moron yesterday")[0][0]["context"] == "reported"
    assert scorer.score(None)[0] == scorer.score("")[0] == scorer.score("good day")[0] < 0.1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in found}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8
    assert n.get((0, 1), 0) / n[0, 0] < 0.01


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, "word " * 30000)], DOCS).withColumn("score", F.lit("kept"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, none).collect()
    assert len(found) == 4 and all(r.score == 0 and r.predicted == 0 for r in found)
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 7)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs.limit(0), odd).count() == 0
    assert [bool(zlib.crc32(str(i).encode()) % 3 == 1) for i in range(50)] == [r[0] for r in spark.range(50).orderBy("id").select(toxicity.held_out(F.col("id"))).collect()]


# ---------------------------------------------------------------- op3


def plain_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    bits = [sum(xxhash.xxh64_intdigest(x, 42) >> k & 1 for x in s) for k in range(64)]
    return sum((2 * b > len(s)) << k for k, b in enumerate(bits))


def groups(ids, linked):
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and root[i] != root[j] and linked(i, j):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return root


def test_covering_masks_miss_nothing():
    rng, family = random.Random(1), simhash.masks()
    assert len(family) == 15
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4)))
        assert any(diff & m == 0 for m in family)


def test_simhash_components(spark):
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts())] + [(500, None), (501, ""), (502, " \t"), (503, "A b"), (504, "a B")]
    found = by_id(simhash.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(0))))
    prints = {i: plain_print(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in found.items()} == {i: format(p, "016x") for i, p in prints.items()}
    assert {i: r.component_id for i, r in found.items()} == groups(list(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)


def test_simhash_large_buckets():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ np.uint64(int(b) & 0xFF) for b in rng.integers(0, 256, 80)]))
    a, b = simhash._close_in_large(prints, 3)
    root = common.local_roots(len(prints), a, b)
    true = groups(list(range(0, 300)), lambda i, j: int(prints[i] ^ prints[j]).bit_count() <= 3)
    for i in true:
        for j in true:
            if true[i] == true[j]:
                assert root[i] == root[j]


def test_simhash_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    found = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d")], DOCS)).collect()
    assert [r.component_id for r in found] == [4, 4, 4]


def test_representatives_keep_one_of_each_group(spark):
    long = [" ".join(f"x{i}y{j}" for j in range(60)) for i in range(20)]
    near = [t.replace("y7 ", "z ") for t in long[:10]]
    rows = list(enumerate([*long, *near, *long[:5], "", None]))
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == set(range(20)) | {35}


# ---------------------------------------------------------------- op4


def test_warc_round_trip(spark, tmp_path):
    page = "<p>" + "ä" * 90
    rows = [(5, "http://a/", page), (2, "http://b/\r\nX: y", page), (9, None, page), (None, "u", page), (7, "u", "kurz"), (8, "u", "kurz"), (1, "u", None), (6, "u", page + "\r\n\r\nWARC/1.1\r\n\r\n"), (2, "again", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit(1))
    found = warc.archive(df, str(tmp_path / "w")).collect()
    assert len(found) == len(rows)
    for r in found:
        mine = [h or "" for i, _, h in rows if i == r.page_id]
        assert any(r.payload_digest == hashlib.sha256(h.encode()).hexdigest() and r.payload_bytes == len(h.encode()) for h in mine)
        same = r.payload_digest == hashlib.sha256(page.encode()).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 2) if same and r.page_id != 2 else ("response", None))
        assert (r.payload is None) == (r.record_type == "revisit")
    assert warc.archive(df.limit(0), str(tmp_path / "none")).count() == 0


def test_warc_headers_and_file_sizes(spark, tmp_path, monkeypatch):
    """Ids are unique, revisits name their response, and large payloads don't share files with many others."""
    monkeypatch.setattr(warc, "CLASSES", (200, 5000))
    monkeypatch.setattr(warc, "FILE_BYTES", 6000)
    page, other = "<p>" + "x" * 120, "y" * 150
    rows = [(1, "http://a/", page), (1, "http://b/", other), (2, "http://c/", page), (3, "http://d/", page), (4, "u", "z" * 4000), (5, "u", "z" * 4001), (6, "u", "w" * 9000), (7, "u", "w" * 9001), (8, "r", "q" * 300), (8, "r", "q" * 300), (9, "r", "q" * 300)]
    path = str(tmp_path / "w")
    found = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path).collect()
    assert len(found) == len(rows) and sorted(r.page_id for r in found if r.refers_to is not None) == [2, 3, 9]
    heads = [h for f in (tmp_path / "w").rglob("*.gz") for h, _ in warc.parse_archive(f.read_bytes())]
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(rows)
    for h in heads:
        if h["WARC-Type"] == "revisit" and h["X-Page-ID"] != "9":
            assert ids[h["WARC-Refers-To"]]["X-Page-ID"] == "1" and h["WARC-Refers-To-Target-URI"] == "http://a/" and h["WARC-Refers-To-Date"] == h["WARC-Date"]
    assert max(sum(int(h["X-Payload-Length"]) for h, _ in warc.parse_archive(f.read_bytes())) for f in (tmp_path / "w").rglob("*.gz")) <= 9001


# ---------------------------------------------------------------- op5


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_fast_tokenizer_is_exact(vocabulary):
    fast, rng = packing.FastTokenizer(vocabulary), random.Random(1)
    signs = list(" \n\t\r'stmdrevelx09.,!é“…¿-²½\u00a0\u2028漢<|") + ["<|endoftext|>", "don't", "  "]
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(15)))
        assert fast(t) == fast.whole(t), repr(t)


def test_bins_are_feasible_and_full():
    rng = random.Random(2)
    for _ in range(20):
        counts = {n: rng.randrange(1, 30) for n in rng.sample(range(1, 101), rng.randrange(1, 40))}
        bins, used = packing.minimum_bin_slack(counts, 100), {}
        for times, own in bins:
            assert sum(n * c for n, c in own) <= 100
            for n, c in own:
                used[n] = used.get(n, 0) + times * c
        assert used == counts
        least = max(-(-sum(n * c for n, c in counts.items()) // 100), sum(c for n, c in counts.items() if n > 50))
        assert sum(t for t, _ in bins) <= least * 1.2 + 2


def test_packing_rows(spark, vocabulary):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "word " * 5000), (3, "word " * 5000), *[(10 + i, t) for i, t in enumerate(texts(40))]]
    found = packing.pack_documents(spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit(1)), vocabulary, 128, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in found)
    whole = packing.FastTokenizer(vocabulary)
    assert sum(r.length for r in found) == sum(len(whole(t or "")) // 4 + 1 for _, t in rows)
    assert all(r.length == 128 for r in found if r.piece)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 128
    assert packing.pack_documents(spark.createDataFrame([], DOCS), vocabulary).count() == 0


def test_pieces_equal_the_plain_tokenizer(spark, vocabulary):
    """Pieces of whole documents, by the tokenizer alone: cuts, starts, lengths and check sums."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(-1, None), (-2, ""), (-3, "<|endoftext|> 漢字 "), (-4, "zq " * 60_000)]
    true = set()
    for doc, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        ends = list(range(len(ids), 0, -packing.SEQUENCE))[::-1]
        for k, end in enumerate(ends):
            start = ends[k - 1] if k else 0
            true.add((doc, k, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
    found = packing.pieces(spark.createDataFrame(rows, DOCS), vocabulary).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == true and len(found) == len(true)


# ---------------------------------------------------------------- op6


def test_cascade_is_exact(spark):
    universe = spark.createDataFrame([(f"h{i}",) for i in range(3000)] + [(None,), ("",)], "key string")
    listed = spark.createDataFrame([(f"h{i}",) for i in range(0, 3000, 7)] + [("elsewhere",), (None,)], "key string")
    cascade = url_filter.Cascade(universe, listed)
    assert len(cascade.levels) > 1
    marked = cascade.mark(universe, "key", "hit").collect()
    assert all(r.hit == (r.key not in (None, "") and int(r.key[1:]) % 7 == 0) for r in marked)
    assert url_filter.Cascade(universe, listed.limit(0)).mark(universe, "key", "hit").where("hit").count() == 0


def test_cascade_of_many_keys_in_parts(spark, monkeypatch):
    """120,000 listed keys of 400,000, in one part and in several; a third of the rows has one key."""
    universe = spark.range(400_000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"), F.col("id"), F.lit(1).alias("part"))
    rows = universe.unionByName(spark.range(200_000).select(F.lit("h70").alias("key"), F.lit(70).alias("id"), F.lit(2).alias("part"))).unionByName(spark.createDataFrame([(None, 1, 3)], "key string, id long, part int"))
    listed = universe.where("id % 10 in (0, 3, 7)").select("key")
    for bound, parts in ((1 << 20, 1), (1 << 16, 5)):
        monkeypatch.setattr(url_filter, "PART_BYTES", bound)
        cascade = url_filter.Cascade(rows, listed)
        assert (cascade.parts > 1) == (parts > 1) and len(cascade.levels) > 2
        wrong = cascade.mark(rows, "key", "hit").where("hit <> (key is not null and id % 10 in (0, 3, 7))")
        assert wrong.count() == 0 and cascade.mark(rows, "key", "hit").count() == 600_001


def test_urls_of_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, "x"), (None, "http://A.com/fr/", None), (1, None, "x"), (3, "http://b.net/" + "p" * 100_000, "")], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("b.net",), ("",)], "key string")
    found = sorted(map(tuple, url_filter.judge_urls(odd, queries.URL_RULES, listed).select("page_id", "host", "rule", "verdict").collect()), key=str)
    assert found == [(1, "", None, "block"), (1, "", None, "block"), (3, "b.net", None, "block"), (None, "a.com", "com/fr/", "allow")]
    assert url_filter.judge_urls(odd.limit(0), queries.URL_RULES, listed).count() == 0


def test_url_parts(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG", "x://h/p?q://z", "x://h?p/q", "x://H#f/", "://only/path/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p"))
    assert [tuple(r) for r in df.collect()] == [("", ""), ("", ""), ("", ""), ("a.example.org", ""), ("h", "/p"), ("h", ""), ("h", ""), ("only", "/path/")]


# ---------------------------------------------------------------- op7


def plain_repeats(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(9)
    rows = list(enumerate(texts(80, 4, 60)))
    rows += [(200, "a" * 300), (201, "b" + "a" * 200), (202, "ab" * 100), (203, rows[3][1] + " " + rows[5][1]), (204, None), (205, ""), (206, "x" * 49)]
    rows += [(300 + i, "".join(rng.choice("ab") for _ in range(400))) for i in range(6)]
    df = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1)).repartition(5)
    found = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(repeats.remove_repeats(df)).items()}
    assert found == plain_repeats(rows)


def found_repeats(df):
    return {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(repeats.remove_repeats(df)).items()}


def test_repeats_of_long_texts_over_chunks_indexes_and_shards(spark):
    """A text over a chunk's bytes, variants over an index's, text over a shard's; the last rows differ in single bytes."""
    rng = random.Random(11)
    long = "".join(rng.choice("abcdefghij ") for _ in range(900_000))
    rows = [(9, long), (3, long[500_000:810_000]), (1, long[100:400] + "|" + long[600_000:600_049]), (12, long[:300_000] + "ä" + long[300_000:])]
    base = "".join(rng.choice("klmnopqrst") for _ in range(60_000))
    for i in range(50):
        at = sorted(rng.sample(range(60_000), 900))
        rows.append((100 + i, "".join(base[a:b] + rng.choice("XYZ") for a, b in zip([0, *at], [*at, 60_000], strict=True))))
    assert sum(len(t) for _, t in rows) > repeats.SHARD_BYTES / 2 and len(long) > repeats.CHUNK_BYTES
    assert found_repeats(spark.createDataFrame(rows, DOCS).repartition(3)) == plain_repeats(rows)


def test_repeats_with_small_blocks_shards_and_hot_anchors(spark, monkeypatch):
    """One line that all documents have within other text, so that its anchors are hot; all bounds are small."""
    rng = random.Random(12)
    line = "the line that is in every document of this corpus, word by word"
    own = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    rows = [(i * 7 % 101, own(rng.randrange(90)) + line[: rng.randrange(30, 64)] + own(rng.randrange(90)) + line) for i in range(100)]
    whole = cut_whole(rows)
    for name, value in (("CHUNK_BYTES", 700), ("INDEX_BYTES", 500), ("SHARD_BYTES", 2000), ("COMBINE_BYTES", 3000), ("HOME_BYTES", 2000)):
        monkeypatch.setattr(repeats, name, value)
    monkeypatch.setattr(repeats, "hot_anchors", lambda rows: whole[:40])
    assert find_small(rows) == {(d, a, b) for d, t in rows for a, b in plain_spans(rows, d, t)}
    assert len(whole) > 40


def cut_whole(rows):
    """Anchors, the most frequent first."""
    data = [t.encode() for _, t in rows]
    sizes = np.array([len(t) for t in data])
    s = repeats.cut(np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes), np.array([d for d, _ in rows]), np.arange(len(rows)))
    anchor, n = np.unique(s.anchor(), return_counts=True)
    return np.sort(anchor[np.argsort(-n)])


def plain_spans(rows, doc, text):
    first = {}
    for i, t in sorted(rows):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    hit = [p for p in range(len(text) - 49) if first[text[p : p + 50]] < doc]
    return repeats.merged(np.array(hit, int), np.array(hit, int) + 50)


def find_small(rows):
    """Spans by the operator's parts, without Spark: dealt in batches, hot anchors by their sides, and gathered by shard."""
    hot, shards, spans = repeats.hot_anchors(None), 7, []
    table = pa.record_batch([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows]), pa.array(range(len(rows)), pa.int64())], ["doc_id", "text", "row"])
    dealt = {}
    for shard, home, data in (x for b in repeats.dealer(hot, shards, 3)(iter([table.slice(i, 9) for i in range(0, len(rows), 9)])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        (spans if home is not None else dealt.setdefault(shard, [])).append(data)
    parts = [np.frombuffer(zstandard.decompress(d), "<i8").reshape(4, -1) for d in spans]
    parts += [np.stack(repeats.shard_spans(repeats.Segments.unpack(blobs))) for blobs in dealt.values()]
    doc, _, low, high = np.concatenate(parts, axis=1)
    return {(d, a, b) for d in set(doc.tolist()) for a, b in repeats.merged(low[doc == d], high[doc == d])}


def test_equal_names_of_unequal_segments_are_told_apart():
    data = np.frombuffer(b"x" * 50 + b"y" * 50 + b"x" * 50, np.uint8)
    s = repeats.Segments(*(np.array(x) for x in ([1, 2, 3], [0, 1, 2], [0, 0, 0], [50, 50, 50], [0, 0, 0])), np.zeros(3, np.uint64), np.array([0, 50, 100]), data)
    order, start, _, repeat = repeats.split_repeats(s)
    assert len(start) == 2 and s.doc[order[repeat]].tolist() == [3]


def test_repeats_edges(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    same = repeats.remove_repeats(spark.createDataFrame([(None, "y" * 80), (1, "y" * 80), (1, "y" * 80)], DOCS)).collect()
    assert [r.n_removed for r in same] == [0, 0, 0] and {r.doc_id for r in same} == {None, 1}


def test_run_length_index_statistics():
    rng = np.random.default_rng(1)
    texts_ = [rng.choice([97, 98], n).astype(np.uint8) for n in (30, 25, 40)]
    size = np.array([len(t) for t in texts_])
    index = repeats.RunLengthIndex(np.concatenate(texts_), size)
    above, match = index.stream()
    assert index.run_lengths.sum() == len(index.symbols)
    for p in range(len(index.symbols)):
        if index.left[p] and above[p] >= 0 and match[p] > 0:
            a, b = (index.symbols[x : x + match[p]].tobytes() for x in (p, above[p]))
            assert a == b


# ---------------------------------------------------------------- op8


def test_pseudonyms_round_trip(spark):
    rows = [(1, "call +1 (988) 555-2485 or 988-555-2485"), (2, "4337166598464399 and 4337-1665-9846-4399, not 4337166598464398"), (3, "219-09-9999, 000-12-1234"), (4, "DE89 3704 0044 0532 0130 00"), (5, "2021-02-28, 2021-02-30, 28.02.2021, 02/28/2021, 31/12/2020"), (6, "42.144.35.254 300.1.1.1"), (7, "bosbt.42@mail8.example.com"), (8, None), (9, ""), (10, "plain text 12"), (11, "+33 6 12 34 56 78")]
    df = spark.createDataFrame(rows, DOCS).withColumn("raw", F.lit("kept")).checkpoint()
    done, name = pseudonyms.pseudonymize(df, "k")
    done = done.checkpoint()
    new = by_id(done)
    assert {i: len(r[name]) for i, r in new.items()} == {1: 2, 2: 2, 3: 1, 4: 1, 5: 4, 6: 1, 7: 1, 8: 0, 9: 0, 10: 0, 11: 1}
    digits = ["".join(c for c in f.value if c.isdigit())[-10:] for f in new[1][name]]
    assert digits[0] == digits[1] and new[5][name][0].value.split("-")[0] in new[5][name][1].value
    assert "2021-02-30" in new[5].text and "300.1.1.1" in new[6].text and "4337166598464398" in new[2].text
    assert all(new[i].text != t for i, t in rows if i in (1, 2, 3, 4, 5, 6, 7, 11)) and new[1].raw == "kept"
    again = pseudonyms.pseudonymize(done.select("doc_id", "text"), "k", back=True)[0]
    assert {i: r.text for i, r in by_id(again).items()} == dict(rows)


def plain_feistel(value, kind, key):
    """The network in plain Python: characters of one half moved within their class by a stream from the other half."""
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for n in range(pseudonyms.ROUNDS):
        stream, out = hashlib.sha256(f"{key}|{kind}|{n}|{right}".encode()).hexdigest(), ""
        for i, c in enumerate(left):
            step = int(stream[i % 16 * 4 : i % 16 * 4 + 4], 16)
            low, size = (48, 10) if c in "0123456789" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (ord(c), 1)
            out += chr(low + (ord(c) - low + step) % size)
        left, right = right, out
    return left + right


def plain_walk(value, kind, key, valid):
    value = plain_feistel(value, kind, key)
    while not valid(value):
        value = plain_feistel(value, kind, key)
    return value


def test_pseudonyms_equal_plain_python(spark):
    rng, key = random.Random(8), "k"
    values = ["".join(rng.choice("0123456789abcXYZ-._") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(pseudonyms.feistel(F.col("v"), "kind", key)).collect()] == [plain_feistel(v, "kind", key) for v in values]

    social = [f"{rng.randrange(1, 899):03}-{rng.randrange(1, 99):02}-{rng.randrange(1, 9999):04}" for _ in range(60)]
    social = [s for s in social if not s.startswith("666")]
    ok = lambda d: not re.search("^(000|666|9)|^...00|0000$", d)
    new = [plain_walk(s.replace("-", ""), "social", key, ok) for s in social]
    days = ["2021-02-28", "1900-01-01", "2099-12-31", "2000-02-29"]
    first = datetime.date(1900, 1, 1)
    day = lambda n: first + datetime.timedelta(days=int(n))
    moved = []
    for d in days:
        old = (datetime.date.fromisoformat(d) - first).days
        late = day(old).day > 12
        moved.append(day(plain_walk(f"{old:05}", "date", key, lambda x: int(x) < pseudonyms.DAYS and (day(x).day > 12) == late)).isoformat())  # noqa: B023
    rows = [(i, f"text {v} text" * 1) for i, v in enumerate([*social, *days])]
    done, _ = pseudonyms.pseudonymize(spark.createDataFrame(rows, DOCS), key)
    found = by_id(done)
    assert [found[i].text for i, _ in rows] == [f"text {v} text" for v in [*(f"{n[:3]}-{n[3:5]}-{n[5:]}" for n in new), *moved]]
    assert pseudonyms.pseudonymized(spark.createDataFrame([], DOCS), key).count() == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    found = {r[0] for r in df.select(pseudonyms.feistel(F.col("v"), "t", "k")).collect()}
    assert len(found) == 1000 and all(len(x) == 3 and x.isdigit() for x in found)


# ---------------------------------------------------------------- op9


def test_contamination_cases(spark):
    words = [f"b{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words[:20])), (2, "only Three words"), (3, None), (10, " ".join(words[10:30])), (None, "x"), (11, ""), (2, "only Three words"), (12, "two Words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "z " + " ".join(words[:15]).upper()), (2, "a only three words b " * 2), (3, None), (4, ""), (5, " ".join(words[:12])), (6, "w " * 500 + " ".join(words[:13])), (7, " ".join(words[:30])), (8, "one two! words three")], DOCS)
    docs = docs.withColumn("contamination", F.lit(0)).withColumn("key", F.lit(1)).withColumn("h", F.lit(2))
    one = by_id(decontamination.contamination(docs, bench))
    assert [(one[i].n_words, one[i].n_hit, one[i].items, one[i].contaminated) for i in range(1, 9)] == [(16, 15, [1], True), (10, 6, [2], True), (0, 0, [], False), (0, 0, [], False), (12, 0, [], False), (513, 13, [1], False), (30, 30, [1, 10], True), (4, 2, [12], True)]
    assert one[7].items_sha256 == hashlib.sha256(b"1,10").hexdigest() and one[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    marked, name = decontamination.mark_contamination(docs.union(docs), bench)
    assert name not in docs.columns and marked.drop(name).columns == docs.columns and marked.count() == 16
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert {(r.n_hit, r.n_items) for r in decontamination.contamination(docs, bench.limit(0)).collect()} == {(0, 0)}


def plain_contamination(text, items, size):
    words, hit, found = decontamination.words_of(text), set(), set()
    for item, own in items:
        own = decontamination.words_of(own)
        n = min(size, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("size", [3, 5, 13])
def test_contamination_equals_brute_force(spark, size):
    """Few different words, so that windows tie, overlap and repeat; a template in a third of the texts and of the items."""
    rng = random.Random(size)
    draw = lambda n, of: " ".join(rng.choice(["a", "b", "é", "Dd", "e-f", "x"][:of]) for _ in range(n))
    template = draw(30, 6)
    items = [(i, draw(rng.randrange(0, 25), 6) + (f" {template} t{i}" if i % 3 == 0 else "")) for i in range(60)]
    items += [(5, draw(9, 2)), (100, items[3][1]), (101, "a"), (102, "x x")]
    texts = [draw(rng.randrange(0, 40), 2 + i % 5) + (f" {template} t{rng.randrange(60)} z" if i % 3 == 0 else "") for i in range(150)]
    texts += [" q".join(t for _, t in rng.choices(items, k=3)) for _ in range(100)] + texts[:20] + [draw(6_000, 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5)
    found = by_id(decontamination.contamination(docs, spark.createDataFrame(items, "item_id int, text string"), size))
    assert {i: (r.n_words, r.n_hit, r["items"]) for i, r in found.items()} == {i: plain_contamination(t, items, size) for i, t in enumerate(texts)}


# ---------------------------------------------------------------- op10


def test_vectors_recall_and_edges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    near = base[:200] + rng.normal(size=(200, 16)) * 0.06
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *near, base[0], base[0] * 3])]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = x @ x.T >= 0.95
    for block in (2048, 16):
        monkeypatch.setattr(vector_dedup, "LIST_BLOCK", block)
        monkeypatch.setattr(vector_dedup.blocks, "__defaults__", (block,))
        found = by_id(vector_dedup.vector_near_duplicates(df), "vec_id")
        mine, all_ = sum(found[i].n_links for i in range(len(rows))), true.sum() - len(rows)
        assert 0.9 * all_ <= mine <= all_
        assert all(found[i].n_links <= true[i].sum() - 1 for i in range(len(rows)))
        assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i, _ in odd)
    assert vector_dedup.vector_near_duplicates(df.limit(0)).count() == 0
    assert vector_dedup.vector_near_duplicates(df.where("vec_id = 3")).first().kept


@pytest.mark.parametrize("n", [600, 2400])
def test_vectors_of_a_dense_group_lose_no_link(spark, monkeypatch, n):
    rng = np.random.default_rng(n)
    direction = lambda k: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(k, 64)))
    # pairwise cosines of some 0.95 to 0.97 in the group; its last rows lie at and beyond the threshold to it
    spread = np.r_[np.full(n // 3, 0.2), np.full(60, 0.3)][:, None]
    x = np.r_[direction(1) + spread * direction(len(spread)), direction(n - len(spread))]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.95).sum(axis=1) - 1
    for block in (2048, 100):
        monkeypatch.setattr(vector_dedup, "CORE_BLOCK", block)
        monkeypatch.setattr(vector_dedup.blocks, "__defaults__", (block,))
        found = by_id(vector_dedup.vector_near_duplicates(df), "vec_id")
        assert [found[i].n_links for i in range(n)] == true.tolist()
        assert {found[i].component_id for i in range(n // 3)} == {0}
