"""The pipeline on the smallest tables against plain Python."""

import random
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from wirelens.llm import decontamination, packing, pseudonyms, simhash, toxicity
from wirelens.llm.queries import PSEUDONYM_KEY, table

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def hit_words(text, items):
    words, hit = decontamination.words_of(text), set()
    for item in items:
        own = decontamination.words_of(item)
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        hit.update(p for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows for p in range(i, i + n))
    return len(hit), len(words)


@pytest.fixture(scope="module")
def stages(spark):
    docs, kept = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    return kept


def test_stages_equal_plain_python(spark, stages):
    calm, single, clean, private = stages
    documents = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    scores = {r.doc_id: r.score for r in toxicity.toxicity(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert calm == {i: t for i, t in documents.items() if scores[i] < toxicity.CUT}

    sets = {i: shingles(t) for i, t in calm.items()}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and group[i] != group[j] and jaccard(sets[i], sets[j]) >= 0.8:
                new, old = sorted((group[i], group[j]))
                group = {k: new if g == old else g for k, g in group.items()}
    assert single.keys() == set(group.values())

    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    hits = {i: hit_words(t, items) for i, t in single.items()}
    assert clean.keys() == {i for i, (hit, n) in hits.items() if not (hit and 20 * hit >= n)}

    assert private.keys() == clean.keys()
    restored = spark.createDataFrame(list(private.items()), "doc_id long, text string")
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymize(restored, PSEUDONYM_KEY, back=True)[0].collect()}
    assert back == clean


def test_packing_holds_every_document(spark, stages):
    vocabulary = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    private, encode = stages[-1], packing.FastTokenizer(vocabulary)
    found = corpus_pipeline.run(spark, SF).collect()
    total = {}
    for r in found:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(encode(t or "")) // 4 + 1 for i, t in private.items()}
    assert max(r.offset + r.length for r in found) <= packing.SEQUENCE


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    rows = spark.createDataFrame([(1, None, "en", "s", 0), (None, "a b", None, None, None), (2, "", "en", "s", 0), (3, "call 988-555-2485", "en", "s", 17)], docs.schema)
    for given, kept in ((docs, 0), (rows.withColumn("score", F.lit(1)), 3)):
        now = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == given.columns
        assert now.count() == kept


@pytest.mark.parametrize("words", [105, 300])
def test_near_copies_are_exact_at_the_threshold(spark, words):
    """Texts around a similarity of 0.8 that all have one long passage in common; the longer ones are over the sketch."""
    rng = random.Random(2)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows = own(2 * words // 3), []
    for i in range(150):
        text = passage + own(words // 3)
        rows.append((2 * i, " ".join(text)))
        for at in rng.sample(range(words), max(1, (5 + i % 5) * words // 300)):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(text)))
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in group:
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows) // 2 < len(set(group)) < len(rows)
    assert kept == set(group)


def test_near_copies_that_share_an_id(spark):
    """Of a group one row stays, with the least id, also where rows share it; other columns go along; null ids stay."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (3, "quite another text than that", "d"), (3, "and a third one", "e"), (3, "and a third one", "f"), (None, text, "g"), (None, text, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    found = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert found.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text) for r in found.collect())
    assert kept == sorted([(0, text), (0, text), (1, text), (3, "quite another text than that"), (3, "and a third one")])


def test_texts_of_frequent_passages_make_few_candidates(spark, monkeypatch):
    """Texts of the same passages that mostly differ too much: parities leave out nearly all pairs that aren't alike."""
    rng, counted, write = random.Random(4), {}, simhash.materialize

    def materialize(df, name="rows"):
        rows = write(df, name)
        counted[name] = rows.count()
        return rows

    monkeypatch.setattr(simhash, "materialize", materialize)
    passages = [" ".join(f"p{i}w{k}" for k in range(9)) for i in range(40)]
    rows = [(i, " ".join(passages[k] for k in sorted(rng.sample(range(40), 34)))) for i in range(240)]
    sets = [shingles(t) for _, t in rows]
    near = {(i, j) for i in range(240) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8}
    group = list(range(240))
    for i, j in near:
        old, new = max(group[i], group[j]), min(group[i], group[j])
        group = [new if g == old else g for g in group]
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(group) and 1 < len(kept) < 240
    assert counted["remaining"] < 6000 < 28_680  # of so many pairs


def shuffled(spark):
    """Bytes that all tasks so far have written to shuffles."""
    time.sleep(0.5)  # the last tasks' figures arrive late
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def test_near_copies_shuffle_little_of_texts_alone(spark):
    """Texts, and shingles of one text alone, stay where they are read; what a step has shuffled is gone after it."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.randrange(16**12):x}" for _ in range(400)) for _ in range(300)]
    rows = [*enumerate(texts), (300, texts[7] + " and more"), (301, "and " + texts[8])]
    docs, before = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id").transform(simhash.materialize), shuffled(spark)
    kept = {r.doc_id for r in simhash.materialize(simhash.representatives(docs)).collect()}
    assert kept == set(range(300))
    sent = shuffled(spark) - before
    assert sent < sum(len(t) for _, t in rows) * 7 // 10, sent
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: held.getAllFiles().mkString("\n").count(".data")
    old = files()
    simhash.materialize(docs.groupBy("text").count())
    for _ in range(50):  # files go in the background
        if files() <= old:
            break
        time.sleep(0.2)
    assert files() <= old
