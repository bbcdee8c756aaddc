import random
from datetime import datetime, timedelta, timezone
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from wirelens.functions.rulepacks import RUSSIAN
from wirelens.functions.text import stem
from wirelens.operators import events
from wirelens.operators.duplicates import remove_duplicates
from wirelens.operators.events import compare, fingerprint, history_rows, title_pairs, title_ratio
from wirelens.operators.graph import components
from wirelens.operators.pairs import event_pairs, unpublished

AT = datetime(2026, 10, 9, 12, 0, tzinfo=timezone.utc)
SCHEMA = "ordinal long, title string, url string, source string, published_at timestamp, score int, article_text string, description string, image_url string, strong_topics array<string>"
FACTS = "В Казани охотник ранил рыбака возле пристани, затем лодочник вывез снасти, палатку, бензопилу и фонарь через протоку к заимке"


def item(n, title, **own):
    base = {"ordinal": n, "title": title, "url": f"http://x/{n}", "source": "s", "published_at": AT, "score": 10, "article_text": FACTS, "description": "", "image_url": None, "strong_topics": ["убий"]}
    return tuple((base | own).values())


def kept(spark, *rows):
    df = fingerprint(spark.createDataFrame(list(rows), SCHEMA), RUSSIAN)
    return [r.ordinal for r in remove_duplicates(df, RUSSIAN).orderBy("slot_ordinal").collect()]


def test_stemmer_cuts_the_longest_suffix(spark):
    words = ["охотниками", "рыбака", "Ёлочная", "дом", "прокурорского", "-лесника-"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(stem(F.col("w"), RUSSIAN.suffixes, RUSSIAN.role_suffixes))

    def plain(w):
        w = w.casefold().replace("ё", "е").strip("-")
        for s in sorted(RUSSIAN.suffixes, key=len, reverse=True):
            if w.endswith(s) and len(w) - len(s) >= 4:
                w = w[: -len(s)]
                break
        for s in RUSSIAN.role_suffixes:
            if w.endswith(s) and len(w) - len(s) >= 4:
                return w[: -len(s)]
        return w

    assert [r[0] for r in df.collect()] == [plain(w) for w in words]


def test_fingerprint_fields(spark):
    r = fingerprint(spark.createDataFrame([item(0, "Убийство в городе Казань")], SCHEMA), RUSSIAN).first().event_fingerprint
    assert r.topics == ["homicide"] and "казан" in r.locations and "казань" in r.local_locations
    assert "охот" in r.tokens and not any("убий" in t for t in r.tokens) and r.tokens == sorted(set(r.tokens))


def test_same_url_and_same_title(spark):
    assert kept(spark, item(0, "Один заголовок", url="u", strong_topics=[]), item(1, "Совсем иначе названо", url="u", strong_topics=[])) == [0]
    assert kept(spark, item(0, "Один и тот же заголовок", strong_topics=[]), item(1, "Один и тот же заголовок!", strong_topics=[])) == [0]


def test_the_better_of_one_event_remains_in_the_slot(spark):
    assert kept(spark, item(0, "Трагедия у реки", score=9), item(1, "Рыбака нашли без помощи", score=11)) == [1]
    assert kept(spark, item(0, "Трагедия у реки"), item(1, "Рыбака нашли без помощи", image_url="http://i")) == [1]
    assert kept(spark, item(0, "Трагедия у реки"), item(1, "Рыбака нашли без помощи")) == [0]


def test_other_places_times_and_unknown_dates_stay_apart(spark):
    assert kept(spark, item(0, "Суд вынес решение по делу в Москве", strong_topics=[]), item(1, "Суд вынес решение по делу в Казани", strong_topics=[])) == [0, 1]
    assert kept(spark, item(0, "Трагедия у реки"), item(1, "Рыбака нашли без помощи", published_at=AT + timedelta(hours=37))) == [0, 1]
    assert kept(spark, item(0, "Трагедия у реки"), item(1, "Рыбака нашли без помощи", published_at=None)) == [0, 1]


def prints(spark, **own):
    base = {"topics": ["homicide"], "tokens": [], "locations": [], "lead_tokens": [], "local_locations": []}
    return spark.createDataFrame([(base | own,)], "p struct<topics:array<string>,tokens:array<string>,locations:array<string>,lead_tokens:array<string>,local_locations:array<string>>")


def compared(spark, a, b):
    df = prints(spark, **a).withColumnRenamed("p", "a").crossJoin(prints(spark, **b).withColumnRenamed("p", "b"))
    now = F.lit(AT)
    return df.select(compare(F.col("a"), F.col("b"), now, now, RUSSIAN.lead_noise).alias("c")).first().c


def test_lead_match_needs_a_concrete_place(spark):
    own, other = [f"слово{i}" for i in range(8)], [f"слово{i}" for i in range(8)] + [f"иное{i}" for i in range(30)]
    lots = own + [f"прочее{i}" for i in range(30)]
    a = {"tokens": lots, "lead_tokens": own, "local_locations": ["окинав"]}
    assert compared(spark, a, {"tokens": other, "local_locations": ["окинав"]}).lead_match
    assert not compared(spark, a, {"tokens": other, "local_locations": ["осак"]}).is_duplicate
    assert compared(spark, a, {"tokens": [*other, "окинав"], "local_locations": None}).lead_match


def test_facts_need_a_place_or_density(spark):
    words = [f"слово{i}" for i in range(6)]
    assert not compared(spark, {"tokens": words}, {"tokens": words}).is_duplicate
    assert compared(spark, {"tokens": words, "locations": ["казань"]}, {"tokens": words, "locations": ["казань"]}).is_duplicate
    assert compared(spark, {"tokens": [*words, "слово6"]}, {"tokens": [*words, "слово6"]}).is_duplicate
    assert not compared(spark, {"topics": ["suicide"], "tokens": words}, {"tokens": words}).is_duplicate


def test_history(spark):
    df = fingerprint(spark.createDataFrame([item(0, "Трагедия у реки"), item(1, "Погода", strong_topics=[]), item(2, "Ещё", strong_topics=[])], SCHEMA), RUSSIAN)
    past = history_rows(fingerprint(spark.createDataFrame([item(9, "Рыбака нашли без помощи", url="http://old"), item(8, "Старое", url="http://x/1")], SCHEMA), RUSSIAN))
    assert dict(past.dtypes)["published_at"] == "string" and "article_text" not in past.columns
    old = past.withColumn("event_fingerprint", F.when(F.col("url") == "http://old", F.col("event_fingerprint")))
    assert sorted(r.ordinal for r in unpublished(df, old).collect()) == [2]
    assert sorted(r.ordinal for r in unpublished(df, old.withColumn("event_fingerprint", F.lit(None).cast(df.schema["event_fingerprint"].dataType))).collect()) == [0, 2]


def test_title_pairs_lose_nothing(spark):
    rng = random.Random(3)
    base = ["the cat sat on the mat", "суд вынес приговор по делу", "a b c d e f g h", "новости дня"]
    titles = sorted({"".join(c for c in rng.choice(base) if rng.random() > 0.12) for _ in range(60)} - {""})
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    true = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if max(ratio(titles[i], titles[j]), ratio(titles[j], titles[i])) >= 0.75}
    for block in (256, 7):
        assert {(r.l_id, r.r_id) for r in title_pairs(df, block=block).collect()} == true and true


def some_titles(seed, n, lengths):
    """Titles of few syllables, some of them copies with edits, some a few words over and over."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["the", "an", "in", "tion", "er", "ed", "ing", "of", "ba", "cu", "ky"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    titles = []
    for i in range(n):
        length, kind = rng.choice(lengths), rng.random()
        pool = rng.sample(words, 3) if kind < 0.1 else words
        text = list(" ".join(rng.choice(pool) for _ in range(length))[:length])
        if titles and kind > 0.7:
            old, rate = rng.choice(titles), rng.choice([0, 0.002, 0.05, 0.2])
            text = [c for c in old[: int(len(old) * rng.uniform(0.6, 1.1))] if rng.random() >= rate]
        titles.append("".join(text).strip())
    return [(i, t) for i, t in enumerate(dict.fromkeys(titles)) if t]


@pytest.mark.parametrize("lengths", [(20, 63, 64, 65, 130), (190, 199, 200, 201, 260), (700, 720, 900, 1100)])
def test_titles_of_all_lengths_equal_all_with_all(lengths):
    titles = some_titles(len(lengths), 70, lengths)
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio() >= 0.75
    true = {(i, j, ratio(x, y), ratio(y, x)) for i, x in titles for j, y in titles if i < j}
    true = {t for t in true if t[2] or t[3]}
    assert len(true) >= 3 and set(events.alike_titles(titles, titles, 0.75, once=True)) == true
    left, right = titles[::2], titles[1::2]
    apart = {t for t in true if (t[0] in dict(left)) != (t[1] in dict(left))}
    found = events.alike_titles(left, right, 0.75)
    assert len(found) == len(apart) and set(found) == apart


def test_few_long_titles_are_aligned_letter_by_letter(monkeypatch):
    """Titles of one language share their letters; bounds leave hardly a pair for one alignment at a time."""
    times, one = [], events.longest_common
    monkeypatch.setattr(events, "longest_common", lambda *a: times.append(1) or one(*a))
    rng = random.Random(1)
    words = ["".join(rng.choices("etaoinsrhld", k=rng.randrange(2, 7))) for _ in range(400)] + ["of", "by", "mug", "pick"]
    titles = [(i, " ".join(rng.choices(words, k=90))) for i in range(200)]
    assert int(events.may_be_alike([t for _, t in titles], [t for _, t in titles], 0.75).sum()) > 30_000
    events.alike_titles(titles, titles, 0.75, once=True)
    assert len(times) < 200


def test_hardly_a_pair_of_short_titles_is_aligned_whole(monkeypatch):
    """Common subsequences of a few letters leave out what letters alone don't."""
    given, one = [], events.long_common
    monkeypatch.setattr(events, "long_common", lambda texts, patterns, a, *rest: given.append(len(a)) or one(texts, patterns, a, *rest))
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinsrhld", k=rng.randrange(2, 7))) for _ in range(400)]
    titles = [(i, " ".join(rng.choices(words, k=rng.randrange(14, 26)))) for i in range(400)]
    assert int(events.may_be_alike([t for _, t in titles], [t for _, t in titles], 0.75).sum()) > 50_000
    events.alike_titles(titles, titles, 0.75, once=True)
    assert sum(given) < 5_000


@pytest.mark.parametrize("own", [{"TILE": 24, "FEW": 0, "SPARSE": 1.1}, {"TILE": 30, "FEW": 0, "SPARSE": 0, "SHORT": 0}, {"CELLS": 50, "SHORT": 10**6, "FULL": 2}])
def test_title_bounds_lose_nothing_in_small_tiles(own, monkeypatch):
    for name, value in own.items():
        monkeypatch.setattr(events, name, value)
    titles = some_titles(11, 90, (5, 30, 64, 120, 190, 210, 300))
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio() >= 0.75
    true = {(i, j, ratio(x, y), ratio(y, x)) for i, x in titles for j, y in titles if i < j}
    true = {t for t in true if t[2] or t[3]}
    assert len(true) >= 3 and set(events.alike_titles(titles, titles, 0.75, once=True)) == true
    left, right = titles[::2], titles[1::2]
    assert set(events.alike_titles(left, right, 0.75)) == {t for t in true if (t[0] in dict(left)) != (t[1] in dict(left))}


def test_ratio_of_a_second_title_is_that_of_the_matcher():
    titles = [t for _, t in some_titles(5, 40, (20, 190, 200, 350, 700))] + ["", "q", "ab" * 150, "z" + "ab" * 150]
    for y in titles:
        second = events.Second(y)
        for x in titles:
            told = SequenceMatcher(None, x, y).ratio()
            assert all(second.has_ratio(x, least) == (told >= least) for least in (0.3, 0.75, told, told + 1e-9))


def test_title_ratio_depends_on_order(spark):
    df = spark.createDataFrame([("tide", "diet")], "a string, b string")
    r = df.select(title_ratio(F.col("a"), F.col("b")).alias("x"), title_ratio(F.col("b"), F.col("a")).alias("y")).first()
    assert (r.x, r.y) == (0.25, 0.5)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1050)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(find(n) == r for n, r in found.items())
    assert {n for n in parent if find(n) != n} <= found.keys()


def test_event_pairs_are_not_repeated(spark):
    df = fingerprint(spark.createDataFrame([item(0, "Трагедия", strong_topics=["убий", "изнасил"]), item(1, "Иное", strong_topics=["убий", "изнасил"])], SCHEMA), RUSSIAN)
    assert event_pairs(df, df).where("l_id < r_id").count() == 1


def test_history_without_fingerprints_compares_none(spark, monkeypatch):
    from wirelens.operators import pairs

    def compared_anyway(*_, **__):
        raise AssertionError

    monkeypatch.setattr(pairs, "event_pairs", compared_anyway)
    df = fingerprint(spark.createDataFrame([item(0, "Трагедия", url="http://a"), item(1, "Иное", url="http://b")], SCHEMA), RUSSIAN)
    old = df.where("ordinal = 0").select("url", "published_at", F.lit(None).cast(df.schema["event_fingerprint"].dataType).alias("event_fingerprint"))
    assert [r.ordinal for r in unpublished(df, old).collect()] == [1]
