"""Event pairs by rare tokens, the ordered scan by blocks, its reports, ordinals and running sums, against plain code."""

import random
from datetime import datetime, timedelta, timezone

import plain
import pytest
from pyspark.sql import functions as F

from wirelens.functions.rulepacks import RUSSIAN, SYNTHETIC
from wirelens.functions.text import normalize_title
from wirelens.operators import duplicates, order, pairs
from wirelens.operators.events import FINGERPRINT, compare, locations
from wirelens.plans import catalogue

AT = datetime(2026, 10, 9, tzinfo=timezone.utc)
ITEM = "ordinal long, title string, url string, source string, published_at timestamp, score int, article_text string, image_url string, event_fingerprint " + FINGERPRINT.simpleString()
WORDS = [f"w{i}" for i in range(60)]


def told(tokens, topics=("homicide",), places=(), lead=(), local=()):
    return (list(topics), sorted(set(tokens)), list(places), list(lead), None if local is None else list(local))


def some_items(seed, n=90, span=100):
    """Items with copies, overlapping sets and openings, several families, repeated urls, and missing values."""
    rng, rows, texts = random.Random(seed), [], []
    for i in range(n):
        tokens = rng.sample(WORDS, rng.randrange(0, 16))
        if texts and rng.random() < 0.6:
            tokens = [t for t in rng.choice(texts) if rng.random() > 0.15] + rng.sample(WORDS, rng.randrange(4))
        texts.append(tokens)
        print_ = told(tokens, rng.choice([["homicide"], ["suicide"], ["homicide", "suicide"], []]), rng.sample(["казан", "москв"], rng.randrange(2)), rng.sample(tokens, min(len(tokens), 9)) + ["город"], rng.choice([None, (), ("казан",)]))
        title = rng.choice([f"title number {rng.randrange(12)} of things", rng.choice(["В Казани", "В Москве"]) + " вынесли приговор", "".join(rng.choices("abcdefgh ", k=12)), None])
        at = None if rng.random() < 0.05 else AT + timedelta(minutes=rng.randrange(span * 60))
        rows.append((i, title, f"u{rng.randrange(n)}", "s", at, rng.choice([1, 2, 3, None]), rng.choice(["x", "xx", "", None]), rng.choice(["i", None]), print_))
    return rows


def same_events(spark, df):
    """All pairs by comparing all with all."""
    side = lambda p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("ordinal", "published_at", "event_fingerprint")])
    both = side("l").crossJoin(side("r")).withColumn("d", compare(F.col("l_event_fingerprint"), F.col("r_event_fingerprint"), F.col("l_published_at"), F.col("r_published_at"), RUSSIAN.lead_noise))
    return {(r.l_ordinal, r.r_ordinal): r.d.asDict() for r in both.where("d.is_duplicate").select("l_ordinal", "r_ordinal", "d").collect()}


@pytest.mark.parametrize("seed", range(2))
def test_event_pairs_equal_all_with_all(spark, seed):
    df = spark.createDataFrame(some_items(seed), ITEM)
    true = same_events(spark, df)
    found = {(r.l_id, r.r_id): r.details.asDict() for r in pairs.event_pairs(df, df, RUSSIAN.lead_noise).collect()}
    assert found == true and sum(a != b for a, b in true) > 10 and any(d["lead_match"] for d in true.values())
    left, right = df.where("ordinal % 3 = 0"), df.where("ordinal % 3 <> 0").withColumnRenamed("ordinal", "h")
    rows = [(r.l_id, r.r_id) for r in pairs.event_pairs(left, right, RUSSIAN.lead_noise, right_id="h").collect()]
    assert sorted(rows) == sorted((a, b) for a, b in true if a % 3 == 0 and b % 3)
    assert pairs.event_pairs(df.where("false"), df, RUSSIAN.lead_noise).count() == 0


def test_candidates_are_few_in_a_hot_bucket(spark):
    """A third of the rows are of one family and day, with common words in all of them: few pairs are compared."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        tokens = rng.sample([f"common{k}" for k in range(8)], 4) + [f"own{rng.randrange(4000)}" for _ in range(9)]
        if i % 50 == 1:
            tokens = rows[-1][-1][1][:12] + ["extra"]
        at = AT + timedelta(minutes=i if i % 3 == 0 or i % 50 < 2 else i * 3000)
        rows.append((i, "t", f"u{i}", "s", at, 1, "", None, told(tokens, places=["казан"])))
    df = spark.createDataFrame(rows, ITEM)
    side = pairs.prints(df)
    candidates = pairs.candidate_prints(side, None, ()).count()
    hot = 900 // 3
    found = {(r.l_id, r.r_id) for r in pairs.event_pairs(df, df).where("l_id < r_id").collect()}
    assert candidates < hot * hot / 2 / 10 and len(found) >= 12
    assert found == {(a, b) for a, b in same_events(spark, df) if a < b}


@pytest.mark.parametrize("rows", [2048, 40])
def test_candidates_share_enough_though_all_words_are_common(spark, monkeypatch, rows):
    """All words are in many texts, so that any two share some: candidates are only the pairs that share enough."""
    monkeypatch.setattr(pairs, "CELL_ROWS", rows)
    rng = random.Random(6)
    words = [f"common{k}" for k in range(120)]
    own = [rng.sample(words, 40) for _ in range(150)]
    own += [rng.sample(o[:30] + words[:8], 25) for o in own[::30]]
    df = spark.createDataFrame([(i, "t", f"u{i}", "s", AT + timedelta(hours=i / 4), 1, "", None, told(t, places=["казан"])) for i, t in enumerate(own)], ITEM)
    enough = {(i, j) for i in range(len(own)) for j in range(i) if len(set(own[i]) & set(own[j])) >= 0.45 * min(len(set(own[i])), len(set(own[j])))}
    found = {(r.l_id, r.r_id) for r in pairs.event_pairs(df, df).where("l_id < r_id").collect()}
    assert found == {(a, b) for a, b in same_events(spark, df) if a < b} and found
    assert len(found) <= pairs.candidate_prints(pairs.prints(df), None, ()).count() <= len(enough) < 600


def test_prefixes_are_lossless():
    rng = random.Random(1)
    frequency = {w: rng.randrange(5) for w in WORDS}
    for _ in range(3000):
        a = rng.sample(WORDS, rng.randrange(1, 20))
        b = rng.sample(WORDS, rng.randrange(len(a), 40))
        n = len(set(a) & set(b))
        if n >= 5 and n / len(a) >= 0.45:
            assert set(pairs.prefix(a, 5, frequency)) & set(b)
        assert n >= 5 and n / len(a) >= 0.45 or n < pairs.least_shared(len(a), 5)
    assert pairs.prefix(None, 5, {}) == pairs.prefix(["a"] * 9, 5, {}) == []


def as_rows(df, pack):
    norm, places = normalize_title(F.col("title")), locations(F.coalesce("title", F.lit("")), pack)
    return [r.asDict() for r in df.select("ordinal", "url", "score", "article_text", "image_url", norm.alias("norm"), places.alias("places")).collect()]


@pytest.mark.parametrize("seed,block", [(0, 20_000), (1, 12)])
def test_decisions_equal_the_plain_scan(spark, seed, block):
    df = spark.createDataFrame(some_items(seed, 60, 60), ITEM).repartition(3)
    events = same_events(spark, df).keys()
    true = plain.scan(as_rows(df, RUSSIAN), lambda new, old: (new["ordinal"], old["ordinal"]) in events)
    told_ = duplicates.decisions(df, RUSSIAN, block=block)
    found = [tuple(r) for r in told_.collect()]
    assert sorted(found) == sorted(true) and {g for _, g, *_ in true} == {"url", "title", "event", None}
    stands = {}
    for i, ground, slot, _, takes_over in true:
        if ground is None or takes_over:
            stands[slot] = i
    assert {(r.slot_ordinal, r.ordinal) for r in duplicates.survivors(told_).collect()} == set(stands.items())
    report = duplicates.duplicate_report(df, told_, RUSSIAN).collect()
    assert sorted(r.new_ordinal for r in report) == sorted(i for i, ground, *_ in true if ground)
    assert all((r.details is not None and r.details.is_duplicate) == (r.ground == "event") for r in report)


def test_a_chain_and_a_clique_of_a_third_each(spark):
    """15,000 items: a clique of one event whose account gets better now and then, a chain in which every event is the
    next one's too, others alone. Blocks of 4000 items: neither group is one task's, and the result is the scan's."""
    n = 15_000
    ids = spark.range(n).withColumnRenamed("id", "ordinal")
    k = F.floor(F.col("ordinal") / 3)
    kind = F.col("ordinal") % 3
    array = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    clique = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("clique"), i.cast("string")))
    # neighbours in the chain share seven of fourteen tokens
    chain = F.transform(F.sequence(k * 7, k * 7 + 13), lambda i: F.concat(F.lit("chain"), i.cast("string")))
    alone = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("x"), i.cast("string"), F.col("ordinal").cast("string")))
    tokens = F.when(kind == 0, clique).when(kind == 1, chain).otherwise(alone)
    none = F.array().cast("array<string>")
    print_ = F.struct(array("homicide").alias("topics"), F.array_sort(tokens).alias("tokens"), none.alias("locations"), none.alias("lead_tokens"), none.alias("local_locations"))
    score = F.when(kind == 0, F.floor(F.sqrt(k.cast("double")) / 20)).otherwise(k % 2)
    title = F.md5(F.col("ordinal").cast("string"))
    df = ids.select("ordinal", F.lit(None).cast("string").alias("title"), F.concat(F.lit("u"), F.col("ordinal").cast("string")).alias("url"), F.lit("s").alias("source"), F.lit(AT).alias("published_at"), score.cast("int").alias("score"), F.lit("").alias("article_text"), F.lit(None).cast("string").alias("image_url"), print_.alias("event_fingerprint"))
    # titles that are alike to none: lengths differ too much for a ratio of 1
    df = df.withColumn("title", title)
    found = {r.ordinal: r for r in duplicates.decisions(df, SYNTHETIC, title=1.0, block=4000).collect()}
    assert len(found) == n
    best, standing, last = -1, None, None
    for i in range(n):
        r, k_ = found[i], i // 3
        if i % 3 == 2:
            assert (r.ground, r.slot) == (None, i)
        elif i % 3 == 0:
            quality = int(k_**0.5 / 20)
            assert (r.ground, r.slot, r.other, r.takes_over) == ((None, 0, None, False) if standing is None else ("event", 0, standing, quality > best))
            if quality > best:
                best, standing = quality, i
        else:
            # the one before stands if it opened a slot or took one over
            if last is None or not last[1]:
                assert (r.ground, r.slot) == (None, i)
                last = (i, True)
            else:
                takes = k_ % 2 > (k_ - 1) % 2
                assert (r.ground, r.other, r.takes_over) == ("event", i - 3, takes)
                last = (i, takes)
    assert best >= 3


def test_ordinals_and_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), i, rng.choice([None, rng.randrange(-50, 50)]), "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, i long, v long, part string").repartition(7)
    expected, total = [], 0
    for place, (k, i, v, _) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1]))):
        total += v or 0
        expected.append((k, i, v, total, place))
    by = [F.desc("k"), F.col("i")]
    found = order.running(df, {"upto": F.col("v")}, by, "place").select("k", "i", "v", "upto", "place").collect()
    assert sorted(map(tuple, found), key=lambda r: r[-1]) == expected
    numbered = order.numbered(df, by, start=5)
    assert numbered.columns == ["k", "i", "v", "part", "ordinal"] and [r.ordinal - 5 for r in sorted(numbered.collect(), key=lambda r: (-r.k, r.i))] == list(range(2000))
    assert order.numbered(df.where("false"), by).count() == 0
    replaced = order.running(df, {"v": F.col("v")}, by).select("i", "v").collect()
    assert {r.i: r.v for r in replaced} == {i: t for _, i, _, t, _ in expected}


def test_ordinals_need_no_single_task(spark):
    plan = order.numbered(catalogue.table(spark, "/root/testdata/sf0.01", "lineitem"), [F.col("l_orderkey"), F.col("l_linenumber")])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]
