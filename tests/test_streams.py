"""Versioned tables, upserts and intake by micro-batches, sessions and interval joins of streams: equal to batch results,
after replays, failures and restarts."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wirelens.functions.rulepacks import RUSSIAN
from wirelens.operators import intake
from wirelens.operators.duplicates import remove_duplicates
from wirelens.operators.events import fingerprint
from wirelens.sources import sinks
from wirelens.sources.tables import Conflict, VersionedTable
from wirelens.streaming import ledger, news

AT = datetime(2026, 10, 9, tzinfo=timezone.utc)


def test_a_write_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.version().number == 0 and table.read(schema="a long").count() == 0
    with pytest.raises(FileNotFoundError):
        table.read()
    first = table.replace(spark.range(3))
    assert first.number == 1 and table.read().count() == 3
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.replace(table.read().union(spark.range(9)))
    assert table.version().number == 1 and table.read().count() == 3
    second = table.replace(table.read().union(spark.range(4)), first, "why")
    assert (second.number, table.version().note, table.read().count(), table.read(1).count()) == (2, "why", 7, 3)
    with pytest.raises(Conflict):
        table.replace(spark.range(1), first)
    assert table.read().count() == 7
    table.clean(1)
    assert table.read().count() == 7 and len(list((tmp_path / "t/data").iterdir())) == 1


def test_state_never_goes_back(spark, tmp_path):
    path = f"{tmp_path}/state"
    with pytest.raises(intake.IntakeError):
        intake.load_state(spark, path)
    intake.save_state(spark, intake.State(5, "u5", ("a",)), path)
    intake.save_state(spark, intake.State(7, "u7", ("a", "b")), path)
    assert intake.load_state(spark, path) == intake.State(7, "u7", ("a", "b"))
    with pytest.raises(Conflict):
        intake.save_state(spark, intake.State(6, "u6"), path)
    assert intake.load_state(spark, path).cursor == 7


def test_history_stays_when_its_rewrite_fails(spark, tmp_path):
    path = f"{tmp_path}/h"
    spark.createDataFrame([(i, f"u{i}") for i in range(5)], "n long, url string").write.json(path)
    bad = spark.read.schema("n long, url string").json(path).select("n", F.when(F.col("n") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("url")).cast("string").alias("url"))
    with pytest.raises(Exception, match="broken"):
        sinks.rewrite_history(bad, path)
    assert spark.read.json(path).count() == 5
    sinks.rewrite_history(spark.read.schema("n long, url string").json(path).where("n > 1"), path)
    assert sorted(r.n for r in spark.read.json(path).collect()) == [2, 3, 4] and not (tmp_path / "h.before").exists()


def posts(spark, *rows):
    return spark.createDataFrame([(i, t, "2026", None, u) for i, t, u in rows], ledger.POSTS)


def test_a_batch_that_comes_again_writes_nothing(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/posts")
    apply = lambda k, rows, stream="s": ledger.apply_once(table, stream, k, ledger.POSTS, lambda old: ledger.merge_posts(old, rows))
    assert apply(0, posts(spark, (1, "a", None), (2, "b", None), (2, "bb", None)))
    assert not apply(0, posts(spark, (1, "changed", "http://x"))) and table.version().number == 1
    with pytest.raises(ZeroDivisionError):  # fails before it commits
        ledger.apply_once(table, "s", 1, ledger.POSTS, lambda old: 1 / 0)
    assert apply(1, posts(spark, (1, "linked", "http://x"), (3, "c", None))) and apply(0, posts(spark, (4, "d", None)), "other")
    assert {(r.message_id, r.text, r.source_url) for r in table.read().collect()} == {(1, "linked", "http://x"), (2, "bb", None), (3, "c", None), (4, "d", None)}
    assert ledger.applied(table.version()) == {"s": 1, "other": 0} and not apply(1, posts(spark, (9, "z", None)))


def test_streams_of_posts_equal_batches_after_a_restart(spark, tmp_path):
    table, source = VersionedTable(spark, f"{tmp_path}/posts"), f"{tmp_path}/in"
    run = lambda: ledger.posts_stream(spark.readStream.schema(ledger.POSTS).json(source), table, "posts", f"{tmp_path}/c").awaitTermination()
    posts(spark, (1, "a", None), (2, "b", None)).coalesce(1).write.mode("append").json(source)
    run()
    posts(spark, (2, "b2", "http://y"), (3, "c", None)).coalesce(1).write.mode("append").json(source)
    run(), run()
    assert {(r.message_id, r.text) for r in table.read().collect()} == {(1, "a"), (2, "b2"), (3, "c")} and table.version().number == 2


ITEMS = "ordinal long, title string, url string, source string, published_at timestamp, score int, article_text string, description string, image_url string, strong_topics array<string>"
FACTS = "В Казани охотник ранил рыбака возле пристани, затем лодочник вывез снасти, палатку, бензопилу и фонарь через протоку к заимке"


def test_events_of_a_stream_are_told_once(spark, tmp_path):
    """Late and repeated accounts of an event, and repeated urls, over batches and a restart; as in one batch."""
    def item(n, title, hours, url=None, text=FACTS):
        return n, title, url or f"http://x/{n}", "s", AT + timedelta(hours=hours), 10, text, "", None, ["убий"]

    batches = [
        [item(0, "Трагедия у реки", 0), item(1, "Рыбака нашли без помощи", 2), item(2, "Пожар в порту", 0, text="Иное дело")],
        [item(3, "Охотника ищут на заимке", -20), item(4, "Другое название", 1, "http://x/2", "Совсем иной текст"), item(5, "Спустя двое суток", 40)],
        [item(6, "Снова о рыбаке", 10)],
    ]
    table, source = VersionedTable(spark, f"{tmp_path}/history"), f"{tmp_path}/in"
    for rows in batches:
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").json(source)
        for _ in range(2):  # a restart with nothing new
            ledger.news_stream(spark.readStream.schema(ITEMS).json(source), table, RUSSIAN, "news", f"{tmp_path}/c").awaitTermination()
    whole = remove_duplicates(fingerprint(spark.createDataFrame([r for b in batches for r in b], ITEMS), RUSSIAN), RUSSIAN)
    urls = {r.url for r in table.read().collect()}
    assert urls == {r.url for r in whole.collect()} == {"http://x/0", "http://x/2", "http://x/5"} and table.version().number == 3


def events(spark, rows, path):
    spark.createDataFrame([(f"s{k % 3}", AT + timedelta(minutes=m), n) for n, (k, m) in enumerate(rows)], "source string, published_at timestamp, n long").coalesce(1).write.mode("append").json(path)


def collected(spark, df, name, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start().awaitTermination()
    return spark.table(name)


def test_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    path, schema = f"{tmp_path}/in", "source string, published_at timestamp, n long"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path).withWatermark("published_at", "1 hour")
    events(spark, [(k, m) for k in range(3) for m in (0, 10, 25, 100 + k, 120)], path)
    events(spark, [(1, 40), (2, 150), (0, 600)], path)
    whole = {tuple(r) for r in news.sessions(spark.read.schema(schema).json(path), "30 minutes").collect()}
    events(spark, [(0, 5000)], path)  # moves the watermark on
    events(spark, [(0, 30), (1, 41)], path)  # late by days: left out
    found = {tuple(r) for r in collected(spark, news.sessions(stream(), "30 minutes"), "sessions", tmp_path).collect()}
    assert found == whole and len(found) > 5


def test_stream_joins_stream_within_hours(spark, tmp_path):
    schema = "source string, published_at timestamp, n long"
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    events(spark, [(k, 60 * h) for k in range(3) for h in range(0, 100, 9)], a)
    events(spark, [(k, 60 * h + 7) for k in range(3) for h in range(0, 100, 25)], b)
    read = lambda reader, p: reader.schema(schema).json(p)
    near = lambda r: news.near_published(read(r, a), read(r, b), "source", hours=12).select("n", "old_n")
    whole = {tuple(r) for r in near(spark.read).collect()}
    assert {tuple(r) for r in collected(spark, near(spark.readStream), "near", tmp_path).collect()} == whole and whole
