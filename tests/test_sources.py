import gc
import json
from datetime import datetime, timezone

import oracle
import pyarrow as pa
from pyspark.sql import functions as F

from wirelens.functions.rulepacks import RUSSIAN
from wirelens.operators.classify import write_with_counts
from wirelens.operators.render import CAPTION, POST, render
from wirelens.plans import catalogue, scale  # noqa: F401  (scale registers page_headlines)
from wirelens.sources import article, dom, feeds, listing, sinks, table_functions
from wirelens.sources.listing import read_listings
from wirelens.streaming import news

NOW = datetime(2026, 9, 22, 12, 0, tzinfo=timezone.utc)
PAGE = "name string, url string, html string, adapter string, timezone string, `limit` string"


def listed(spark, adapter, html, url="https://www.site.ru/list", limit=None):
    df = spark.createDataFrame([("s", url, html, adapter, None, limit)], PAGE)
    return read_listings(df, F.lit(NOW)).orderBy("source_place").collect()


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>A &amp; B</title><link>http://x/1</link><pubDate>Fri, 21 Aug 2026 10:05:00 GMT</pubDate><description>&lt;b&gt;bold&lt;/b&gt; text</description></item><item><title>only</title></item></channel></rss>")
    rows = feeds.read_rss(spark, str(tmp_path / "a.xml"), "s").orderBy("url").collect()
    assert [(r.title, r.url, r.description, r.source) for r in rows] == [("only", "", "", "s"), ("A & B", "http://x/1", "bold text", "s")]
    assert rows[0].published_at is None and rows[1].published_at is not None
    both = feeds.union_in_order([feeds.read_rss(spark, str(tmp_path / "a.xml"), s) for s in "ab"])
    assert {(r.source, r.source_ordinal) for r in both.collect()} == {("a", 0), ("b", 1)}


def test_catalogue_of_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"name": "a", "enabled": False}, {"name": "b"}, {"name": "c", "enabled": True}]))
    found = feeds.source_catalogue(spark, str(tmp_path / "s.json"))
    assert feeds.source_counts(found).first().asDict() == {"active": 2, "disabled": 1}


def test_cards_with_selectors(spark):
    html = '<article class="section_news_item"><div class="section_news_item_content_title"><a href="/news-1/">Убит  мужчина</a></div><span class="section_news_item_date">сегодня, 10:00</span><p class="section_news_item_content_preview">p</p></article><article class="section_news_item"></article><article class="section_news_item"><div class="section_news_item_content_title"><a href="https://other.ru/news-1/">x</a></div></article>'
    rows = listed(spark, "vnru", html)
    assert [(r.title, r.url, r.description, r.source_place) for r in rows] == [("Убит мужчина", "https://www.site.ru/news-1/", "p", 1)]
    assert rows[0].published_at is not None
    assert listed(spark, "vnru", html, limit="-3") == [] and len(listed(spark, "vnru", html, limit="x")) == 1
    assert listed(spark, "unknown", html) == listed(spark, "vnru", None) == []


def test_local_markers_categories_and_page_date(spark):
    html = '<div class="header_today">21 сентября, понедельник</div><a class="lenta_material latest" href="/news/1-a"><div class="lenta_material_info"><div>10:30</div></div><p class="lenta_material_title">Пожар в Томске</p></a><a class="lenta_material" href="/news/2-b"><p class="lenta_material_title">Томск и окрестности</p></a><a class="lenta_material" href="/news/3-c"><p class="lenta_material_title">Москва</p></a>'
    rows = listed(spark, "vtomske", html)
    assert [r.title for r in rows] == ["Пожар в Томске", "Томск и окрестности"]
    assert rows[0].published_at is not None and rows[1].published_at is None
    a42 = '<a class="card__link" href="/lenta/news/5-x"><article class="card"><i class="card__category">Криминал</i><b class="card__title">T</b></article></a><a class="card__link" href="/lenta/news/6-x"><article class="card"><i class="card__category">Спорт</i><b class="card__title">T</b></article></a>'
    assert [r.url for r in listed(spark, "a42", a42)] == ["https://www.site.ru/lenta/news/5-x"]
    amic = '<div class="archive-news-item"><h2 class="title"><a href="/news/x-5">Барнаул</a></h2><span class="published_at">сегодня, 9:00<i>3</i></span></div>'
    assert listed(spark, "amic", amic)[0].published_at is not None


def test_rows_of_one_url_are_merged(spark):
    html = '<div><a href="/text/incidents/2026/09/20/1/"><img></a></div><div><a href="/text/incidents/2026/09/20/1/" title="Short">x</a></div><div><a href="/text/incidents/2026/09/20/1/" data-announcement-title="The longer title">x</a><span>sub</span><i data-announcement-date="сегодня, 10:00"></i></div><div><a href="/text/incidents/2026/09/21/2/">Other</a></div>'
    rows = listed(spark, "ngs", html)
    assert [(r.title, r.description) for r in rows] == [("The longer title", "sub"), ("Other", "")]
    last = '<div><div><div><a data-announcement-title="A" href="/2026/09/20/1/">x</a></div></div></div><div><div><div><a data-announcement-title="B" href="/2026/09/20/1/">x</a></div></div></div>'
    assert [(r.title, r.published_at is not None) for r in listed(spark, "fontanka", last)] == [("B", True)]


def test_channel(spark):
    post = '<div class="tgme_widget_message" data-post="{}"><a class="tgme_widget_message_photo_wrap" style="background-image:url(\'{}\')"></a><div class="tgme_widget_message_text">Text<br><br><br><br>more<br>🔗 <a href="https://src/1">Источник</a></div><time datetime="2026-09-01T10:00:00+00:00"></time></div>'
    html = post.format("Chan/5", "https://i/1.jpg") + post.format("other/6", "https://i/1.jpg") + post.format("chan/7", "http://i/1.jpg") + post.format("chan/x", "https://i/1.jpg")
    rows = feeds.read_channel(spark.createDataFrame([(html,), (None,)], "html string"), "chan").collect()
    assert [(r.message_id, r.text, r.image_url, r.source_url) for r in rows] == [("5", "Text\n\nmore", "https://i/1.jpg", "https://src/1")]


def test_history_and_cards(spark, tmp_path):
    assert feeds.read_history(spark, str(tmp_path / "none")).count() == 0
    kind = feeds.HISTORY.split("event_fingerprint ")[1]
    items = spark.createDataFrame([("t", "http://u", NOW, "s", None, "long text")], f"title string, url string, published_at timestamp, source string, event_fingerprint {kind}, article_text string")
    sinks.append_history(items, str(tmp_path / "h"))
    sinks.append_history(items, str(tmp_path / "h"))
    assert [r.url for r in feeds.read_history(spark, str(tmp_path / "h"), strict=True).collect()] == ["http://u"] * 2
    events = spark.createDataFrame([("e1", ' A "title" ', "https://u/1", "", "2026-09-01T10:00:00")], "event_id string, title string, url string, source string, published_at string")
    for _ in range(2):
        sinks.write_cards(events, str(tmp_path / "cards"), F.lit("2026-09-02"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "cards")).collect())
    assert 'title: "A \\"title\\""' in text and '  - name: "u"' in text and text.count("event_id: ") == 1


def test_card_urls(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\nsources:\n  - name: "n"\n    url: "https://u/1"\n  - url: "https://u/2"\n---\n')
    assert sorted(r.url for r in feeds.card_urls(spark, str(tmp_path)).collect()) == ["https://u/1", "https://u/2"]


def test_publishing_ends_with_success_or_doubt():
    assert sinks.publish_steps({"photo": "failed", "file": "ok", "text": "ok"}) == (["photo", "file"], True)
    assert sinks.publish_steps({"photo": "uncertain", "text": "ok"}) == (["photo"], False)
    assert sinks.publish_steps({"photo": "failed", "text": "failed"}) == (["photo", "text"], False)


def test_stream(spark, tmp_path):
    def put(name, *rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("ordinal", "title", "url", "source", "published_at"), r, strict=True))) for r in rows))

    def run():
        stream = news.first_by_url(news.item_stream(spark, str(tmp_path / "in")))
        news.append_history(news.admitted(stream, RUSSIAN, 4).select("ordinal", "url", "score"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        return sorted(r.ordinal for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("1.json", (1, "Убит мужчина", "u1", "a", "2026-09-20T10:00:00Z"), (2, "Погода", "u2", "a", "2026-09-20T11:00:00Z"))
    assert run() == [1]
    put("2.json", (3, "Убит мужчина", "u1", "b", "2026-09-20T12:00:00Z"), (4, "Раскрыто убийство", "u4", "b", "2026-09-21T10:00:00Z"))
    assert run() == [1, 4]


def test_card_loaders(spark, tmp_path):
    (tmp_path / "cards/a").mkdir(parents=True)
    (tmp_path / "cards/a/one.md").write_text('---\nevent_id: "e1"\ntitle: \'Two words\'\nplain: yes\nempty:\n---\n\nThe body.\n', "utf-8")
    (tmp_path / "cards/bare.md").write_text("no front matter", "utf-8")
    (tmp_path / "cards/two.json").write_text('{\n "event_id": "e2",\n "sources": [{"url": "http://x"}]\n}', "utf-8")
    found = {r.body.strip(): r.fields for r in feeds.read_cards(spark, str(tmp_path / "cards")).collect()}
    assert found == {"The body.": {"event_id": "e1", "title": "Two words", "plain": "yes"}, "no front matter": {}}
    (row,) = feeds.read_json_cards(spark, str(tmp_path / "cards"), "event_id string, sources array<struct<url:string>>").collect()
    assert (row.event_id, row.sources[0].url) == ("e2", "http://x")


def test_captions_are_shorter_posts(spark):
    item = [("Заголовок & ещё", "Первое предложение. " * 90, None, "Источник", "http://x/1?a=1&b=2", datetime(2026, 9, 1, tzinfo=timezone.utc), ["убий"])]
    df = spark.createDataFrame(item, "title string, description string, article_text string, source string, url string, published_at timestamp, matched_topics array<string>")
    post, caption = (render(df, RUSSIAN, limit, "text").first().text for limit in (POST, CAPTION))
    assert len(caption) <= CAPTION < len(post) <= POST and "…" in caption and caption.splitlines()[0] == post.splitlines()[0] and caption.splitlines()[-1] == post.splitlines()[-1]


def test_writes_quarantine_what_stages_stop(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, True), (2, True, None), (3, False, True), (4, None, False)], "n int, a boolean, b boolean")
    counts = write_with_counts(rows, {"first": F.col("a"), "second": F.col("b")}, str(tmp_path / "w"))
    assert counts == {"collected": 4, "first": 2, "second": 1, "stopped_first": 2, "stopped_second": 1}
    back = {r.n: (r.passed, r.stopped) for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert back == {1: ("true", None), 2: ("false", "second"), 3: ("false", "first"), 4: ("false", "first")}
    assert write_with_counts(rows.where("false"), {"first": F.col("a")}, str(tmp_path / "e")) == {"collected": 0, "first": 0, "stopped_first": 0}


def test_table_functions_in_sql(spark):
    table_functions.register(spark)
    pages = spark.createDataFrame([(1, '<p>a <a href="/x?a=1&amp;b=2"> one  two </a><a name="n">no</a></p><h2> </h2><a href="">e</a>'), (2, None), (3, "")], "id int, html string")
    links = spark.sql("SELECT id, l.* FROM {pages}, LATERAL page_links(html) l", pages=pages).collect()
    assert [tuple(r) for r in links] == [(1, 0, "/x?a=1&b=2", "one two"), (1, 1, "", "e")]
    assert [tuple(r) for r in spark.sql("SELECT id, b.* FROM {pages}, LATERAL page_blocks(html) b", pages=pages).collect()][0][:3] == (1, 0, "p")


def test_headlines_keep_references_without_semicolon(spark, tmp_path):
    html = "<article><h1>a &amp;&lt;b&gt;&#x27; &amp&copy &amp;amp</h1><p>x</p></article>"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    name = "page_headlines"
    assert oracle.check(spark, name, catalogue.QUERIES[name], catalogue.ORACLES[name], str(tmp_path)) == 1
    assert catalogue.QUERIES[name](spark, str(tmp_path)).first().headline == "a &<b>' &amp&copy &amp"


def test_trees_of_pages_do_not_stay():
    """Values are made of few pages at a time, and a page's nodes are gone when its value is made, uncollected."""
    gc.collect()
    gc.disable()
    try:
        html = "<nav>" + "<a href='/x'><b>t</b></a>" * 40 + "</nav><article><h1>h</h1><aside><p>no</p></aside><p>p</p></article>"
        article.extract(html, article.Extractor("article", drop=("aside",))), listing.cards(html, listing.Listing("nav a[href]", "/", "UTC")), article.image_of(html, "")
        assert not [o for o in gc.get_objects() if isinstance(o, dom.Node)]
    finally:
        gc.enable()
    pages = pa.array(["x"] * 200)
    assert dom.of_pages(lambda h: h + "y", pa.string(), pages).to_pylist() == ["xy"] * 200 and len(dom.of_pages(str, pa.string(), pages[:0])) == 0
