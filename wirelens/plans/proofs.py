"""Queries over rows that are made from the driver's tables: rule packs on known cases, pages, feeds, histories, intake.

Each has SQL for the same rows: what the operator must find was put into its input, so the SQL tells it from the ids.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions import text as tx
from wirelens.functions.dates import event_date_label, long_date, url_date
from wirelens.functions.rulepacks import RUSSIAN
from wirelens.functions.storage import materialize, new_path
from wirelens.operators import classify as cl
from wirelens.operators import events as ev
from wirelens.operators import feed, intake, pairs, policy
from wirelens.operators.render import spaced
from wirelens.plans.catalogue import PRINTED, news, printed, query, table
from wirelens.sources import feeds, sinks
from wirelens.sources.article import article_text, image_url
from wirelens.sources.listing import read_listings

#: When all cases are published.
AT = datetime.datetime(2026, 9, 22, 12, 0, tzinfo=datetime.timezone.utc)


def cases(spark, sf_dir, rows: list[tuple], schema: str) -> DataFrame:
    """Every document with one of the cases, by the remainder of its id: doc_id and the case's columns."""
    known = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(len(rows))).cast("int").alias("k"))
    return docs.join(F.broadcast(known), "k").drop("k")  # a dozen fixed rows


def values(rows: list[tuple], names: str) -> str:
    """The cases' expectations for SQL: a table with k, their number, and names."""
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"
    lines = ", ".join("(" + ", ".join(map(cell, (k, *r))) + ")" for k, r in enumerate(rows))
    return f"documents JOIN (VALUES {lines}) AS known(k, {names}) ON doc_id % {len(rows)} = k"


# ---------------------------------------------------------------- the Russian pack on known cases

#: Title, body, and the rule that rejects it.
POLICY = [
    ("Политик раскрыл отношения с убитым лидером страны", "", "political_commentary"),
    ("Канцлер прокомментировал визит: убийца возвращается на место преступления", "", "political_rhetoric"),
    ("МИД выразил протест в связи с убийством туриста", "", "diplomatic_reaction"),
    ("Водитель убил попутчика; МИД выразил протест в связи с убийством", "", None),
    ("На базе ввели запрет на выход военных после убийства женщины", "", "military_crime_response"),
    ("Почти все пленницы подверглись изнасилованию, заявил министр", "", "aggregate_political_statement"),
    ("Убийство в центре: главные новости 5 мая", "Что произошло за сутки. Убит мужчина.", "news_roundup"),
    ("Новости города: убит мужчина", "", None),
    ("Подозреваемый в убийстве ранен при погоне", "Полицейские догнали машину.", "nonfatal_suspect_incident"),
    ("Подозреваемый в убийстве ранен при погоне", "При погоне полицейский погиб.", None),
    ("Медведь убил туриста", "", "animal_event"),
    ("Мужчина убил хозяина собаки", "", None),
    ("Мужчина расстрелял машину соседа", "", "nonfatal_shooting"),
    ("Его обвиняют в покушении на убийство", "", "standalone_attempt"),
    ("Его обвиняют в покушении на убийство, жену он убил", "", None),
    ("В Токио убит бизнесмен", "", "excluded_country"),
    ("В Москве убит гражданин, прибывший из Индии", "", None),
    ("В Швеции мужчина изнасиловал туристку", "", "foreign_rape"),
    ("В Москве мужчина изнасиловал туристку", "", None),
    ("Мужчина изнасиловал туристку", "", None),
    ("В Швеции трое мужчин: двое изнасиловали туристку", "", None),
    ("В Швеции туристку изнасиловали и убили", "", None),
    ("Раскрыто убийство 2010 года", "", "stale_event"),
    ("Убийство мужчины, 1978 года рождения", "", None),
    ("Раскрыто убийство 2026 года", "", None),
    ("Раскрыто убийство двадцатилетней давности", "", "stale_event"),
    ("Убийцу сторожа нашли спустя полтора года", "", "stale_event"),
    ("Женщина убита 5 мая прошлого года", "", "stale_event"),
]

#: Title; admitted, reason of rejection, score, topics, strong topics, fragments that tell what was asked for.
ADMISSION = [
    ("Убит мужчина", True, None, 10, "убит", "убит", 0),
    ("Полиция задержала вора", False, "only contextual topics: задерж, полици", 2, "задерж,полици", "", 0),
    ("Погода на неделю", False, "no crime topics", 0, "", "", 0),
    ("Нападение на прохожего", False, "violent context without severe outcome: нападен", 1, "нападен", "", 0),
    ("После нападения прохожий погиб", True, "only contextual topics: нападен", 8, "нападен", "нападен + погиб", 0),
    ("Она просила соседа, чтобы он убил мужа", False, "requested killing is not a completed homicide", 0, "", "", 1),
    ("Врач назвал убийцу иммунитета", False, "figurative homicide language", 10, "убий", "убий", 0),
    ("Фильм про убийство", False, "excluded keyword", 10, "убий", "убий", 0),
    ("Убить время", False, "no crime topics", 0, "", "", 0),
    ("Переубийственный заголовок", False, "no crime topics", 0, "", "", 0),
    ("Полиция: следствие, арест, обвинение, розыск, убийство", True, "only contextual topics: арест, следств, полици, обвин, розыск", 13, "убий,арест,следств,полици,обвин,розыск", "убий", 0),
]


def judged(spark, sf_dir) -> DataFrame:
    rows = cases(spark, sf_dir, [(t, "", b) for t, b, _ in POLICY], "title string, description string, article_text string")
    return policy.judge(rows.withColumn("published_at", F.lit(AT)))


@query(f"SELECT doc_id, rule, rule IS NULL AS passed FROM {values([(r,) for _, _, r in POLICY], 'rule')}")
def policy_cascade(spark, sf_dir):
    """The editorial cascade on known cases (F9, F9a to F9m)."""
    return judged(spark, sf_dir).select("doc_id", F.col("policy_rejection").alias("rule"), F.col("policy_passed").alias("passed"))


@query(f"SELECT coalesce(rule, 'passed') AS rule, count(*) AS n FROM {values([(r,) for _, _, r in POLICY], 'rule')} GROUP BY 1")
def policy_counts(spark, sf_dir):
    """Rejections by rule."""
    return judged(spark, sf_dir).groupBy(F.coalesce("policy_rejection", F.lit("passed")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, admitted, reason, score, topics, strong, CAST(ignored AS INTEGER) AS ignored FROM {values([c[1:] for c in ADMISSION], 'admitted, reason, score, topics, strong, ignored')}")
def admission_cases(spark, sf_dir):
    """Admission by the Russian pack: stems, guards, masks, figurative and excluded words, derived topics, scores
    (F2 to F7, A1, P14)."""
    rows = cl.classify(cases(spark, sf_dir, [(c[0], "") for c in ADMISSION], "title string, description string"), RUSSIAN, scored=True)
    return rows.select("doc_id", "admitted", F.col("rejection_reason").alias("reason"), "score", F.array_join("matched_topics", ",").alias("topics"), F.array_join("strong_topics", ",").alias("strong"), F.size("ignored_fragments").alias("ignored"))


@query(f"SELECT doc_id, reason FROM {values([c[1:3] for c in ADMISSION], 'admitted, reason')} WHERE admitted AND doc_id % 2 = 0 ORDER BY doc_id LIMIT 20")
def selected_report(spark, sf_dir):
    """What is selected and why."""
    rows = cl.classify(cases(spark, sf_dir, [(c[0], "") for c in ADMISSION], "title string, description string"), RUSSIAN, scored=True)
    shown = cl.selected_report(rows.where(F.col("admitted") & (F.col("doc_id") % 2 == 0)), "doc_id")
    return shown.select("doc_id", F.col("rejection_reason").alias("reason")).orderBy("doc_id").limit(20)


@query(f"SELECT doc_id, place FROM {values([('казань',), ('северное',), ('',)], 'place')}")
def local_places(spark, sf_dir):
    """Places that a text names as such."""
    rows = cases(spark, sf_dir, [("Убийство в городе Казань",), ("Драка у села Северное",), ("Казань и Северное",)], "t string")
    return rows.select("doc_id", F.array_join(F.transform(tx.extract_all(F.col("t"), RUSSIAN.local_places[0], 1), F.lower), ",").alias("place"))


# ---------------------------------------------------------------- listings, feeds, pages


def page(adapter: str, body: Column) -> Column:
    return F.struct(F.lit(adapter).alias("adapter"), body.alias("html"))


@query("""WITH n AS (SELECT page_id AS i FROM pages)
SELECT 'vnru' AS adapter, i, 'Card ' || i AS title, 'https://www.site.ru/news-' || i || '/' AS url, 'p' || i AS description, CAST(NULL AS TIMESTAMP) AS published_at FROM n
UNION ALL SELECT 'vtomske', i, 'Томск ' || i, 'https://www.site.ru/news/' || i || '-a', '', NULL FROM n WHERE i % 2 = 0
UNION ALL SELECT 'amic', i, 'Барнаул ' || i, 'https://www.site.ru/news/x-' || i, '', TIMESTAMP '2026-09-05 09:00:00' FROM n
UNION ALL SELECT 'a42', i, 'T' || i, 'https://www.site.ru/lenta/news/' || i || '-x', '', NULL FROM n WHERE i % 3 <> 0
UNION ALL SELECT 'ngs', i, 'The longer title ' || i, 'https://www.site.ru/text/incidents/2026/09/20/' || i || '/', 'sub', TIMESTAMP '2026-09-20 00:00:00' FROM n
UNION ALL SELECT 'fontanka', i, 'B', 'https://www.site.ru/2026/09/20/' || i || '/', '', TIMESTAMP '2026-09-20 00:00:00' FROM n""")
def listing_adapters(spark, sf_dir):
    """Cards of listing pages by each adapter's spec: links, markers, categories, dates, rows of one url
    (S3 to S10, P3, P4, P7, F10, F11, J7, W3, D5)."""
    i = F.col("page_id").cast("string")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    bodies = [
        page("vnru", put('<article class="section_news_item"><div class="section_news_item_content_title"><a href="/news-', i, '/">Card  ', i, '</a></div><p class="section_news_item_content_preview">p', i, '</p></article><article class="section_news_item"><div class="section_news_item_content_title"><a href="https://other.ru/news-1/">x</a></div></article>')),
        page("vtomske", put('<a class="lenta_material" href="/news/', i, '-a"><p class="lenta_material_title">', F.when(F.col("page_id") % 2 == 0, "Томск").otherwise("Москва"), " ", i, "</p></a>")),
        page("amic", put('<div class="archive-news-item"><h2 class="title"><a href="/news/x-', i, '">Барнаул ', i, '</a></h2><span class="published_at">5 сентября 2026, 16:00<i>3</i></span></div>')),
        page("a42", put('<a class="card__link" href="/lenta/news/', i, '-x"><article class="card"><i class="card__category">', F.when(F.col("page_id") % 3 == 0, "Спорт").otherwise("Криминал"), '</i><b class="card__title">T', i, "</b></article></a>")),
        page("ngs", put(*[x for more in ('><img></a></div>', ' title="Short">x</a></div>') for x in ('<div><a href="/text/incidents/2026/09/20/', i, '/"', more)], '<div><a href="/text/incidents/2026/09/20/', i, '/" data-announcement-title="The longer title ', i, '">x</a><span>sub</span></div>')),
        page("fontanka", put(*[x for t in "AB" for x in (f'<div><div><div><a data-announcement-title="{t}" href="/2026/09/20/', i, '/">x</a></div></div></div>')])),
        page("unknown", put("<a href='/x'>x</a>")),
    ]
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*bodies)).alias("p"))
    name = F.concat("p.adapter", F.lit("|"), i)
    listed = read_listings(pages.select(name.alias("name"), F.lit("https://www.site.ru/list").alias("url"), "p.html", "p.adapter", F.when(F.col("p.adapter") != "amic", "UTC").alias("timezone"), F.lit(None).cast("string").alias("limit")), F.lit(AT))
    return listed.select(F.split("source", r"\|")[0].alias("adapter"), F.split("source", r"\|")[1].cast("long").alias("i"), "title", "url", "description", "published_at")


@query("SELECT page_id, e, CASE e WHEN 'a42' THEN 'one ' || page_id || chr(10) || chr(10) || 'two' WHEN 'mk' THEN 'first ' || page_id WHEN 'amic' THEN 'p ' || page_id || chr(10) || chr(10) || 'q' WHEN 'vn' THEN '' ELSE 'all' || chr(10) || chr(10) || 'p ' || page_id END AS text FROM pages, (VALUES ('a42'), ('mk'), ('amic'), ('vn'), ('other')) AS x(e)")
def article_extractors(spark, sf_dir):
    """Articles by their sites' extractors; never the page's surroundings where a container is missing."""
    i = F.col("page_id").cast("string")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pages = [
        ("a42", put('<article class="material"><h1>h</h1><div class="material__body" itemprop="articleBody"><p>no</p><div class="rte-block rte-text"><p>one  ', i, "</p><p>two</p></div></div></article>")),
        ("mk", put('<div class="article__body" itemprop="articleBody"><p>first ', i, "</p><p>Читайте также: x</p><p>last</p></div>")),
        ("amic", put('<div id="post"><h1>h</h1><section class="text"><p>p ', i, "</p><div><p>nested</p></div><blockquote>q</blockquote></section></div>")),
        ("vn", put("<p>chrome ", i, "</p>")),
        ("other", put("<p>all</p><div><p>p ", i, "</p></div>")),
    ]
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), h.alias("html")) for e, h in pages])).alias("p"))
    return rows.select("page_id", "p.e", article_text(F.col("p.html"), F.col("p.e")).alias("text"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://s.org/i/' || page_id || '.jpg' WHEN 1 THEN 'https://cdn.org/t.png' END AS image, CASE page_id % 3 WHEN 0 THEN 'https://s.org/x/y' ELSE 'https://s.org/' || page_id END AS resolved FROM pages")
def page_images(spark, sf_dir):
    """Main pictures of pages, and links resolved against a page."""
    i = F.col("page_id")
    html = F.when(i % 3 == 0, F.concat(F.lit('<meta property="og:image" content="/i/'), i.cast("string"), F.lit('.jpg"><meta name="twitter:image" content="no">'))).when(i % 3 == 1, '<meta name="twitter:image" content="https://cdn.org/t.png">').otherwise("<p>none</p>")
    href = F.when(i % 3 == 0, "y").otherwise(F.concat(F.lit("../"), i.cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", image_url(html, F.lit("https://s.org/a/b")).alias("image"), tx.absolute_url(F.lit("https://s.org/x/z"), href).alias("resolved"))


@query("SELECT CAST(event_id AS VARCHAR) AS title, 'http://x/' || event_id AS url, date_trunc('second', ts) AS published_at, 'bold ' || event_type || ' & more' AS description, source FROM events, (VALUES ('a'), ('b')) AS s(source)")
def rss_items(spark, sf_dir):
    """Items of RSS files, of two sources in their order."""
    e = F.format_string("<item><title>%s</title><link>http://x/%s</link><pubDate>Fri, %s GMT</pubDate><description>&lt;b&gt;bold&lt;/b&gt; %s &amp;amp; more</description></item>", F.col("event_id").cast("string"), F.col("event_id").cast("string"), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.col("event_type"))
    path = new_path(spark, "rss")
    feed_of = F.expr("event_id div 500")  # a feed is one file with one root
    whole = table(spark, sf_dir, "events").groupBy(feed_of.alias("feed")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(e), "\n"), F.lit("</channel></rss>")).alias("value"))
    whole.repartition("feed").write.partitionBy("feed").text(path)
    return feeds.union_in_order([feeds.read_rss(spark, path, s) for s in "ab"]).drop("source_ordinal")


@query("SELECT n_regionkey % 2 = 0 AS enabled, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) FILTER (n_nationkey % 5 = 4) AS unknown FROM nation GROUP BY 1")
def source_states(spark, sf_dir):
    """A catalogue of sources, which of them are active, and which have a type that nothing reads."""
    path = new_path(spark, "sources")
    kind = F.when(F.col("n_nationkey") % 5 == 4, "carrier pigeon").when(F.col("n_nationkey") % 2 == 0, "rss").otherwise("html")
    named = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), kind.alias("type"), F.when(F.col("n_regionkey") % 2 == 1, False).alias("enabled"))
    named.write.json(path)
    found = feeds.source_catalogue(spark, path, one_array=False)
    unread = feeds.unknown_types(found).select("name", F.lit(1).alias("unread"))
    return found.join(unread, "name", "left").groupBy("enabled").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count("unread").alias("unknown"))


@query("SELECT CAST(page_id AS VARCHAR) AS message_id, 'Text' || chr(10) || chr(10) || 'more' AS text, 'https://i/' || page_id || '.jpg' AS image_url, 'https://src/' || page_id AS source_url FROM pages")
def channel_posts(spark, sf_dir):
    """Posts of stored channel pages."""
    post = '<div class="tgme_widget_message" data-post="{0}/%s"><a class="tgme_widget_message_photo_wrap" style="background-image:url(\'{1}://i/%s.jpg\')"></a><div class="tgme_widget_message_text">Text<br><br><br><br>more<br>🔗 <a href="https://src/%s">Источник</a></div><time datetime="2026-09-01T10:00:00+00:00"></time></div>'
    i = F.col("page_id").cast("string")
    html = F.concat(*[F.format_string(post.format(c, s), i, i, i) for c, s in (("Chan", "https"), ("other", "https"), ("chan", "http"))])
    return feeds.read_channel(table(spark, sf_dir, "pages").select(html.alias("html")), "chan").drop("published_at")


# ---------------------------------------------------------------- histories, cards, intake


@query(f"WITH {PRINTED} SELECT url, title, source, len(tokens) AS tokens, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_at, CAST(1 + (ordinal % 2 = 0)::INT AS BIGINT) AS times FROM prints JOIN (SELECT ordinal, title, source FROM news) USING (ordinal)")
def history_round_trip(spark, sf_dir):
    """A history appended to twice, rewritten without its first half of repeats, and read strictly."""
    items, path = printed(spark, sf_dir), new_path(spark, "history")
    sinks.append_history(items, path)
    sinks.append_history(items.where("ordinal % 2 = 0"), path)
    sinks.rewrite_history(feeds.read_history(spark, path, strict=True), path)
    read = feeds.read_history(spark, path).groupBy("url", "title", "source", "published_at").agg(F.first(F.size("event_fingerprint.tokens")).cast("long").alias("tokens"), F.count(F.lit(1)).alias("times"))
    return read


@query("SELECT 'https://u/' || n_nationkey AS url FROM nation UNION ALL SELECT 'https://single/' || n_nationkey FROM nation UNION ALL SELECT 'https://bare/' || n_nationkey FROM nation")
def card_urls(spark, sf_dir):
    """Urls of sources in written cards, and in cards with single quotes or none."""
    path, key = new_path(spark, "cards"), F.col("n_nationkey").cast("string")
    own = table(spark, sf_dir, "nation")
    sinks.write_cards(own.select(key.alias("event_id"), F.col("n_name").alias("title"), F.concat(F.lit("https://u/"), key).alias("url"), F.lit("s").alias("source"), F.lit("2026-09-01T00:00:00Z").alias("published_at")), f"{path}/written", F.lit("2026-09-02"))
    other = F.concat(F.lit("---\nsources:\n  - name: x\n    url: 'https://single/"), key, F.lit("'\n  - name: y\n    url: https://bare/"), key, F.lit("\n---\nbody url: https://no/1\n"))
    own.select(other.alias("value")).write.option("lineSep", "\n").text(f"{path}/other")
    return feeds.card_urls(spark, path, "*")


@query(f"WITH {PRINTED} SELECT ordinal FROM prints WHERE ordinal % 3 <> 0")
def unpublished_urls(spark, sf_dir):
    """Items that a history without fingerprints does not know by url."""
    items = news(spark, sf_dir)  # without fingerprints, as none are compared
    past = items.where("ordinal % 3 = 0").select("url", "published_at", F.lit(None).cast(ev.FINGERPRINT).alias("event_fingerprint"))
    return pairs.unpublished(items, past).select("ordinal")


_DUPLICATE = """len(list_intersect(a.topics, b.topics)) > 0 AND abs(epoch(a.published_at) - epoch(b.published_at)) <= 129600 AND least(len(a.tokens), len(b.tokens)) > 0
 AND len(list_intersect(a.tokens, b.tokens)) >= 5 AND len(list_intersect(a.tokens, b.tokens)) / least(len(a.tokens), len(b.tokens)) >= 0.45
 AND (len(list_intersect(a.places, b.places)) > 0 OR (len(list_intersect(a.tokens, b.tokens)) >= 7 AND len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) >= 0.20))"""


@query(f"WITH {PRINTED} SELECT ordinal FROM prints a WHERE ordinal % 2 = 0 AND NOT EXISTS (SELECT 1 FROM prints b WHERE b.ordinal % 2 = 1 AND {_DUPLICATE})")
def unpublished_events(spark, sf_dir):
    """Items whose event a history of other urls does not tell."""
    items = printed(spark, sf_dir)
    past = ev.history_rows(items.where("ordinal % 2 = 1"))
    return pairs.unpublished(items.where("ordinal % 2 = 0"), past, ()).select("ordinal")


_SCAN = 60


@query(f"""WITH h AS (SELECT page_id - (SELECT min(page_id) FROM pages) AS position, page_id FROM pages), s AS (SELECT * FROM h WHERE position BETWEEN 7 AND {6 + _SCAN}),
g AS (SELECT position, CASE WHEN page_id % 5 = 0 THEN 'existing_url' WHEN page_id % 7 = 0 THEN 'not_current' WHEN page_id % 3 = 0 THEN 'not_several' END AS gate, page_id % 11 AS key FROM s),
o AS (SELECT *, gate IS NULL AND key <> 4 AND NOT EXISTS (SELECT 1 FROM g e WHERE e.key = g.key AND e.position < g.position AND (e.gate IS NULL OR e.gate = 'existing_url')) AS output FROM g)
SELECT position, gate, output FROM o QUALIFY coalesce(sum(output::INT) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 6""")
def intake_scan(spark, sf_dir):
    """One run of the importer: bounded scan behind the cursor, gates in order, one card for an event, the prefix that
    fills the limit, and the state to go on from, written and read again (I1 to I8, F12 to F15, J8, W4, W5, U5)."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    first = pages.agg(F.min("page_id")).first()[0] or 0
    i = F.col("page_id")
    event = F.struct(F.array(F.lit("homicide")).alias("topics"), F.array(F.concat(F.lit("token"), (i % 11).cast("string"))).alias("tokens"), F.array(F.lit("place")).alias("locations"))
    title = F.when(i % 7 == 0, "Итоги дня: убиты трое").when(i % 3 == 0, "Убит мужчина").otherwise("Убиты трое мужчин, два человека")
    history = materialize(pages.select((i - first).alias("position"), title.alias("title"), F.concat(F.lit("https://h/"), i.cast("string")).alias("url"), F.lit("2026-09-20T10:00:00+00:00").alias("published_at"), event.alias("event_fingerprint")), "history")
    existing = history.where(F.pmod(F.col("position") + first, F.lit(5)) == 0).select("url")
    start = intake.bootstrap(history.where("position < 7"))
    known = history.where(F.pmod(F.col("position") + first, F.lit(11)) == 4).select(intake.event_key(F.col("event_fingerprint")).alias("key")).limit(1).collect()  # one row
    path = new_path(spark, "state")
    intake.save_state(spark, intake.replace(start, keys=tuple(r["key"] for r in known)), path)
    none = spark.createDataFrame([], "candidate_id string, url string")
    rows, _ = intake.scan(history, intake.load_state(spark, path), existing, none, limit=6, scan_limit=_SCAN, now=F.lit(AT), days=7, current_only=True, several_only=True)
    return rows.select("position", "gate", "output")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'no title' WHEN 1 THEN 'no url' WHEN 2 THEN 'bad url' END AS problem FROM pages")
def invalid_rows(spark, sf_dir):
    """Rows of a history that can't be used."""
    k = F.col("page_id") % 4
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(k == 0, "  ").otherwise("t").alias("title"), F.when(k == 1, "").when(k == 2, "ftp://x").otherwise("https://x/1").alias("url"))
    return rows.select("page_id", intake.invalid().alias("problem"))


# ---------------------------------------------------------------- dates, labels, cards of the site

_MONTHS = "['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря']"


@query(f"SELECT o_orderkey, date_trunc('day', o_orderdate) AS found, day(o_orderdate) || ' ' || {_MONTHS}[month(o_orderdate)] || ' ' || year(o_orderdate) AS words, day(o_orderdate) || ' ' || {_MONTHS}[month(o_orderdate)] || ' ' || year(o_orderdate) || ' г.' AS label FROM orders")
def dates_of_urls(spark, sf_dir):
    """Dates found in urls, and dates in words."""
    url = F.concat(F.lit("https://s/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit("/"))
    return table(spark, sf_dir, "orders").select("o_orderkey", url_date(url, r"^/(\d{4})/(\d{2})/(\d{2})/\d+/?$", F.lit("UTC")).alias("found"), long_date(F.col("o_orderdate")).alias("words"), event_date_label(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("label"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'Вынесен приговор' WHEN 1 THEN 'Дело рассматривается в суде' END AS status, CASE WHEN n_regionkey > 1 THEN 'status' ELSE '' END AS problems, n_name || ', ' || n_regionkey AS place, CASE WHEN n_nationkey % 2 = 0 THEN 'Named' ELSE 'site.org' END AS source, CASE WHEN n_nationkey < 999 THEN lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0') END AS number, CAST(n_nationkey % 4 AS INTEGER) AS n_updates FROM nation")
def event_cards(spark, sf_dir):
    """What a card shows: labels, problems of its schema, place, source's name, number and counts."""
    n = F.col("n_nationkey")
    cards = table(spark, sf_dir, "nation").select(
        n, "n_name", F.when(F.col("n_regionkey") == 0, "verdict").when(F.col("n_regionkey") == 1, "trial").otherwise("odd").alias("status"), F.lit("not_assessed").alias("legal_status"), F.lit("A title of ten").alias("title"), F.lit("s" * 40).alias("summary"), F.lit("2026-09").alias("event_date"), F.array(F.lit("t")).alias("topics"),
        F.array(F.struct(F.when(n % 2 == 0, "https://www.site.org/1").otherwise("https://x/2").alias("url"), F.lit("Named").alias("name"))).alias("sources"), F.array_repeat(F.lit("u"), (n % 4).cast("int")).alias("updates"), F.col("n_regionkey").cast("string").alias("region"),
    )
    return cards.select("n_nationkey", feed.label(F.col("status"), feed.EVENT_STATUS).alias("status"), F.array_join(feed.event_problems(), ",").alias("problems"), feed.place_line(F.col("n_name"), F.col("region")).alias("place"), feed.source_name(F.col("sources"), F.lit("https://www.site.org/1")).alias("source"), feed.registry_number(n).alias("number"), F.size("updates").alias("n_updates"))


@query(r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10))) AS digest FROM documents")
def spaced_texts(spark, sf_dir):
    """White space of posts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(spaced(F.col("text"))).alias("digest"))
