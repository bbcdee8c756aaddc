"""Listing pages: cards by specs, one for each adapter; links, places and dates are judged by DataFrame functions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.functions.dates import publication_date, url_date
from wirelens.functions.text import fold, host, path, squeeze
from wirelens.sources.dom import Node, of_pages, parsed

LIMIT = 40


@dataclass(frozen=True)
class Listing:
    """How a site's listing shows its articles. Selectors are looked up inside a card, or on the page for page_date."""

    card: str
    path: str  # what the path of an article's url is like
    zone: str
    link: str | None = None  # None: the card is the link
    title: str | None = None  # None: the link's text
    title_attributes: tuple[str, ...] = ()
    date: str | None = None
    date_attribute: str | None = None  # of an element near the link, in at most date_levels of its ancestors
    date_levels: int = 0
    date_pattern: str | None = None  # what of the text of that ancestor is the date
    own_text: bool = False  # only text directly in the date's element
    page_date: str | None = None  # the day stands on the page, and holds for cards of class page_date_class
    page_date_class: str = ""
    description: str | None = None
    subtitle: bool = False  # the span after a link with a title attribute
    needs: str | None = None
    category: str | None = None
    categories: tuple[str, ...] = ()
    markers: tuple[str, ...] = ()
    url_date: str | None = None
    merge: str | None = None  # rows of one url: "join" their best fields, or take the "last"


#: Parts of the names of places that a region's titles hold.
TOMSK = ("томск", "томич", "северск", "стрежев", "колпашев", "асино")
ALTAI = ("алтай", "барнаул", "бийск", "рубцовск", "белокурих", "заринск", "новоалтайск", "яров", "славгород")

_INCIDENT = r"^/text/incidents/(\d{4})/(\d{2})/(\d{2})/\d+/?$"
_DAY = r"^/(\d{4})/(\d{2})/(\d{2})/\d+/?$"


def _platform(zone: str) -> Listing:
    return Listing("a[href]", _INCIDENT, zone, title_attributes=("data-announcement-title", "title"), date_attribute="data-announcement-date", date_levels=5, subtitle=True, url_date=_INCIDENT, merge="join")


#: Specs by adapter.
ADAPTERS: dict[str, Listing] = {
    "ngs": _platform("Asia/Novosibirsk"),
    "116ru": _platform("Europe/Moscow"),
    "e1ru": _platform("Asia/Yekaterinburg"),
    "vnru": Listing("article.section_news_item", r"^/news-.*/$", "Asia/Novosibirsk", link=".section_news_item_content_title a[href]", date=".section_news_item_date", description=".section_news_item_content_preview"),
    "vtomske": Listing("a.lenta_material[href]", r"^/news/\d+-[^/]+/?$", "Asia/Tomsk", title=".lenta_material_title", date=".lenta_material_info > div", page_date=".header_today", page_date_class="latest", markers=TOMSK),
    "amic": Listing(".archive-news-item", r"^/news/[^/]+-\d+/?$", "Asia/Barnaul", link="h2.title a[href]", date=".published_at", own_text=True, markers=ALTAI),
    "a42": Listing("a.card__link[href]", r"^/lenta/news/\d+-[^/]+/?$", "Asia/Novokuznetsk", title=".card__title", date=".card__date", description=".card__description, .card__preview", needs="article.card", category=".card__category", categories=("происшествия", "криминал")),
    "fontanka": Listing("a[data-announcement-title][href]", _DAY, "Europe/Moscow", title_attributes=("data-announcement-title",), date_levels=3, date_pattern=r"\d{1,2}\s+[А-Яа-яЁё]+,\s+\d{4},\s+\d{1,2}:\d{2}", url_date=_DAY, merge="last"),
}

CARD = pa.struct([("title", pa.string()), ("url", pa.string()), ("date_text", pa.string()), ("description", pa.string())])


def register_adapter(name: str, spec: Listing) -> None:
    ADAPTERS[name] = spec


def _text(node: Node | None) -> str:
    return node.text() if node else ""


def _date_text(page: Node, card: Node, link: Node, spec: Listing) -> str:
    if spec.page_date:
        if spec.page_date_class not in (card.attributes.get("class") or "").split():
            return ""
        return f"{_text(page.select(spec.page_date)).split(',', 1)[0]} в {_text(card.select(spec.date))}"
    if spec.date:
        node = card.select(spec.date)
        return (node.first_string() if spec.own_text else node.text()) if node else ""
    if not spec.date_levels or spec.date_attribute and not link.attributes.get(spec.title_attributes[0]):
        return ""
    node: Node | None = link
    for _ in range(spec.date_levels):
        node = node.parent
        if node is None:
            return ""
        if spec.date_attribute and (found := node.select(f"[{spec.date_attribute}]")):
            return found.attributes.get(spec.date_attribute) or ""
    match = re.search(spec.date_pattern, node.text()) if spec.date_pattern else None
    return match[0] if match else ""


def _subtitle(link: Node) -> str:
    own = link.parent.children if link.parent else []
    after = own[own.index(link) + 1 :] if link in own else []
    return next((n.text() for n in after if isinstance(n, Node) and n.tag == "span"), "")


def cards(html: str | None, spec: Listing | None) -> list[dict]:
    """title, href, date_text and description of a listing's cards, in order; none for an unknown adapter."""
    if spec is None:
        return []
    found = []
    with parsed(html or "") as page:
        for card in page.select_all(spec.card):
            link = card.select(spec.link) if spec.link else card
            if link is None or spec.needs and card.select(spec.needs) is None:
                continue
            if spec.category and _text(card.select(spec.category)).casefold() not in spec.categories:
                continue
            named = next((v for a in spec.title_attributes if (v := link.attributes.get(a))), None)
            title = " ".join((named if named else _text(card.select(spec.title)) if spec.title else link.text()).split())
            first = spec.title_attributes[0] if spec.title_attributes else ""
            description = _subtitle(link) if spec.subtitle and link.attributes.get(first) else _text(card.select(spec.description)) if spec.description else ""
            if title:
                found.append({"title": title, "href": link.attributes.get("href") or "", "date_text": _date_text(page, card, link, spec), "description": description})
    return found


def read_listings(pages: DataFrame, now) -> DataFrame:
    """title, url, published_at, description, source and source_place of the articles on listing pages.

    pages: name, url, html, adapter, timezone and limit (as text; 40 if it is no number, 0 if it is negative) of each
    source. A null page and an unknown adapter give no rows. now: the present, for relative dates.
    """
    specs = dict(ADAPTERS)

    def convert(htmls: pa.Array, names: pa.Array, urls: pa.Array) -> pa.Array:
        found = lambda h, n, u: [{**card, "url": urljoin(u or "", card["href"])} for card in cards(h, specs.get(n))]
        return of_pages(found, pa.list_(CARD), htmls, names, urls)

    # urls are made here too: each function more is a Python worker more for every task
    kind = "array<struct<title:string,url:string,date_text:string,description:string>>"
    shown = pages.withColumn("card", F.arrow_udf(convert, kind)("html", "adapter", "url")).select("name", F.col("url").alias("page_url"), "adapter", "timezone", "limit", F.posexplode("card").alias("place", "card"))
    rows = shown.select("name", "page_url", "adapter", "timezone", "limit", "place", "card.*")

    def by_adapter(value):
        out = F.lit(None)
        for name, spec in specs.items():
            out = F.when(F.col("adapter") == name, value(spec)).otherwise(out)
        return out

    rows = rows.withColumn("zone", F.coalesce("timezone", by_adapter(lambda s: F.lit(s.zone))))
    zone = F.col("zone")
    local = by_adapter(lambda s: F.exists(F.array(*map(F.lit, s.markers)), lambda m: F.contains(fold(F.col("title")), m)) if s.markers else F.lit(True))
    direct = by_adapter(lambda s: path(F.col("url")).rlike(s.path)) & (host(F.col("url")) == host(F.col("page_url")))
    page_date = publication_date(F.col("date_text"), zone, now)
    from_url = by_adapter(lambda s: url_date(F.col("url"), s.url_date, zone) if s.url_date else F.lit(None).cast("timestamp"))
    dated = rows.where(direct & local).withColumns({"page_date": page_date, "from_url": from_url, "description": squeeze(F.col("description"))})

    # rows of one url: the longest title (the first of equal ones), the first description, the last date; or the last row
    mode = by_adapter(lambda s: F.lit(s.merge))
    group = F.when(mode.isNull(), F.col("place"))
    last = lambda c: F.max_by(c, "place")
    joined = dated.withColumns({"mode": mode, "group": group}).groupBy("name", "adapter", "limit", "url", "group").agg(
        F.min("place").alias("place"),
        F.first("mode").alias("mode"),
        F.when(F.first("mode") == "last", last("title")).otherwise(F.max_by("title", F.struct(F.length("title"), -F.col("place")))).alias("title"),
        F.when(F.first("mode") == "last", last("description")).otherwise(F.coalesce(F.min_by("description", F.when(F.col("description") != "", F.col("place"))), F.lit(""))).alias("description"),
        F.when(F.first("mode") == "last", last(F.coalesce("page_date", "from_url"))).otherwise(F.coalesce(F.max_by("page_date", F.when(F.col("page_date").isNotNull(), F.col("place"))), F.min("from_url"))).alias("published_at"),
    )
    newest = F.when(F.col("mode") == "join", F.col("published_at"))
    order = Window.partitionBy("name").orderBy(newest.desc_nulls_last(), "place")
    most = F.greatest(F.lit(0), F.coalesce(F.col("limit").try_cast("int"), F.lit(LIMIT)))
    ranked = joined.withColumn("source_place", F.row_number().over(order)).where(F.col("source_place") <= most)
    return ranked.select("title", "url", "published_at", "description", F.col("name").alias("source"), "source_place")
