"""Feed posts and site pages: upserts, tails, publishable events, related events, the sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.functions.text import escape_xml, host

#: Labels of an event's and a person's status.
EVENT_STATUS = {
    "reported": "Появилось первое сообщение", "investigating": "Идёт проверка или расследование", "suspect_detained": "Подозреваемый задержан", "charged": "Предъявлено обвинение",
    "trial": "Дело рассматривается в суде", "verdict": "Вынесен приговор", "closed": "Событие закрыто для обновлений",
}
LEGAL_STATUS = {
    "no_person_named": "Конкретное лицо не названо", "suspect": "Лицо упоминается как подозреваемое", "accused": "Лицу предъявлено обвинение",
    "defendant": "Дело в отношении подсудимого рассматривает суд", "convicted": "Лицо признано виновным судом", "acquitted": "Лицо оправдано судом", "case_closed": "Дело прекращено",
    "not_assessed": "Статус указан в первоисточнике",
}


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Posts by message_id with action: new ones are inserted; of known ones only a newly found source link, with the
    text, is taken over; the rest stays as it is. Both have message_id, text, published_at, image_url, source_url."""
    fields = ["text", "published_at", "image_url", "source_url"]
    old = existing.select("message_id", F.lit(True).alias("_old"), *[F.col(f).alias(f"_old_{f}") for f in fields])
    both = old.join(new.select("message_id", F.lit(True).alias("_new"), *fields), "message_id", "full")
    link = F.col("_new") & F.coalesce(F.col("source_url") != "", F.lit(False)) & ~F.col("source_url").eqNullSafe(F.col("_old_source_url"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.coalesce(link, F.lit(False)), "link").otherwise("keep")
    told = both.withColumn("action", action)
    pick = lambda f: F.when(F.col("action") == "insert", F.col(f)).when((F.col("action") == "link") & F.lit(f in ("text", "source_url")), F.col(f)).otherwise(F.col(f"_old_{f}"))
    return told.select("message_id", *[pick(f).alias(f) for f in fields], "action")


def tail(posts: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The last posts of each key."""
    return posts.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= limit).drop("_n")


def publishable() -> Column:
    """Section, state, sources, summary, demo and updates of an event let it be shown."""
    ready = (F.col("section") == "crime") & (F.col("publication_status") == "ready") & (F.size("sources") > 0) & (F.trim("summary") != "")
    return F.coalesce(ready & (F.coalesce("demo", F.lit(False)) | (F.size("updates") > 0)), F.lit(False))


def event_problems() -> Column:
    """The fields of an event card that break its schema."""
    text = lambda f, n: F.coalesce(F.length(F.trim(f)), F.lit(0)) < n
    bad = {
        "title": text("title", 10),
        "summary": text("summary", 40),
        "event_date": ~F.coalesce(F.col("event_date").rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), F.lit(False)),
        "status": ~F.coalesce(F.col("status").isin(*EVENT_STATUS), F.lit(False)),
        "legal_status": ~F.coalesce(F.col("legal_status").isin(*LEGAL_STATUS), F.lit(False)),
        "topics": F.coalesce(F.size("topics"), F.lit(0)) < 1,
        "sources": F.coalesce(F.size("sources"), F.lit(0)) < 1,
    }
    return F.filter(F.array(*[F.when(c, F.lit(f)) for f, c in bad.items()]), lambda f: f.isNotNull())


def place_line(*parts: Column) -> Column:
    """Parts of a place in one line."""
    return F.concat_ws(", ", *parts)


def source_name(sources: Column, url: Column) -> Column:
    """The name under which the sources (url, name; the last of equal urls) list a url, else its host."""
    named = F.element_at(F.filter(sources, lambda s: s["url"] == url)["name"], F.lit(-1))
    return F.coalesce(F.when(F.exists(sources, lambda s: s["url"] == url), named), host(url))


def registry_number(index: Column) -> Column:
    """A row's place from 0 as a number from 1 of three digits at least."""
    number = (index + 1).cast("string")
    return F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))


def label(value: Column, labels: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), value)


def related(events: DataFrame, id_: str = "event_id", ids: str = "related_events", field: str = "title") -> DataFrame:
    """Events with the fields of those they name, in the order named; unknown ones are left out."""
    named = events.select(id_, F.posexplode(ids).alias("pos", "other"))
    found = named.join(events.select(F.col(id_).alias("other"), F.col(field).alias("value")), "other")
    lists = found.groupBy(id_).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("related"))
    return events.join(lists, id_, "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def sitemap_rows(static: DataFrame, events: DataFrame, site: str) -> DataFrame:
    """url elements of the static pages (path, changefreq, priority) and of the publishable events that aren't demos."""
    own = events.where(publishable() & ~F.coalesce("demo", F.lit(False))).select(F.concat(F.lit("/crime/"), F.col("event_id"), F.lit("/")).alias("path"), F.lit("weekly").alias("changefreq"), F.lit("0.8").alias("priority"), "lastmod")
    pages = static.unionByName(own, allowMissingColumns=True)
    last = F.coalesce(F.concat(F.lit("\n    <lastmod>"), F.col("lastmod"), F.lit("</lastmod>")), F.lit(""))
    loc = escape_xml(F.concat(F.lit(site.rstrip("/")), F.col("path")))
    return pages.withColumn("xml", F.concat(F.lit("  <url>\n    <loc>"), loc, F.lit("</loc>"), last, F.lit("\n    <changefreq>"), F.col("changefreq"), F.lit("</changefreq>\n    <priority>"), F.col("priority"), F.lit("</priority>\n  </url>")))
