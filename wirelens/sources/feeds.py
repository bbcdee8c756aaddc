"""Feeds: the catalogue of sources, RSS files, stored channel pages, histories and cards."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.functions.dates import rfc822
from wirelens.functions.storage import materialize
from wirelens.functions.text import clean_description
from wirelens.sources.dom import PAGES, Node, parsed

SOURCE = "name string, type string, url string, adapter string, timezone string, extractor string, `limit` string, enabled boolean"
RSS_ITEM = "title string, link string, description string, pubDate string"
HISTORY = "title string, url string, published_at string, source string, event_fingerprint struct<topics:array<string>,tokens:array<string>,locations:array<string>,lead_tokens:array<string>,local_locations:array<string>>"
POST = "message_id string, text string, published_at string, image_url string, source_url string"


def source_catalogue(spark: SparkSession, path: str, one_array: bool = True) -> DataFrame:
    """Sources of a JSON catalogue (an array, or lines); one that says nothing about it is enabled."""
    return spark.read.schema(SOURCE).json(path, multiLine=one_array).withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def unknown_types(sources: DataFrame, read: tuple[str, ...] = ("rss", "html")) -> DataFrame:
    """Sources of a type that no reader takes, with a warning; they bring no rows."""
    warning = F.concat(F.lit("unknown source type: "), F.coalesce("type", F.lit("none")))
    return sources.where(~F.coalesce(F.col("type").isin(*read), F.lit(False))).withColumn("warning", warning)


def source_counts(sources: DataFrame) -> DataFrame:
    on = F.coalesce("enabled", F.lit(True))
    return sources.agg(F.count_if(on).alias("active"), F.count_if(~on).alias("disabled"))


def read_rss(spark: SparkSession, path: str, source: str) -> DataFrame:
    """title, url, published_at, description and source of the items of RSS files; missing texts are empty.

    Files are split by item by Spark's own XML reader, so a long feed is read by many tasks.
    """
    text = lambda name: F.coalesce(name, F.lit(""))
    items = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    return items.select(text("title").alias("title"), text("link").alias("url"), rfc822(text("pubDate")).alias("published_at"), clean_description(text("description"), every_entity=True).alias("description"), F.lit(source).alias("source"))


def union_in_order(parts: list[DataFrame]) -> DataFrame:
    """All rows with source_ordinal, the place of their part."""
    whole = None
    for n, part in enumerate(parts):
        own = part.withColumn("source_ordinal", F.lit(n))
        whole = own if whole is None else whole.unionByName(own, allowMissingColumns=True)
    return whole


def read_history(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The published items, of JSON lines or of one JSON array. A missing or broken history is empty; if strict it is an
    error at once."""
    reader = spark.read.schema(HISTORY).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    try:
        first = spark.read.text(path).where(F.trim("value") != "").first()
        rows = reader.json(path, multiLine=first is not None and first["value"].lstrip().startswith("["))
    except AnalysisException:
        if strict:
            raise
        return spark.createDataFrame([], HISTORY)
    return materialize(rows, "history") if strict else rows


def read_cards(spark: SparkSession, path: str, files: str = "*.md*") -> DataFrame:
    """Cards of text files below a path: fields (the front matter's simple values by name) and body."""
    cards = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(path, wholetext=True)
    front = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---", 1)
    lines = F.filter(F.split(front, "\n"), lambda line: line.rlike(r"^\w+:\s*\S"))
    pairs = F.transform(lines, lambda line: F.struct(F.regexp_extract(line, r"^(\w+):", 1).alias("key"), F.regexp_replace(line, r"^\w+:\s*[\"']?|[\"']?\s*$", "").alias("value")))
    return cards.select(F.map_from_entries(F.array_distinct(pairs)).alias("fields"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n*", "").alias("body"))


def read_json_cards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cards of JSON files, one to a file, below a path."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path, multiLine=True)


def card_urls(spark: SparkSession, path: str, files: str = "*.md*") -> DataFrame:
    """Distinct http(s) urls in the cards (text files with front matter) below a path, quoted either way or not at all."""
    cards = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(path)
    url = F.regexp_extract("value", r"^\s*(?:- )?url:\s*[\"']?(https?://[^\"'\s]+)", 1)
    return cards.select(url.alias("url")).where("url <> ''").distinct()


#: Words of a link to the source, and where a post's picture is.
SOURCE_WORDS = ("источник", "читать источник")
_PICTURE = re.compile(r"background-image\s*:\s*url\(['\"]?([^'\")]+)")
_SOURCE_LINE = re.compile(r"(?:^|\n)\s*🔗?\s*(?:читать\s+)?источник\s*(?=\n|$)", re.IGNORECASE)


def _written(node: Node) -> str:
    """Text with line breaks."""
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else _written(c) for c in node.children)


def channel_posts(html: str | None, channel: str) -> Iterator[dict]:
    """Posts of a stored channel page: those of the channel with a number, a text, a picture and a date."""
    with parsed(html or "") as page:
        for message in page.select_all("div.tgme_widget_message"):
            owner, _, number = (message.attributes.get("data-post") or "").partition("/")
            body, time = message.select("div.tgme_widget_message_text"), message.select("time[datetime]")
            wrap = message.select(".tgme_widget_message_photo_wrap")
            picture = _PICTURE.search(wrap.attributes.get("style") or "") if wrap else None
            link = next((a.attributes["href"] for a in (body.select_all("a[href]") if body else []) if _written(a).strip().casefold() in SOURCE_WORDS and re.match("https?://", a.attributes["href"] or "")), None)
            text = re.sub(r"\n{3,}", "\n\n", _written(body).strip()) if body else ""
            if link:
                text = re.sub(r"\n{3,}", "\n\n", _SOURCE_LINE.sub("", text)).strip()
            at = (time.attributes["datetime"] or "").strip() if time else ""
            if owner.casefold() == channel.casefold() and number.isdigit() and text and picture and picture[1].startswith("https://") and at:
                yield {"message_id": number, "text": text, "published_at": at, "image_url": picture[1], "source_url": link}


def read_channel(pages: DataFrame, channel: str) -> DataFrame:
    """POST of the posts on stored pages (column html)."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(f.split()[0], pa.string()) for f in POST.split(", ")])
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                if found := [p for html in batch.column(0).slice(at, PAGES).to_pylist() for p in channel_posts(html, channel)]:
                    yield pa.RecordBatch.from_pylist(found, kind)

    return pages.select("html").mapInArrow(convert, POST)
