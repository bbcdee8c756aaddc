"""Structured Streaming: items that arrive as files, judged, freed of repeated urls and appended to the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirelens.functions.rulepacks import RulePack
from wirelens.operators.classify import classify

ITEM = "ordinal long, title string, description string, article_text string, url string, source string, published_at timestamp"


def item_stream(spark: SparkSession, path: str, lookback: str = "3 days", files: int = 100) -> DataFrame:
    """Items of JSON files as they arrive; those later than lookback behind the newest are late and left out."""
    items = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files).json(path)
    return items.withWatermark("published_at", lookback)


def first_by_url(items: DataFrame) -> DataFrame:
    """The first arrival of each url; state is held no longer than the watermark needs it."""
    return items.dropDuplicatesWithinWatermark(["url"])


def admitted(items: DataFrame, pack: RulePack, least: int) -> DataFrame:
    """Items that the rule pack admits with at least this score."""
    return classify(items, pack, scored=True).where(F.col("admitted") & (F.col("score") >= least))


def counts_by_window(items: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Items of each source in windows of event time; a window is given out when the watermark has passed it."""
    grouped = items.groupBy(F.window("published_at", width, slide or width).alias("w"), "source")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "source", "n")


def sessions(items: DataFrame, gap: str = "30 minutes", at: str = "published_at", key: str = "source") -> DataFrame:
    """start, end, key and n: runs of a key's items that lie less than gap apart. Of a stream, a session is given out when
    the watermark has passed its end; state is that of open sessions."""
    grouped = items.groupBy(F.session_window(at, gap).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def near_published(items: DataFrame, published: DataFrame, key: str, at: str = "published_at", lookback: str = "3 days", hours: int = 36) -> DataFrame:
    """Items with those published rows of an equal key that lie within so many hours, as columns of a prefix `old_`.

    Both may be streams: both get watermarks, and the bound on time lets either side's rows go when none can match.
    """
    old = published.select(*[F.col(c).alias(f"old_{c}") for c in published.columns])
    if items.isStreaming:
        items, old = items.withWatermark(at, lookback), old.withWatermark(f"old_{at}", lookback)
    span = F.expr(f"INTERVAL {hours} HOURS")
    near = (F.col(key) == F.col(f"old_{key}")) & (F.col(f"old_{at}") >= F.col(at) - span) & (F.col(f"old_{at}") <= F.col(at) + span)
    return items.join(old, near)


def append_history(items: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append rows to a history of Parquet files, each exactly once: the checkpoint holds what is done."""
    writer = items.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
