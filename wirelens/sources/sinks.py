"""Sinks: history, event cards, the sitemap, and the outcome of publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.operators.events import history_rows
from wirelens.operators.feed import sitemap_rows

#: The sentences of a card.
SUMMARY = ("Источник «", "» опубликовал сообщение: «", "». В карточке сохранены дата публикации и прямая ссылка на исходный материал.")


def append_history(items: DataFrame, path: str) -> None:
    """Add published items to a history of JSON lines, without their texts."""
    history_rows(items).write.mode("append").json(path)


def rewrite_history(rows: DataFrame, path: str) -> None:
    """Put these rows in the place of a history, which they may have been read from.

    Rows are written beside the history, which is then moved away and replaced: until then it stays as it was, and a
    failure between the two moves leaves it under `<path>.before`. Where readers must never meet that gap, keep the
    history as a VersionedTable.
    """
    spark = rows.sparkSession
    whole, aside, before = path.rstrip("/"), f"{path.rstrip('/')}.next-{uuid.uuid4().hex}", f"{path.rstrip('/')}.before"
    rows.write.json(aside)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = at(whole).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at(whole)):
        files.delete(at(before), True)
        if not files.rename(at(whole), at(before)):
            raise OSError(f"{whole} cannot be moved")
    if not files.rename(at(aside), at(whole)):
        raise OSError(f"{aside} cannot be moved to {whole}")
    files.delete(at(before), True)


def quoted(value: Column) -> Column:
    """A scalar as a JSON string, which front matter takes too."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def card_text(now: Column) -> Column:
    """The card of a row of event_id, title, url, source and published_at (ISO text): front matter and a body."""
    source = F.trim(F.when(F.length("source") > 0, F.col("source")).otherwise(F.coalesce(F.try_parse_url(F.col("url"), F.lit("AUTHORITY")), F.lit(""))))
    title, day, url = F.trim("title"), F.substring("published_at", 1, 10), F.trim("url")
    summary = F.concat(F.lit(SUMMARY[0]), source, F.lit(SUMMARY[1]), title, F.lit(SUMMARY[2]))
    lines = [
        ("---", None), ("event_id: ", quoted(F.col("event_id"))), ('section: "crime"', None), ('publication_status: "ready"', None), ("title: ", quoted(title)), ("summary: ", quoted(summary)),
        ("event_date: ", quoted(day)), ('date_basis: "source_publication"', None), ('status: "reported"', None), ('legal_status: "not_assessed"', None), ("created_at: ", quoted(now)), ("updated_at: ", quoted(now)),
        ("sources:", None), ("  - name: ", quoted(source)), ("    url: ", quoted(url)), ("    published_at: ", quoted(F.trim("published_at"))), ("related_events: []", None), ("demo: false", None), ("---", None), ("", None), ("", summary),
    ]
    return F.array_join(F.array(*[F.lit(head) if tail is None else F.concat(F.lit(head), tail) for head, tail in lines]), "\n")


def write_cards(events: DataFrame, path: str, now: Column) -> None:
    """Cards below a path, a folder for each event_id: written again, a card replaces itself."""
    done = events.select("event_id", card_text(now).alias("value"))
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("event_id").text(path)


def write_sitemap(static: DataFrame, events: DataFrame, site: str, path: str) -> None:
    """url elements as lines; whoever serves them puts the head and the foot around them."""
    sitemap_rows(static, events, site).select("xml").write.mode("overwrite").text(path)


def publish_steps(outcomes: dict[str, str]) -> tuple[list[str], bool]:
    """The steps taken for one item, given what each would bring (ok, uncertain or failed), and whether it is published.

    A picture by address, then as a file, then the banner, then text alone; a success or an uncertain outcome ends it,
    and only a success is written to the history.
    """
    taken = []
    for step in ("photo", "file", "banner", "text"):
        if step in outcomes:
            taken.append(step)
            if outcomes[step] in ("ok", "uncertain"):
                return taken, outcomes[step] == "ok"
    return taken, False
