"""Upserts and intake as streams: each micro-batch is applied once, however often it is delivered."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirelens.functions.rulepacks import RulePack
from wirelens.functions.storage import materialize
from wirelens.operators.duplicates import remove_duplicates
from wirelens.operators.events import FINGERPRINT, fingerprint, history_rows
from wirelens.operators.feed import upsert
from wirelens.operators.pairs import unpublished
from wirelens.sources.tables import Version, VersionedTable

POSTS = "message_id long, text string, published_at string, image_url string, source_url string"


def applied(version: Version) -> dict[str, int]:
    """The last batch of each stream that a version holds."""
    return json.loads(version.note) if version.note else {}


def apply_once(table: VersionedTable, stream: str, batch_id: int, schema: str, change: Callable[[DataFrame], DataFrame]) -> bool:
    """Commit change(rows of the table) as the effect of a stream's batch, and whether anything was written.

    The table's pointer names the last batch of each stream, so rows and ledger are committed by one rename: a batch
    that comes again (after a failure or a restart) is known and left out, and one that failed before its commit has
    left nothing behind. A Conflict with another writer is the caller's to try again.
    """
    base = table.version()
    done = applied(base)
    if done.get(stream, -1) >= batch_id:
        return False
    rows = table.read(base.number or None, schema)
    table.replace(change(rows), base, json.dumps(done | {stream: batch_id}))
    return True


def merge_posts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Posts after an upsert; of several rows of one id in a batch the last by published_at and text counts."""
    last = Window.partitionBy("message_id").orderBy(F.desc_nulls_last("published_at"), F.desc_nulls_last("text"))
    one = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return upsert(existing, one).drop("action")


def posts_stream(posts: DataFrame, table: VersionedTable, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert a stream of POSTS into a versioned table, each micro-batch exactly once."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        apply_once(table, name, batch_id, POSTS, lambda existing: merge_posts(existing, rows))

    writer = posts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()


HISTORY = "title string, url string, published_at string, source string, event_fingerprint " + FINGERPRINT.simpleString()


def take_new(history: DataFrame, items: DataFrame, pack: RulePack) -> DataFrame:
    """The history with those of items (with fingerprints) whose url and event it doesn't hold, one for each event."""
    items = materialize(items, "batch")
    new = remove_duplicates(unpublished(items, history, pack.lead_noise), pack)
    return history.unionByName(history_rows(new))


def news_stream(items: DataFrame, table: VersionedTable, pack: RulePack, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Items of a stream (ordinal unique in a batch, title, description, article_text, url, source, published_at, score,
    strong_topics, image_url), freed of what the history holds by url or event, and appended to it as one version.

    An event is known for 36 hours around its date, a url for as long as the history is kept: late and repeated items of
    any age are held against the history itself, not against state that has ended.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        apply_once(table, name, batch_id, HISTORY, lambda history: take_new(history, fingerprint(rows, pack), pack))

    writer = items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()
