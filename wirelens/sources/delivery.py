"""Delivery of posts as a sink of its own: `posts.write.format("delivery")`, with the sender injected.

A post is tried step by step: its picture by address (photo), the picture as a file only where the other side says that
it can't fetch the address, a banner, text alone. A success ends it, and so does an uncertain outcome, which may have
been a success: nothing is sent again that may have arrived.

Each task keeps a log of its own, with a line before each call of the sender and one after it. A task that is run again
reads what earlier attempts at the same part have logged: settled steps are taken from there, and a step with a line
before it but none after it is uncertain. `deliver` deals posts by key, so that a part holds the same posts each time,
and leaves out those that an earlier run has settled. Logs lie in a folder that all executors mount.
"""

from __future__ import annotations

import glob
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STEPS = ("photo", "file", "banner", "text")
OK, UNCERTAIN, UNREACHABLE, FAILED = "ok", "uncertain", "unreachable", "failed"
LOG = "run string, key string, step string, outcome string, at double"

#: Called with a post and a step; gives an outcome, or None where the post or the setting has nothing for this step.
Sender = Callable[[Row, str], str | None]


def local_path(path: str) -> str:
    """The path as the file system mounts it; other schemes are an error, as no line could be added there."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"{path}: logs of deliveries need a mounted folder")
    return "/" + rest.lstrip("/")


def next_step(done: dict[str, str | None]) -> str | None:
    """The step after those that are done (with outcomes); None where the post is settled."""
    if OK in done.values() or UNCERTAIN in done.values():
        return None
    for step in STEPS:
        if step not in done and (step != "file" or done.get("photo") == UNREACHABLE):
            return step
    return None


@dataclass
class Sent(WriterCommitMessage):
    """What one task has done: numbers only."""

    posts: int
    calls: int
    published: int
    uncertain: int


class DeliveryWriter(DataSourceWriter):
    def __init__(self, sender: Sender, folder: str, sync: bool):
        self.sender, self.folder, self.sync, self.run = sender, folder, sync, f"{time.time_ns():020}-{uuid.uuid4().hex}"  # runs sort by when they began

    def _logged(self, part: int) -> tuple[dict[str, dict[str, str | None]], int]:
        """Outcomes by key and step that earlier attempts at a part have logged, and how many attempts there were."""
        found: dict[str, dict[str, str | None]] = {}
        logs = glob.glob(f"{self.folder}/run-{self.run}-{part:05}-*.jsonl")
        for log in logs:
            started: set[tuple[str, str]] = set()
            with open(log, encoding="utf-8") as lines:
                for line in lines:
                    try:
                        row = json.loads(line)
                    except ValueError:
                        continue  # a line that was cut off: before a call, which then wasn't made, or after one, which stays uncertain
                    if row["outcome"] is None:
                        started.add((row["key"], row["step"]))
                    else:
                        started.discard((row["key"], row["step"]))
                        found.setdefault(row["key"], {})[row["step"]] = row["outcome"]
            for key, step in started:
                found.setdefault(key, {}).setdefault(step, UNCERTAIN)
        return found, len(logs)

    def write(self, iterator: Iterator[Row]) -> Sent:
        part = TaskContext.get().partitionId()
        os.makedirs(self.folder, exist_ok=True)
        logged, before = self._logged(part)
        posts = calls = published = uncertain = 0
        with open(f"{self.folder}/run-{self.run}-{part:05}-{before:03}.jsonl", "x", encoding="utf-8") as log:

            def note(key: str, step: str, outcome: str | None) -> None:
                log.write(json.dumps({"run": self.run, "key": key, "step": step, "outcome": outcome, "at": time.time()}) + "\n")
                log.flush()
                if self.sync:
                    os.fsync(log.fileno())

            for post in iterator:
                posts += 1
                done = logged.setdefault(post["key"], {})
                while step := next_step(done):
                    note(post["key"], step, None)
                    done[step] = self.sender(post, step) or "none"
                    note(post["key"], step, done[step])
                    calls += 1
                published += OK in done.values()
                uncertain += UNCERTAIN in done.values()
        return Sent(posts, calls, published, uncertain)

    def _close(self, state: str, messages: list) -> None:
        known = [m for m in messages if m is not None]
        sums = {name: sum(getattr(m, name) for m in known) for name in ("posts", "calls", "published", "uncertain")}
        os.makedirs(f"{self.folder}/_runs", exist_ok=True)
        with open(f"{self.folder}/_runs/{self.run}.json", "w", encoding="utf-8") as out:
            json.dump({"run": self.run, "state": state, **sums}, out)

    def commit(self, messages: list) -> None:
        self._close("committed", messages)

    def abort(self, messages: list) -> None:
        """What was sent can't be taken back: the logs stay and count."""
        self._close("aborted", messages)


def register(spark: SparkSession, sender: Sender, name: str = "delivery") -> None:
    """Make a sink known that calls sender. Options: path (a mounted folder for logs), sync (whether each line is forced
    to the disk, true unless said otherwise)."""

    class Delivery(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite: bool) -> DeliveryWriter:
            if overwrite:
                raise ValueError("a delivery can't be overwritten: use mode append")
            return DeliveryWriter(sender, local_path(self.options["path"]), str(self.options.get("sync", "true")).lower() == "true")

    spark.dataSource.register(Delivery)


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """key, run, step, outcome: a row for each step that a run has taken of a post. A step without an outcome is uncertain;
    steps for which there was nothing to send are left out. A folder without logs has none."""
    if not glob.glob(f"{local_path(folder)}/run-*.jsonl"):
        return spark.createDataFrame([], "key string, run string, step string, outcome string")
    lines = spark.read.text(folder).select(F.from_json("value", LOG).alias("line")).select("line.*").where("key is not null and step is not null")
    each = lines.groupBy("key", "run", "step").agg(F.coalesce(F.max("outcome"), F.lit(UNCERTAIN)).alias("outcome"))
    return each.where("outcome <> 'none'")


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """key, steps (in their order), outcome of the last one, published (a success), of the last run that tried the post."""
    order = F.array_position(F.array(*map(F.lit, STEPS)), F.col("step"))
    runs = attempts(spark, folder).groupBy("key", "run").agg(F.array_sort(F.collect_list(F.struct(order.alias("n"), "step", "outcome"))).alias("taken"))
    each = runs.groupBy("key").agg(F.max_by("taken", "run").alias("taken"))
    last = F.element_at("taken", -1)["outcome"]
    return each.select("key", F.col("taken")["step"].alias("steps"), last.alias("outcome"), (last == OK).alias("published"))


def deliver(posts: DataFrame, folder: str, name: str = "delivery", sync: bool = True) -> None:
    """Send posts (key and whatever the sender reads) by a registered sink, but for those that are settled already.

    Posts without a key are not sent; of posts with one key one is sent, with no choice which. A post all of whose steps
    failed is tried again by the next call, one that is uncertain never.
    """
    spark = posts.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("spark.speculation would send posts twice")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settled = outcomes(spark, folder).where(F.col("outcome").isin(OK, UNCERTAIN)).select("key")
    fresh = posts.where("key is not null").withColumn("key", F.col("key").cast("string")).dropDuplicates(["key"]).join(settled, "key", "left_anti")
    fresh.repartition(parts, "key").write.format(name).mode("append").option("sync", str(sync).lower()).save(folder)
