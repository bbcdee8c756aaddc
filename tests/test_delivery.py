"""Delivery: every combination of outcomes, tasks that are run again, runs that are repeated."""

import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from wirelens.sources import delivery

PHOTO, OTHER = (None, "ok", "uncertain", "unreachable", "failed"), (None, "ok", "uncertain", "failed")


def expected(photo, file, banner, text):
    taken = []
    for step, outcome, wanted in (("photo", photo, True), ("file", file, photo == "unreachable"), ("banner", banner, True), ("text", text, True)):
        if wanted and outcome is not None:
            taken.append((step, outcome))
            if outcome in ("ok", "uncertain"):
                break
    return taken


def planned():
    return lambda row, step: row[step]


def test_all_outcomes(spark, tmp_path):
    cases = [(f"k{i}", *c) for i, c in enumerate(itertools.product(PHOTO, OTHER, OTHER, OTHER))]
    posts = spark.createDataFrame([*cases, cases[3], (None, "ok", "ok", "ok", "ok")], "key string, photo string, file string, banner string, text string")
    delivery.register(spark, planned())
    folder = f"file:{tmp_path}/log"
    delivery.deliver(posts, folder, sync=False)
    want = {c[0]: expected(*c[1:]) for c in cases}
    found = {r.key: r for r in delivery.outcomes(spark, folder).collect()}
    assert {k: (r.steps, r.outcome, r.published) for k, r in found.items()} == {k: ([s for s, _ in t], t[-1][1], t[-1][1] == "ok") for k, t in want.items() if t}
    (run,) = os.listdir(tmp_path / "log" / "_runs")
    told = json.loads((tmp_path / "log" / "_runs" / run).read_text())
    assert told["state"] == "committed" and told["posts"] == len(cases) and told["published"] == sum(r.published for r in found.values())
    # again: what succeeded or is uncertain is never sent again
    again = posts.withColumns({s: F.lit("ok") for s in delivery.STEPS})
    delivery.deliver(again, folder, sync=False)
    lines = [json.loads(x) for f in (tmp_path / "log").glob("run-*.jsonl") for x in f.read_text().splitlines()]
    calls = [(x["key"], x["step"]) for x in lines if x["outcome"] in ("ok", "uncertain")]
    assert len(calls) == len({k for k, _ in calls})
    assert {r.key for r in delivery.outcomes(spark, folder).where("published").collect()} == {k for k, t in want.items() if not t or t[-1][1] != "uncertain"}
    with pytest.raises(Exception, match="append"):
        posts.write.format("delivery").mode("overwrite").save(folder)


class Part:
    """Stands for the context of a task."""

    @staticmethod
    def get():
        return Part

    @staticmethod
    def partitionId():  # noqa: N802
        return 7


def test_a_task_run_again_repeats_no_send(tmp_path, monkeypatch):
    """The sender breaks down during the third post's banner: a second attempt sends only what comes after."""
    monkeypatch.setattr(delivery, "TaskContext", Part)
    sent = []

    def sender(post, step):
        sent.append((post["key"], step))
        if (post["key"], step) == ("c", "banner"):
            raise ConnectionError
        return post[step]

    posts = [{"key": k, "photo": p, "file": "failed", "banner": "ok", "text": "ok"} for k, p in (("a", "ok"), ("b", "uncertain"), ("c", "unreachable"), ("d", "failed"))]
    writer = delivery.DeliveryWriter(sender, str(tmp_path), True)
    with pytest.raises(ConnectionError):
        writer.write(iter(posts))
    with open(next(tmp_path.glob("*.jsonl")), "a") as log:
        log.write('{"key": "d", "st')  # a line that was cut off
    done = writer.write(iter(posts))
    assert len(sent) == len(set(sent)) and sent[-2:] == [("d", "photo"), ("d", "banner")]
    assert (done.posts, done.calls, done.published, done.uncertain) == (4, 2, 2, 2)
    writer.abort([done, None])
    assert json.loads(next((tmp_path / "_runs").iterdir()).read_text())["state"] == "aborted"


def test_paths_and_empty_posts(spark, tmp_path):
    assert delivery.local_path("file:///a/b") == "/a/b" and delivery.local_path("/a/b:c") == "/a/b:c"
    with pytest.raises(ValueError, match="mounted"):
        delivery.local_path("s3://bucket/x")
    delivery.register(spark, planned())
    posts = spark.createDataFrame([], "key string, photo string, file string, banner string, text string")
    delivery.deliver(posts, f"{tmp_path}/none")
    assert delivery.outcomes(spark, f"{tmp_path}/none").count() == 0
