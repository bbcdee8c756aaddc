"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions.storage import materialize


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """node and root (its component's least node) of links (a long, b long); nodes without links are left out.

    In each round every node takes the first of itself and its neighbours for its group, and links are redrawn between
    groups. First is by id in one round, which gathers stars, and by a hash of the round in the next, which shortens
    chains by a factor however their ids are ordered. A step's rows are written, so that lineage stays short. Nulls are
    ignored.
    """
    spark = links.sparkSession
    edges = materialize(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds_taken: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(rounds_taken)
        if turn == rounds:
            raise RuntimeError("components do not settle")
        place = lambda node: F.struct((F.xxhash64(node, F.lit(turn)) if turn % 2 else F.lit(0)).alias("order"), node.alias("node"))  # noqa: B023, E731
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        groups = materialize(ends.groupBy(F.col("a").alias("node")).agg(F.min(place(F.col("b"))).alias("near")).select("node", F.least(place(F.col("node")), "near")["node"].alias("group")))
        rounds_taken.append(groups)
        a, b = (groups.select(F.col("node").alias(c), F.col("group").alias(f"{c}_group")) for c in ("a", "b"))
        drawn = edges.join(a, "a").join(b, "b").where("a_group <> b_group")
        edges = materialize(drawn.select(F.least("a_group", "b_group").alias("a"), F.greatest("a_group", "b_group").alias("b")).distinct())
    if not rounds_taken:
        return spark.createDataFrame([], "node long, root long")
    found = rounds_taken.pop()
    while rounds_taken:
        later = found.select(F.col("node").alias("group"), F.col("group").alias("later"))
        found = materialize(rounds_taken.pop().join(later, "group", "left").select("node", F.coalesce("later", "group").alias("group")))
    least = found.groupBy("group").agg(F.min("node").alias("root"))
    return materialize(found.join(least, "group").select("node", "root"))
