"""Every query of the catalogue against its SQL; those without SQL run and give rows."""

import os
from difflib import SequenceMatcher

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from wirelens.operators import duplicates
from wirelens.plans import catalogue

SF = os.environ.get("CATALOGUE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    assert oracle.check(spark, name, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) >= 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLES.keys()))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() >= 0


def test_entry_point(spark):
    assert __spark_entry__.entry(spark).columns == ["ordinal", "score", "topics"]
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_duplicates_are_found_by_whole_titles(spark, monkeypatch):
    given = []
    monkeypatch.setattr(duplicates, "remove_duplicates", lambda items, pack: given.append(items) or items.withColumn("slot_ordinal", items.ordinal))
    catalogue.QUERIES["greedy_dedup"](spark, SF)
    whole = catalogue.printed(spark, SF).where("admitted").select("ordinal", "title")
    assert sorted(given[0].select("ordinal", "title").collect()) == sorted(whole.collect())
    assert whole.where("length(title) > 120").count()


def test_title_pairs_are_of_whole_titles(spark, tmp_path):
    opening = "the council of the town has met today to "  # over 40 characters
    titles = [opening + "vote", opening + "vote.", opening + "x" * 90, opening + "y" * 90, "so " + opening + "y" * 90, "quite another", opening + "vote"]
    docs = spark.createDataFrame([(i, t + "\nbody", "en", "s", len(t)) for i, t in enumerate(titles)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = {}
    for r in catalogue.news(spark, str(tmp_path)).select("ordinal", catalogue.tx.normalize_title(F.col("title")).alias("title")).orderBy("ordinal").collect():
        first.setdefault(r.title, r.ordinal)
    alike = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.75
    true = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and alike(a, b)}
    assert {tuple(r) for r in catalogue.QUERIES["title_similarity_pairs"](spark, str(tmp_path)).collect()} == true and (2, 3) not in true and true


def test_urls_alone_need_no_fingerprints(spark):
    """A history without fingerprints is matched by urls: no token is made."""
    plan = catalogue.QUERIES["unpublished_urls"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" in plan and "Generate" not in plan and "regexp" not in plan
