"""A training corpus from documents: toxicity, near-duplicates, benchmark contamination, personal data, packing.

Each stage takes the session, the documents that the stage before it kept, and the folder of tables; it is written as
Parquet and read again as the next stage's documents. Null ids: such a document is judged like any other, but never
taken for a copy. Rows that share an id are rows like others: of a group of near-copies one row stays, even if several
have the least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm.common import fresh, materialize
from wirelens.llm.decontamination import is_contaminated, mark_contamination
from wirelens.llm.packing import pack_documents
from wirelens.llm.pseudonyms import pseudonymize
from wirelens.llm.queries import PSEUDONYM_KEY, table
from wirelens.llm.simhash import representatives
from wirelens.llm.toxicity import CUT, mark_toxicity
from wirelens.operators.order import numbered


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the cut."""
    marked, name = mark_toxicity(docs, table(spark, sf_dir, "labels"))
    return marked.where(F.col(name)["score"] < CUT).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near-copies (five-word shingles, similarity of 0.8)."""
    if not docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return _drop_near_copies_of_rows(docs)
    kept = materialize(representatives(docs, shingle=5, least=0.8), "kept")
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))


def _drop_near_copies_of_rows(docs: DataFrame) -> DataFrame:
    """The same where ids repeat: rows get numbers of their own, in the order of their ids, and are told apart by these."""
    row = fresh("row", docs.columns)
    named = materialize(numbered(docs.where(F.col("doc_id").isNotNull()), [F.col("doc_id"), F.xxhash64("text")], row), "rows")
    given = named.select(F.col(row).alias("doc_id"), "text")
    kept = materialize(representatives(given, shingle=5, least=0.8), "kept").withColumnRenamed("doc_id", row)
    return named.join(kept, row, "left_semi").drop(row).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are in windows of benchmark items."""
    marked, name = mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(~is_contaminated(F.col(name)["n_hit"], F.col(name)["n_words"])).drop(name)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal numbers and dates replaced by pseudonyms."""
    done, name = pseudonymize(docs, PSEUDONYM_KEY)
    return done.drop(name)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("contamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores and tokenizers are beyond SQL; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
