"""Cutting lineage with tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, one of our own on this machine,
    which only serves a local master: on a cluster that is an error."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="wirelens-")
    return _own[context.applicationId]


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/wirelens-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files when it ends, rather than until the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    with freeing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has written to the shared folder, once its results are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
