"""Shared storage for intermediate tables.

Executors may be lost at any time, so lineage is cut by writing Parquet under the folder that the
cluster names in ``spark.checkpoint.dir``. Only where that is unset (tests) a temporary folder is
used instead.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null key where keys are held as plain 64-bit integers.
NO_KEY = -(2**63)

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="loomwright-")
    return _FALLBACK[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/loomwright/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, partition_by: str | None = None) -> str:
    """Writes ``df`` to a fresh shared path and returns the path."""
    path = new_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and reads it back: a cut in the lineage that survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(save(df, name))


def drop(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """Intermediate tables of a long plan, each removed as soon as no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[DataFrame, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Like ``materialize``, for ``drop``."""
        path = save(df, name)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[table] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            drop(self.spark, self.paths.pop(table))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the jobs inside; names have _ for dots."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def restored(key: str, alias: str) -> Column:
    """A key column in which NO_KEY is null again."""
    return F.when(F.col(key) != F.lit(NO_KEY), F.col(key)).alias(alias)
