"""Cuts in the lineage: tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="loomwright-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark)}/loomwright/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and reads it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """Rows with their place from 0 in the given order, by counts of ranges and not in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(rows.repartitionByRange(n, order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    # One row for each range.
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return dealt.withColumn("__r", inside).join(F.broadcast(before), "__p").select(*rows.columns, (F.col("__before") + F.col("__r")).cast("long").alias(name))


def drop(df: DataFrame) -> None:
    """Removes the table behind a kept DataFrame that no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: A smaller input may be one row group, which is one task whatever the cluster; above, its splits are many.
SPREAD_BYTES = 512 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small input to all cores; a larger one is left as it is read.

    For narrow work that is worth more than the shuffle of at most SPREAD_BYTES by the plan's estimate.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
