"""Operator 7, sharding [native]: contiguous shards of near-equal bytes.

Rows are range-partitioned by (key, row number of the scan), each partition is summed, the totals
give every partition its offset in one global order of bytes, and running sums inside a partition
complete the prefix sums. A row goes to the shard in which the middle of its byte interval falls,
so a cut is off its equal target by at most half a row.

Defined cases: a null text has no bytes and still takes ``overhead`` bytes; equal keys keep the
order of the scan and get distinct slots; a null key comes first; a text may have any length; groups of equal texts are
cut like all rows, since the law is one of bytes and a group may be larger than a shard; an empty table gives an empty result; a row larger than
a whole shard leaves the shards it covers empty. Other columns of the input are ignored, so their
names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm import store


def shard_by_bytes(
    docs: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    overhead: int = 8,
    partitions: int | None = None,
) -> DataFrame:
    """Returns key, size, text_crc32, shard and slot (gapless from 0 within its shard).

    The text is read once; everything that is shuffled is four numbers a row. ``partitions`` is the
    number of range partitions (default: the session's shuffle partitions).
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(key).alias("k"),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
        F.monotonically_increasing_id().alias("at"),
    )
    placed = store.materialize(
        rows.repartitionByRange(n, "k", "at").withColumn("part", F.spark_partition_id()), "shard-rows"
    )

    # One row for each range partition: their number is fixed by ``n``, whatever the input's size.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_start"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_start"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )

    inside = Window.partitionBy("part").orderBy("k", "at")
    prefix = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    ranked = (
        placed.withColumn("prefix", prefix)
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(starts), "part")
        .withColumn("middle", 2 * (F.col("byte_start") + F.col("prefix")) + F.col("size"))
        .withColumn("shard", F.expr(f"cast(middle * {int(shards)} div (2 * all_bytes) as int)"))
        .withColumn("row", F.col("row_start") + F.col("nth") - 1)
    )
    # As many rows as shards.
    firsts = ranked.groupBy("shard").agg(F.min("row").alias("first_row"))
    return ranked.join(F.broadcast(firsts), "shard").select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
    )
