"""Operator 2, line dedup [native]: levelled sorted runs of line hashes.

``LineRuns`` is a small log-structured index on shared storage. Batches of lines arrive in document
order; each batch is merge-joined against the sorted runs of keys seen so far, keys that no run
holds are written as a new sorted run, and ``fanout`` runs of one level are compacted into one run
of the next. Runs are tables with one sorted file for each bucket of the hash, so a join reads a run as it lies,
without a shuffle or a sort, and so does a compaction. A run row is a 128-bit line hash with the smallest document
that holds the line, so a line of a later batch that meets a run loses to that document, and within a batch the
smallest document wins.

Defined cases: a null or empty text is one empty line; a text and a line may have any length; a key shorter than
``min_chars`` code points never counts as a repeat; rows that share a document id count as one document, so their
common lines stay in each of them, and each row loses its own repeats only; a row without an id is a document of its
own, told from others by its text, and comes after all documents with ids; an empty table gives an empty result;
columns of the input that clash with n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import store

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the faster built-in, which does the same there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, _UPPER, _UPPER.lower())
    )


def line_key(c: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(c, F.lit(" \t\n\u000b\f\r")))


def split_lines(c: Column) -> Column:
    """The lines of a text; a null text is one empty line."""
    return F.split(F.coalesce(c, F.lit("")), "\n", -1)


#: Lets a scan of a bucket that is one sorted file count as sorted.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Input bytes of a batch by the plan's estimate, and how few and many batches there may be.
_BATCH_BYTES, _LEAST, _MOST = 1 << 40, 4, 64


class LineRuns:
    """Sorted runs of (h1, h2, owner), disjoint in their keys, in levels of ``fanout`` runs."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self._before = spark.conf.get(_ORDERED, "false")

    def __enter__(self) -> LineRuns:
        self.spark.conf.set(_ORDERED, "true")
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(_ORDERED, self._before)
        for name in list(self.paths):
            self._drop(name)

    def seen(self, keys: DataFrame) -> DataFrame:
        """``keys`` (h1, h2, ...) with the owner that a run has for them, or null: one merge join a run, at most
        ``fanout`` - 1 runs a level."""
        owners = []
        for i, name in enumerate(n for level in self.levels for n in level):
            run = self.spark.table(name).withColumnRenamed("owner", f"owner{i}")
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left")
            owners.append(f"owner{i}")
        # Runs are disjoint: one of them at most has an owner.
        owner = F.coalesce(*owners, F.lit(None).cast("long"))
        return keys.withColumn("owner", owner).drop(*owners)

    def add(self, fresh: DataFrame) -> None:
        """Writes a run of keys that no run holds yet, then compacts full levels."""
        self._put(0, fresh.repartition(self.buckets, "h1", "h2"))

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        name = f"loomwright_run_{uuid.uuid4().hex}"
        self.paths[name] = store.new_path(self.spark, f"run{level}")
        rows = run.select("h1", "h2", "owner")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, reduce(_merged, [self.spark.table(n) for n in full]))
            for n in full:
                self._drop(n)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        store.drop(self.spark, self.paths.pop(name))


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs without a common key as one: a full merge join, bucket by bucket."""
    other = b.withColumnRenamed("owner", "other")
    return a.join(other.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", F.coalesce("owner", "other").alias("owner"))


def _batches(docs: DataFrame) -> int:
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(_LEAST, -(-size // _BATCH_BYTES)), _MOST if size < 1 << 60 else _LEAST)


def _row(key: str, text: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(key, text)


def repeated_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = 10,
    batches: int | None = None,
    fanout: int = 3,
) -> DataFrame:
    """Returns (key, row, pos): each line that a smaller document also holds; ``row`` is a hash of key and text.

    ``batches`` ranges of the key (default: by the size of the input), of about equal row counts, pass through the
    index in order. The text is read once; batches are directories of one table of line hashes.
    """
    spark = docs.sparkSession
    batches = batches or _batches(docs)
    cuts = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx(key, cuts, 1000).alias("b")).first()["b"] if cuts else []
    batch = reduce(lambda c, b: c + (F.col("k") > F.lit(b)).cast("int"), bounds or [], F.lit(0))
    batch = F.when(F.col("k").isNull(), batches - 1).otherwise(batch)
    line = docs.select(F.col(key).cast("long").alias("k"), _row(key, text).alias("row"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    hashed = (
        line.select("k", "row", "pos", line_key(F.col("line")).alias("lk"))
        .where(F.char_length("lk") >= min_chars)
        .select("k", "row", "pos", F.xxhash64("lk").alias("h1"), F.xxhash64(F.lit(7), F.col("lk")).alias("h2"), batch.alias("batch"))
    )
    table = store.save(hashed, "line-hashes", partition_by="batch")
    lines = spark.read.schema("k long, row long, pos int, h1 long, h2 long, batch int").parquet(table)

    found = []
    with LineRuns(spark, fanout) as index:
        for b in range(batches):
            mine = lines.where(F.col("batch") == b).drop("batch")
            bare = F.when(F.col("k").isNull(), F.col("row"))
            own = mine.groupBy("h1", "h2").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.min(bare).alias("bare"), F.max(bare).alias("bare_last"))
            many = (F.col("first") < F.col("last")) | (F.col("bare") < F.col("bare_last")) | (F.col("first").isNotNull() & F.col("bare").isNotNull())
            keys = store.materialize(index.seen(own).withColumn("many", F.coalesce(many, F.lit(False))), "batch-keys")
            repeats = keys.where(F.col("owner").isNotNull() | F.col("many")).select("h1", "h2", F.coalesce("owner", "first").alias("owner"), "bare")
            loses = F.when(F.col("owner").isNotNull(), F.col("k").isNull() | (F.col("k") > F.col("owner"))).otherwise(F.col("row") > F.col("bare"))
            found.append(mine.join(repeats, ["h1", "h2"]).where(loses).select("k", "row", "pos"))
            if b + 1 < batches:
                index.add(keys.where(F.col("owner").isNull()).select("h1", "h2", F.col("first").alias("owner")))
    return reduce(DataFrame.unionAll, found).withColumnRenamed("k", key)


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = 10,
    batches: int | None = None,
    fanout: int = 3,
) -> DataFrame:
    """Returns all columns of ``docs`` with the text cleaned, plus n_lines and n_dropped.

    ``docs`` is scanned twice; whole texts are shuffled once, to meet their dropped lines.
    """
    drops = repeated_lines(docs, key, text, min_chars, batches, fanout)
    # A repeated row has each of its places more than once.
    drops = drops.groupBy(F.col(key).alias("__k"), F.col("row").alias("__r")).agg(F.collect_set("pos").alias("__gone"))
    split = docs.withColumn("__row", _row(key, text)).withColumn("__lines", split_lines(F.col(text))).drop(text)
    joined = split.hint("merge").join(drops, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__row") == F.col("__r")), "left")
    # __lines comes out of the join, so the lambda below reads it and never splits again.
    stays = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    cleaned = F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n")).otherwise(
        F.array_join(F.transform(stays, lambda i: F.get("__lines", i)), "\n")
    )
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    out = joined.select(
        *rest,
        cleaned.alias(text),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out.select(*[c for c in docs.columns if c in (*rest, text)], "n_lines", "n_dropped")
