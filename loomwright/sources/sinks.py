"""Sinks: inventory tables, JSON logs and reports, summary CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INVENTORY = "canonical_id long, text string, token_count int, embedding array<double>"
# The columns of a summary CSV, in order.
SUMMARY_COLUMNS = [
    "row_type", "source", "compression_ratio", "mode", "status", "avg_token_reduction", "avg_rouge_l", "p99_latency_ms",
    "unifier_hit_rate", "total_requests", "tau", "cache_hit_rate", "canonical_count", "merged_cluster_count",
    "cluster_purity", "total_prompts",
]


def empty_inventory(spark: SparkSession) -> DataFrame:
    """What an experiment starts from."""
    return spark.createDataFrame([], INVENTORY)


def save_inventory(inventory: DataFrame, path: str) -> None:
    """Texts and vectors in one row each, so they cannot disagree."""
    inventory.write.mode("overwrite").parquet(path)


def load_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A saved inventory; an empty one where nothing was saved."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return empty_inventory(spark)
    return spark.read.schema(INVENTORY).parquet(path)


def append_log(events: DataFrame, path: str) -> None:
    """JSON lines, added to what is there; nested fields stay nested and nulls are written."""
    events.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def summary_rows(benchmarks: DataFrame, taus: DataFrame) -> DataFrame:
    """Benchmark rows and threshold rows under one header, blank where a row has no such column."""
    parts = [benchmarks.withColumn("row_type", F.lit("benchmark")), taus.withColumn("row_type", F.lit("tau_sweep"))]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.select(*[F.col(c) if c in both.columns else F.lit(None).cast("string").alias(c) for c in SUMMARY_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def show_table(rows: DataFrame, columns: list[str] | None = None, digits: int = 3, limit: int = 50) -> str:
    """A report of at most ``limit`` rows as a text table: numbers to the right, missing values as a dash."""
    names = columns or rows.columns
    cells = [[_cell(r[c], digits) for c in names] for r in rows.select(*names).limit(limit).collect()]
    right = [all(isinstance(x, (int, float)) or x == "-" for x, _ in (row[i] for row in cells)) for i in range(len(names))]
    width = [max([len(n), *(len(row[i][1]) for row in cells)]) for i, n in enumerate(names)]
    line = lambda values: "  ".join(v.rjust(w) if r else v.ljust(w) for v, w, r in zip(values, width, right, strict=True)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in width]), *(line([t for _, t in row]) for row in cells)])


def _cell(value: object, digits: int) -> tuple[object, str]:
    if value is None:
        return "-", "-"
    return value, f"{value:.{digits}f}" if isinstance(value, float) else str(value)
