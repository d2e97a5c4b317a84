"""Evaluation aggregates: means, rates, percentiles, purity, diversity, roll-ups and goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.rouge import rouge_l
from loomwright.functions.text import mean_or_zero
from loomwright.operators.storage import keep

#: The five modes of a baseline comparison and what they switch on.
MODES = {
    "no_compression": ("ok", False, False),
    "compression_only": ("ok", True, False),
    "full": ("ok", True, True),
    "external_compressor": ("unavailable", False, False),
    "exact_cache_only": ("stub", False, False),
}


def hit_rate(hit: Column) -> Column:
    """Share of hits, 0 without rows."""
    return mean_or_zero(hit.cast("double"))


def share_at_least(c: Column, threshold: float) -> Column:
    """Share of values at or above the threshold, 0 without rows."""
    return mean_or_zero((c >= threshold).cast("double"))


def percentiles(rows: DataFrame, value: str, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., p, value): the value at rank min(int(n * p), n - 1) of each group.

    Equal values are counted first; counts are dealt into ranges of (by, value), and ranks come from the counts of whole
    ranges before and running counts inside, so no group is in one task.
    """
    by = by or []
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    # Dealt by ranges once and kept, as a place in a range must not change between its two uses.
    dealt = keep(counted.repartitionByRange(n, *by, value).withColumn("__r", F.spark_partition_id()), "value-counts")
    # A row for each range of each group.
    sizes = dealt.groupBy(*by, "__r").agg(F.sum("c").alias("m"))
    group = Window.partitionBy(*by)
    before = sizes.select(*by, "__r", (F.sum("m").over(group.orderBy("__r")) - F.col("m")).alias("before"), F.sum("m").over(group).alias("n"))
    wanted = before.join(sizes, [*by, "__r"]).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    at = F.least((F.col("n") * F.col("p")).cast("long"), F.col("n") - 1)
    wanted = wanted.withColumn("at", at - F.col("before")).where((F.col("at") >= 0) & (F.col("at") < F.col("m")))
    ranked = dealt.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "__r").orderBy(value)))
    inside = ranked.join(wanted.select(*by, "__r", "p", "at"), [*by, "__r"]).where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c")))
    return inside.select(*by, "p", F.col(value).alias("value"))


def rate_of_external(ratio: float, least: float = 0.05, most: float = 1.0) -> float:
    """The share of tokens to keep that an external compressor is asked for: one less the ratio, within its limits."""
    return min(most, max(least, 1.0 - ratio))


def quality(rows: DataFrame, reference: str, output: str, key: str = "doc_id", threshold: float = 0.85) -> DataFrame:
    """One row for two output columns: pairs, mean, least and greatest ROUGE-L, share at or above the threshold, and whether
    the mean meets it. Rows without one of the outputs don't count."""
    scored = rows.where(F.col(reference).isNotNull() & F.col(output).isNotNull()).select(rouge_l(F.col(reference), F.col(output)).alias("r"))
    return scored.agg(
        F.count("*").alias("pairs"), mean_or_zero(F.col("r")).alias("avg_rouge_l"), F.min("r").alias("min_rouge_l"), F.max("r").alias("max_rouge_l"), share_at_least(F.col("r"), threshold).alias("share_above"), (mean_or_zero(F.col("r")) >= threshold).alias("meets_goal")
    )


def summary(requests: DataFrame, by: list[str], reduction: str = "token_reduction", rouge: str = "rouge_l", hit: str = "cache_hit", latency: str = "latency_ms") -> DataFrame:
    """Six metrics for each group: mean reduction and ROUGE-L, p50 and p99 latency, hit rate, requests."""
    means = requests.groupBy(*by).agg(mean_or_zero(F.col(reduction)).alias("avg_token_reduction"), mean_or_zero(F.col(rouge)).alias("avg_rouge_l"), hit_rate(F.col(hit)).alias("unifier_hit_rate"), F.count("*").alias("total_requests"))
    tail = percentiles(requests, latency, [0.5, 0.99], by)
    wide = tail.groupBy(*by).agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50_latency_ms"), F.max(F.when(F.col("p") == 0.99, F.col("value"))).alias("p99_latency_ms"))
    return means.join(wide, by, "left").na.fill(0.0, ["p50_latency_ms", "p99_latency_ms"])


def goals(metrics: DataFrame, reduction: float = 0.30, rouge: float = 0.85, latency: float = 50.0) -> DataFrame:
    """Adds meets_token_reduction, meets_rouge_l and meets_latency."""
    return metrics.withColumns(
        {
            "meets_token_reduction": F.col("avg_token_reduction") >= reduction,
            "meets_rouge_l": F.col("avg_rouge_l") >= rouge,
            "meets_latency": F.col("p99_latency_ms") <= latency,
        }
    )


def cluster_hits(rows: DataFrame, cluster: str, order: str, hit: str = "cache_hit") -> DataFrame:
    """(cluster, variants, first_miss, subsequent_hits, subsequent_total): hits of all but a cluster's first row."""
    ranked = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(cluster).orderBy(order)))
    later = F.col("__nth") > 1
    return ranked.groupBy(cluster).agg(
        F.count("*").alias("variants"),
        F.max(F.when(~later, ~F.col(hit))).alias("first_miss"),
        F.sum((later & F.col(hit)).cast("long")).alias("subsequent_hits"),
        F.sum(later.cast("long")).alias("subsequent_total"),
    )


def cluster_hit_rate(clusters: DataFrame, goal: float = 0.70) -> DataFrame:
    """One row: subsequent hit rate over all clusters, share of clusters hit in full, and whether the goal is met."""
    rate = F.coalesce(F.sum("subsequent_hits") / F.sum("subsequent_total"), F.lit(0.0))
    full = mean_or_zero(((F.col("subsequent_total") > 0) & (F.col("subsequent_hits") == F.col("subsequent_total"))).cast("double"))
    return clusters.agg(rate.alias("subsequent_hit_rate"), full.alias("full_cluster_rate"), (rate >= goal).alias("meets_goal"))


def purity(assigned: DataFrame, by: list[str], canonical: str = "canonical_id", cluster: str = "cluster_id", hit: str = "cache_hit") -> DataFrame:
    """Totals, hit rate, canonicals, those that merge clusters, and the mean of 1 / clusters of a canonical."""
    per = assigned.groupBy(*by, canonical).agg(F.countDistinct(cluster).alias("k"), F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("h"))
    return per.groupBy(*by).agg(
        F.sum("n").alias("total_prompts"),
        F.sum("h").alias("cache_hits"),
        (F.sum("h") / F.sum("n")).alias("cache_hit_rate"),
        F.count("*").alias("canonical_count"),
        F.sum((F.col("k") > 1).cast("long")).alias("merged_cluster_count"),
        F.coalesce(F.avg(F.when(F.col("k") > 0, 1 / F.col("k"))), F.lit(1.0)).alias("cluster_purity"),
    )


def prefix_diversity(rows: DataFrame, by: list[str], cluster: str = "cluster", prompt: str = "final_prompt") -> DataFrame:
    """(by..., unique_final_prompts_per_cluster): mean number of distinct final prompts of a cluster."""
    distinct = rows.groupBy(*by, cluster).agg(F.countDistinct(prompt).alias("k"))
    return distinct.groupBy(*by).agg(F.avg("k").alias("unique_final_prompts_per_cluster"))


def mode_summary(records: DataFrame, mode: str = "mode") -> DataFrame:
    """Per mode: requests, mean of positive reductions, hit rate, latencies, run 1 over run 2, prefix diversity.

    Records have mode, cluster, run_index, final_prompt, unifier_hit, token_reduction, pipeline_ms and backend_ms.
    """
    ran = lambda i: F.when((F.col("run_index") == i) & (F.col("backend_ms") != 0), F.col("backend_ms"))
    base = records.groupBy(mode).agg(
        F.count("*").alias("total_requests"),
        mean_or_zero(F.when(F.col("token_reduction") > 0, F.col("token_reduction"))).alias("avg_token_reduction"),
        hit_rate(F.col("unifier_hit")).alias("unifier_hit_rate"),
        mean_or_zero(F.col("pipeline_ms")).alias("avg_pipeline_ms"),
        F.avg("backend_ms").alias("avg_backend_ms"),
        F.avg(ran(2)).alias("avg_backend_run2_ms"),
        F.when(F.avg(ran(1)) > 0, F.avg(ran(1)) / F.avg(ran(2))).alias("speedup_run2_vs_run1"),
    )
    return base.join(prefix_diversity(records, [mode]), mode, "left")


def compare_baselines(metrics: DataFrame) -> DataFrame:
    """All five modes with their status and metrics (null where a mode did not run), and cache_hit_improvement.

    ``metrics`` has a row for each mode that ran, with mode and unifier_hit_rate at least.
    """
    spark = metrics.sparkSession
    modes = spark.createDataFrame([(m, s, c, u) for m, (s, c, u) in MODES.items()], "mode string, status string, enable_compression boolean, enable_unification boolean")
    rates = metrics.agg(*[F.coalesce(F.max(F.when(F.col("mode") == m, F.col("unifier_hit_rate"))), F.lit(0.0)).alias(n) for m, n in (("full", "f"), ("compression_only", "b"))])
    better = rates.select(F.when(F.col("b") > 0, F.col("f") / F.col("b")).when(F.col("f") > 0, F.lit(float("inf"))).otherwise(1.0).alias("cache_hit_improvement"))
    # One row of two rates.
    return F.broadcast(modes).join(metrics, "mode", "left").join(F.broadcast(better))


def service_stats(events: DataFrame, hit: str = "cache_hit", total_ms: str = "pipeline_total_ms") -> DataFrame:
    """One row: requests (failed ones too), unifier_cache_hits, unifier_hit_rate, avg_pipeline_ms."""
    return events.agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum(F.col(hit).cast("long")), F.lit(0)).alias("unifier_cache_hits"),
        hit_rate(F.col(hit)).alias("unifier_hit_rate"),
        mean_or_zero(F.col(total_ms)).alias("avg_pipeline_ms"),
    )


def best_row(rows: DataFrame, score: str, order: str) -> DataFrame:
    """The row with the highest score, the first by ``order`` on a tie; no row for no rows."""
    best = rows.agg(F.max(F.struct(F.col(score), (-F.col(order)).alias("o"), F.struct(*[F.col(c) for c in rows.columns]).alias("r")))["r"].alias("r"))
    return best.where("r is not null").select("r.*")


def roll_up(reports: DataFrame, modes: str = "modes") -> DataFrame:
    """A row for each mode of reports (source, compression_ratio, modes: map of mode to struct(status, metrics map))."""
    rows = reports.select("source", "compression_ratio", F.explode(modes).alias("mode", "m"))
    number = lambda n: F.try_element_at(F.col("m.metrics"), F.lit(n)).cast("double").alias(n)
    return rows.select("source", "compression_ratio", "mode", "m.status", *[number(n) for n in ("avg_token_reduction", "avg_rouge_l", "p99_latency_ms", "unifier_hit_rate", "total_requests")])


def derived(benchmarks: DataFrame) -> DataFrame:
    """One row: runs and the means of what is not null over at least one."""
    mean = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / F.greatest(F.lit(1), F.count(c))
    return benchmarks.agg(F.count("*").alias("benchmark_runs"), mean("avg_token_reduction").alias("avg_token_reduction"), mean("unifier_hit_rate").alias("avg_unifier_hit_rate"))
