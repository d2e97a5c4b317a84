"""Full evaluation: baselines at each ratio, the threshold sweep, goals, and one summary of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.config import Options
from loomwright.functions.rouge import rouge_l
from loomwright.functions.vectors import hashed_words
from loomwright.operators import metrics
from loomwright.operators.storage import keep
from loomwright.plans.pipeline import process, tau_sweep
from loomwright.sources import sinks


def run_baselines(prompts: DataFrame, ratio: float, options: Options | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All five modes at a ratio: status, six metrics where the mode ran (with ROUGE-L of the prompt), goals.

    Latencies per row have no meaning inside a Spark job and are 0 here; ``bench.py`` times whole queries.
    """
    options = options or Options()
    rows = None
    for mode, (status, compressing, unifying) in metrics.MODES.items():
        if status != "ok":
            continue
        done = process(prompts, 0.0 if mode == "no_compression" else ratio, options=options, enable_compression=compressing, enable_unification=unifying, key=key, text=text)
        one = done.select(F.lit(mode).alias("mode"), "token_reduction", "cache_hit", rouge_l(F.col("raw_prompt"), F.col("final_prompt")).alias("rouge_l"), F.lit(0.0).alias("latency_ms"))
        rows = one if rows is None else rows.unionAll(one)
    summed = metrics.compare_baselines(keep(metrics.summary(rows, ["mode"]), "mode-metrics"))
    e = options.evaluation
    return metrics.goals(summed, e.token_reduction_target, e.rouge_l_threshold, e.latency_p99_ms).withColumn("compression_ratio", F.lit(float(ratio)))


def full_evaluation(prompts: DataFrame, out: str, options: Options | None = None, cluster: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes benchmark, tau_sweep and summary tables under ``out`` and returns the summary rows."""
    options = options or Options()
    runs = None
    for ratio in options.evaluation.ratios:
        one = run_baselines(prompts, ratio, options, key, text)
        runs = one if runs is None else runs.unionAll(one)
    runs = keep(runs.withColumn("source", F.lit("evaluation")), "benchmarks")
    vectors = prompts.select(key, cluster, hashed_words(F.col(text), options.unifier.embedding_dim).alias("v"))
    taus = keep(tau_sweep(vectors, options.evaluation.taus, key, "v", cluster).withColumn("source", F.lit("evaluation")), "tau-sweep")
    summary = sinks.summary_rows(runs, taus)
    sinks.write_report(runs, f"{out}/benchmark")
    sinks.write_report(taus, f"{out}/tau_sweep")
    sinks.write_report(metrics.derived(runs), f"{out}/derived")
    sinks.write_csv(summary, f"{out}/summary")
    return summary
