"""Command line over a prompt file or Parquet table.

process, inventory: the pipeline, from the inventory that the options name if there is one; sweep, eval-compression: ratios
with ROUGE-L; tau: thresholds; benchmark: all modes at one ratio; eval-unifier: clusters one after the other; quality: two
output columns; demo: the experiment's modes as a table; evaluate: everything.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright import config
from loomwright.functions.vectors import hashed_words
from loomwright.operators import metrics
from loomwright.operators.storage import keep
from loomwright.plans import evaluation, pipeline
from loomwright.sources import prompts, sinks


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source, text) of a .txt, .json or Parquet source."""
    if path.endswith(".txt"):
        return prompts.text_lines(spark, path).select(F.col("ord").alias("doc_id"), F.lit("file").alias("source"), "text")
    if path.endswith(".json"):
        rows = prompts.json_prompts(spark, path, flatten_clusters=True, drop_blank=True)
        return rows.select(F.col("ord").alias("doc_id"), F.col("cluster_id").cast("string").alias("source"), "text")
    return spark.read.parquet(path)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomwright", description=__doc__)
    parser.add_argument("command", choices=["process", "sweep", "eval-compression", "tau", "inventory", "benchmark", "eval-unifier", "quality", "demo", "evaluate"])
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--config")
    parser.add_argument("--ratio", type=float)
    parser.add_argument("--tau", type=float)
    parser.add_argument("--max-clusters", type=int)
    parser.add_argument("--columns", nargs=2, default=["reference", "output"], help="of quality")
    args = parser.parse_args(argv)
    options = config.load(args.config)
    spark = SparkSession.builder.appName("loomwright").getOrCreate()
    rows = read(spark, args.input)
    ratio = options.compressor.compression_ratio if args.ratio is None else args.ratio
    tau = options.unifier.similarity_threshold if args.tau is None else args.tau
    dims, e = options.unifier.embedding_dim, options.evaluation
    if args.command in ("process", "inventory"):
        known = sinks.load_inventory(spark, options.unifier.inventory_path)
        done = pipeline.process(rows, args.ratio, args.tau, options, known=known)
        if args.command == "process":
            done.write.mode("overwrite").parquet(args.output)
        else:
            sinks.save_inventory(pipeline.inventory(done, dims, known, shorter=options.unifier.replace_if_shorter), args.output)
    elif args.command in ("sweep", "eval-compression"):
        sinks.write_report(pipeline.compression_sweep(rows, e.ratios, with_rouge=True), args.output)
    elif args.command == "tau":
        vectors = rows.select("doc_id", "source", hashed_words(F.col("text"), dims).alias("v"))
        sinks.write_report(pipeline.tau_sweep(vectors, e.taus, "doc_id", "v", "source"), args.output)
    elif args.command == "benchmark":
        sinks.write_report(evaluation.run_baselines(rows, ratio, options), args.output)
    elif args.command == "eval-unifier":
        hits = pipeline.unifier_evaluation(rows, tau, "source", "doc_id", "doc_id", "text", args.max_clusters, dims)
        sinks.write_report(metrics.cluster_hit_rate(hits, e.hit_rate_target), args.output)
    elif args.command == "quality":
        sinks.write_report(metrics.quality(rows, *args.columns, threshold=e.rouge_l_threshold), args.output)
    elif args.command == "demo":
        records = keep(pipeline.experiment(rows.select(F.col("doc_id").alias("ord"), F.col("source").alias("cluster"), "text"), ratio=ratio, tau=tau), "records")
        timed = records.withColumns({"pipeline_ms": F.lit(0.0), "backend_ms": F.lit(None).cast("double")})
        print(sinks.show_table(metrics.mode_summary(timed).orderBy("mode")))
        print(sinks.show_table(pipeline.compare_modes(records)))
        sinks.write_report(pipeline.compare_modes(records), args.output)
    else:
        evaluation.full_evaluation(rows, args.output, options)


if __name__ == "__main__":
    main()
