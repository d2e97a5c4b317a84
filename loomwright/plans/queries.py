"""One registered query for each operator, over the test tables; ``oracles`` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.rouge import rouge_l
from loomwright.functions.text import is_guarded, jaccard, mean_or_zero, preview, token_count, word_set
from loomwright.functions.vectors import hashed_words
from loomwright.operators import compress as compressing
from loomwright.operators import dedupe, generate, metrics, routing, scoring, unify
from loomwright.operators.storage import fresh_path, keep, spread
from loomwright.plans import pipeline
from loomwright.plans.oracles import ROUNDED
from loomwright.sources import prompts as sources
from loomwright.sources import sinks
from loomwright.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Threshold of vector queries: no pair of test vectors lies close to it.
TAU = 0.30
#: Threshold of the text pipeline on bags of words.
TEXT_TAU = 0.95


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(build: Query) -> Query:
    """Registers a query under its function's name, with its order-dependent sums rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(spark, sf_dir)
        # As SQL rounds: the product to a whole number, not the decimal digits that are shown.
        return df.withColumns({c: F.round(F.col(c) * 1e6, 0) / 1e6 for c in ROUNDED[build.__name__]}) if build.__name__ in ROUNDED else df

    run.__name__ = build.__name__
    QUERIES[build.__name__] = run
    return run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query
def segments(spark, sf_dir):
    n, t = scoring.segment_sizes(F.col("text"))
    return spread(_documents(spark, sf_dir)).select("doc_id", n.alias("n_segments"), t.alias("n_tokens"))


@query
def guarded_segments(spark, sf_dir):
    segs = scoring.split(spread(_documents(spark, sf_dir)), max_length=64).where(is_guarded(F.col("segment")))
    return segs.select("doc_id", "idx", preview(F.col("segment"), 120).alias("preview"), "token_count", "truncated")


@query
def segment_scores(spark, sf_dir):
    scored, _ = scoring.score(_documents(spark, sf_dir))
    return scored.select("doc_id", "idx", "token_count", "protected", "score")


@query
def compress(spark, sf_dir):
    return compressing.compress(_documents(spark, sf_dir)).drop("dropped_segments", "truncated_segments")


@query
def compression_sweep(spark, sf_dir):
    return pipeline.compression_sweep(_documents(spark, sf_dir))


@query
def segment_diagnostics(spark, sf_dir):
    return compressing.diagnostics(_documents(spark, sf_dir))


@query
def nearest_canonical(spark, sf_dir):
    """All vectors against the canonicals of all."""
    rows = table(spark, sf_dir, "embeddings")
    led = unify.unify(rows, TAU).where("not cache_hit").select("vec_id", "canonical_id")
    return unify.nearest(rows, rows.join(led, "vec_id").select("canonical_id", "embedding"), TAU)


@query
def unify_in_rounds(spark, sf_dir):
    """The form for tables of any size, whatever the size of this one."""
    return unify.unify(table(spark, sf_dir, "embeddings"), TAU, local_rows=0)


@query
def unify_from_inventory(spark, sf_dir):
    """The lower half of the ids builds an inventory, the upper half is unified against it: together, all rows."""
    rows = table(spark, sf_dir, "embeddings")
    half = rows.agg(F.avg("vec_id").alias("h")).first()["h"] or 0.0
    low, high = rows.where(F.col("vec_id") <= half), rows.where(F.col("vec_id") > half)
    first = keep(unify.unify(low, TAU), "unified")
    entries = first.where("not cache_hit").join(low, "vec_id").select("canonical_id", "embedding")
    both = first.unionAll(unify.unify(high, TAU, inventory=entries))
    return both.select("vec_id", "canonical_id", "similarity", "cache_hit")


@query
def unify_prompts(spark, sf_dir):
    return unify.unify(table(spark, sf_dir, "embeddings"), TAU)


@query
def tau_sweep(spark, sf_dir):
    return pipeline.tau_sweep(table(spark, sf_dir, "embeddings"), [0.25, 0.30, 0.40])


@query
def pipeline_process(spark, sf_dir):
    return pipeline.process(_documents(spark, sf_dir), tau=TEXT_TAU).drop("raw_prompt")


@query
def canonical_inventory(spark, sf_dir):
    entries = pipeline.inventory(pipeline.process(_documents(spark, sf_dir), tau=TEXT_TAU))
    return entries.select("canonical_id", "text", "token_count", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).cast("long").alias("mass"))


@query
def warmup_clusters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", hashed_words(F.col("text")).alias("vector"), token_count(F.col("text")).alias("token_count"))
    return unify.warmup(docs, 0.9, block="source")


@query
def exact_dedupe(spark, sf_dir):
    return dedupe.first_occurrences(_documents(spark, sf_dir), "text", ["doc_id"])


@query
def cluster_overlap(spark, sf_dir):
    return dedupe.cluster_cohesion(table(spark, sf_dir, "documents"), "source", "doc_id")


@query
def near_duplicate_removal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedupe.drop_near_duplicates(docs, "source", key="doc_id").select("doc_id", "source")


@query
def training_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return dedupe.training_pairs(rows, "conv_id", "turn")


@query
def shortest_member(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("token_count", token_count(F.col("text")))
    return dedupe.shortest_by_tokens(docs, "source", key="doc_id").select("source", "doc_id", "token_count")


@query
def route_messages(spark, sf_dir):
    return routing.route(table(spark, sf_dir, "conversations")).drop("text")


@query
def recorded_prompts(spark, sf_dir):
    return routing.recorded_prompts(table(spark, sf_dir, "conversations"))


@query
def first_user_prompts(spark, sf_dir):
    return sources.chat_prompts(table(spark, sf_dir, "conversations"), 50)


@query
def rejected_requests(spark, sf_dir):
    parts = F.when(F.col("event_id") % 7 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array("event_type", "props"))
    _, rejected = routing.validate(table(spark, sf_dir, "events").select("event_id", parts.alias("prompt")))
    return rejected.select("event_id", "status")


@query
def request_log(spark, sf_dir):
    done = compressing.compress(_documents(spark, sf_dir)).withColumns({"request_id": F.col("doc_id"), "final_prompt": F.col("compressed")})
    log = routing.event_log(done)
    return log.select("request_id", "endpoint", "token_reduction", "original_tokens", "final_tokens", "token_delta", "final_prompt", "canonical_id", "request_meta.model", "request_meta.max_tokens")


@query
def service_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("event_type") == "purchase").alias("cache_hit"), F.col("value").alias("pipeline_total_ms"))
    return metrics.service_stats(events)


@query
def latency_percentiles(spark, sf_dir):
    return metrics.percentiles(table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_type",
        ((F.col("event_id") % 10) / 10).alias("token_reduction"),
        ((F.col("user_id") % 5) / 5).alias("rouge_l"),
        (F.col("event_id") % 3 == 0).alias("cache_hit"),
        F.col("value").alias("latency_ms"),
    )


@query
def request_summary(spark, sf_dir):
    return metrics.goals(metrics.summary(_requests(spark, sf_dir), ["event_type"]))


def _labelled(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return unify.unify(rows, TAU).join(rows.select("vec_id", "label"), "vec_id")


@query
def cluster_hits(spark, sf_dir):
    return metrics.cluster_hits(_labelled(spark, sf_dir), "label", "vec_id")


@query
def cluster_hit_rate(spark, sf_dir):
    return metrics.cluster_hit_rate(metrics.cluster_hits(_labelled(spark, sf_dir), "label", "vec_id"))


@query
def prefix_diversity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return metrics.prefix_diversity(docs, ["lang"], "source", "text")


@query
def mode_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("mode"),
        (F.col("user_id") % 10).cast("string").alias("cluster"),
        (F.col("event_id") % 2 + 1).alias("run_index"),
        F.col("props").alias("final_prompt"),
        (F.col("event_id") % 3 == 0).alias("unifier_hit"),
        ((F.col("event_id") % 7 - 2) / 10).alias("token_reduction"),
        F.col("value").alias("pipeline_ms"),
        F.when(F.col("event_id") % 11 > 0, F.col("value") * 2).alias("backend_ms"),
    )
    return metrics.mode_summary(rows)


@query
def baseline_comparison(spark, sf_dir):
    mode = F.when(F.col("event_type") == "click", "full").otherwise("no_compression").alias("mode")
    rates = table(spark, sf_dir, "events").groupBy(mode).agg(metrics.hit_rate(F.col("event_id") % 3 == 0).alias("unifier_hit_rate"), F.count("*").alias("total_requests"))
    return metrics.compare_baselines(rates)


@query
def best_mode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("score"), F.min("event_id").alias("o"))
    return metrics.best_row(rows, "score", "o").drop("o")


@query
def share_above(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(metrics.share_at_least(F.col("value"), 50).alias("share"))


@query
def result_roll_up(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("source"), "event_type").agg(F.avg("value").alias("a"), F.count("*").cast("double").alias("n"))
    values = F.create_map(F.lit("avg_token_reduction"), F.col("a"), F.lit("total_requests"), F.col("n"))
    entry = F.struct("event_type", F.struct(F.lit("ok").alias("status"), values.alias("metrics")))
    reports = per.groupBy("source").agg(F.map_from_entries(F.collect_list(entry)).alias("modes")).withColumn("compression_ratio", F.lit(0.4))
    return metrics.roll_up(reports)


@query
def derived_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("avg_token_reduction"))
    return metrics.derived(rows.withColumn("unifier_hit_rate", F.lit(None).cast("double")))


@query
def summary_table(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mode")).agg(F.avg("value").alias("avg_token_reduction"))
    taus = table(spark, sf_dir, "embeddings").groupBy((F.col("label") / 10).alias("tau")).agg(F.count("*").alias("total_prompts"))
    return sinks.summary_rows(runs, taus).select("row_type", "mode", "avg_token_reduction", "tau", "total_prompts")


@query
def paraphrases(spark, sf_dir):
    return generate.paraphrases(table(spark, sf_dir, "benchmark"), "item_id")


@query
def expanded_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumn("cluster_id", F.col("item_id") % 5)
    return generate.expand(rows, 40, key="item_id")


@query
def invented_paraphrases(spark, sf_dir):
    return generate.shuffled(generate.invented_clusters(spark), "id")


@query
def workload_cross(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy(F.col("source").alias("cluster")).agg(F.min(F.struct("doc_id", "text"))["text"].alias("context"))
    tasks = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("cluster"), F.col("item_id").alias("paraphrase_index"), F.col("text").alias("task"))
    return generate.workload(first, tasks)


@query
def prompt_bundle(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), "text")
    docs = _documents(spark, sf_dir).withColumnRenamed("doc_id", "ord")
    return sources.bundle([items, docs, items], 500)


@query
def unstemmed_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # One row for each language; found by its key first, so that no text but these is moved.
    least = docs.groupBy("lang").agg(F.min("doc_id").alias("least"))
    chosen = docs.join(F.broadcast(least), "lang").where(F.col("doc_id").eqNullSafe(F.col("least")))
    first = chosen.groupBy("lang").agg(word_set(F.min("text")).alias("f"))
    return spread(docs).join(F.broadcast(first), "lang").select("doc_id", jaccard(word_set(F.col("text")), F.col("f")).alias("overlap"))


@query
def percentiles_of_all(spark, sf_dir):
    """Percentiles of one group that holds every row."""
    return metrics.percentiles(table(spark, sf_dir, "events"), "value", [0.0, 0.5, 0.9, 1.0])


@query
def all_user_prompts(spark, sf_dir):
    """First user prompts of all conversations."""
    return routing.first_user_prompts(table(spark, sf_dir, "conversations"))


@query
def whole_bundle(spark, sf_dir):
    """A bundle of all sources, without a limit."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), "text")
    docs = _documents(spark, sf_dir).withColumnRenamed("doc_id", "ord")
    return sources.bundle([items, docs, items])


@query
def rouge_scores(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    done = spread(compressing.compress(docs).join(docs, "doc_id"))
    return done.select("doc_id", rouge_l(F.col("text"), F.col("compressed")).alias("rouge_l"))


@query
def experiment_modes(spark, sf_dir):
    """The three modes over the conversations' user prompts, summed up by mode."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    numbered = rows.select(F.col("conv_id").cast("string").alias("cluster"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")
    records = pipeline.experiment(numbered, tau=TEXT_TAU)
    return records.groupBy("mode").agg(F.count("*").alias("total_requests"), metrics.hit_rate(F.col("unifier_hit")).alias("unifier_hit_rate"), mean_or_zero(F.when(F.col("token_reduction") > 0, F.col("token_reduction"))).alias("avg_token_reduction"), F.countDistinct("final_prompt").alias("final_prompts"))


#: Items of a JSON file that a query writes, and prompts of a cluster in it.
PER_FILE, PER_CLUSTER = 100, 10


def _json_files(rows, item, order, part, name):
    """Writes a folder of JSON lists, one for each value of ``part``, of at most PER_FILE rows; paths sort like it."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("item")))), lambda x: x["item"])
    path = fresh_path(rows.sparkSession, name)
    rows.groupBy(F.lpad(part.cast("string"), 12, "0").alias("part")).agg(F.to_json(listed).alias("value")).write.partitionBy("part").text(path)
    return path


def _part(size):
    return F.floor(F.col("item_id") / size)


@query
def line_file_prompts(spark, sf_dir):
    """Documents written as lines and read as prompts."""
    path = fresh_path(spark, "lines")
    _documents(spark, sf_dir).orderBy("doc_id").select("text").write.text(path)
    return sources.text_lines(spark, path)


@query
def json_file_prompts(spark, sf_dir):
    """A third of the items under "prompt", a third under "text", the others under both."""
    rest = F.col("item_id") % 3
    item = F.struct(F.when(rest != 1, F.col("text")).alias("prompt"), F.when(rest != 0, F.concat(F.lit("t "), "text")).alias("text"), F.when(rest == 2, F.col("item_id")).alias("cluster_id"))
    path = _json_files(table(spark, sf_dir, "benchmark"), item, F.col("item_id"), _part(PER_FILE), "json")
    first = sources.json_prompts(spark, path).withColumn("by", F.lit("prompt"))
    return first.unionAll(sources.json_prompts(spark, path, ["text", "prompt"], drop_blank=True).withColumn("by", F.lit("text")))


def _cluster_files(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").groupBy(_part(PER_CLUSTER).alias("c")).agg(F.array_sort(F.collect_list(F.struct("item_id", "text")))["text"].alias("prompts"))
    item = F.struct(F.concat(F.lit("c"), F.col("c")).alias("cluster"), F.col("prompts"))
    return _json_files(rows, item, F.col("c"), F.floor(F.col("c") / PER_CLUSTER), "clusters")


@query
def cluster_file_prompts(spark, sf_dir):
    return sources.json_prompts(spark, _cluster_files(spark, sf_dir), flatten_clusters=True)


@query
def workload_file(spark, sf_dir):
    return sources.workload_clusters(spark, _cluster_files(spark, sf_dir))


@query
def paraphrase_file(spark, sf_dir):
    """Variants of some items have no number."""
    variant = F.when(F.col("item_id") % PER_CLUSTER > 2, PER_CLUSTER - F.col("item_id") % PER_CLUSTER)
    item = F.struct(F.col("item_id").alias("id"), F.lit("k").alias("category"), _part(PER_CLUSTER).cast("int").alias("cluster_id"), variant.alias("variant_id"), F.col("text"))
    path = _json_files(table(spark, sf_dir, "benchmark"), item, F.col("item_id"), _part(PER_FILE), "variants")
    return sources.paraphrase_clusters(spark, path).select("cluster_id", "category", F.posexplode("variants").alias("place", "text"))


@query
def mixed_file_prompts(spark, sf_dir):
    """A folder of a JSON list and of lines: the lists' items, then the lines of the other files."""
    rows = table(spark, sf_dir, "benchmark")
    path = _json_files(rows, F.col("text"), F.col("item_id"), _part(PER_FILE), "mixed")
    lines = F.array_join(F.array_sort(F.collect_list(F.struct("item_id", "text")))["text"], "\n")
    part = F.concat(F.lit("x"), F.lpad(_part(PER_FILE).cast("string"), 12, "0")).alias("part")
    rows.groupBy(part).agg(lines.alias("value")).write.mode("append").partitionBy("part").text(path)
    return sources.prompts_or_lines(spark, path)


@query
def inventory_round_trip(spark, sf_dir):
    """Canonical vectors saved over another inventory and loaded."""
    rows = table(spark, sf_dir, "embeddings")
    led = unify.unify(rows, TAU).where("not cache_hit").select("vec_id", "canonical_id").join(rows, "vec_id")
    entries = led.select("canonical_id", F.concat(F.lit("label "), "label").alias("text"), F.col("vec_id").cast("int").alias("token_count"), F.col("embedding").cast("array<double>").alias("embedding"))
    path = fresh_path(spark, "inventory")
    sinks.save_inventory(sinks.load_inventory(spark, path), path + "-empty")
    sinks.save_inventory(entries, path)
    loaded = sinks.load_inventory(spark, path).unionAll(sinks.load_inventory(spark, path + "-empty"))
    return loaded.select("canonical_id", "text", "token_count", F.size("embedding").cast("long").alias("dims"))


@query
def shorter_canonicals(spark, sf_dir):
    """The first document of each source, replaced by its shortest if that is shorter."""
    docs = _documents(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    rows = docs.select(F.col("source").alias("canonical_id"), F.col("doc_id").alias("ord"), "text", token_count(F.col("text")).alias("token_count"))
    first = rows.groupBy("canonical_id").agg(F.min(F.struct("ord", "text", "token_count")).alias("f")).select("canonical_id", "f.text", "f.token_count")
    return unify.replace_if_shorter(first, rows)


@query
def report_file(spark, sf_dir):
    path = fresh_path(spark, "report")
    stats = service_stats(spark, sf_dir)
    sinks.write_report(stats, path)
    return spark.read.schema(stats.schema).json(path)


@query
def appended_log(spark, sf_dir):
    """Events added to a JSON log in two writes."""
    path = fresh_path(spark, "log")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("props"))
    sinks.append_log(events.where("event_type = 'click'"), path)
    sinks.append_log(events.where("event_type <> 'click'"), path)
    return spark.read.schema(events.schema).json(path)


@query
def unify_only(spark, sf_dir):
    """The pipeline with compression switched off."""
    return pipeline.process(_documents(spark, sf_dir), tau=TEXT_TAU, enable_compression=False).select("doc_id", "final_prompt", "compressed_tokens", "cache_hit", "canonical_id")


@query
def compress_only(spark, sf_dir):
    """The pipeline with unification switched off."""
    return pipeline.process(_documents(spark, sf_dir), enable_unification=False).select("doc_id", "final_prompt", "compressed_tokens", "cache_hit", "canonical_id")


def _stream(spark, sf_dir, name):
    # A pattern may name one file; a plain path must be a folder.
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.[p]arquet")


@query
def streamed_unify(spark, sf_dir):
    """Vectors as a stream, against the growing inventory in its state."""
    path = fresh_path(spark, "unified-stream")
    rows = jobs.unify_stream(_stream(spark, sf_dir, "embeddings"), TAU)
    writer = rows.writeStream.option("checkpointLocation", path + "-progress").outputMode("append").trigger(availableNow=True)
    writer.format("parquet").start(path).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path).drop("block")


@query
def streamed_stats(spark, sf_dir):
    path = fresh_path(spark, "stats-stream")
    events = _stream(spark, sf_dir, "events").select((F.col("event_type") == "purchase").alias("cache_hit"), F.col("value").alias("pipeline_total_ms"))
    stats = jobs.running_stats(events)
    writer = stats.writeStream.option("checkpointLocation", path + "-progress").outputMode("complete").trigger(availableNow=True)
    writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(stats.schema).parquet(path)


@query
def streamed_log(spark, sf_dir):
    path = fresh_path(spark, "log-stream")
    events = _stream(spark, sf_dir, "events").select("event_id", "event_type", "value")
    jobs.log_events(events, path, path + "-progress", once=True).awaitTermination()
    return spark.read.schema(events.schema).json(path)


@query
def streamed_search(spark, sf_dir):
    """Vectors as a stream, against canonicals that are read anew for each micro-batch."""
    path = fresh_path(spark, "search-stream")
    rows = table(spark, sf_dir, "embeddings")
    led = unify.unify(rows, TAU).where("not cache_hit").select("vec_id", "canonical_id")
    rows.join(led, "vec_id").select("canonical_id", "embedding").write.parquet(path + "-inventory")
    jobs.search_stream(
        _stream(spark, sf_dir, "embeddings"), lambda s: s.read.parquet(path + "-inventory"), TAU, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), path + "-progress", once=True
    ).awaitTermination()
    return spark.read.parquet(path).drop("batch")
