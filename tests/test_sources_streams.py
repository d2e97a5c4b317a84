"""Files in and out, chats, generators, metrics and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright import config
from loomwright.functions.rouge import lcs_length, rouge_l_score, stem, words
from loomwright.operators import generate, metrics, routing, unify
from loomwright.plans import pipeline
from loomwright.sources import prompts, sinks
from loomwright.streaming import jobs


def put(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def texts(df):
    return [r.text for r in df.orderBy("ord").collect()]


def test_prompt_files(spark, tmp_path):
    assert texts(prompts.text_lines(spark, put(tmp_path, "p.txt", " one \n\n two\n"))) == ["one", "two"]
    assert texts(prompts.json_prompts(spark, put(tmp_path, "a.json", ["x", "{y}"]))) == ["x", "{y}"]
    both = [{"prompt": "p", "text": "t"}, {"text": "u"}, {"other": 1}]
    assert texts(prompts.json_prompts(spark, put(tmp_path, "b.json", both))) == ["p", "u", ""]
    assert texts(prompts.json_prompts(spark, put(tmp_path, "c.json", both), ["text", "prompt"], drop_blank=True)) == ["t", "u"]
    assert texts(prompts.json_prompts(spark, put(tmp_path, "d.json", {"prompts": ["m", "n"]}))) == ["m", "n"]
    clusters = [{"cluster": "a", "prompts": ["1", "2"]}, {"cluster": "b", "prompts": ["3"]}]
    path = put(tmp_path, "e.json", clusters)
    assert texts(prompts.json_prompts(spark, path, flatten_clusters=True)) == ["1", "2", "3"]
    assert texts(prompts.json_prompts(spark, path)) == ["", ""]
    assert {(r.cluster, r.paraphrase_index, r.text) for r in prompts.workload_clusters(spark, path).collect()} == {("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3")}
    ids = prompts.json_prompts(spark, put(tmp_path, "f.json", [{"text": "a", "cluster_id": 9}, {"text": "b"}])).orderBy("ord").collect()
    assert [r.cluster_id for r in ids] == [9, 1]
    records = [{"id": 1, "cluster_id": 1, "variant_id": 1, "text": "b"}, {"id": 0, "cluster_id": 1, "text": "a"}]
    assert prompts.paraphrase_clusters(spark, put(tmp_path, "g.json", records)).first().variants == ["a", "b"]


def test_bundle_and_inventory(spark, tmp_path):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "ord long, text string")
    b = spark.createDataFrame([(0, "y"), (1, "z")], "ord long, text string")
    assert texts(prompts.bundle([a, b])) == ["x", "y", "z"] and texts(prompts.bundle([a, b], 2)) == ["x", "y"]
    path = str(tmp_path / "inv")
    assert sinks.load_inventory(spark, path).count() == 0
    inv = spark.createDataFrame([(0, "x", 1, [1.0, 0.0])], sinks.INVENTORY)
    sinks.save_inventory(inv, path)
    assert sinks.load_inventory(spark, path).collect() == inv.collect()
    sinks.write_csv(sinks.summary_rows(spark.createDataFrame([("m", 0.5)], "mode string, avg_token_reduction double"), spark.createDataFrame([(0.8,)], "tau double")), str(tmp_path / "csv"))
    read = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert read.columns == sinks.SUMMARY_COLUMNS and read.count() == 2
    sinks.write_report(inv.select("canonical_id"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_routing(spark):
    df = chat(spark, [(1, 0, "system", "s1"), (1, 1, "user", "u"), (1, 2, "system", "s2"), (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "user", " "), (3, 0, "assistant", "x"), (4, 0, "system", None), (4, 1, "user", "c")])
    out = {(r.conv_id, r.turn): (r.processed, r.recorded) for r in routing.route(df).collect()}
    assert out[1, 0] == (True, True) and out[1, 2] == (True, False) and out[1, 1] == (False, False)
    assert out[2, 1] == (True, True) and out[2, 2] == (False, False) and out[3, 0] == (False, False) and out[4, 1] == (True, True)
    rec = {r.conv_id: (r.text, r.noop) for r in routing.recorded_prompts(df).collect()}
    assert rec == {1: ("s1", False), 2: ("b", False), 3: ("x", True), 4: ("c", False)}
    assert {r.conv_id: r.prompt for r in routing.first_user_prompts(df).collect()} == {1: "u", 2: "a", 4: "c"}
    ok, bad = routing.validate(spark.createDataFrame([(1, ["a", "b"]), (2, [" "])], "id long, prompt array<string>"))
    assert [r.prompt for r in ok.collect()] == ["a\nb"] and [r.status for r in bad.collect()] == [400]


def test_event_log(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 10, 6, 0.4, "x" * 600, True, 3, 0.9)], "request_id string, original_tokens int, compressed_tokens int, token_reduction double, final_prompt string, cache_hit boolean, canonical_id long, similarity double")
    log = routing.event_log(rows)
    assert len(log.columns) == 20
    for _ in range(2):
        sinks.append_log(log, str(tmp_path / "log"))
    back = spark.read.json(str(tmp_path / "log")).collect()
    assert len(back) == 2 and back[0].token_delta == 4 and len(back[0].final_prompt) == 500 and back[0].request_meta.max_tokens == 512


def test_metrics(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", float(i)) for i in range(10)], "g string, v double")
    got = {(r.g, r.p): r.value for r in metrics.percentiles(df, "v", [0.5, 0.99], ["g"]).collect()}
    assert got == {("a", 0.99): 99.0, ("a", 0.5): 50.0, ("b", 0.5): 5.0, ("b", 0.99): 9.0}
    assert metrics.service_stats(spark.createDataFrame([], "cache_hit boolean, pipeline_total_ms double")).first().unifier_hit_rate == 0.0
    rows = [(0, 1, True), (1, 1, False), (1, 2, True), (2, 3, False)]
    p = metrics.purity(spark.createDataFrame([(0.8, *r) for r in rows], "tau double, canonical_id long, cluster_id long, cache_hit boolean"), ["tau"]).first()
    assert abs(p.cluster_purity - 0.8333) < 1e-3 and p.merged_cluster_count == 1 and p.canonical_count == 3
    rec = [("m", "c", 1, "p", False, 0.3, 1.0, 4.0), ("m", "c", 2, "p", True, 0.0, 3.0, 2.0), ("m", "c", 2, "p", True, 0.5, 3.0, None)]
    m = metrics.mode_summary(spark.createDataFrame(rec, "mode string, cluster string, run_index int, final_prompt string, unifier_hit boolean, token_reduction double, pipeline_ms double, backend_ms double")).first()
    assert m.avg_token_reduction == pytest.approx(0.4) and m.speedup_run2_vs_run1 == 2.0 and m.unique_final_prompts_per_cluster == 1.0
    assert metrics.best_row(df.limit(0), "v", "v").count() == 0


def test_generators(spark):
    rows = spark.createDataFrame([(0, 1, "Write a poem."), (1, 1, "If so, stop!"), (2, 1, " ")], "ord long, cluster_id long, text string")
    out = {(r.ord, r.transform): r.text for r in generate.paraphrases(rows).collect()}
    assert out[0, "conditional"] == "Given the input below, write a poem." and (1, "conditional") not in out and (1, "passive") not in out
    assert out[0, "passive"] == "The following task should be completed: write a poem."
    more = generate.expand(rows, 6).orderBy("variant_id").collect()
    assert [r.variant_id for r in more] == list(range(6)) and [r.text for r in more[:2]] == ["Write a poem.", "If so, stop!"]
    made = generate.invented_clusters(spark, 12, 10)
    assert made.count() == 120 and made.select("cluster_id").distinct().count() == 12 and made.select("text").distinct().count() == 120
    assert made.where("is_canonical").count() == 12


def test_rouge():
    assert rouge_l_score("the same text", "the same text") == 1.0
    assert rouge_l_score("a b c d e", "a x c e") == pytest.approx(2 * 0.75 * 0.6 / 1.35)
    assert rouge_l_score("", "x") == 0.0 and rouge_l_score("Running dogs", "run dog") == 1.0 and rouge_l_score("dogs bark", "cats bark") == 0.5
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "sky", "happy", "agreed", "adjustment")] == ["caress", "poni", "relat", "hop", "sky", "happi", "agre", "adjust"]
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.integers(0, 4, n).astype(str).tolist() for n in rng.integers(1, 30, 2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert lcs_length(a, b) == t[-1, -1]
    assert words("A-b_c 12!") == ["a", "b", "c", "12"]


def test_pipeline_toggles(spark):
    df = spark.createDataFrame([(0, "Aa bb cc. Dd ee. Ff gg hh ii."), (1, "Aa bb cc. Dd ee. Ff gg hh ii."), (2, "other words")], "doc_id long, text string")
    raw = pipeline.process(df, enable_compression=False, enable_unification=False).orderBy("doc_id").collect()
    assert [(r.final_prompt, r.token_reduction, r.cache_hit) for r in raw] == [(r.raw_prompt, 0.0, False) for r in raw]
    full = pipeline.process(df, 0.5).orderBy("doc_id").collect()
    assert [r.cache_hit for r in full] == [False, True, False] and full[0].final_prompt == full[1].final_prompt
    assert pipeline.inventory(pipeline.process(df, 0.5)).count() == 2
    records = pipeline.experiment(df.select(F.col("doc_id").alias("ord"), F.lit("c").alias("cluster"), "text"))
    assert records.count() == 3 * 2 * 3 and records.where("mode = 'full' and run_index = 2 and not unifier_hit").count() == 0


def test_config(tmp_path, monkeypatch):
    assert config.load(None) == config.Options() and config.load("nowhere.yaml") == config.Options()
    a, b = put(tmp_path, "a.json", {"unifier": {"similarity_threshold": 0.5}}), put(tmp_path, "b.json", {"compressor": {"compression_ratio": 0.2}})
    assert config.load(a).unifier.similarity_threshold == 0.5
    monkeypatch.setenv(config.ENV, b)
    assert config.load(a).compressor.compression_ratio == 0.2
    monkeypatch.setenv(config.ENV, put(tmp_path, "c.json", {"compressor": {"compression_ratio": 2}}))
    with pytest.raises(ValueError):
        config.load()


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for part in range(3):
        df.where(f"vec_id >= {part * 20} and vec_id < {part * 20 + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = jobs.unify_stream(stream, 0.8).writeStream.format("memory").queryName("unified").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.vec_id, r.leader, r.canonical_id, round(r.similarity, 6), r.cache_hit) for r in spark.table("unified").collect())
    want = sorted((r.vec_id, r.leader, r.canonical_id, round(r.similarity, 6), r.cache_hit) for r in unify.unify(df, 0.8).collect())
    assert got == want


def test_stats_log_and_search_streams(spark, tmp_path):
    events = spark.createDataFrame([("a", True, 2.0), ("b", False, 4.0)], "request_id string, cache_hit boolean, pipeline_total_ms double")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = jobs.running_stats(stream).writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("stats").first().asDict() == {"requests": 2, "unifier_cache_hits": 1, "unifier_hit_rate": 0.5, "avg_pipeline_ms": 3.0}
    jobs.log_events(stream, str(tmp_path / "log"), str(tmp_path / "cp1"), once=True).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    vec = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    vec.write.parquet(str(tmp_path / "vec"))
    seen = []
    inv = vec.withColumnRenamed("vec_id", "canonical_id")
    jobs.search_stream(spark.readStream.schema(vec.schema).parquet(str(tmp_path / "vec")), lambda s: inv, 0.8, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp2"), once=True).awaitTermination()
    assert len(seen) == 1 and seen[0].hit


def test_prompts_or_lines(spark, tmp_path):
    from loomwright.sources.prompts import prompts_or_lines

    (tmp_path / "a.json").write_text('["one", {"text": " two "}, ""]')
    (tmp_path / "b.json").write_text('{"prompts": [{"prompt": "three"}]}')
    (tmp_path / "c.json").write_text('{"other": 1}')
    (tmp_path / "d.txt").write_text("four\n\n five\n")
    rows = prompts_or_lines(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.text for r in rows] == ["one", "two", "three", '{"other": 1}', "four", "five"]


def test_reports_and_quality(spark):
    from loomwright.operators import metrics
    from loomwright.sources.sinks import show_table

    df = spark.createDataFrame([(1, "a b c", "a b c"), (2, "a b c d", "a x c d"), (3, None, "x")], "doc_id long, r string, o string")
    q = metrics.quality(df, "r", "o").first()
    assert (q.pairs, q.min_rouge_l, q.max_rouge_l, q.share_above, q.meets_goal) == (2, 0.75, 1.0, 0.5, True)
    assert metrics.rate_of_external(0.4) == 0.6 and metrics.rate_of_external(0.99) == 0.05
    text = show_table(spark.createDataFrame([("full", 0.5), ("raw", None)], "mode string, rate double"))
    assert text.split("\n") == ["mode   rate", "----  -----", "full  0.500", "raw       -"]


def test_hooks_and_modes(spark):
    from loomwright.operators.compress import compress
    from loomwright.plans import pipeline

    texts = ["First part here. Second part is there. Third one.", "Alone it stands", "First part here. Second part is there. Third one."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    last = compress(df, [0.6], scorer=lambda s: s.select("doc_id", "idx", F.col("idx").cast("double").alias("score"))).orderBy("doc_id").collect()
    assert last[0].compressed == "Third one."
    embed = lambda c: F.array(F.char_length(c).cast("double"), F.lit(1.0))
    done = pipeline.process(df, tau=0.9, enable_compression=False, embedder=embed)
    assert sum(r.cache_hit for r in done.collect()) == 2
    known = pipeline.inventory(pipeline.process(df, tau=0.95))
    again = pipeline.process(df, tau=0.95, known=known).orderBy("doc_id").collect()
    assert all(r.cache_hit and r.similarity > 0.99 for r in again) and [r.canonical_id for r in again] == [0, 1, 0]
    records = pipeline.experiment(df.select(F.col("doc_id").alias("ord"), F.lit("c").alias("cluster"), "text"), tau=0.95)
    m = pipeline.compare_modes(records).first()
    assert m.requests == 6 and m.raw_hit_rate == 0 and m.full_hit_rate > 0.5 and m.raw_prompts_per_cluster == 2
    rows = spark.createDataFrame([(i, i % 2, i // 2, t) for i, t in enumerate([texts[0], texts[1], texts[0], texts[1], texts[0], "quite another"])], "id long, cluster_id long, variant_id long, text string")
    hits = {r.cluster_id: (r.subsequent_hits, r.subsequent_total) for r in pipeline.unifier_evaluation(rows, 0.95).collect()}
    assert hits == {0: (2, 2), 1: (1, 2)}
    assert pipeline.unifier_evaluation(rows, 0.95, max_clusters=1).count() == 1
    assert pipeline.warmed_inventory(df, 0.95).count() == 2
