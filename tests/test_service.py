"""The service functions, the full evaluation and the command line."""

from pyspark.sql import functions as F

from loomwright.__main__ import main
from loomwright.plans import evaluation, service
from loomwright.sources import sinks


def test_chat_completions(spark):
    rows = [(1, 0, "system", "Aa bb cc dd. Ee ff gg. Hh ii jj kk ll."), (1, 1, "user", "hello"), (2, 0, "user", "first words here"), (2, 1, "user", "Aa bb cc dd. Ee ff gg. Hh ii jj kk ll."), (3, 0, "assistant", "only me")]
    served = service.chat_completions(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    sent = {(r.conv_id, r.turn): r.text for r in served.forwarded.collect()}
    assert sent[1, 1] == "hello" and sent[2, 0] == "first words here" and sent[3, 0] == "only me"
    assert sent[1, 0] == sent[2, 1] and len(sent[1, 0]) < len(rows[0][3])
    results = {r.conv_id: r for r in served.results.collect()}
    assert results[3].noop and results[3].token_reduction == 0.0 and results[3].final_prompt == "only me"
    assert not results[1].cache_hit and results[2].cache_hit and results[2].canonical_id == results[1].canonical_id
    log = served.log
    assert log.count() == 3 and len(log.columns) == 20
    s = service.stats(log, sinks.empty_inventory(spark)).first()
    assert s.requests == 3 and s.unifier_cache_hits == 1 and s.canonical_inventory_size == 0


def test_process_requests(spark):
    df = spark.createDataFrame([(1, ["One two.", "Three four five."]), (2, ["", " "])], "request_id long, prompt array<string>")
    results, rejected = service.process_requests(df)
    assert [r.request_id for r in results.collect()] == [1] and [r.request_id for r in rejected.collect()] == [2]


def test_full_evaluation_and_cli(spark, tmp_path):
    lines = "Aa bb cc dd. Ee ff gg. Must hh ii.\nAa bb cc dd. Ee ff gg. Must hh ii.\nOther words. Entirely here.\n"
    path = tmp_path / "p.txt"
    path.write_text(lines)
    docs = spark.createDataFrame(list(enumerate(lines.split("\n")[:3])), "doc_id long, text string").withColumn("source", F.lit("s"))
    summary = evaluation.full_evaluation(docs, str(tmp_path / "out"))
    assert summary.columns == sinks.SUMMARY_COLUMNS and summary.count() == 3 * 5 + 4
    full = summary.where("mode = 'full' and compression_ratio = 0.4").first()
    assert full.status == "ok" and 0 < full.unifier_hit_rate < 1 and full.total_requests == 3
    assert summary.where("status = 'unavailable'").count() == 3
    main(["process", str(path), str(tmp_path / "res")])
    assert spark.read.parquet(str(tmp_path / "res")).count() == 3
    main(["inventory", str(path), str(tmp_path / "inv")])
    assert sinks.load_inventory(spark, str(tmp_path / "inv")).count() == 2
    main(["sweep", str(path), str(tmp_path / "sweep")])
    main(["tau", str(path), str(tmp_path / "tau")])
    assert spark.read.json(str(tmp_path / "sweep")).count() == 3 and spark.read.json(str(tmp_path / "tau")).count() == 4
