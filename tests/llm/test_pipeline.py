"""The pipeline against brute force on a small corpus, stage by stage."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwright.llm import store

WS = " \t\n\x0b\f\r"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdeghimnoprst", k=rng.randint(2, 8))) for _ in range(900)]
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, make(12)) for i in range(5)]
    docs, labels, plan = [], [], {}

    def add(text, what):
        i = len(docs)
        docs.append((i, text, "en", "s", len(text or "")))
        plan[i] = what

    shared = make(8)
    for _ in range(250):
        add("\n".join(make(rng.randint(30, 60)) for _ in range(4)), "clean")
    for i in range(60):
        add(make(40) + " zzorkish " + make(20) + " quuxling", "toxic")
    for i in range(10):
        add("\n".join([make(50), shared, make(40)]), "clean")
    for i in range(10):  # a near copy: one word of one long line differs
        words = docs[i][1].replace("\n", " ").split()
        words[50] = "changed"
        add(" ".join(words), "near")
        docs[i] = (i, docs[i][1].replace("\n", " "), *docs[i][2:])
    for i in range(5):
        add(make(30) + " " + items[i][1] + " " + make(30), "leak")
    add(None, "clean")
    for i, what in plan.items():
        labels.append((i, 1, int(what == "toxic")))
    path = store.new_path(spark, "fixture")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, plan


def test_each_stage(spark, corpus):
    path, docs, plan = corpus
    now = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    gone = {"toxicity": "toxic", "simhash_near_dedup": "near", "benchmark_decontamination": "leak"}
    for name, stage in corpus_pipeline.STAGES:
        after = store.materialize(stage(spark, now, path), "test-stage")
        if name == "best_fit_packing":
            assert ids(after) == ids(now)
            assert all(r.n <= 1024 for r in after.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect())
            return
        assert after.columns == corpus_pipeline.COLUMNS
        want = {i for i in ids(now) if plan[i] != gone.get(name)}
        assert ids(after) == want, name
        if name == "line_dedup":
            before, left = ({r.doc_id: r.text for r in x.collect()} for x in (now, after))
            first = {}
            for i in sorted(before):
                for line in (before[i] or "").split("\n"):
                    first.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WS)), i)
            for i, t in before.items():
                kept = [x for x in (t or "").split("\n") if len(x.strip(WS)) < 10 or first[re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(WS))] == i]
                assert left[i] == "\n".join(kept)
        now = after


def test_run(spark, corpus):
    path, docs, plan = corpus
    out = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, what in plan.items() if what == "clean"}


def test_edge_cases(spark):
    """Null and shared ids, null texts, repeated rows, other columns, empty tables: nothing crashes or gets lost."""
    rng = random.Random(2)
    make = lambda n: " ".join("".join(rng.choices("abcdeghimnoprst", k=rng.randint(2, 8))) for _ in range(n))
    item = make(12)
    plain = [make(40) for _ in range(6)]
    rows = [(None, plain[0]), (None, plain[1]), (3, plain[2]), (3, plain[3]), (3, plain[3]), (4, None), (5, ""), (6, make(5) + " " + item), (None, item + " " + make(9)), (6, plain[4]), (None, "x " * 30_000 + plain[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, predicted string, score double").repartition(2)
    path = store.new_path(spark, "fixture")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    texts = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    every = sorted((i or 0, t or "") for i, t in rows)
    clean = sorted((i or 0, t or "") for i, t in rows if item not in (t or ""))
    assert texts(corpus_pipeline.drop_lines(spark, docs, path)) == every
    assert texts(corpus_pipeline.drop_contaminated(spark, docs, path)) == clean
    near = texts(corpus_pipeline.drop_near_copies(spark, docs, path))
    assert near == sorted({x for x in every if x != (5, "")})
    assert len(texts(corpus_pipeline.drop_toxic(spark, docs, path))) in (0, len(rows))
    assert len({r.sequence_id for r in corpus_pipeline.pack(spark, docs, path).where("doc_id is null").collect()}) >= 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name
