"""Overlaps at size: all pairs in bounded cells, candidates that few rows share, centres in steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import dedupe, unify
from loomwright.plans.queries import QUERIES


def test_candidates_are_few_although_words_are_common(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, 1, " ".join([*(f"c{w}" for w in rng.choice(3000, 60, replace=False)), *(f"own{i}-{j}" for j in range(10))])) for i in range(600)]
    rows += [(600, 1, rows[7][2] + " more"), (601, 1, rows[8][2] + " other")]
    found = {}
    keep = dedupe.keep

    def counted(df, name):
        out = keep(df, name)
        found[name] = out.count()
        return out

    monkeypatch.setattr(dedupe, "keep", counted)
    df = spark.createDataFrame(rows, "ord long, g long, text string")
    assert sorted(r.ord for r in dedupe.drop_near_duplicates(df, "g").collect()) == list(range(600))
    assert found["candidates"] == 2


def test_cohesion_in_cells_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "TILE_WORDS", 300)
    monkeypatch.setattr(dedupe, "TILE_STEP", 7)
    rng = np.random.default_rng(2)
    rows = [(int(i % 140), None if i % 50 == 0 else int(i % 3), " ".join(f"w{w}" for w in (rng.zipf(1.5, rng.integers(0, 14)) % 60))) for i in range(150)]
    df = spark.createDataFrame(rows, "ord long, g long, text string")
    every = dedupe.overlaps(df, "g").groupBy("g").agg(F.count("*").alias("n"), F.avg("overlap").alias("a"), F.max("overlap").alias("m")).orderBy("g").collect()
    got = dedupe.cluster_cohesion(df, "g").orderBy("g").collect()
    assert [(r.g, r.pairs, r.max_overlap) for r in got] == [(r.g, r.n, r.m) for r in every]
    assert [r.mean_overlap for r in got] == pytest.approx([r.a for r in every])


def test_texts_stay_where_they_are_for_the_overlap_with_their_language(spark, tmp_path):
    rows = [(i, ["en", "de", None][i % 3], f"w{i % 5} w{i % 7}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["unstemmed_overlap"](spark, str(tmp_path))
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 40 and {r.doc_id: r.overlap for r in df.collect()}[0] == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_centres_in_steps_are_those_one_by_one():
    rng = np.random.default_rng(4)
    x = unify._unit(np.abs(rng.normal(size=(400, 5))))
    n = rng.integers(1, 20, 400)
    centres, members = [], []
    for i, row in enumerate(x):
        sims = np.round(np.array(centres) @ row, unify.DIGITS) if centres else np.zeros(0)
        if len(sims) and sims.max() >= 0.9:
            c = int(sims.argmax())
            members[c].append(i)
            m = len(members[c])
            mean = centres[c] * ((m - 1) / m) + row / m
            centres[c] = mean / np.linalg.norm(mean)
        else:
            centres.append(row)
            members.append([i])
    for step in (1, 7, 256):
        work = unify._Centres(0.9, step)
        for lo in range(0, 400, 150):
            work.add(np.arange(lo, min(lo + 150, 400)), n[lo : lo + 150], x[lo : lo + 150])
        out = work.result("b").to_pydict()
        assert out["members"] == [len(m) for m in members]
        assert out["canonical_key"] == [min(m, key=lambda i: (n[i], i)) for m in members]
