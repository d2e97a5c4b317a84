"""Segments, budgets and selection: worked cases."""

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators.compress import compress, diagnostics, prompt_arrays, select_segments, trim_tokens
from loomwright.operators.scoring import score


def arrays(spark, segs):
    rows = [(1, None, [(i, " ".join(["w"] * n) + f"{i}", n, False, s, p) for i, n, s, p in segs])]
    kind = "doc_id long, blank string, segs array<struct<idx:int,segment:string,token_count:int,truncated:boolean,score:double,protected:boolean>>"
    return spark.createDataFrame(rows, kind)


@pytest.mark.parametrize(
    ("segs", "ratio", "target", "kept", "tokens"),
    [
        ([(0, 4, 1.0, False), (1, 4, 1.1, False), (2, 3, 9.0, False)], 0.55, 4, [2], 3),
        ([(0, 5, 10.0, True), (1, 3, 1.0, False), (2, 3, 1.1, False)], 0.80, 2, [0], 5),
        ([(0, 5, 80.0, False), (1, 9, 1.0, True), (2, 3, 10.0, False)], 0.55, 7, [1], 9),
        ([(0, 5, 10.0, False), (1, 7, 10.0, False), (2, 4, 10.0, False)], 0.34, 10, [0, 2], 9),
        ([(0, 9, 1.0, False), (1, 8, 2.0, False), (2, 8, 2.0, False)], 0.90, 2, [1], 8),
        ([(0, 9, 1.0, False), (1, 1, float("inf"), False), (2, 8, 2.0, False)], 1.5, 1, [1], 1),
    ],
)
def test_selection(spark, segs, ratio, target, kept, tokens):
    r = select_segments(arrays(spark, segs), F.lit(ratio)).first()
    assert (r.target_tokens, r.kept) == (target, kept)
    assert sum(n for i, n, _, _ in segs if i in r.kept) == tokens
    assert r.compressed == " ".join(" ".join(["w"] * n) + f"{i}" for i, n, _, _ in segs if i in kept)


def test_budget_is_cut_in_doubles(spark):
    rows = spark.createDataFrame([(100, 0.55), (11, 0.55), (17, 0.55), (1, 0.9)], "n int, r double")
    assert [r[0] for r in rows.select(T.target_tokens(F.col("n"), F.col("r"))).collect()] == [44, 4, 7, 1]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("One here. Two there. Three!", 3),
        ("no terminator at all", 1),
        ("first paragraph\n\nsecond paragraph", 2),
        (" \n\t ", 0),
        (None, 0),
        ("", 0),
        ("Ends. ", 1),
    ],
)
def test_split(spark, text, parts):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.size(T.segments(F.col("t")))).first()[0] == parts


def test_single_segment_is_trimmed_by_token(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d must e f g h i"), (3, ""), (4, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in compress(df, [0.40]).collect()}
    assert out[1].compressed == "a b c d i j" and out[1].compressed_tokens == 6 == out[1].target_tokens
    assert "must" in out[2].compressed.split()
    assert out[3].segments_total == 0 == out[4].segments_total and out[3].compressed == "" == out[4].compressed
    assert out[3].token_reduction == 0.0


def test_trim_drops_the_least_surprising_tokens(spark):
    text = "a b c d common rare common odd y z"
    corpus = spark.createDataFrame([(1, text), (2, "common common common common. Other one.")], "doc_id long, text string")
    _, model = score(corpus)
    rows = corpus.where("doc_id = 1").withColumn("target_tokens", F.lit(8))
    assert trim_tokens(rows, model, ["doc_id"]).first().trimmed == "a b c d rare odd y z"


def test_ratios_share_scores_and_invariants_hold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = compress(docs, [0.25, 0.40, 0.55]).collect()
    assert len(out) == 3 * docs.count()
    for r in out:
        assert r.protected_segments_kept <= r.segments_kept or r.segments_total == 1
        assert len(r.dropped_segments) == r.segments_total - r.segments_kept
    kept = diagnostics(docs, 0.40).where("kept").groupBy("doc_id").count().collect()
    whole = {r.doc_id: r.segments_kept for r in out if r.ratio == 0.40 and r.segments_total > 1}
    assert {r.doc_id: r["count"] for r in kept if r.doc_id in whole} == whole


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert compress(df, [0.4]).count() == 0
    assert prompt_arrays(df)[0].count() == 0 == score(df)[0].count()


def test_overlap_and_tokens(spark):
    df = spark.createDataFrame([("a b c", "b c D"), ("", "a"), ("A a", "a")], "x string, y string")
    got = df.select(T.jaccard(T.word_set(F.col("x")), T.word_set(F.col("y"))), T.token_count(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(0.5, 3), (0.0, 0), (1.0, 2)]


def test_scores_add_losses_in_token_order(spark, monkeypatch):
    """Equal segments score alike wherever they stand, to the last digit, with and without rare tokens."""
    import math

    from loomwright.operators import scoring

    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[(i * 7 + j * j) % 40] for j in range(25)) + ". " + " ".join(words[(i * 3 + j) % 40] for j in range(9)) + "." for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string").repartition(5)
    for most in (1_000_000, 20):
        monkeypatch.setattr(scoring, "BROADCAST_TOKENS", most)
        rows, model = scoring.score(df)
        counts = {r.token: r.c for r in model.table.collect()}
        for r in rows.collect():
            total = 0.0
            for t in r.segment.split()[1:]:
                total += -math.log((counts[t] + 1) / float(model.total + model.distinct))
            assert r.score == math.floor(math.exp(total / (len(r.segment.split()) - 1)) * 1e9 + 0.5) / 1e9
