"""Toxicity: the label model, held-out accuracy and edge cases."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomwright.llm import toxicity
from loomwright.llm.toxicity import fit, held_out, label_model, score


def corpus(n, seed=0):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeghimnoprst", k=rng.randint(2, 8))) for _ in range(400)]
    bad = ["zzork", "quuxl", "vlimp"]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randint(3, 80))
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "a", "er", "ing"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_label_model_finds_good_voters_and_repeats():
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.2).astype(int)
    flip = lambda p: np.where(rng.random(4000) < p, 1 - y, y)
    good, fair, poor, noise = flip(0.05), flip(0.1), flip(0.3), rng.integers(0, 2, 4000)
    votes = np.column_stack([good, fair, poor, poor, noise])
    given = flip(0.15)
    post, accuracy, correlation = label_model(votes, toxicity._rates(votes, given), given.mean())
    assert accuracy[0] > 0.9 > accuracy[2] > 0.6 > accuracy[4] > 0.4
    assert correlation[2, 3] > 0.9 and abs(correlation[0, 4]) < 0.1
    # Nearer the truth than the labels that were given, which it doesn't repeat.
    assert ((post > 0.5) == y).mean() > 0.93 > (given == y).mean()
    assert ((post > 0.5) != given).mean() > 0.1


def plain_features(text):
    found = set(re.findall("[a-z\x80-\U0010ffff]+", text.lower()))
    return {(0, w) for w in found} | {(n, w[:n]) for n in (4, 5, 6) for w in found if len(w) >= n}


def plain_shapes(text):
    n, letters = max(len(text), 1), max(len(re.findall("[A-Za-z\x80-\U0010ffff]", text)), 1)
    spaced = re.findall("[^\\x20\\x09-\\x0D]+", text)
    return [
        len(re.findall("[A-ZÀ-ÖØ-Þ]", text)) / letters,
        len(re.findall("[0-9]", text)) / n,
        len(re.findall(r"[!-/:-@\[-^`{-~]", text)) / n,
        min(1.0, 10 * text.count("!") / n),
        sum(a == b for a, b in zip(spaced, spaced[1:], strict=False)) / max(len(spaced), 1),
        float(n < 200),
    ]


def hashed(feature):
    n, w = feature
    data = np.frombuffer(w.encode(), np.uint8)
    return toxicity.words.scramble(toxicity.words.Words(data, None, np.array([0]), np.array([len(data)]), None).hashes() + toxicity._SALT[n])[0] if n else toxicity.words.Words(data, None, np.array([0]), np.array([len(data)]), None).hashes()[0]


def test_scores_are_those_of_a_plain_model():
    texts = ["", "One one Two!! zzorkish 12 a_b", "ÉTÉ été Ünder-über x" * 9, "long " * 70_000 + "ZZORK", None, "no such thing", "zzor quuxlingly"]
    weights = {(0, "one"): 1.5, (4, "zzor"): 2.0, (5, "zzork"): -0.5, (0, "été"): 0.7, (6, "quuxli"): 3.0, (4, "über"): 0.1}
    order = sorted(weights, key=hashed)
    model = toxicity.Model(np.array([hashed(f) for f in order], np.uint64), np.array([weights[f] for f in order]), np.array([0.3, -2.0, 1.0, 4.0, 0.5, -0.25]), -1.0)
    got = model.score(toxicity.pa.array(texts))
    for t, x in zip(texts, got.tolist(), strict=True):
        t = t or ""
        z = -1.0 + sum(weights.get(f, 0) for f in plain_features(t)) + float(np.dot(model.shapes, plain_shapes(t)))
        assert math.isclose(x, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_without_the_label_model_results_are_worse(spark):
    docs, labels = corpus(3000, 5)
    rng = random.Random(1)
    given = [(i, 1 - t if rng.random() < 0.33 else t) for i, t in labels]
    d, g = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(given, "doc_id long, toxic int")
    wrong = {}
    for weak in (True, False):
        out = {r.doc_id: r for r in score(d, fit(d, g, weak=weak)).withColumn("h", held_out("doc_id")).collect()}
        wrong[weak] = sum(out[i].predicted != labels[i][1] for i, _ in docs if out[i].h)
    assert wrong[False] >= 2 * wrong[True] + 10 and wrong[True] <= 10, wrong


def test_held_out_rows_are_scored_right(spark):
    docs, labels = corpus(1500)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    wrong = [(i, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, t) for i, t in labels]
    for given in (labels, wrong):  # held-out labels change nothing
        model = fit(d, spark.createDataFrame(given, "doc_id long, toxic int"))
        out = {r.doc_id: r for r in score(d, model).withColumn("h", held_out("doc_id")).collect()}
        test = [i for i, _ in docs if out[i].h]
        assert 200 < len(test) < 550
        assert all(out[i].h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in docs)
        assert np.mean([out[i].predicted == labels[i][1] for i in test]) > 0.98


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (4, "long " * 20000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(4, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    for labels in (none, one):
        out = score(docs, fit(docs, labels)).collect()
        assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    docs, labels = corpus(400, 3)
    d = spark.createDataFrame([*docs, docs[0], (None, docs[0][1])], "doc_id long, text string")
    out = score(d, fit(d, spark.createDataFrame([*labels, labels[0]], "doc_id long, toxic int")), keep=["doc_id"]).collect()
    assert len({r.score for r in out if r.doc_id in (None, 0)}) == 1 and len(out) == 402
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score(empty, fit(empty, none)).count() == 0
