"""Substring dedup against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import substring_dedup
from loomwright.llm.substring_dedup import remove_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n):
    toks = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in toks for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(rows, toks, strict=True):
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def data(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "É", "x,"]
    passages = [rng.choices(vocab, k=rng.randint(5, 40)) for _ in range(12)]
    rows = []
    for i in range(90):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.5 else rng.choices(vocab, k=rng.randint(1, 15))
            if rng.random() < 0.3 and w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a " * 50), (205, "x y " * 30), (206, "q " + "p1 p2 " * 40 + "r"), (207, "p1 p2 " * 12), (204, "long " + "z" * 9000), (7, rows[7][1]), (7, "other text of the same id"), (None, rows[3][1])]
    return rows


@pytest.mark.parametrize(("window", "anchor", "hot"), [(8, 4, 10_000), (8, 3, 2), (5, 5, 10_000), (10, 1, 3)])
def test_matches_brute_force(spark, window, anchor, hot):
    rows = data(window + anchor)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("removed", F.lit("clash")).withColumn("h", F.lit(1))
    out = remove_duplicates(df, window, anchor, hot).collect()
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in out if r.doc_id is not None])
    want = brute([(d if d is not None else -1, t) for d, t in rows], window)
    assert got == [r for r in want if r[0] != -1]
    assert [(r.n_words, r.n_removed, r.text) for r in out if r.doc_id is None] == [r[1:] for r in want if r[0] == -1]
    assert all(r.n_removed == sum(x["last"] - x["first"] + 1 for x in r.removed) for r in out)


def test_anchors_of_a_huge_text_do_not_depend_on_its_size(monkeypatch):
    rng = np.random.default_rng(1)
    vocab = rng.integers(1 << 40, size=5000).astype(np.uint64)
    make = lambda n: substring_dedup.words.scramble(vocab[rng.integers(0, 5000, n)])
    tail = make(3000)
    alone, huge = tail, np.concatenate([make((1 << 22) + 10_000), tail])

    def anchors(hashes):
        w = substring_dedup.words.Words(None, None, None, None, np.array([0, len(hashes)]))
        h, place, lo, hi = substring_dedup._anchors(w, hashes, 35, 16)
        base = len(hashes) - len(tail)
        inside = lo >= base
        return {(int(a), int(p - base)) for a, p in zip(h[inside], place[inside], strict=True)}

    assert len(anchors(alone)) > 100 and anchors(alone) - anchors(huge) <= {min(anchors(alone), key=lambda x: x[1])}
    for starts in (1, 7, 100):  # lots of windows of any size give the same anchors
        whole = anchors(alone)
        monkeypatch.setattr(substring_dedup, "_STARTS", starts)
        assert anchors(alone) == whole
        monkeypatch.undo()


def test_copies_of_one_phrase_in_one_task(spark):
    rng = random.Random(9)
    shared = " ".join(f"s{rng.randrange(99)}" for _ in range(20))
    rows = [(i, f"{shared} u{i} " + " ".join(f"v{i}x{j}" for j in range(9))) for i in range(300)] + [(300, None), (301, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = remove_duplicates(df, 8, 4)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()) == brute(rows, 8)


def test_empty(spark):
    assert remove_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
