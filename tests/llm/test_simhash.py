"""SimHash near-dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwright.llm.components import components
from loomwright.llm.simhash import Ranges, hex_fingerprint, link_fingerprints, near_duplicates, self_join


def brute_fp(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_trie_join_finds_every_component():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    for spread in (1, 3, 6):
        flips = np.zeros(600, np.uint64)
        for _ in range(spread):
            flips ^= np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)
        v = np.unique(rng.choice(centres, 600) ^ flips)
        label = self_join(v, np.array([0, len(v)]), 0, 4)
        near = [(i, j) for i in range(len(v)) for j in range(i) if bin(int(v[i] ^ v[j])).count("1") <= 4]
        assert label.tolist() == roots(len(v), near)


@pytest.mark.parametrize("dense", [8, 60, 1 << 18])
def test_dense_subtries_are_split(spark, dense):
    rng = np.random.default_rng(7)
    # Half of the fingerprints share their first 30 bits, so that some subtries of many tries are dense.
    v = rng.integers(0, 1 << 62, 700, dtype=np.uint64)
    v[:350] = (np.uint64(0xABCDEF1) << np.uint64(34)) | (v[:350] & np.uint64((1 << 18) - 1))
    v = np.unique(v)
    df = spark.createDataFrame([(int(x.view(np.int64)), i) for i, x in enumerate(v)], "fp long, rep long").repartition(3)
    links = [(r.u, r.v) for r in link_fingerprints(df, 4, dense).collect()]
    near = [(i, j) for i in range(len(v)) for j in range(i) if bin(int(v[i] ^ v[j])).count("1") <= 4]
    assert roots(len(v), links) == roots(len(v), near)
    assert len(set(roots(len(v), near))) < len(v)


def test_ranges_keep_all_that_may_link():
    rng = np.random.default_rng(3)
    leaf = np.unique((np.uint64(0x2A5) << np.uint64(54)) | rng.integers(0, 1 << 54, 400, dtype=np.uint64))
    signed = (leaf ^ np.uint64(1 << 63)).view(np.int64)
    ranges = Ranges({5: signed[19:-1:20]}, 4)
    place = ranges.place(5, signed)
    assert np.bincount(place).max() == 20
    partners = [set(ranges.partners(5, i, 10, int(leaf[0])).tolist()) for i in range(place.max() + 1)]
    for i in range(len(leaf)):
        for j in range(i):
            if bin(int(leaf[i] ^ leaf[j])).count("1") <= 4:
                assert place[j] in partners[place[i]] and place[i] in partners[place[j]]
    assert all(i in p for i, p in enumerate(partners)) and all((i in partners[j]) == (j in partners[i]) for i in range(len(partners)) for j in range(i))


def texts():
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(500)] + ["Élan", "É", "x-y"]
    out = [None, "", " \n", "one", "One\ttwo", "one two", "a b c d e", "A  B\nc d e"]
    for _ in range(25):
        base = rng.choices(vocab, k=rng.randint(20, 200))
        out.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(rng.choice([" ", "\n", "  "]).join(copy))
    return [(1000 - 3 * i, t) for i, t in enumerate(out)]


def test_near_duplicates_match_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("fp", F.lit("clash"))
    out = {r.doc_id: (r.h, r.component_id) for r in near_duplicates(df).withColumn("h", hex_fingerprint()).collect()}
    rows = sorted(rows)
    fps = [brute_fp(t, 4) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    assert out == {i: (f"{fp:016x}", rows[r][0]) for (i, _), fp, r in zip(rows, fps, root, strict=True)}
    assert len(set(root)) < len(rows) - 20


def test_null_keys(spark):
    rows = [(None, "same text here now"), (4, "same text here now"), (None, "quite another text of no id")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (0, 4), (4, 4)]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("shape", ["chain", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    links = {"chain": [(i, i + 1) for i in range(40)], "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "none": []}[shape]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.u: r.v for r in components(df).collect()}
    assert [got.get(i, i) for i in range(61)] == roots(61, links)
