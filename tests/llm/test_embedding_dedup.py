"""Embedding near-dedup against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm.embedding_dedup import near_duplicates


def data(dims, n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 5, dims))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * rng.choice([0.05, 0.15, 0.3], (n, 1))
    rows = [(int(i) + 50, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(7, rows[0][1]), (8, rows[0][1]), (9, [3 * v for v in rows[0][1]]), (1, None), (2, [0.0] * dims), (3, []), (4, [float("nan")] + [1.0] * (dims - 1)), (5, [None] + [1.0] * (dims - 1)), (6, [float("inf")] * dims), (10, [1.0]), (11, [2.0] + [0.0] * (dims - 1))]
    return rows


def brute(rows, threshold, dims):
    x = np.zeros((len(rows), dims))
    for i, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v):
            x[i, : len(v)] = v
    norm = np.linalg.norm(x, axis=1)
    cos = (x @ x.T) / np.maximum(np.outer(norm, norm), 1e-300)
    near = cos >= threshold
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    root = list(range(len(rows)))
    while True:
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))], key=lambda r: ids[r]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    return sorted((ids[i], int(near[i].sum()), ids[root[i]], ids[i] == ids[root[i]]) for i in range(len(rows)))


@pytest.mark.parametrize(("dims", "n", "tile"), [(16, 300, 60), (3, 200, 40), (64, 150, 4096), (1, 20, 5)])
def test_matches_brute_force(spark, dims, n, tile):
    rows = data(dims, n, dims)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash"))
    out = near_duplicates(df, 0.95, tile_rows=tile).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == brute(rows, 0.95, dims)


def test_empty_and_null_id(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicates(df).count() == 0
    out = near_duplicates(spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in out) == [(0, 0, True), (3, 0, True)]
