"""Operator 4, embedding near-dedup: PCA-ordered tiled comparison.

Vectors are scaled to length one and turned onto their principal axes. Distinct vectors, ordered by
their leading coordinates, are cut into tiles; pairs of tiles whose bounding boxes on the leading axes lie
too far apart for the threshold are skipped. In a pair of tiles the leading dimensions are multiplied
first, with the norms of what is left of each vector as one more column, so that the product is an
upper bound of the cosine; pairs that cannot reach the threshold stop there, the others go on through more
dimensions, and what is left at the end is decided on the given vectors in double precision.

Copies of a vector collapse before anything is compared. A pair of tiles emits the number of links of
each vector and a spanning forest of its links, never all pairs. Any rotation gives right results, so
the axes decide the speed only; they come from all vectors, as a sum of d x d products.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or whose id is
null, links with nothing; a vector with fewer components than the longest counts as filled up with
zeros; vectors may have any length; repeated rows count as vectors of their own; an empty table gives an empty result; only the id
and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import store
from loomwright.llm.components import components
from loomwright.llm.simhash import _unite

_TILE_BYTES, _TILES = 32 << 20, 16
_BOX = 8  # leading coordinates of a bounding box
_MARGIN = 1e-4  # of single-precision bounds
_STRIP = 1 << 21  # pairs of vectors that are multiplied at once


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles, filled up with zeros; a row with a null is all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    value = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), dims))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.where(np.isfinite(value), value, 0)
    out[np.unique(row[bad | ~np.isfinite(value)])] = 0
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their size; zero rows stay zero."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(float).tiny)


def _axes(distinct: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes as columns, and the share of the squared length on each; d * d / 2 sums reach the driver."""
    upper = np.triu_indices(dims)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            u = _unit(np.frombuffer(b"".join(batch.column("v").to_pylist())).reshape(-1, dims))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], ["i", "s"])

    sums = distinct.select("v").mapInArrow(products, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    cov = np.zeros((dims, dims))
    for r in sums:
        cov[upper[0][r.i], upper[1][r.i]] = cov[upper[1][r.i], upper[0][r.i]] = r.s
    value, axes = np.linalg.eigh(cov)
    return np.ascontiguousarray(axes[:, ::-1]), value[::-1] / max(value.sum(), 1e-300)


def compare_tiles(x: np.ndarray, y: np.ndarray, axes: np.ndarray, steps: list[int], threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of x and y with a cosine of at least the threshold; i < j if both are one tile."""
    ux, uy = _unit(x), _unit(y)
    rx, ry = (ux @ axes).astype(np.float32), (uy @ axes).astype(np.float32)
    left_x = [np.sqrt(np.maximum((rx[:, m:].astype(float) ** 2).sum(axis=1), 0)).astype(np.float32) for m in steps]
    left_y = [np.sqrt(np.maximum((ry[:, m:].astype(float) ** 2).sum(axis=1), 0)).astype(np.float32) for m in steps]
    lead_y = np.ascontiguousarray(np.column_stack([ry[:, : steps[0]], left_y[0]]).T)
    height = max(1, _STRIP // max(len(y), 1))
    for top in range(0, len(x), height):
        rows = slice(top, top + height)
        bound = np.column_stack([rx[rows, : steps[0]], left_x[0][rows]]) @ lead_y
        i, j = np.nonzero(bound >= threshold - _MARGIN)
        i += top
        if same:
            i, j = i[i < j], j[i < j]
        dot = np.einsum("ij,ij->i", rx[i, : steps[0]], ry[j, : steps[0]])
        for s, (a, b) in enumerate(zip(steps, steps[1:], strict=False), 1):
            dot += np.einsum("ij,ij->i", rx[i, a:b], ry[j, a:b])
            on = dot + left_x[s][i] * left_y[s][j] >= threshold - _MARGIN
            i, j, dot = i[on], j[on], dot[on]
        exact = np.einsum("ij,ij->i", ux[i], uy[j]) >= threshold
        yield i[exact], j[exact]


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.95,
    tile_rows: int | None = None,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Returns key, n_links, component_id and kept for each row.

    Each tile is sent to the tiles its box allows: with unstructured vectors that is all of them, and the
    work is quadratic in their number with a small constant; with vectors that fill few dimensions it is not.
    The boxes, 128 bytes for each tile, are gathered on the driver. A tile has ``tile_rows`` vectors, by default as many as
    _TILE_BYTES hold, as a tile is copied once for each tile it meets; small inputs are cut into some tiles too.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    spark = vectors.sparkSession
    given = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    dims = given.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0
    if dims < 1:
        return given.select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            ok = x.any(axis=1) & ~batch.column("k").is_null().to_numpy(zero_copy_only=False)
            blob = [r.tobytes() if good else None for r, good in zip(x + 0.0, ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(blob, pa.binary())], ["k", "v"])

    rows = given.mapInArrow(clean, "k long, v binary").select("k", "v", F.xxhash64("v").alias("h"), F.hash("v").alias("g"))
    rows = store.materialize(rows, "vectors")
    linked_rows = rows.where(F.col("v").isNotNull())
    distinct = store.materialize(linked_rows.groupBy("h", "g").agg(F.min("k").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "distinct-vectors")
    size = distinct.count()
    if size:
        axes, share = _axes(distinct, dims)
        tiles = -(-size // tile_rows) if tile_rows else max(-(-size * dims * 8 // _TILE_BYTES), min(_TILES, -(-size // 1024)))
        links = _links(distinct, axes, share, threshold, max(1, tiles), dims)
    else:
        links = spark.createDataFrame([], "kind int, u long, v long")
    counts = links.where("kind = 0").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("other"))
    joined = components(links.where("kind = 1").select("u", "v")).select(F.col("u").alias("rep"), F.col("v").alias("root"))
    named = distinct.select("h", "g", "rep", "n").join(counts, "rep", "left").join(joined, "rep", "left")
    named = named.select(
        "h", "g", (F.coalesce("other", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")
    )
    some = linked_rows.select("k", "h", "g").join(named, ["h", "g"]).select("k", "n_links", "root")
    none = rows.where(F.col("v").isNull()).select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("root"))
    return some.unionAll(none).select(
        F.col("k").alias(key), "n_links", F.col("root").alias("component_id"), F.coalesce(F.col("k") == F.col("root"), F.lit(True)).alias("kept")
    )


def _links(distinct: DataFrame, axes: np.ndarray, share: np.ndarray, threshold: float, tiles: int, dims: int) -> DataFrame:
    """(kind, u, v): kind 0 has u's number of linked rows with another vector, kind 1 a link of the forest."""
    box = min(_BOX, dims)
    # The first step takes a quarter of the squared length; then twice as many dimensions each time.
    steps = [min(dims, max(4, int(np.searchsorted(np.cumsum(share), 0.25)) + 1))]
    while steps[-1] < dims:
        steps.append(min(dims, 2 * steps[-1]))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _unit(np.frombuffer(b"".join(batch.column("v").to_pylist())).reshape(-1, dims)) @ axes[:, :2]
            lead = [pa.array(u[:, min(i, dims - 1)]) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rep", "n", "v")], *lead], ["rep", "n", "v", "p", "q"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if len(b)]
        if not whole:
            return
        t = pa.Table.from_batches(whole)
        x = np.frombuffer(b"".join(t.column("v").to_pylist())).reshape(-1, dims)
        u = _unit(x) @ axes[:, :box]
        blobs = [t.column("rep").to_numpy().tobytes(), t.column("n").to_numpy().tobytes(), x.tobytes()]
        corners = [pa.array([c.tolist()], pa.list_(pa.float64())) for c in (u.min(axis=0), u.max(axis=0))]
        yield pa.RecordBatch.from_arrays([*[pa.array([b], pa.binary()) for b in blobs], *corners], ["ids", "ns", "x", "lo", "hi"])

    turned = distinct.mapInArrow(turn, "rep long, n long, v binary, p double, q double")
    dealt = turned.repartitionByRange(tiles, "p", "q", "rep").mapInArrow(pack, "ids binary, ns binary, x binary, lo array<double>, hi array<double>")
    packed = store.materialize(dealt.withColumn("tile", F.monotonically_increasing_id()), "tiles")
    boxes = sorted(packed.select("tile", "lo", "hi").collect())
    names = np.array([b.tile for b in boxes], np.int64)
    lows, highs = np.array([b.lo for b in boxes]), np.array([b.hi for b in boxes])
    shared = distinct.sparkSession.sparkContext.broadcast((names, lows, highs))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lows, highs = shared.value
        for batch in batches:
            for r, tile in enumerate(batch.column("tile").to_pylist()):
                a = int(np.searchsorted(names, tile))
                gap = np.maximum(0, np.maximum(lows - highs[a], lows[a] - highs))
                near = np.flatnonzero(1 - (gap**2).sum(axis=1) / 2 >= threshold - 1e-9)
                own = batch.slice(r, 1)
                for b in near.tolist():
                    lo, hi = min(a, b), max(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([hi]), pa.array([a]), *[own.column(c) for c in ("ids", "ns", "x")]], ["a", "b", "own", "ids", "ns", "x"])

    def meet(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("own")
        parts = [tuple(np.frombuffer(cell.column(c)[r].as_py(), kind) for c, kind in (("ids", np.int64), ("ns", np.int64), ("x", np.float64))) for r in range(len(cell))]
        same = len(parts) == 1
        (ids, ns, x), (ids_y, ns_y, y) = parts[0], parts[-1]
        x, y = x.reshape(-1, dims), y.reshape(-1, dims)
        shift = 0 if same else len(ids)
        label = np.arange(len(ids) + (0 if same else len(ids_y)))
        seen = np.zeros(len(label), np.int64)
        for i, j in compare_tiles(x, y, axes, steps, threshold, same):
            np.add.at(seen, i, ns_y[j])
            np.add.at(seen, j + shift, ns[i])
            _unite(label, i, j + shift)
        every = ids if same else np.concatenate([ids, ids_y])
        linked, moved = np.flatnonzero(seen), np.flatnonzero(label != np.arange(len(label)))
        kind = np.repeat(np.array([0, 1], np.int32), [len(linked), len(moved)])
        return pa.table({"kind": kind, "u": np.concatenate([every[linked], every[moved]]), "v": np.concatenate([seen[linked], every[label[moved]]])})

    cells = packed.select("tile", "ids", "ns", "x").mapInArrow(send, "a long, b long, own long, ids binary, ns binary, x binary")
    return store.materialize(cells.groupBy("a", "b").applyInArrow(meet, "kind int, u long, v long"), "vector-links")
