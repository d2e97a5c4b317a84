"""Exact and greedy near-duplicate removal, overlaps within clusters, training pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import jaccard, word_set
from loomwright.operators.storage import drop, keep, spread
from loomwright.operators.unify import first_independent_set

#: Words whose numbers of rows close_pairs broadcasts, the most common ones; all others count as rarer than these.
COMMON_WORDS = 1 << 20
#: Word hashes of a tile of word sets, and rows of it that are compared at once.
TILE_WORDS, TILE_STEP = 2 << 20, 1024
#: A word that this share of both sides holds is counted by a matrix product, a rarer one by listing its pairs.
DENSE = 0.05


def first_occurrences(rows: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The first row of each distinct text by ``order``: a partial minimum, so a common text costs one row a task."""
    order = order or ["ord"]
    rest = [c for c in rows.columns if c not in (*order, text)]
    best = rows.groupBy(text).agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select(*[F.col(text) if c == text else F.col(f"b.{c}").alias(c) for c in rows.columns])


def overlaps(rows: DataFrame, cluster: str, key: str = "ord", text: str = "text") -> DataFrame:
    """(cluster, i, j, overlap) for i < j within each cluster: Jaccard similarity of their word sets."""
    sets = rows.select(F.col(cluster).alias("g"), F.col(key).alias("k"), word_set(F.col(text)).alias("w"))
    a, b = sets.alias("a"), sets.alias("b")
    paired = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.k") < F.col("b.k")))
    return paired.select(F.col("a.g").alias(cluster), F.col("a.k").alias("i"), F.col("b.k").alias("j"), jaccard(F.col("a.w"), F.col("b.w")).alias("overlap"))


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, row of each, sizes) of word sets."""
    sizes = np.array([len(w) for w in sets], np.int64)
    return np.concatenate([*sets, np.zeros(0, np.int64)]), np.repeat(np.arange(len(sets)), sizes), sizes


def _in_common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of words in common of all pairs of two lists of word sets."""
    (wa, ra, _), (wb, rb, _) = _flat(a), _flat(b)
    words = np.intersect1d(wa, wb)
    out = np.zeros(len(a) * len(b))
    if len(words):
        def places(w, r):
            at = np.searchsorted(words, w)
            ok = words[np.minimum(at, len(words) - 1)] == w
            return at[ok], r[ok]

        (pa_, ra), (pb, rb) = places(wa, ra), places(wb, rb)
        na, nb = (np.bincount(p, minlength=len(words)) for p in (pa_, pb))
        dense = na * nb > DENSE**2 * len(a) * len(b)
        column = np.cumsum(dense) - 1
        x, y = np.zeros((len(a), dense.sum()), np.float32), np.zeros((len(b), dense.sum()), np.float32)
        for m, p, r in ((x, pa_, ra), (y, pb, rb)):
            m[r[dense[p]], column[p[dense[p]]]] = 1
        out += (x @ y.T).ravel()
        # The rest: each row of a with a word meets all rows of b with it, which lie together in the order of words.
        pa_, ra = pa_[~dense[pa_]], ra[~dense[pa_]]
        pb, rb = pb[~dense[pb]], rb[~dense[pb]]
        rb = rb[np.argsort(pb, kind="stable")]
        few = np.where(dense, 0, nb)
        start, each = (np.cumsum(few) - few)[pa_], few[pa_]
        # Some millions of pairs at once.
        for rows in np.split(np.arange(len(pa_)), np.flatnonzero(np.diff(np.cumsum(each) >> 22)) + 1):
            n = each[rows]
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[rows], n)
            out += np.bincount(np.repeat(ra[rows], n) * len(b) + rb[i], minlength=len(out))
    return out.reshape(len(a), len(b))


def _cohesion(cell: pa.Table) -> pa.Table:
    """Pairs of two tiles, or of one: their number, and sum and maximum of their overlaps."""
    cell = cell.sort_by("tile")
    tiles = [([np.frombuffer(w, np.int64) for w in words], np.array(keys)) for words, keys in zip(cell.column("w").to_pylist(), cell.column("k").to_pylist(), strict=True)]
    one = cell.column("a")[0].as_py() == cell.column("b")[0].as_py()
    n, total, top = 0, 0.0, None
    if one or len(tiles) == 2:
        (a, ka), (b, kb) = tiles[0], tiles[-1]
        for i in range(0, len(a), TILE_STEP):
            for j in range(i if one else 0, len(b), TILE_STEP):
                x, y, kx, ky = a[i : i + TILE_STEP], b[j : j + TILE_STEP], ka[i : i + TILE_STEP], kb[j : j + TILE_STEP]
                both = _in_common(x, y)
                sizes = np.array([len(w) for w in x])[:, None] + np.array([len(w) for w in y])
                pairs = (kx[:, None] < ky) if one and i == j else (kx[:, None] != ky)
                each = (both / np.maximum(sizes - both, 1))[pairs]
                if len(each):
                    n, total, top = n + len(each), total + float(each.sum()), max(top or 0.0, float(each.max()))
    return pa.table({"g": cell.column("g")[:1], "n": pa.array([n], pa.int64()), "s": pa.array([total], pa.float64()), "m": pa.array([top], pa.float64())})


def cluster_cohesion(rows: DataFrame, cluster: str, key: str = "ord", text: str = "text") -> DataFrame:
    """(cluster, pairs, mean_overlap, max_overlap) over all pairs of a cluster.

    All pairs are compared, in cells of two tiles of one cluster of some TILE_WORDS word hashes each, so memory is bounded and any
    number of tasks share a cluster; the time grows with the square of its rows. Words are 64-bit hashes; keys are whole numbers.
    """
    given = spread(rows.select(F.col(cluster).alias("g"), F.col(key).cast("long").alias("k"), F.col(text).alias("t"))).where("g is not null and k is not null")
    sets = keep(given.select("g", "k", _hashes(F.col("t")).alias("w")), "word-sets")
    # Tiles of a cluster by its number of words, and small enough that its cells are dealt out.
    sizes = sets.groupBy("g").agg(F.sum(F.size("w") + 16).alias("words"), F.count("*").alias("n"))
    tiles = sizes.select(F.col("g").alias("g_"), F.greatest(F.ceil(F.col("words") / TILE_WORDS), F.least(F.ceil(F.col("n") / TILE_STEP), F.lit(6))).alias("n_"))
    dealt = sets.join(F.broadcast(tiles), F.col("g") == F.col("g_")).withColumn("tile", F.pmod(F.xxhash64("k"), F.col("n_")))

    def pack(tile: pa.Table) -> pa.Table:
        words = [np.array(w, np.int64).tobytes() for w in tile.column("w").to_pylist()]
        return pa.table({"g": tile.column("g")[:1], "n_": tile.column("n_")[:1], "tile": tile.column("tile")[:1], "k": pa.array([tile.column("k").to_pylist()], pa.list_(pa.int64())), "w": pa.array([words], pa.list_(pa.binary()))})

    kind = dict(rows.select(F.col(cluster).alias("g")).dtypes)["g"]
    packed = keep(dealt.select("g", "n_", "tile", "k", "w").groupBy("g", "tile").applyInArrow(pack, f"g {kind}, n_ long, tile long, k array<long>, w array<binary>"), "tiles")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_") - 1))
    sent = packed.select("g", "tile", other.alias("o"), "k", "w").select("g", F.least("tile", "o").alias("a"), F.greatest("tile", "o").alias("b"), "tile", "k", "w")
    cells = sent.groupBy("g", "a", "b").applyInArrow(_cohesion, f"g {kind}, n long, s double, m double").where("n > 0")
    out = cells.groupBy("g").agg(F.sum("n").alias("pairs"), (F.sum("s") / F.sum("n")).alias("mean_overlap"), F.max("m").alias("max_overlap"))
    return out.withColumnRenamed("g", cluster)


def close_pairs(rows: DataFrame, cluster: str, min_overlap: float, key: str = "ord", text: str = "text") -> DataFrame:
    """(i, j, overlap) for i < j of one cluster with an overlap of at least ``min_overlap``, without comparing all pairs.

    Two sets that overlap so much share one of the first n - ceil(min_overlap * n) + 1 of their n words in any fixed order;
    the order is that of the number of rows with a word, so the first ones are those that fewest share. Only rows that share such a
    word, and whose sizes and places in the order allow the overlap, are compared. Words are 64-bit hashes.
    """
    rows = spread(rows.select(F.col(cluster).alias("g"), F.col(key).alias("k"), F.col(text).alias("t")))
    words = rows.select("g", "k", _hashes(F.col("t")).alias("w")).where(F.size("w") > 0)
    return _close(keep(words, "word-sets"), min_overlap)


def _hashes(text: Column) -> Column:
    """Hashes of the distinct words of a text, in order."""
    return F.array_sort(F.transform(word_set(text), lambda x: F.xxhash64(x)))


def _common(sets: DataFrame) -> pa.Table:
    """(x, count) of the words that most rows hold, at most COMMON_WORDS of them, by their hash."""
    held = keep(sets.select(F.explode("w").alias("x")).groupBy("x").count().where("count > 1"), "word-counts")
    # One row for each number of rows; of them there are few, as their sum is that of all words.
    room, least = COMMON_WORDS, None
    for r in held.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).toLocalIterator():
        room -= r.n
        if room < 0:
            break
        least = r["count"]
    out = held.where(F.lit(False) if least is None else F.col("count") >= least).toArrow().sort_by("x")
    drop(held)
    return out


def _close(sets: DataFrame, min_overlap: float) -> DataFrame:
    """close_pairs of word sets (g, k, w), as hashes in order."""
    spark, kinds = sets.sparkSession, dict(sets.dtypes)
    common = _common(sets)
    shared = spark.sparkContext.broadcast((common.column("x").to_numpy(), common.column("count").to_numpy()))
    # A little below the threshold, so that rounding loses no pair.
    least = min_overlap - 1e-9

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = shared.value
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                w = batch.column("w").flatten().to_numpy()
                n = batch.column("w").value_lengths().to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                held = np.zeros(len(w), np.int64)
                if len(words):
                    at = np.minimum(np.searchsorted(words, w), len(words) - 1)
                    held = np.where(words[at] == w, counts[at], 0)
                order = np.lexsort((w, held, row))
                place = np.arange(len(w)) - (np.cumsum(n) - n)[row]
                took = place < np.maximum(n - np.ceil(least * n).astype(np.int64) + 1, 1)[row]
                at = pa.array(row[took])
                yield pa.RecordBatch.from_arrays([batch.column("g").take(at), batch.column("k").take(at), pa.array(n[row[took]].astype(np.int32)), pa.array(place[took].astype(np.int32)), pa.array(w[order][took])], ["g", "k", "n", "p", "h"])

    marks = keep(sets.mapInArrow(first, f"g {kinds['g']}, k {kinds['k']}, n int, p int, h long"), "marks")
    a, b = marks.alias("a"), marks.alias("b")
    alike = (F.col("a.g") == F.col("b.g")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.k") < F.col("b.k"))
    sized = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(least)
    # The first word in common has none in common before it, so no more than what follows it on either side.
    reach = F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p")) >= (F.col("a.n") + F.col("b.n")) * F.lit(least / (1 + least))
    pairs = a.join(b, alike & sized & reach).select(F.col("a.k").alias("i"), F.col("b.k").alias("j")).distinct()
    pairs = keep(pairs, "candidates")
    left, right = sets.select(F.col("k").alias("i"), F.col("w").alias("x")), sets.select(F.col("k").alias("j"), F.col("w").alias("y"))
    compared = pairs.join(left, "i").join(right, "j").select("i", "j", jaccard(F.col("x"), F.col("y")).alias("overlap"))
    return compared.where(F.col("overlap") >= min_overlap)


def drop_near_duplicates(rows: DataFrame, cluster: str, max_overlap: float = 0.92, key: str = "ord", text: str = "text") -> DataFrame:
    """Keeps a row if its overlap with every kept earlier row of its cluster is below ``max_overlap``.

    Keys are unique. Rows without words overlap with nothing.
    """
    given = spread(rows.select(F.col(cluster).alias("g"), F.col(key).alias("k"), F.col(text).alias("t")))
    sets = keep(given.select("g", "k", _hashes(F.col("t")).alias("w")), "word-sets")
    # Of rows with one word set only the first can stay, and what is close to one is close to all.
    name = [F.xxhash64("w").alias("h1"), F.hash("w", F.size("w")).alias("h2")]
    own = F.when(F.size("w") == 0, F.col("k")).alias("own")
    firsts = keep(sets.select("g", "k", own, *name).groupBy("g", "own", "h1", "h2").agg(F.min("k").alias("k")).select("k"), "first-rows")
    distinct = keep(sets.where(F.size("w") > 0).join(firsts, "k", "left_semi"), "distinct-sets")
    drop(sets)
    close = _close(distinct, max_overlap).select("i", "j")
    state = first_independent_set(firsts, close)
    return rows.join(state.where("leader").select(F.col("k").alias(key)), key, "left_semi")


def training_pairs(rows: DataFrame, cluster: str = "cluster_id", key: str = "ord", text: str = "text") -> DataFrame:
    """(cluster, anchor, positive): the shortest text in characters (the first on a tie) with every member, both ways.

    (member, canonical) is left out where both are the same text; (canonical, member) is not.
    """
    best = F.min(F.struct(F.char_length(text).alias("n"), F.col(key).alias("k"), F.col(text).alias("t"))).over(Window.partitionBy(cluster))
    named = rows.withColumn("c", best["t"])
    forth = named.where(F.col(text) != F.col("c")).select(cluster, F.col(text).alias("anchor"), F.col("c").alias("positive"))
    return forth.unionAll(named.select(cluster, F.col("c").alias("anchor"), F.col(text).alias("positive")))


def shortest_by_tokens(rows: DataFrame, cluster: str, tokens: str = "token_count", key: str = "ord", text: str = "text") -> DataFrame:
    """(cluster, key, tokens, text): the member with the fewest tokens, the first on a tie."""
    best = rows.groupBy(cluster).agg(F.min(F.struct(F.col(tokens).alias("n"), F.col(key).alias("k"), F.col(text).alias("t"))).alias("b"))
    return best.select(cluster, F.col("b.k").alias(key), F.col("b.n").alias(tokens), F.col("b.t").alias(text))
