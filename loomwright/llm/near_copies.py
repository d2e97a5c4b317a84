"""Near copies by exact Jaccard similarity of word shingles; SimHash links are a first guess.

Texts with the same set of shingles are one node. Two sets with a similarity of 4/5 share one of their first
n - ceil(4n/5) + 1 shingles in any order that holds for all sets; so each such shingle is a bucket, and the pairs
within buckets are all that there are to test. The order puts shingles that are common in a sample last, which
keeps buckets small and changes no result. Lengths, places and a 512-bit parity sketch rule out pairs
that can't reach the threshold. Pairs left are compared by parities at two places or more a shingle, a sixteenth or an eighth of
the sets, and what passes, of which few are no copies, is decided on the whole sets.

Buckets are read twice: first each node meets the first of its bucket (and its SimHash links), and what passes is
joined; then only pairs across components are tested, so a large group of copies doesn't cost its square.

Defined cases: case (A-Z) and white space don't count; fewer words than a shingle are one shingle; null and wordless
texts are copies of each other and of nothing else; texts are compared whole; each row is judged by its own text, whatever
its key: rows of one key may be in several groups; a row with a null key is compared like any other, comes after all keys
and names no component; repeated rows are all kept or all not; an empty table gives an empty result; only the key and the
text are read. Equality of shingles is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm import simhash, store, words
from loomwright.llm.components import components

_SKETCH = 512
_SAMPLE, _COMMON = 20_000, 100_000  # rows sampled for the order; shingles it puts last
_CHUNK = 1 << 16  # pairs compared at once
_BYTES, _ROWS = 1 << 18, 1024  # texts handled at once


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words.release()
    for batch in batches:
        for row in range(0, len(batch), _ROWS):
            yield batch.slice(row, _ROWS)
    words.release()


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, data, offsets in words.blocks(column, _BYTES, lower=True):
        w = words.split_words(data, offsets, words.SPACED)
        hashes = w.hashes()
        grams = words.gram_hashes(hashes, shingle)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            yield np.unique(grams[a : b - shingle + 1] if b - a >= shingle else words.gram_hashes(hashes[a:b], max(b - a, 1)))


def _node(s: np.ndarray) -> int:
    """Names a set."""
    if not len(s):
        return 0
    return int(words.scramble(words.scramble(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the set's shingles by place; two sketches differ in no more bits than sets in shingles."""
    return np.packbits(np.bincount((s >> np.uint64(7)).astype(np.int64) % _SKETCH, minlength=_SKETCH) & 1 == 1).tobytes()


def _parities(s: np.ndarray) -> bytes:
    """A sketch like ``_sketch`` with a power of two of places, two a shingle at least."""
    places = max(_SKETCH, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(7)).astype(np.int64) & (places - 1), minlength=places) & 1 == 1).tobytes()


def _may_reach(x: bytes, y: bytes, both: int) -> bool:
    """Whether sets with these parities, of ``both`` shingles together, may have a similarity of 4/5."""
    x, y = (np.frombuffer(z, np.uint64) for z in (x, y))
    small = min(len(x), len(y))
    # Folded, the longer sketch is that of its set with fewer places.
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, small), axis=0) for z in (x, y))
    return bool(9 * np.bitwise_count(x ^ y).sum(dtype=np.int64) <= both)


def _reaches(x: bytes, y: bytes, both: int) -> bool:
    """Whether two sets have a similarity of 4/5."""
    x, y = (np.frombuffer(z, np.uint64) for z in (x, y))
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * both


def _nodes(docs: DataFrame, shingle: int) -> DataFrame:
    """(k, r, node, n, sketch, fp) of each row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [(_node(s), len(s), _sketch(s)) for s in shingle_sets(batch.column("t"), shingle)]
            node, n, sketch = zip(*sets, strict=True) if sets else ((), (), ())
            fp = simhash.fingerprints(batch.column("t"), shingle, _BYTES).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("r"), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(sketch, pa.binary()), pa.array(fp)], ["k", "r", "node", "n", "sketch", "fp"])

    return docs.mapInArrow(mark, "k long, r long, node long, n int, sketch binary, fp long")


def _common(docs: DataFrame, rows: int, shingle: int) -> np.ndarray:
    """Shingles that a sample of rows holds more than twice, the most common last."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in shingle_sets(batch.column("t"), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["h"])

    sample = docs.where(F.pmod(F.xxhash64("r", F.lit("sample")), F.lit(max(1, rows // _SAMPLE))) == 0)
    counts = sample.mapInArrow(spread, "h long").groupBy("h").count().where("count > 2")
    found = counts.orderBy(F.desc("count"), "h").limit(_COMMON).select("h").toArrow()
    return found.column("h").to_numpy()[::-1].view(np.uint64)


def _plant(docs: DataFrame, common: np.ndarray, shingle: int) -> DataFrame:
    """(h, node, n, place): the first shingles of each set, in the order of all."""
    order = np.argsort(common)
    known = common[order]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out: list[tuple[np.ndarray, ...]] = []
            for s in shingle_sets(batch.column("t"), shingle):
                rank = np.full(len(s), -1)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, order[at], -1)
                first = s[np.argsort(rank, kind="stable")][: len(s) - (4 * len(s) + 4) // 5 + 1] if len(s) else s
                m = len(first)
                out.append((first.view(np.int64), np.full(m, _node(s)), np.full(m, len(s), np.int32), np.arange(m, dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["h", "node", "n", "place"])

    return docs.mapInArrow(plant, "h long, node long, n int, place int")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets, some at a time, of rows sorted by h."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        h = batch.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        if cut or (held and held[-1].column("h")[-1].as_py() != h[0]):
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
        held = []
    words.release()


def _shared(planted: DataFrame, partitions: int) -> DataFrame:
    """Rows of buckets with two nodes or more, each node once."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_bucket(batches):
            h, node = table.column("h").to_numpy(), table.column("node").to_numpy()
            new = np.concatenate([[True], h[1:] != h[:-1]])
            once = np.flatnonzero(new | np.concatenate([[True], node[1:] != node[:-1]]))
            start = np.flatnonzero(new[once])
            size = np.diff(np.append(start, len(once)))
            rows = once[np.repeat(size > 1, size)]
            if len(rows):
                yield from table.take(pa.array(rows)).combine_chunks().to_batches()

    dealt = planted.repartition(partitions, "h").sortWithinPartitions("h", "node")
    return dealt.mapInArrow(keep, planted.schema)


def _pairs(rows: DataFrame, partitions: int, first_only: bool) -> DataFrame:
    """(u, v): pairs of a bucket with different labels that may reach the threshold; or those with its first row."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_bucket(batches):
            h, node, label, n, place = (table.column(c).to_numpy() for c in ("h", "node", "label", "n", "place"))
            n, place = n.astype(np.int64), place.astype(np.int64)
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, _SKETCH // 64)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
            out: list[np.ndarray] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                i = a
                while i < (a + 1 if first_only else b):
                    # Rows are sorted by label: the rows of one label meet those behind it only.
                    own = i + int(np.searchsorted(label[i:b], label[i], side="right"))
                    if first_only:
                        own = i + 1
                    many = own - i > 1
                    step = max(1, _CHUNK // (b - a))
                    x = np.arange(i, min(own if many else b, i + step, a + 1 if first_only else b))
                    y = np.arange(own, b)
                    if len(x) and len(y):
                        both = n[x][:, None] + n[y]
                        ok = (label[x][:, None] < label[y]) if not first_only else (label[x][:, None] != label[y])
                        ok &= 5 * np.minimum(n[x][:, None], n[y]) >= 4 * np.maximum(n[x][:, None], n[y])
                        ok &= 9 * np.minimum((n - place)[x][:, None], (n - place)[y]) >= 4 * both
                        p, q = np.nonzero(ok)
                        far = np.bitwise_count(sketch[x[p]] ^ sketch[y[q]]).sum(axis=1, dtype=np.int64)
                        near = 9 * far <= both[p, q]
                        out.append(np.stack([node[x[p[near]]], node[y[q[near]]]]))
                    i = int(x[-1]) + 1
            if out:
                u, v = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    dealt = rows.repartition(partitions, "h").sortWithinPartitions("h", "label", "node")
    return dealt.mapInArrow(meet, "u long, v long")


def _candidates(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller node first."""
    return pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _passing(tables: store.Tables, pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, describe: Callable[[np.ndarray], bytes], test: Callable[[bytes, bytes, int], bool]) -> DataFrame:
    """Those of the pairs whose sets, as described, pass the test; the table of the pairs goes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [(_node(s), len(s), describe(s)) for s in shingle_sets(batch.column("t"), shingle)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*sets, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["node", "n", "s"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x, y, both = (batch.column(c) for c in ("x", "y", "both"))
            yes = pa.array([test(a.as_buffer(), b.as_buffer(), n.as_py()) for a, b, n in zip(x, y, both, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(yes) for c in ("u", "v")], ["u", "v"])

    wanted = tables.put(nodes.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi").select("node", "rep"), "wanted")
    # Repeated rows have one set: it stays once.
    sets = docs.join(wanted.select(F.col("rep").alias("r")).distinct(), "r", "left_semi").select("t").mapInArrow(gather, "node long, n long, s binary")
    sets = tables.put(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
    one, other = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(s)) for c, s in (("u", "x"), ("v", "y")))
    full = pairs.join(one, "u").join(other, "v").select("u", "v", "x", "y", (F.col("nu") + F.col("nv")).alias("both"))
    out = tables.put(full.mapInArrow(decide, "u long, v long"), "passing")
    tables.drop(wanted, sets, pairs)
    return out


def _similar(tables: store.Tables, pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """Those of the pairs of nodes whose sets have a similarity of 4/5 or more."""
    close = _passing(tables, pairs, docs, nodes, shingle, _parities, _may_reach)
    return _passing(tables, close, docs, nodes, shingle, np.ndarray.tobytes, _reaches)


def row_hash(key: str, text: str) -> Column:
    """Names a row by its key and text."""
    return F.xxhash64(key, text)


def near_copies(docs: DataFrame, shingle: int = 5, max_distance: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key, row (its row_hash), component_id (smallest key reachable by similarities of 4/5 or more) and kept for
    each row: of a component, the row with the smallest key and of those the one with the smallest hash is kept.

    Batches for Python are small meanwhile: pairs bring two sets each, which stand outside of the heap. A job's shuffle files
    go when it ends, not when the driver happens to collect its garbage.
    """
    small, clean = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with store.settings(docs.sparkSession, **{small: "2m", clean: "true"}):
        return _near_copies(docs, shingle, max_distance, key, text)


def _near_copies(docs: DataFrame, shingle: int, max_distance: int, key: str, text: str) -> DataFrame:
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = store.Tables(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), row_hash(key, text).alias("r"), F.col(text).alias("t"))
    marked = tables.put(_nodes(rows, shingle), "shingle-nodes")
    by_node = [F.min("r").alias("rep"), F.min("k").alias("least"), F.min("sketch").alias("sketch")]
    nodes = tables.put(marked.groupBy("node").agg(*by_node), "distinct-sets")

    # SimHash: the nodes of a fingerprint with the least of them, and the links of these.
    prints = marked.select("fp", "node").distinct()
    least = tables.put(prints.groupBy("fp").agg(F.min("node").alias("rep")), "distinct-fingerprints")
    guessed = prints.join(least, "fp").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    guessed = guessed.unionAll(simhash.link_fingerprints(least, max_distance))

    common = _common(rows, marked.count(), shingle)
    shared = tables.put(_shared(_plant(rows, common, shingle), partitions), "shared-shingles")
    seen = shared.join(nodes.select("node", "sketch"), "node")
    stars = _pairs(seen.withColumn("label", F.col("node")), partitions, True)
    met = tables.put(_candidates(stars.unionAll(guessed)), "pairs")
    tables.drop(least)
    links = _similar(tables, met, rows, nodes, shingle)
    joined = components(links).withColumnRenamed("u", "node").withColumnRenamed("v", "to")
    labelled = seen.join(joined, "node", "left").withColumn("label", F.coalesce("to", "node")).drop("to")
    across = tables.put(_candidates(_pairs(labelled, partitions, False)), "pairs")
    tables.drop(shared)
    links = links.unionAll(_similar(tables, across, rows, nodes, shingle))

    joined = components(links).withColumnRenamed("u", "node").withColumnRenamed("v", "to")
    named = tables.put(nodes.select("node", "least").join(joined, "node", "left").select("node", "least", F.coalesce("to", "node").alias("to")), "named")
    by_name = named.select("node", "to").join(named.groupBy("to").agg(F.min("least").alias("component_id")), "to")
    # The one table that stays: the result reads it.
    member = store.materialize(marked.select("k", "r", "node").join(by_name, "node"), "members")
    tables.drop(*tables.paths)
    # Few rows have their component's key, so this is little to shuffle whatever the group's size.
    first = member.where(F.col("k").eqNullSafe(F.col("component_id"))).groupBy("to").agg(F.min("r").alias("first"))
    kept = F.col("k").eqNullSafe(F.col("component_id")) & (F.col("r") == F.col("first"))
    return member.join(first, "to").select(F.col("k").alias(key), F.col("r").alias("row"), "component_id", kept.alias("kept"))
