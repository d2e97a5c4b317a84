"""Operator 6, SimHash near-dedup: a binary trie joined with itself.

Fingerprints are bit majorities over the XXH64 hashes of word shingles. Equal fingerprints collapse
first; the distinct ones are the leaves of a binary trie. The join walks pairs of trie nodes
together from (root, root), counts the levels at which the two paths differ, and drops a pair of
nodes as soon as that count passes the budget.

To spread the walk over a cluster the 64 levels are cut into ``max_distance`` + 2 blocks. Two
fingerprints within the budget agree on at least two whole blocks, so for every choice of two
blocks there is a trie with these levels on top, and its subtries below them, in which both
fingerprints stand under one node, are joined independently of each other. A subtrie is a run of
sorted numbers: nodes are ranges, children are found by counting bits. A subtrie with many leaves is cut into
ranges of bounded size, and each pair of ranges that may hold a link is joined on its own.

Of the links found in a subtrie a spanning forest is emitted, never all pairs; a pair of nodes
whose leaves already are in one component is dropped too, so dense groups of copies don't cost the
square of their size. Connected components over the distinct fingerprints follow.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer words
than a shingle are one shingle; repeated rows share a fingerprint; a null key is in the
component of its fingerprint, which is null if no row with a key has that; an empty table gives an empty result; only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import store, words
from loomwright.llm.components import components

_ONE = np.uint64(1)
_DENSE = 1 << 18  # leaves that are joined in one piece at most
_SIGN = np.uint64(1 << 63)
_FRONTIER = 1 << 17  # pairs of nodes that are expanded at once; a level holds back a few times as many


def _normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, words.Words]:
    """The block with one space between the words of a document, and its words."""
    w = words.split_words(data, offsets, words.SPACED)
    keep = words.SPACED[data]
    last = np.zeros(len(w.start), bool)
    last[w.first[1:][np.diff(w.first) > 0] - 1] = True
    gap = w.end[~last]
    keep[gap] = True
    data = data.copy()
    data[gap] = 0x20
    moved = np.concatenate([[0], np.cumsum(keep)])
    return data[keep].tobytes(), words.Words(data, offsets, moved[w.start], moved[w.end - 1] + 1 if len(w.end) else w.end, w.first)


def fingerprints(column: pa.Array, shingle: int, max_bytes: int = 1 << 21) -> np.ndarray:
    """64-bit fingerprint of each text; texts of ``max_bytes`` together, or one, are handled at once."""
    from xxhash import xxh64_digest

    out = np.zeros(len(column), np.uint64)
    for row, data, offsets in words.blocks(column, max_bytes, lower=True):
        body, w = _normal_words(data, offsets)
        count = np.diff(w.first)
        shingles = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
        filled = np.flatnonzero(shingles)
        if not len(filled):
            continue
        first = np.concatenate([[0], np.cumsum(shingles[filled])])
        start = np.repeat(w.first[filled] - first[:-1], shingles[filled]) + np.arange(first[-1])
        end = np.minimum(start + shingle, np.repeat(w.first[filled + 1], shingles[filled])) - 1
        spans = zip(w.start[start].tolist(), w.end[end].tolist(), strict=True)
        digests = np.frombuffer(b"".join([xxh64_digest(body[a:b], 42) for a, b in spans]), np.uint8).reshape(-1, 8)
        ones = _bit_sums(digests, first)
        majority = 2 * ones > shingles[filled, None]
        out[row + filled] = np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _bit_sums(digests: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Set bits by document and place; documents are the runs between ``first``."""
    out = np.zeros((len(first) - 1, 64), np.int64)
    step = 1 << 16
    for lo in range(0, len(digests), step):
        hi = min(lo + step, len(digests))
        a = np.searchsorted(first, lo, side="right") - 1
        b = np.searchsorted(first, hi, side="left")
        bits = np.unpackbits(digests[lo:hi], axis=1)
        out[a:b] += np.add.reduceat(bits, np.maximum(first[a:b] - lo, 0), axis=0, dtype=np.int32)
    return out


def trie_blocks(max_distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``max_distance`` + 2 blocks, from the highest bit down."""
    n = max_distance + 2
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _reordered(fp: np.ndarray, on_top: list[tuple[int, int]], rest: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprints with the bits of some blocks moved to the top levels."""
    out, used = np.zeros_like(fp), 0
    for first, width in on_top + rest:
        part = (fp << np.uint64(first)) >> np.uint64(64 - width)
        used += width
        out |= part << np.uint64(64 - used)
    return out


def self_join(leaves: np.ndarray, bounds: np.ndarray, depth: int, budget: int, cuts: np.ndarray | None = None) -> np.ndarray:
    """Component of each leaf, as the index of a leaf in it.

    ``leaves`` are distinct and sorted within the subtries [bounds[i], bounds[i + 1]), whose leaves share
    their first ``depth`` bits. With ``cuts``, only leaves before cuts[i] are joined with those behind, where it is above
    bounds[i].
    """
    n = len(leaves)
    label = np.arange(n)
    lo, hi = bounds[:-1].astype(np.int32), bounds[1:].astype(np.int32)
    split = np.zeros(len(lo), bool) if cuts is None else cuts > lo
    end, begin = (np.where(split, lo if cuts is None else cuts, x).astype(np.int32) for x in (hi, lo))
    many = (hi - lo > 1) & (begin < hi)
    stack = [(depth, np.stack([lo[many], end[many], begin[many], hi[many], np.zeros(many.sum(), np.int32)]))]
    changes = np.arange(n)
    set_bits: dict[int, np.ndarray] = {}  # by level: leaves before each place whose bit is set
    while stack:
        level, pairs = stack.pop()
        if pairs.shape[1] > _FRONTIER:
            stack.append((level, pairs[:, _FRONTIER:]))
            pairs = pairs[:, :_FRONTIER]
        a, a_end, b, b_end, diff = pairs
        # Both nodes wholly in one component: nothing to learn below.
        known = (changes[a] == changes[a_end - 1]) & (changes[b] == changes[b_end - 1]) & (label[a] == label[b])
        small = (a_end - a == 1) & (b_end - b == 1) & ~known
        if small.any():
            i, j = a[small], b[small]
            near = np.bitwise_count(leaves[i] ^ leaves[j]) <= budget
            if near.any():
                _unite(label, i[near], j[near])
                changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        go = ~known & ~small
        if level == 64 or not go.any():
            continue
        a, a_end, b, b_end, diff = pairs[:, go]
        if level not in set_bits:
            bit = ((leaves >> np.uint64(63 - level)) & _ONE).astype(np.int32)
            set_bits[level] = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)])
        ones = set_bits[level]
        a_mid, b_mid = a_end - (ones[a_end] - ones[a]), b_end - (ones[b_end] - ones[b])
        twin = a == b
        below = []
        for left, left_end, right, right_end, more in ((a, a_mid, b, b_mid, 0), (a_mid, a_end, b_mid, b_end, 0), (a, a_mid, b_mid, b_end, 1), (a_mid, a_end, b, b_mid, 1)):
            live = (left < left_end) & (right < right_end) & (diff + more <= budget)
            live &= (left != right) | (left_end - left > 1)
            if left is a_mid and right is b:
                live &= ~twin  # the mirror image of the pair before
            below.append(np.stack([x[live] for x in (left, left_end, right, right_end)] + [diff[live] + np.int32(more)]))
        # Nodes that agree on this level come first: what is alike is joined before it is compared.
        if any(part.shape[1] for part in below):
            stack.append((level + 1, np.concatenate(below, axis=1)))
    return label


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j; a label always is the lowest index of its component."""
    while True:
        x, y = label[i], label[j]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class Ranges:
    """Cuts of the dense subtries: ``last[node]`` has the last leaf of each range but the last one, in signed order."""

    def __init__(self, last: dict[int, np.ndarray], budget: int):
        self.last, self.budget = last, budget
        self.nodes = np.array(sorted(last), np.int64)

    def place(self, node: int, leaf: np.ndarray) -> np.ndarray:
        """The range of each leaf."""
        return np.searchsorted(self.last[node], leaf)

    def partners(self, node: int, own: int, depth: int, first: int) -> np.ndarray:
        """Ranges that may hold leaves within the budget of those in ``own``, by the bits that all of a range share.

        ``first`` is a leaf of the node, ``depth`` its number of bits.
        """
        cut = self.last[node].view(np.uint64) ^ _SIGN
        low = np.uint64(first) & ~np.uint64((1 << (64 - depth)) - 1)
        lo, hi = np.append(low, cut), np.append(cut, low | np.uint64((1 << (64 - depth)) - 1))
        differ = lo ^ hi
        for shift in (1, 2, 4, 8, 16, 32):
            differ |= differ >> np.uint64(shift)
        shared = ~(differ | differ[own])
        return np.flatnonzero(np.bitwise_count((lo ^ lo[own]) & shared) <= self.budget)


def _dense_ranges(planted: DataFrame, dense: int, budget: int) -> Ranges:
    """Nodes with more than ``dense`` leaves, of which there are few, cut into ranges of about half as many."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(batch.column("node").to_numpy(), return_counts=True)], ["node", "n"])

    counts = planted.select("node").mapInArrow(tally, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > dense)
    # At most one in ``dense`` of all leaves reaches the driver.
    parts = {r.node: -(-2 * r.n // dense) for r in counts.collect()}
    if not parts:
        return Ranges({}, budget)
    names, most = np.array(sorted(parts), np.int64), max(parts.values())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.isin(batch.column("node").to_numpy(), names)))

    leaves = planted.select("node", "leaf").mapInArrow(pick, "node long, leaf long")
    cuts = leaves.groupBy("node").agg(F.percentile_approx("leaf", [i / most for i in range(1, most)], max(10_000, 20 * most)).alias("b")).collect()
    return Ranges({r.node: np.unique(np.array([r.b[i * most // parts[r.node] - 1] for i in range(1, parts[r.node])], np.int64)) for r in cuts}, budget)


def link_fingerprints(distinct: DataFrame, max_distance: int, dense: int = _DENSE) -> DataFrame:
    """(u, v): a spanning forest of the links between rows (fp, rep) with distinct fp, by their rep.

    ``distinct`` is read up to three times. No task joins more than about ``dense`` leaves at once.
    """
    blocks = trie_blocks(max_distance)
    tries = []
    for pair in combinations(range(len(blocks)), 2):
        top = [blocks[i] for i in pair]
        tries.append((top, [b for b in blocks if b not in top]))
    depth = [sum(w for _, w in top) for top, _ in tries]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for t, (top, rest) in enumerate(tries):
                leaf = _reordered(fp, top, rest)
                node = (leaf >> np.uint64(64 - depth[t])).astype(np.int64)
                # Leaves are shifted into the signed order, in which Spark sorts.
                signed = (leaf ^ _SIGN).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node + (t << 40)), pa.array(signed), batch.column("rep")], ["node", "leaf", "rep"])

    planted = distinct.mapInArrow(plant, "node long, leaf long, rep long")
    # A table of fewer rows has no dense node.
    ranges = _dense_ranges(planted, dense, max_distance) if distinct.count() > dense else Ranges({}, max_distance)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Plants, and adds the cell of a leaf, two ranges of its node; a leaf of a dense node is in several."""
        for batch in plant(batches):
            node, leaf = (batch.column(c).to_numpy() for c in ("node", "leaf"))
            isin = np.isin(node, ranges.nodes)
            rows, lows, highs = [np.flatnonzero(~isin)], [np.zeros((~isin).sum(), np.int32)], [np.zeros((~isin).sum(), np.int32)]
            for name in np.unique(node[isin]).tolist():
                mine = np.flatnonzero(node == name)
                place = ranges.place(name, leaf[mine])
                first = int(leaf[mine[0]].view(np.uint64) ^ _SIGN)
                for own in np.unique(place).tolist():
                    here, other = mine[place == own], ranges.partners(name, own, depth[name >> 40], first).astype(np.int32)
                    rows.append(np.repeat(here, len(other)))
                    lows.append(np.tile(np.minimum(other, own), len(here)))
                    highs.append(np.tile(np.maximum(other, own), len(here)))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("node", "leaf", "rep")], pa.array(np.concatenate(lows)), pa.array(np.concatenate(highs))], ["node", "leaf", "rep", "low", "high"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def solve(all_rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Joins whole cells; those of one trie together."""
            node, cell, signed, rep = all_rows
            for t in np.unique(node >> 40).tolist():
                mine = node >> 40 == t
                own, where, order, ids = node[mine], cell[mine], signed[mine], rep[mine]
                bounds = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]) | (where[1:] != where[:-1])) + 1, [len(own)]])
                cuts = np.zeros(len(bounds) - 1, np.int64)
                for i in np.flatnonzero(where[bounds[:-1]] >> 32 != where[bounds[:-1]] & 0xFFFFFFFF).tolist():
                    a, b = bounds[i : i + 2]
                    low = where[a] >> 32
                    # A cell without leaves in its lower range has no pairs: the cut before it all leaves none.
                    cuts[i] = a + np.searchsorted(order[a:b], ranges.last[int(own[a])][low], side="right")
                    if cuts[i] == a:
                        cuts[i] = b
                label = self_join(order.view(np.uint64) ^ _SIGN, bounds, depth[t], max_distance, cuts)
                moved = np.flatnonzero(label != np.arange(len(label)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["u", "v"])

        for batch in batches:
            node, low, high, leaf, rep = (batch.column(c).to_numpy() for c in ("node", "low", "high", "leaf", "rep"))
            held.append(np.stack([node, (low.astype(np.int64) << 32) + high, leaf, rep]))
            rows += len(node)
            if rows >= 1 << 17:
                joined = np.concatenate(held, axis=1)
                last = np.flatnonzero((joined[0] != joined[0, -1]) | (joined[1] != joined[1, -1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                yield from solve(joined[:, :cut])
                held, rows = [joined[:, cut:]], joined.shape[1] - cut
        if rows:
            yield from solve(np.concatenate(held, axis=1))

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.mapInArrow(deal, "node long, leaf long, rep long, low int, high int")
    cells = dealt.repartition(n, "node", "low", "high").sortWithinPartitions("node", "low", "high", "leaf")
    return cells.mapInArrow(join, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key, fingerprint (long) and component_id (smallest key reachable) for each row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(fingerprints(batch.column("t"), shingle).view(np.int64))], ["k", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    marked = store.materialize(rows.mapInArrow(mark, "k long, fp long"), "fingerprints")
    distinct = store.materialize(marked.groupBy("fp").agg(F.min("k").alias("rep")), "distinct-fingerprints")
    linked = components(link_fingerprints(distinct.where("rep is not null"), max_distance))
    named = distinct.join(linked.withColumnRenamed("u", "rep"), "rep", "left").select("fp", F.coalesce("v", "rep").alias("component_id"))
    return marked.join(named, "fp").select(F.col("k").alias(key), F.col("fp").alias("fingerprint"), "component_id")


def hex_fingerprint(c: str = "fingerprint"):
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(c)), 16, "0"))
