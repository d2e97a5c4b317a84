"""Operator 5, best-fit packing: hierarchical residual packing.

A scan tokenises whole texts, cuts those that are too long and best-fits the pieces of its
partition. Bins that are full or nearly so are final. An underfull bin becomes one item of its
size; partitions are then merged ``fan_in`` at a time, each merge best-fits its items again and
passes on what is still underfull, until one node is left. After a merge one bin at most is not over half full, and bins
over half full never fit each other, so at most one bin of each node has still to be placed: of the others, a node
passes on as many as there are nodes, the roomiest, and the rest is final. So no node holds more than a few bins for each
partition of the input.

Defined cases: a null or empty text is a piece that holds the end id only; a text whose ids with the
end id exceed the capacity is cut so that only its first piece may be short; repeated and null
document ids are packed like others; texts may have any length; an empty table gives an empty result. Only the key and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import store
from loomwright.llm.tokenizing import encoder

_BIN_BITS = 33  # bins of one task


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: largest first, into the open bin that it leaves least room in."""
    bins = np.empty(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0  # bit r: some bin has room r
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = open_rooms >> size
        if fitting and size:
            r = size + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - r
        if r > size:
            room[r - size].append(b)
            open_rooms |= 1 << (r - size)
    return bins, offsets


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str, text: str) -> DataFrame:
    """One row for each piece, best-fitted within its partition: node is the partition, bin its bin."""
    schema = f"{key} long, piece int, start long, length long, ids_crc32 long, node long, bin long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, node = encoder(tokenizer), TaskContext.get().partitionId()
        found: list[np.ndarray] = []
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column("k").to_pylist(), batch.column("t"), strict=True):
                ids = np.append(enc.encode(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            if rows:
                found.append(np.array(rows, np.int64))
        if found:
            all_rows = np.concatenate(found)
            bins, offsets = best_fit(all_rows[:, 3], capacity)
            bins += np.int64(node) << _BIN_BITS
            names = [x.split()[0] for x in schema.split(", ")]
            for lo in range(0, len(all_rows), 1 << 16):
                part = all_rows[lo : lo + (1 << 16)]
                columns = [pa.array(part[:, i]) for i in range(5)]
                columns[1] = columns[1].cast(pa.int32())
                columns += [pa.array(np.full(len(part), node, np.int64)), pa.array(bins[lo : lo + len(part)]), pa.array(offsets[lo : lo + len(part)])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(store.NO_KEY)).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    slack: int = 8,
    fan_in: int = 8,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Returns key, piece, start, length, ids_crc32, sequence_id and offset for each piece.

    A bin with at most ``slack`` free places is final. Texts are read and encoded once and never
    shuffled; merges shuffle underfull bins, three numbers each.
    """
    pieces = store.materialize(tokenize_pieces(docs, tokenizer, capacity, end_id, key, text), "pieces")
    spark = pieces.sparkSession
    top = pieces.agg(F.max("node").alias("n")).first()["n"] or 0
    nodes = top + 1
    items = pieces.groupBy("node", "bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < capacity - slack)
    placed = pieces.drop("node")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        at, offsets = best_fit(pdf["fill"].to_numpy(np.int64), capacity)
        into = np.empty(at.max() + 1, np.int64)
        into[at[::-1]] = pdf["bin"].to_numpy()[::-1]  # a merged bin has the name of its first item
        fill = np.bincount(at, pdf["fill"].to_numpy()).astype(np.int64)
        # Bins that later merges may still fill.
        least = np.argsort(fill, kind="stable")
        passed = fill <= capacity // 2
        passed[least[:nodes]] = True
        passed &= fill < capacity - slack
        return pd.DataFrame({"node": pdf["parent"], "bin": pdf["bin"], "into": into[at], "shift": offsets, "fill": fill[at], "open": passed[at]})

    while top > 0:
        top //= fan_in
        open_items = items.select(F.expr(f"node div {fan_in}").alias("parent"), "bin", "fill")
        merged = open_items.groupBy("parent").applyInPandas(merge, "node long, bin long, into long, shift long, fill long, open boolean")
        merged = store.materialize(merged, "merged-bins")
        moves = merged.where((F.col("bin") != F.col("into")) | (F.col("shift") > 0)).select("bin", "into", "shift")
        placed = placed.join(moves, "bin", "left").select(
            *[c for c in placed.columns if c not in ("bin", "offset")],
            F.coalesce("into", "bin").alias("bin"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
        items = merged.where("open").groupBy("node", F.col("into").alias("bin")).agg(F.max("fill").alias("fill"))
    return placed.select(store.restored(key, key), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
