"""Operator 9, benchmark decontamination: a distributed positional inverted index.

``build_index`` cuts the corpus into segments of whole documents and stores, for each term of a
segment, its postings: the ascending positions (document starts included) at which it stands. The
table is written once and can be searched again for any other benchmark.

``search`` takes the test items in blocks of bounded size. Only the postings of terms that a block
holds are read; they meet again segment by segment, where each window of test words is answered
from its rarest term's list, shifted to the window's start and intersected with the lists of the
other terms in order of their length. A window that has a term which the segment lacks is never looked at. Matches
that cross documents are dropped. ``slop`` > 0 asks for proximity: all terms of a window, in any
order, within that many words more than the window has; the words from the first to the last of them are hit.

Terms are 64-bit hashes of words: another word is taken for a test word with a chance of one in 10**19 for each pair.

Defined cases: each row is a document of its own, whatever its key, and a row with a null key is searched like any
other; a null or wordless text or item has no words and matches nothing; texts may have any length; an item shorter
than a window is one window; repeated items and items with equal texts are all reported; repeated
documents each match; either table may be empty; only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm import store, words

_GAP = 1 << 10  # free positions between documents of a segment: longer than any window may be


_HITS = "array<struct<first:int,last:int>>"
_FOUND = f"segment long, doc int, k long, hits {_HITS}, items array<string>"


def row_hash(key: str, text: str) -> Column:
    """Names a row by its key and text."""
    return F.xxhash64(key, text)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_bytes: int = 1 << 22) -> DataFrame:
    """The stored index: rows (segment, term, postings as little-endian uint32).

    Each segment has one more row with a null term: its documents' row hashes (of key and text), keys, first positions
    and numbers of words, four int64 arrays one after the other.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, keys = batch.column("r").to_numpy(), batch.column("k").to_numpy()
            for row, data, offsets in words.blocks(batch.column("t"), segment_bytes, lower=True):
                w = words.split_words(data, offsets, words.LETTERS)
                docs_here = len(w.first) - 1
                count = np.diff(w.first)
                position = np.arange(len(w.start), dtype=np.int64) + w.doc_of_word() * _GAP
                term = w.hashes()
                order = np.argsort(term, kind="stable")
                at = position[order].astype("<u4")
                term = term[order]
                cut = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
                info = np.concatenate([rows[row : row + docs_here], keys[row : row + docs_here], w.first[:-1] + np.arange(docs_here) * _GAP, count]).astype("<i8")
                ends = np.append(cut, len(term)).astype(np.int64) * 4
                postings = pa.Array.from_buffers(
                    pa.large_binary(), len(cut), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(at.tobytes())]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(cut) + 1, segment, np.int64)),
                        pa.concat_arrays([pa.array(term[cut].view(np.int64)), pa.nulls(1, pa.int64())]),
                        pa.concat_arrays([postings, pa.array([info.tobytes()], pa.binary())]),
                    ],
                    ["segment", "term", "postings"],
                )
                segment += 1

    rows = docs.select(row_hash(key, text).alias("r"), F.coalesce(F.col(key).cast("long"), F.lit(store.NO_KEY)).alias("k"), F.col(text).alias("t"))
    return store.materialize(rows.mapInArrow(index, "segment long, term long, postings binary"), "postings")


class Query:
    """The windows of one block of test items: places in one list of their words, so a window costs a few numbers."""

    def __init__(self, items: pa.Table, window: int):
        self.item_ids, self.window = items.column("item").to_pylist(), window
        parts, counts = [], []
        for _, data, offsets in words.blocks(items.column("text"), lower=True):
            w = words.split_words(data, offsets, words.LETTERS)
            parts.append(w.hashes())
            counts.append(np.diff(w.first))
        term = np.concatenate([*parts, np.zeros(0, np.uint64)])
        count = np.concatenate([*counts, np.zeros(0, np.int64)])
        self.terms, word = np.unique(term, return_inverse=True)
        self.word = word.astype(np.int32)
        windows = np.where(count > 0, np.maximum(count - window + 1, 1), 0)
        item = np.repeat(np.arange(len(count)), windows)
        self.item = item.astype(np.int32)
        self.start = (np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows) + (np.cumsum(count) - count)[item]).astype(np.int32)
        self.width = np.minimum(count, window)[item].astype(np.int16)

    def matches(self, term: np.ndarray, lists: list[np.ndarray], slop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, first positions, last positions) for each window found in a segment with these postings."""
        if not len(term):
            return
        have = np.minimum(np.searchsorted(term, self.terms), len(term) - 1)
        have = np.where(term[have] == self.terms, have, -1)
        length = np.array([len(x) for x in lists], np.int64)
        lacking = np.concatenate([np.zeros(1, np.int32), np.cumsum(have[self.word] < 0, dtype=np.int32)])
        alive = np.flatnonzero(lacking[self.start + self.width] == lacking[self.start])
        for lo in range(0, len(alive), 1 << 14):
            some = alive[lo : lo + (1 << 14)]
            step = np.arange(self.window)
            inside = step < self.width[some, None]
            at = have[self.word[np.where(inside, self.start[some, None] + step, 0)]]
            sizes = np.where(inside, length[at], np.iinfo(np.int64).max)
            rarest_first = np.argsort(sizes, axis=1, kind="stable")
            for w, own, order in zip(some.tolist(), at, rarest_first.tolist(), strict=True):
                width = int(self.width[w])
                if slop:
                    first, last = self._near([lists[own[o]] for o in order[:width]], width + slop)
                else:
                    first = lists[own[order[0]]] - order[0]
                    for o in order[1:width]:
                        if not len(first):
                            break
                        other = lists[own[o]]
                        i = np.searchsorted(other, first + o)
                        i[i == len(other)] = 0
                        first = first[other[i] == first + o]
                    last = first + width - 1
                if len(first):
                    yield w, first, last

    @staticmethod
    def _near(lists: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last positions of spans of at most so many words that hold every list's term and start with one."""
        first = np.unique((lists[0][:, None] - np.arange(span)).ravel())
        starts = np.zeros(len(first), bool)
        last = np.full(len(first), -1)
        ok = np.ones(len(first), bool)
        for other in lists:
            i = np.searchsorted(other, first)
            ok &= i < len(other)
            there = other[np.minimum(i, len(other) - 1)]
            starts |= there == first
            last = np.maximum(last, there)
        ok &= starts & (last < first + span)
        return first[ok], last[ok]


def search(index: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", window: int = 10, slop: int = 0, block_bytes: int = 1 << 23) -> DataFrame:
    """Returns (segment, doc, k, hits, items): per document (its segment and number there, and key) with a match, merged
    [first, last] word spans and item ids.

    Test items are gathered ``block_bytes`` at a time, never all at once; a block costs one pass over the
    postings of its terms. A document can have a row for each block.
    """
    if not 0 < window + slop < _GAP:
        raise ValueError("a window is at least one and fewer than 1024 words")
    spark = index.sparkSession
    own = items.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    n_blocks = -(-2 * total // block_bytes) if total > block_bytes else 1
    found = []
    for b in range(n_blocks):
        part = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b)
        query = Query(part.toArrow(), window)
        if len(query.terms):
            found.append(_search_block(index, query, slop))
    if not found:
        return spark.createDataFrame([], _FOUND)
    out = found[0]
    for other in found[1:]:
        out = out.unionAll(other)
    return out


def _search_block(index: DataFrame, query: Query, slop: int) -> DataFrame:
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(query)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        for batch in batches:
            term = batch.column("term").fill_null(0).to_numpy().view(np.uint64)
            i = np.searchsorted(terms, term)
            keep = (terms[np.minimum(i, len(terms) - 1)] == term) | batch.column("term").is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(keep))

    def answer(segment: pa.Table) -> pa.Table:
        query = shared.value
        segment = segment.combine_chunks()
        meta = segment.column("term").is_null()
        _, keys, first, count = np.frombuffer(segment.filter(meta).column("postings")[0].as_py(), "<i8").reshape(4, -1)
        own = segment.filter(pa.compute.invert(meta))
        term = own.column("term").to_numpy().view(np.uint64)
        order = np.argsort(term)
        blobs = own.column("postings").to_pylist()
        lists = [np.frombuffer(blobs[i], "<u4").astype(np.int64) for i in order.tolist()]
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for w, begin, end in query.matches(term[order], lists, slop):
            doc = np.searchsorted(first, begin, side="right") - 1
            # A match lies in one document: documents are further apart than a window is wide.
            inside = (doc >= 0) & (end < first[doc] + count[doc])
            for d, s, e in zip(doc[inside].tolist(), (begin - first[doc])[inside].tolist(), (end - first[doc])[inside].tolist(), strict=True):
                spans.setdefault(d, []).append((s, e))
                items.setdefault(d, set()).add(int(query.item[w]))
        rows = []
        name = segment.column("segment")[0].as_py()
        for d, s in spans.items():
            merged: list[list[int]] = []
            for a, b in sorted(s):
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            rows.append((name, d, int(keys[d]), [{"first": a, "last": b} for a, b in merged], sorted({query.item_ids[i] for i in items[d]})))
        columns = list(zip(*rows, strict=True)) if rows else [(), (), (), (), ()]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.struct({"first": pa.int32(), "last": pa.int32()})), pa.list_(pa.string()))
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("segment", "doc", "k", "hits", "items"), columns, kinds, strict=True)})

    near = index.mapInArrow(wanted, index.schema)
    return near.groupBy("segment").applyInArrow(answer, _FOUND)


def find_contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, slop: int = 0, block_bytes: int = 1 << 23, row: str | None = None) -> DataFrame:
    """Returns one row for each row of ``docs``: key, n_words, hits (merged word spans) and items (sorted ids).

    ``row`` names one more column, the row_hash by which the caller finds the row again.
    """
    index = build_index(docs, key, text)

    # The documents' numbers of words, from the segments' own rows.
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, blob in zip(batch.column("segment").to_pylist(), batch.column("postings"), strict=True):
                info = np.frombuffer(blob.as_py(), "<i8").reshape(4, -1)
                n = info.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, segment, np.int64)), pa.array(np.arange(n, dtype=np.int32)), *[pa.array(info[i]) for i in (0, 1, 3)]], ["segment", "doc", "r", "k", "n_words"])

    every = index.where(F.col("term").isNull()).select("segment", "postings").mapInArrow(counts, "segment long, doc int, r long, k long, n_words long")
    found = search(index, items, item, item_text, window, slop, block_bytes)
    found = found.groupBy("segment", "doc").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    return every.join(found, ["segment", "doc"], "left").select(
        store.restored("k", key),
        "n_words",
        F.expr(f"coalesce({_MERGE}, cast(array() as {_HITS}))").alias("hits"),
        F.coalesce(F.array_sort(F.array_distinct("items")), F.array().cast("array<string>")).alias("items"),
        *([F.col("r").alias(row)] if row else []),
    )


#: Joins the spans that several blocks of test items found in one document.
_MERGE = """aggregate(array_sort(hits), cast(array() as array<struct<first:int,last:int>>), (out, x) ->
  if(size(out) > 0 and x.first <= element_at(out, -1).last + 1,
     concat(slice(out, 1, size(out) - 1), array(named_struct('first', element_at(out, -1).first, 'last', greatest(element_at(out, -1).last, x.last)))),
     concat(out, array(x))))"""


def n_hit(hits: str = "hits") -> Column:
    """Words covered by merged spans."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
