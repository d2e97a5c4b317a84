"""Operator 1, substring dedup: relative Lempel-Ziv parsing against indexed reference blocks.

The text to parse is taken as its sequence of seeds: the hash of the ``window`` words that start at
each word. A phrase of a document is parsed greedily: where the reference block holds its next seed
elsewhere, the factor is extended along that source for as long as the source goes on with the same
words, and becomes a duplicate span; the parse goes on at the first window that this source doesn't
cover, so windows across the end of a factor are looked up too. A seed that no block holds elsewhere is a
literal. As every window is looked up or covered, the spans are exactly the windows found elsewhere.

Blocks are cut by content so that a phrase needs only one block, however many there are:

1. In each window the least of its hashed ``anchor``-grams is its anchor. Equal windows have equal anchors,
   so windows whose anchor occurs once in the corpus are literals, and drop out after one shuffle of anchors.
2. The rest, the run of seeds around a repeated anchor, goes to the block of its anchor. A block is
   sorted by anchor and phrase: repeats of a phrase are parsed once, and a task holds the distinct phrases of
   a few anchors only; a task that meets a phrase often sends it twice. An anchor with more than ``hot`` occurrences doesn't go to one block: its phrases are
   cut into single seeds, each with a block of its own.
3. Spans return to their documents.

Equal windows are those with equal 64-bit hashes of their words and of their anchor's words.

Defined cases: a null text has no words; a text with fewer words than a window loses nothing; a text may have any number
of words; repeated rows, with equal keys, null keys or not, are copies of each other; an empty table gives an empty
result; columns of the input that clash with new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm import store, words

_PLACE = np.uint64((1 << 22) - 1)
_STARTS = 1 << 20  # windows that are looked at together: their grams are fewer than _PLACE
_OFTEN = 1 << 15  # phrases that a task remembers, or some more
_PHRASE = ["block", "phrase", "rk", "rt", "lo", "n", "seeds"]
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def _row_key(key: str, text: str):
    """Names a row by its content: 96 bits, the same for repeated rows only."""
    return [F.xxhash64(key, text).alias("rk"), F.hash(text).alias("rt")]


def _anchors(w: words.Words, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(gram hash, place, first and last window start) of each anchor of the block, some windows at a time.

    Where two lots of windows share an anchor it is given for each of them.
    """
    every = words.gram_starts(w.first, window)
    lots = [_lot_anchors(every[a : a + _STARTS], hashes, window, anchor) for a in range(0, max(len(every), 1), _STARTS)]
    return tuple(np.concatenate(x) for x in zip(*lots, strict=True))


def _lot_anchors(start: np.ndarray, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    if not len(start):
        return np.zeros(0, np.uint64), start, start, start
    # From the first window to the last there may be words without a window, of short texts: cut where there are many.
    far = int(np.searchsorted(start, start[0] + _STARTS))
    if far < len(start):
        both = _lot_anchors(start[:far], hashes, window, anchor), _lot_anchors(start[far:], hashes, window, anchor)
        return tuple(np.concatenate(x) for x in zip(*both, strict=True))
    base = start[0]
    gram = words.gram_hashes(hashes[base : start[-1] + window], anchor)
    # Least gram of each window: the place is in the low bits, so the leftmost wins a tie.
    best = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    span, reach = window - anchor + 1, 1
    while 2 * reach <= span:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < span:
        best = np.minimum(best[: len(best) - (span - reach)], best[span - reach :])
    place = (best[start - base] & _PLACE).astype(np.int64)
    fresh = np.concatenate([[True], place[1:] != place[:-1]])
    at = np.flatnonzero(fresh)
    return gram[place[at]], place[at] + base, start[at], start[np.append(at[1:], len(start)) - 1]


def _find_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(h, rk, rt, lo, hi, n): window starts lo to hi, as word numbers of the document, have anchor h at n places.

    Where a text repeats a few words, one anchor follows the other with the same hash: such a run is one row.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rk, rt = batch.column("rk").to_numpy(), batch.column("rt").to_numpy()
            for row, data, offsets in words.blocks(batch.column("t")):
                w = words.split_words(data, offsets, words.SPACED)
                h, place, lo, hi = _anchors(w, w.hashes(), window, anchor)
                doc = np.searchsorted(w.first, place, side="right") - 1
                run = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else doc
                n = np.diff(np.append(run, len(h)))
                h, doc, lo, hi = h[run], doc[run], lo[run], hi[run + n - 1]
                base = w.first[doc]
                columns = [h.view(np.int64), rk[row + doc], rt[row + doc], *[x.astype(np.int32) for x in (lo - base, hi - base, n)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "rk", "rt", "lo", "hi", "n"])

    return docs.mapInArrow(find, "h long, rk long, rt int, lo int, hi int, n int")


def _repeated(anchors: DataFrame, hot: int, partitions: int) -> DataFrame:
    """Those rows whose anchor occurs more than once; is_hot where more than ``hot`` rows have it."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by h. The last run of a batch stays open, with its first ``hot`` rows at most.
        held: list[pa.RecordBatch] = []
        last, run_hot = None, False

        def with_flag(rows: pa.RecordBatch, flags) -> pa.RecordBatch:
            columns = [rows.column(c) for c in ("h", "rk", "rt", "lo", "hi")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(flags, pa.bool_())], ["h", "rk", "rt", "lo", "hi", "is_hot"])

        def close() -> Iterator[pa.RecordBatch]:
            rows = sum(len(x) for x in held)
            if run_hot or sum(x.column("n").to_numpy().sum() for x in held) > 1:
                for x in held:
                    yield with_flag(x, np.full(len(x), run_hot or rows > hot))
            held.clear()

        for batch in batches:
            h = batch.column("h").to_numpy()
            if not len(h):
                continue
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            if last is not None and h[0] == last:
                stop = cut[1] if len(cut) > 1 else len(h)
                held.append(batch.slice(0, stop))
                cut = cut[1:]
                if run_hot or sum(len(x) for x in held) > hot:
                    run_hot = True
                    yield from close()
            if len(cut):
                if last is not None:
                    yield from close()
                run_hot = False
                size = np.diff(np.append(cut, len(h)))
                places = np.add.reduceat(batch.column("n").to_numpy().astype(np.int64), cut)
                closed = np.arange(len(cut)) < len(cut) - 1
                pick = np.flatnonzero(np.repeat(closed & (places > 1), size)) + cut[0]
                if len(pick):
                    yield with_flag(batch.take(pa.array(pick)), np.repeat(size, size)[pick - cut[0]] > hot)
                held.append(batch.slice(cut[-1]))
                if size[-1] > hot:
                    run_hot = True
                    yield from close()
                last = h[-1]
        if last is not None:
            yield from close()

    dealt = anchors.repartition(partitions, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(keep, "h long, rk long, rt int, lo int, hi int, is_hot boolean")


def _phrases(candidates: DataFrame, window: int) -> DataFrame:
    """(block, phrase, rk, rt, lo, n, seeds): the n seeds of the windows lo, lo + 1, ... of a document.

    Of a phrase that a task meets often, only the first two go to the block, where they show that it repeats. The others
    have no seeds, and go to any task: they are spans already.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: set[tuple[int, int]] = set()
        for batch in batches:
            rk, rt, found = batch.column("rk").to_numpy(), batch.column("rt").to_numpy(), batch.column("found")
            for row, data, offsets in words.blocks(batch.column("t")):
                w = words.split_words(data, offsets, words.SPACED)
                seeds = words.gram_hashes(w.hashes(), window)
                mine = found.slice(row, len(offsets) - 1)
                n = mine.value_lengths().to_numpy()
                flat = mine.flatten()
                h, lo, hi, is_hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                doc = np.repeat(np.arange(len(n)), n)
                size = np.where(is_hot, 1, hi - lo + 1)
                if is_hot.any():
                    times = np.where(is_hot, hi - lo + 1, 1)
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    h, lo, is_hot, doc, size = (np.repeat(x, times) for x in (h, lo, is_hot, doc, size))
                    lo = lo + np.where(is_hot, step, 0)
                ends = np.cumsum(size)
                at = np.repeat(w.first[doc] + lo - (ends - size), size) + np.arange(size.sum())
                flat_seeds = seeds[at]
                block = np.where(is_hot, flat_seeds[ends - size].view(np.int64), h)
                phrase = np.zeros(len(size), np.int64)
                if len(size):
                    place = np.arange(len(at)) - np.repeat(ends - size, size)
                    phrase = np.add.reduceat(words.scramble(flat_seeds + place.astype(np.uint64)), ends - size).view(np.int64)
                extra = _extra(block, phrase, often)
                lo, keys = lo.astype(np.int32), (rk[row + doc], rt[row + doc])
                if extra.any():
                    columns = [keys[0][extra], np.zeros(extra.sum(), np.int64), *[x[extra] for x in keys], lo[extra], size[extra].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.nulls(len(columns[0]), pa.binary())], _PHRASE)
                    flat_seeds = flat_seeds[~np.repeat(extra, size)]
                    block, phrase, lo, size, *keys = (x[~extra] for x in (block, phrase, lo, size, *keys))
                    ends = np.cumsum(size)
                for a in range(0, len(size), 1 << 15):
                    b = min(a + (1 << 15), len(size))
                    begin = ends[a] - size[a]
                    cuts = np.concatenate([[0], ends[a:b] - begin]).astype(np.int32) * 8
                    blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(flat_seeds[begin : ends[b - 1]].tobytes())])
                    columns = [block[a:b], phrase[a:b], *[x[a:b] for x in keys], lo[a:b], size[a:b].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], blob], _PHRASE)

    return candidates.mapInArrow(build, "block long, phrase long, rk long, rt int, lo int, n int, seeds binary")


def _extra(block: np.ndarray, phrase: np.ndarray, often: set[tuple[int, int]]) -> np.ndarray:
    """Rows beyond the first two of their (block, phrase), here and in what the task had before; ``often`` remembers some."""
    order = np.lexsort([phrase, block])
    b, p = block[order], phrase[order]
    first = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (p[1:] != p[:-1])])) if len(b) else order
    size = np.diff(np.append(first, len(b)))
    nth = np.arange(len(b)) - np.repeat(first, size)
    out = np.zeros(len(b), bool)
    out[order] = nth > 1
    if often:
        seen = np.array([pair in often for pair in zip(b[first].tolist(), p[first].tolist(), strict=True)], bool)
        out[order] |= np.repeat(seen, size)
    if len(often) < _OFTEN:
        many = first[size > 2]
        often.update(zip(b[many].tolist(), p[many].tolist(), strict=True))
    return out


def parse_phrases(seeds: np.ndarray, first: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors (phrase, from seed, number of seeds) of distinct phrases against the block they form.

    Phrase i has the seeds first[i] to first[i + 1] and occurs copies[i] times.
    """
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    # The index: for each seed of the block, another place that holds it, or -1.
    order = np.argsort(seeds, kind="stable")
    value = seeds[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    following = np.concatenate([order[1:], order[:1]])
    last = np.append(start[1:], len(value)) - 1
    following[last] = order[start]
    elsewhere = np.empty(len(seeds), np.int64)
    elsewhere[order] = following
    elsewhere[elsewhere == np.arange(len(seeds))] = -1

    at = first[:-1].copy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.flatnonzero(at < first[1:])
    while len(active):
        here = at[active]
        source = elsewhere[here]
        whole = copies[active] > 1
        hit = whole | (source >= 0)
        at[active[~hit]] += 1
        who, here, source, whole = active[hit], here[hit], source[hit], whole[hit]
        length = np.where(whole, first[who + 1] - here, 1)
        growing = np.flatnonzero(~whole)
        while len(growing):
            mine, theirs = here[growing] + length[growing], source[growing] + length[growing]
            safe = np.minimum(theirs, len(seeds) - 1)
            ok = (mine < first[who[growing] + 1]) & (theirs < first[owner[source[growing]] + 1])
            ok &= seeds[np.minimum(mine, len(seeds) - 1)] == seeds[safe]
            growing = growing[ok]
            length[growing] += 1
        out.append((who, here - first[who], length))
        at[who] += length
        active = active[at[active] < first[active + 1]]
    if not out:
        return at[:0], at[:0], at[:0]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parse(phrases: DataFrame, window: int, partitions: int) -> DataFrame:
    """(rk, rt, first, last): duplicate spans in words."""

    def spans(rk, rt, first, last) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rk), pa.array(rt), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["rk", "rt", "first", "last"])

    def solve(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parses whole blocks: one row for each phrase, or some for one that repeats across batches."""
        table = pa.Table.from_batches(rows).combine_chunks()
        block, phrase = table.column("block").to_numpy(), table.column("phrase").to_numpy()
        blob = table.column("seeds").chunk(0)
        cuts = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
        seeds = np.frombuffer(blob.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]].view(np.uint64)
        cuts = (cuts - cuts[0]) // 8
        fresh = np.concatenate([[True], (block[1:] != block[:-1]) | (phrase[1:] != phrase[:-1])])
        rep = np.flatnonzero(fresh)
        kind = np.cumsum(fresh) - 1
        size = np.diff(cuts)
        keep = np.repeat(fresh, size)
        first = np.concatenate([[0], np.cumsum(size[rep])])
        copies = np.bincount(kind)
        which, start, length = parse_phrases(seeds[keep], first, copies)
        # Every copy of a phrase has its factors.
        order = np.argsort(which, kind="stable")
        per = np.bincount(which, minlength=len(rep))
        begin = np.concatenate([[0], np.cumsum(per)])
        times = per[kind]
        row = np.repeat(np.arange(len(kind)), times)
        f = order[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + begin[kind[row]]] if len(row) else order[:0]
        lo = table.column("lo").to_numpy().astype(np.int64)[row] + start[f]
        yield spans(table.column("rk").to_numpy()[row], table.column("rt").to_numpy()[row], lo, lo + length[f] + window - 2)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by block and phrase. The last block of a batch stays open; of a phrase in it that
        # repeats, two rows are kept and the others answered at once, as all their seeds are elsewhere.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            done = batch.column("seeds").is_null()
            if pc.any(done).as_py():
                known = batch.filter(done)
                lo = known.column("lo").to_numpy()
                yield spans(known.column("rk").to_numpy(), known.column("rt").to_numpy(), lo, lo + known.column("n").to_numpy() + window - 2)
                batch = batch.filter(pc.invert(done))
            if not len(batch):
                continue
            block, phrase = batch.column("block").to_numpy(), batch.column("phrase").to_numpy()
            same = np.zeros(len(batch), bool)
            same[2:] = (block[2:] == block[:-2]) & (phrase[2:] == phrase[:-2])
            if same.any():
                more = batch.filter(pa.array(same))
                lo = more.column("lo").to_numpy()
                yield spans(more.column("rk").to_numpy(), more.column("rt").to_numpy(), lo, lo + more.column("n").to_numpy() + window - 2)
                batch = batch.filter(pa.array(~same))
                block = batch.column("block").to_numpy()
            held.append(batch)
            cut = int(np.flatnonzero(block == block[-1])[0])
            if cut and sum(len(x) for x in held) >= 1 << 15:
                yield from solve([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
        if held:
            yield from solve(held)

    dealt = phrases.repartition(partitions, "block").sortWithinPartitions("block", "phrase")
    return dealt.mapInArrow(parse, "rk long, rt int, first int, last int")


def duplicate_spans(docs: DataFrame, window: int, anchor: int, hot: int, key: str, text: str) -> DataFrame:
    """(rk, rt, spans): for each row that has any, the words of windows that are found elsewhere."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*_row_key(key, text), F.col(text).alias("t"))
    repeated = _repeated(_find_anchors(rows, window, anchor), hot, partitions)
    found = repeated.groupBy("rk", "rt").agg(F.collect_set(F.struct("h", "lo", "hi", "is_hot")).alias("found"))
    found = store.materialize(found, "anchors")
    phrases = _phrases(rows.hint("merge").join(found, ["rk", "rt"]), window)
    spans = _parse(phrases, window, partitions)
    gathered = spans.groupBy("rk", "rt").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return store.materialize(gathered, "spans")


def remove_duplicates(
    docs: DataFrame,
    window: int = 35,
    anchor: int = 16,
    hot: int = 10_000,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Returns the columns ``keep`` (default: all) with the kept words as text, n_words, n_removed and
    removed (the merged spans of removed words).

    Whole texts are shuffled twice: to meet their repeated anchors, and their spans.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor has between one word and a window's words")
    spans = duplicate_spans(docs, window, anchor, hot, key, text)
    new = {text: T.StringType(), "n_words": T.LongType(), "n_removed": T.LongType(), "removed": _SPANS}
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in new.items()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed, removed = [], [], [], []
            for row, data, offsets in words.blocks(batch.column("__text")):
                w = words.split_words(data, offsets, words.SPACED)
                raw = data.tobytes()
                start, end, first = w.start.tolist(), w.end.tolist(), w.first.tolist()
                for d, found in enumerate(batch.column("__spans").slice(row, len(offsets) - 1)):
                    lo, hi = first[d], first[d + 1]
                    merged = _merged(found)
                    stay, pos = [], 0
                    for a, b in merged:
                        stay += range(lo + pos, lo + a)
                        pos = b + 1
                    stay += range(lo + pos, hi)
                    texts.append(b" ".join([raw[start[i] : end[i]] for i in stay]).decode())
                    n_words.append(hi - lo)
                    n_removed.append(hi - lo - len(stay))
                    removed.append([{"first": a, "last": b} for a, b in merged])
            columns = [batch.column(c) for c in kept]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct({"first": pa.int32(), "last": pa.int32()})))
            columns += [pa.array(c, k) for c, k in zip((texts, n_words, n_removed, removed), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *new])

    rows = docs.select(*[F.col(c) for c in kept], F.col(text).alias("__text"), *[c.alias(f"__{n}") for c, n in zip(_row_key(key, text), ("rk", "rt"), strict=True)])
    spans = spans.select(F.col("rk").alias("__rk"), F.col("rt").alias("__rt"), F.col("spans").alias("__spans"))
    joined = rows.hint("merge").join(spans, ["__rk", "__rt"], "left").drop("__rk", "__rt")
    return joined.mapInArrow(cut, schema)


def _merged(found: pa.Scalar) -> list[tuple[int, int]]:
    """Disjoint ascending spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["first"], x["last"]) for x in found.as_py() or []):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
