"""Operator 8, toxicity: weak supervision, then a linear classifier.

1. Voters. Lexicon voters are words and word prefixes of a few lengths; pattern voters are shares of capitals, digits,
   symbols and so on above or below a cut. They are picked on a bounded sample of labelled rows, where they go with
   toxic labels (patterns: with either class). A voter says toxic, clean or nothing, and reads the text only.
2. A generative label model (EM) finds the posterior of each row's class from the voters alone: how often each says what
   in either class is estimated from their agreement, and a voter's evidence is divided by how much others repeat it,
   by their correlations within a class. Given labels are no voters. They set the class prior, and a prior on each
   voter's rates that weighs as much as ``CALIBRATION`` rows; no row's label reaches its posterior in another way.
3. A logistic regression on lexicon and pattern features is fitted to the posteriors, and scores every whole text.

Features are 64-bit hashes, found over whole Arrow blocks; a word is a run of ASCII letters and non-ASCII characters of
the lower-cased text. Rows with crc32(key as text) mod 4 = 2 are held out: their labels are never read into the model.

Defined cases: a null text counts as empty and gets a score; a text of any length is read whole; a null label is no
label; several labels of one key count as the highest; a key with a null is not held out and has no label; repeated rows
get equal scores; with no training rows, or one class only, every score is the smoothed share of toxic labels; an empty
table gives an empty result; columns of the input named score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm import store, words

#: Characters of a prefix; 0 stands for whole words.
LENGTHS = (0, 4, 5, 6)
SHAPES = ("capitals", "digits", "symbols", "exclamations", "repeats", "short")
#: Rows that the given labels weigh in a voter's rates.
CALIBRATION = 25.0
_LETTERS = words._byte_set((0x61, 0x7A), (0x80, 0xFF))
_SALT = np.array([0, 0, 0, 0, 0x51ED270B, 0x9E3779B1, 0x85EBCA6B], np.uint64)  # by prefix length
_BYTES, _TABLE = 1 << 20, 18
_SURE = 4.2  # log odds of a lexicon voter


def held_out(key: str) -> Column:
    """Whether a row's label must not be learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def _lexicon(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) of each word and prefix of a block of lower-cased texts; repeats included."""
    w = words.split_words(data, offsets, _LETTERS)
    doc = w.doc_of_word()
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(begins, w.start), np.searchsorted(begins, w.end)
    begins = np.append(begins, len(data))
    for n in LENGTHS:
        if not n:
            yield doc, w.hashes()
            continue
        long = np.flatnonzero(last - first >= n)
        part = words.Words(data, offsets, w.start[long], begins[first[long] + n], w.first)
        yield doc[long], words.scramble(part.hashes() + _SALT[n])


def _shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares between 0 and 1 by document, as named in SHAPES."""

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])

    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = data | 0x20
    letter = ((low >= 0x61) & (low <= 0x7A)) | (data >= 0xC0)
    digit = (data >= 0x30) & (data <= 0x39)
    symbol = (data > 0x20) & (data < 0x7F) & ~letter & ~digit & (data != 0x5F)
    n = np.maximum(count((data & 0xC0) != 0x80), 1)
    w = words.split_words(data, offsets, words.SPACED)
    h, doc = w.hashes(), w.doc_of_word()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    spaced = np.diff(w.first)
    return np.stack(
        [
            count(((data >= 0x41) & (data <= 0x5A)) | accented) / np.maximum(count(letter), 1),
            count(digit) / n,
            count(symbol) / n,
            np.minimum(1.0, 10 * count(data == 0x21) / n),
            np.bincount(doc[same], minlength=len(spaced)) / np.maximum(spaced, 1),
            (n < 200).astype(float),
        ],
        axis=1,
    )


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, offsets, shapes) of some whole texts at a time."""
    for row, data, offsets in words.blocks(column, _BYTES):
        texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        for _, low, cuts in words.blocks(pc.utf8_lower(texts), 1 << 62):
            yield row, low, cuts, _shapes(data, offsets)


@dataclass
class Model:
    """A fitted classifier: lexicon features in ascending order with their weights, shape weights and intercept."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shapes: np.ndarray = field(default_factory=lambda: np.zeros(len(SHAPES)))
    intercept: float = 0.0

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << _TABLE, bool)
        self.maybe[self.features >> np.uint64(64 - _TABLE)] = True

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, place of the feature): each feature that a document has, once."""
        pairs = []
        for doc, h in _lexicon(data, offsets):
            some = np.flatnonzero(self.maybe[h >> np.uint64(64 - _TABLE)])
            at = np.minimum(np.searchsorted(self.features, h[some]), max(len(self.features) - 1, 0))
            known = self.features[at] == h[some] if len(self.features) else np.zeros(len(some), bool)
            pairs.append(doc[some[known]] * max(len(self.features), 1) + at[known])
        both = np.unique(np.concatenate(pairs))
        return both // max(len(self.features), 1), both % max(len(self.features), 1)

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability that each text is toxic."""
        out = np.zeros(len(column))
        for row, data, offsets, shapes in _blocks(column):
            doc, at = self.find(data, offsets)
            n = len(offsets) - 1
            out[row : row + n] = self.intercept + shapes @ self.shapes + np.bincount(doc, self.weights[at] if len(at) else None, minlength=n)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def label_model(votes: np.ndarray, rates: np.ndarray, prior: float, alone: list[int] | None = None, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class of each row, by EM over voters.

    ``votes`` holds -1 (nothing), 0 or 1 for each row and voter; ``rates`` (class, vote + 1, voter) what each voter is
    taken to say before any agreement is seen, with the weight of CALIBRATION rows; ``prior`` the share of toxic
    rows; ``alone`` voters whose evidence counts in full whatever others say. Returns the posteriors, the voters'
    accuracies and their correlations.
    """
    said = np.stack([votes == v for v in (-1, 0, 1)]).astype(np.float32)

    def posterior(table: np.ndarray, weight: np.ndarray) -> np.ndarray:
        evidence = np.log(table[1] / table[0]) * weight
        evidence[0] = 0  # saying nothing is no evidence: whether any lexicon voter speaks is a voter of its own
        z = np.log(prior / (1 - prior)) + sum(said[v] @ evidence[v] for v in range(3))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    # At first all voters count alike: the row's majority.
    more = said[2].sum(axis=1) - said[1].sum(axis=1)
    post = np.where(more > 0, 0.9, np.where(more < 0, 0.1 * prior, prior))
    correlation = np.eye(votes.shape[1])
    for _ in range(rounds):
        table = np.stack([said.transpose(0, 2, 1) @ p + CALIBRATION * r for p, r in zip((1 - post, post), rates, strict=True)])
        table /= table.sum(axis=1, keepdims=True)
        # Correlations within a class, of what is left of the votes after the class is known. Rows count in their
        # likelier class alone: shares of a row in both would make every two good voters look alike.
        left = 0.0
        for mine in (post <= 0.5, post > 0.5):
            rest = (said[2] - said[1])[mine]
            rest = rest - (rest.mean(axis=0) if len(rest) else 0)
            left = left + rest.T @ rest
        spread = np.sqrt(np.maximum(np.diag(left), 1e-9))
        correlation = left / spread[:, None] / spread[None, :]
        repeated = np.maximum(correlation - np.eye(len(correlation)), 0)
        repeated[alone or []] = repeated[:, alone or []] = 0
        fresh = posterior(table, 1 / (1 + np.where(repeated > 0.3, repeated, 0).sum(axis=1)))
        settled = np.abs(fresh - post).max(initial=0.0) < 1e-4
        post = fresh
        if settled:
            break
    right = said[1].T @ (1 - post) + said[2].T @ post
    return post, right / np.maximum((said[1] + said[2]).sum(axis=0), 1), correlation


def fit_logistic(row: np.ndarray, column: np.ndarray, n_features: int, dense: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft labels, by Adam on the whole sample.

    Row i has the features ``column[row == i]`` and the numbers dense[i], whose weights come last.
    """
    n = len(y)
    w, b = np.zeros(n_features + dense.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[column], minlength=n) + dense @ w[n_features:] + b
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([np.bincount(column, gap[row], minlength=n_features), dense.T @ gap]) / n + l2 * w
        g = np.append(g, gap.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _votes(row: np.ndarray, voter: np.ndarray, n_voters: int, shapes: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Lexicon voters say toxic or nothing, patterns either; the last voter says toxic where any lexicon voter does,
    else clean."""
    out = np.full((len(given), n_voters), -1, np.int8)
    out[row, voter] = 1
    columns = []
    rate = given.mean()
    for j in range(shapes.shape[1]):
        high, low = np.quantile(shapes[:, j], [0.95, 0.3])
        above, below = shapes[:, j] > high, shapes[:, j] <= low
        vote = np.full(len(given), -1)
        # A pattern speaks only where it says more than the share of toxic rows does.
        if above.sum() >= 20 and given[above].mean() > 1.5 * rate:
            vote[above] = 1
        if below.sum() >= 20 and given[below].mean() < rate / 1.5:
            vote[below] = 0
        columns.append(vote)
    return np.column_stack([out, *columns, out.max(axis=1, initial=-1) > 0]).astype(np.int8)


def _rates(votes: np.ndarray, given: np.ndarray) -> np.ndarray:
    """(class, vote + 1, voter): how often each voter says what where the given label is the class, smoothed."""
    table = np.stack([np.stack([(votes[given == c] == v).sum(axis=0) for v in (-1, 0, 1)]) + 0.5 for c in (0, 1)])
    return table / table.sum(axis=1, keepdims=True)


def _sample(docs: DataFrame, labels: DataFrame, rows: int, key: str, text: str, label: str) -> DataFrame:
    given = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("__k"))
        .agg(F.max(F.col(label)).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__k"), "__k")
        .limit(rows)
    )
    # The right side has ``rows`` rows at most.
    return docs.join(F.broadcast(given), F.col(key) == F.col("__k")).select(F.col(text).alias("t"), (F.col("__y") > 0).alias("y"))


def _ranked(sample: DataFrame, voters: int, features: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(features, voters among them, clean rows, toxic rows): those that tell the classes apart."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *[pa.array([(y == c).sum()], pa.int64()) for c in (False, True)]], ["f", "clean", "toxic"])
            for row, data, offsets, _ in _blocks(batch.column("t")):
                for doc, h in _lexicon(data, offsets):
                    order = np.lexsort([doc, h])
                    h, doc = h[order], doc[order]
                    once = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else order
                    h, toxic = h[once], y[row + doc[once]]
                    f, place = np.unique(h, return_inverse=True)
                    both = [np.bincount(place[toxic == c], minlength=len(f)) for c in (False, True)]
                    yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), *map(pa.array, both)], ["f", "clean", "toxic"])

    counts = sample.mapInArrow(count, "f long, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = store.materialize(counts.where("f is null or toxic + clean >= 4"), "lexicon-counts")
    total = counts.where("f is null").first()
    clean, toxic = (total.clean, total.toxic) if total else (0, 0)
    if not clean or not toxic:
        return np.zeros(0, np.uint64), np.zeros(0, bool), clean, toxic

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    # Signed likelihood-ratio statistic of "has the feature" against "is toxic".
    rows = clean + toxic
    has, lacks = F.col("toxic") + F.col("clean"), F.lit(rows) - F.col("toxic") - F.col("clean")
    g = sum(part(F.col(c), has * n / rows) + part(F.lit(n) - F.col(c), lacks * n / rows) for c, n in (("toxic", toxic), ("clean", clean)))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    ranked = counts.where("f is not null").select("f", odds.alias("odds"), (2 * g * F.signum(odds)).alias("g"))
    told = ranked.where("g > 10").orderBy(F.desc("g"), "f").limit(features - features // 5).collect()
    # Voters: the surest of them; labels with errors give lower odds to all.
    least = max(1.0, min(_SURE, told[0].odds - 1.2)) if told else 0.0
    sure = {r.f for r in told[:voters] if r.odds > least and r.g > 15}
    told += ranked.where("g < -10").orderBy("g", "f").limit(features // 5).collect()
    found = np.array(sorted({r.f for r in told}), np.int64)
    found = found[np.argsort(found.view(np.uint64))]
    return found.view(np.uint64), np.isin(found, np.array(sorted(sure), np.int64)), clean, toxic


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 12_000,
    voters: int = 200,
    features: int = 1_500,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    weak: bool = True,
) -> Model:
    """Fits a model on at most ``sample_rows`` labelled rows, taken in the order of a hash of the key, with at most
    ``voters`` lexicon voters and ``features`` lexicon features. Without ``weak`` the given labels stand in for the
    label model's posteriors.
    """
    sample = store.materialize(_sample(docs, labels, sample_rows, key, text, label), "labelled")
    known, sure, clean, toxic = _ranked(sample, voters, features)
    if not clean or not toxic:
        share = (toxic + 0.5) / (clean + toxic + 1)
        return Model(intercept=float(np.log(share / (1 - share))))
    finder = Model(known, np.zeros(len(known)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets, shapes in _blocks(batch.column("t")):
                doc, at = finder.find(data, offsets)
                n = len(offsets) - 1
                cuts = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(cuts), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([found, pa.FixedSizeListArray.from_arrays(pa.array(shapes.ravel()), len(SHAPES)).cast(pa.list_(pa.float64())), batch.column("y").slice(row, n)], ["found", "shapes", "y"])

    # At most sample_rows rows of at most ``features`` numbers.
    seen = sample.mapInArrow(look, "found array<int>, shapes array<double>, y boolean").toArrow().combine_chunks()
    y = seen.column("y").to_numpy(zero_copy_only=False).astype(int)
    shapes = seen.column("shapes").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    size = pc.list_value_length(seen.column("found")).to_numpy().astype(np.int64)
    at = seen.column("found").combine_chunks().flatten().to_numpy().astype(np.int64)
    # Rows arrive in any order; the fit must not depend on it.
    mark = np.add.reduceat(np.append(words.scramble(known)[at], np.uint64(0)), np.minimum(np.cumsum(size) - size, len(at))) if len(y) else size
    order = np.lexsort([*shapes.T, np.where(size > 0, mark, 0), y])
    begin = (np.cumsum(size) - size)[order]
    shapes, size, y = shapes[order], size[order], y[order]
    row = np.repeat(np.arange(len(y)), size)
    column = at[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)]
    target = y.astype(float)
    if weak:
        place = np.cumsum(sure) - 1
        votes = _votes(row[sure[column]], place[column[sure[column]]], int(sure.sum()), shapes, y)
        target, _, _ = label_model(votes, _rates(votes, y), toxic / (clean + toxic), [votes.shape[1] - 1])
    w, b = fit_logistic(row, column, len(known), shapes, target)
    return Model(known, w[: len(known)], w[len(known) :], b)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Returns the columns ``keep`` (default: all) with score and predicted; one scan, no shuffle."""
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(batch.column("__text"))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)
