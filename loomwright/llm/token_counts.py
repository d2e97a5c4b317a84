"""Operator 3, token counts: overlap resynchronisation (see ``tokenizing``).

Defined cases: a null text counts as empty (0 bytes, 0 tokens); every other column of the input
passes through; columns of the input that clash with ``n_bytes``, ``n_tokens`` or ``over_limit``
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomwright.llm.tokenizing import encoder


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    limit: int,
    text: str = "text",
    chunk_chars: int = 1 << 15,
    overlap_chars: int = 1 << 8,
    keep: list[str] | None = None,
) -> DataFrame:
    """Returns the columns ``keep`` (default: all but the text) with n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the path of a ``tokenizers`` file that executors can open. One scan, no shuffle;
    a task holds one Arrow batch and the ids of one chunk.
    """
    new = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    kept = [c for c in (keep if keep is not None else docs.columns) if c != text and c not in dict(new)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in new])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column("__text"):
                body = value.as_py() or ""
                sizes.append(len(body.encode()))
                counts.append(len(enc.encode(body, chunk_chars, overlap_chars)))
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *dict(new)])

    return docs.select(*kept, docs[text].alias("__text")).mapInArrow(count, schema)
