"""Structured Streaming: unification against a growing inventory, running statistics, the event log."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwright.operators.metrics import service_stats
from loomwright.operators.unify import BROADCAST_NUMBERS, DIGITS, EXACT, _unit, nearest

#: Stands for the leader of an entry that was there at the start.
NO_LEADER = -(2**63)


def unify_stream(prompts: DataFrame, tau: float, key: str = "vec_id", vector: str = "embedding", block: str | None = None, inventory: DataFrame | None = None) -> DataFrame:
    """(block, key, leader, canonical_id, similarity, cache_hit) for each arriving prompt.

    ``inventory`` (canonical_id from 0 without gaps, ``vector``), of at most BROADCAST_NUMBERS numbers, is what each block
    starts from; its entries have no leader.

    The inventory is state: one key for all prompts, or one for each block, which then are independent and run in
    parallel. A micro-batch is taken in the order of the key, so any cut of an ordered stream into micro-batches gives
    what one batch gives.
    """

    start = np.zeros((0, 0))
    if inventory is not None:
        size = inventory.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
        if size.n * max(size.d or 1, 1) > BROADCAST_NUMBERS:
            raise ValueError("an inventory of this size is searched with search_stream")
        start = _unit([r[0] for r in inventory.orderBy("canonical_id").select(vector).collect()]) if size.n else start

    def step(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("k", ignore_index=True)
        keys, x = [NO_LEADER] * len(start), start
        if state.exists:
            saved = np.load(io.BytesIO(state.get[0]))
            keys, x = saved["keys"].tolist(), saved["x"]
        out = []
        fresh = _unit(rows["v"].tolist())
        known = list(x)
        for i in range(len(rows)):
            sims = np.stack(known) @ fresh[i] if known else np.zeros(0)
            best = int(np.round(sims, DIGITS).argmax()) if len(sims) else -1
            similarity = float(sims[best]) if best >= 0 else 0.0
            hit = best >= 0 and round(similarity, EXACT) >= tau
            if not hit:
                known.append(fresh[i])
                keys.append(int(rows["k"][i]))
                best = len(keys) - 1
            out.append((group[0], rows["k"][i], None if keys[best] == NO_LEADER else keys[best], best, round(similarity, DIGITS), hit))
        buffer = io.BytesIO()
        np.savez(buffer, keys=np.array(keys, np.int64), x=np.stack(known))
        state.update((buffer.getvalue(),))
        frame = pd.DataFrame(out, columns=["block", key, "leader", "canonical_id", "similarity", "cache_hit"])
        yield frame.astype({"leader": "Int64"})

    rows = prompts.select((F.col(block).cast("string") if block else F.lit("all")).alias("b"), F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    return rows.groupBy("b").applyInPandasWithState(
        step, f"block string, {key} long, leader long, canonical_id long, similarity double, cache_hit boolean", "inventory binary", "append", GroupStateTimeout.NoTimeout
    )


def running_stats(events: DataFrame, hit: str = "cache_hit", total_ms: str = "pipeline_total_ms") -> DataFrame:
    """The service statistics over all events so far; write it in complete mode."""
    return service_stats(events, hit, total_ms)


def log_events(events: DataFrame, path: str, checkpoint: str, seconds: float = 2.0, once: bool = False):
    """Starts a JSON log that is flushed every so many seconds; with ``once`` it takes what is there and ends."""
    writer = events.writeStream.format("json").option("ignoreNullFields", "false").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def search_stream(prompts: DataFrame, read_inventory: Callable[[SparkSession], DataFrame], tau: float, sink: Callable[[DataFrame, int], None], checkpoint: str, key: str = "vec_id", vector: str = "embedding", once: bool = False):
    """Starts a search of arriving prompts against an inventory that is read anew for each micro-batch."""

    def each(batch: DataFrame, number: int) -> None:
        sink(nearest(batch, read_inventory(batch.sparkSession), tau, key, vector), number)

    writer = prompts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
