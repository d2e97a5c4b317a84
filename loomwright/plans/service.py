"""The data side of a prompt service: requests in, forwarded messages, results and log rows out.

Functions carry the names of the endpoints they stand for; forwarding to a model backend is not a Spark job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.config import Options
from loomwright.operators import metrics, routing
from loomwright.operators.storage import keep, numbered
from loomwright.plans.pipeline import process


@dataclass
class Served:
    """What a batch of requests comes to."""

    forwarded: DataFrame
    results: DataFrame
    log: DataFrame


def process_requests(requests: DataFrame, options: Options | None = None, key: str = "request_id", prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """(results, rejected): prompts, or lists of them, through the pipeline. These are not counted as service requests."""
    accepted, rejected = routing.validate(requests, prompt)
    return process(accepted, options=options, key=key, text=prompt), rejected


def chat_completions(messages: DataFrame, options: Options | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Served:
    """Processes what is to be processed in each conversation.

    forwarded: all messages with processed texts in place; results: one row for each conversation (that of its recorded
    message; without one, its last text unchanged); log: event rows. Messages are unified in the order (conv, turn).
    """
    options = options or Options()
    routed = keep(routing.route(messages, options.serving.compressible_roles, conv, turn, role, text), "routed")
    # Numbers in (conv, turn) order, whatever their size.
    routed = keep(numbered(routed.withColumn("__at", F.struct(conv, turn)), "__at", "n"), "numbered").drop("__at")
    number = F.col("n")
    todo = routed.where("processed").select(number.alias("n"), F.col(text).alias("text"))
    done = keep(process(todo, options=options, key="n"), "processed")
    forwarded = routed.join(done.select("n", "final_prompt"), "n", "left").select(conv, turn, role, F.coalesce("final_prompt", text).alias(text))

    rec = routing.recorded_prompts(messages, conv, turn, role, text).join(routed.select(conv, turn, "n"), [conv, turn])
    fields = ["final_prompt", "original_tokens", "compressed_tokens", "token_reduction", "cache_hit", "similarity", "canonical_id"]
    joined = rec.join(done.select("n", *fields), "n", "left")
    results = joined.select(
        conv,
        F.col(text).alias("raw_prompt"),
        F.coalesce("final_prompt", text).alias("final_prompt"),
        "original_tokens",
        "compressed_tokens",
        F.coalesce("token_reduction", F.lit(0.0)).alias("token_reduction"),
        F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"),
        "similarity",
        "canonical_id",
        "noop",
    )
    return Served(forwarded, results, routing.event_log(results.withColumn("request_id", F.col(conv))))


def stats(log: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Service statistics, with the size of the inventory if one is given."""
    out = metrics.service_stats(log)
    return out if inventory is None else out.join(F.broadcast(inventory.agg(F.count("*").alias("canonical_inventory_size"))))
