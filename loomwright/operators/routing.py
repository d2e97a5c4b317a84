"""Chat messages: which are processed, which request is recorded, validation and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import is_blank, preview, strip

#: Roles whose every message is processed.
COMPRESSIBLE = ["system"]
#: Roles that count as the user's in chat data sets.
USER_ROLES = ["human", "user", "Human", "User", "from"]


def route(messages: DataFrame, roles: list[str] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Adds processed (this message goes through the pipeline) and recorded (it stands for its request).

    Every non-blank message of a compressible role is processed and the first of them recorded; a conversation
    without one has its last non-blank user message processed and recorded.
    """
    whole, turns = Window.partitionBy(conv), Window.partitionBy(conv, "__kind")
    open_ = ~is_blank(F.col(text))
    kind = F.when(F.col(role).isin(roles or COMPRESSIBLE) & open_, "first").when((F.col(role) == "user") & open_, "last")
    df = messages.withColumn("__kind", kind)
    df = df.withColumn("__any", F.max((F.col("__kind") == "first").cast("int")).over(whole))
    df = df.withColumn("__lo", F.min(turn).over(turns)).withColumn("__hi", F.max(turn).over(turns))
    has = F.coalesce(F.col("__any"), F.lit(0)) == 1
    first = F.coalesce(F.col("__kind") == "first", F.lit(False))
    last = F.coalesce(F.col("__kind") == "last", F.lit(False)) & ~has & (F.col(turn) == F.col("__hi"))
    return df.select(*messages.columns, (first | last).alias("processed"), (F.when(has, first & (F.col(turn) == F.col("__lo"))).otherwise(last)).alias("recorded"))


def recorded_prompts(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, noop): one row for each conversation; without anything to process, its last message."""
    routed = route(messages, conv=conv, turn=turn, role=role, text=text)
    best = F.max(F.struct("recorded", F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"))).alias("b")
    rows = routed.groupBy(conv).agg(best)
    return rows.select(conv, F.col("b.t").alias(turn), F.col("b.r").alias(role), F.coalesce("b.x", F.lit("")).alias(text), (~F.col("b.recorded")).alias("noop"))


def first_user_prompts(messages: DataFrame, roles: list[str] | None = None, min_chars: int = 0, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, prompt): the first non-blank message of a user role, stripped, if longer than ``min_chars``."""
    rows = messages.where(F.col(role).isin(roles or USER_ROLES) & ~is_blank(F.col(text)))
    first = rows.groupBy(conv).agg(F.min(F.struct(F.col(turn).alias("t"), F.col(text).alias("x")))["x"].alias("p"))
    return first.select(conv, strip(F.col("p")).alias("prompt")).where(F.char_length("prompt") > min_chars)


def validate(requests: DataFrame, prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) requests: list prompts are joined by line ends, blank ones rejected with a status."""
    kind = requests.schema[prompt].dataType.typeName()
    joined = requests.withColumn(prompt, F.array_join(prompt, "\n")) if kind == "array" else requests
    blank = is_blank(F.col(prompt))
    return joined.where(~blank), joined.where(blank).withColumn("status", F.lit(400)).withColumn("error", F.lit("a prompt is required"))


def event_log(results: DataFrame, endpoint: str = "chat", model: str = "default", max_tokens: int = 512, temperature: float = 0.7) -> DataFrame:
    """Log rows for pipeline results (request_id, original_tokens, compressed_tokens, token_reduction, final_prompt,
    cache_hit, canonical_id, similarity); timings and errors are taken where the input has them."""
    have = set(results.columns)

    def take(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)

    # The names and order of a log row's fields.
    return results.select(
        take("request_id", "string"),
        take("timestamp", "double"),
        F.lit(endpoint).alias("endpoint"),
        F.coalesce(take("stream", "boolean"), F.lit(False)).alias("stream"),
        take("token_reduction", "double"),
        F.coalesce(take("cache_hit", "boolean"), F.lit(False)).alias("cache_hit"),
        *[take(n, "double") for n in ("compression_ms", "unification_ms", "pipeline_total_ms", "vllm_ttft_ms", "vllm_total_ms")],
        take("original_tokens", "long"),
        F.col("compressed_tokens").cast("long").alias("final_tokens"),
        (F.col("original_tokens") - F.col("compressed_tokens")).cast("long").alias("token_delta"),
        preview(F.col("final_prompt"), 500).alias("final_prompt"),
        take("canonical_id", "long"),
        take("similarity", "double"),
        take("error", "string"),
        take("bytes_streamed", "long"),
        F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature")).alias("request_meta"),
    )
