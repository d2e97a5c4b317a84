"""Prompt generators: paraphrase transforms, expansion, shuffling, workload crosses and invented clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions.text import strip

# Openings by which a text counts as conditional already, verbs that allow a passive, and what is put first.
_CONDITIONAL = ["if ", "when ", "given "]
CONDITIONAL_LEAD = "Given the input below, "
PASSIVE_LEAD = "The following task should be completed: "
ACTION_VERBS = ["write", "create", "generate", "produce", "provide", "list", "identify", "find", "extract", "determine", "classify", "translate"]

#: Our own wordings, from which a hash of the text picks.
PURPOSES = ["As input for a later step", "To make a review easier", "For a short written record", "So that others can follow along"]
OUTPUTS = ["The result wanted is this", "What should come back is this", "Deliver the outcome of this"]
WARNINGS = ["Without skipping details, ", "Not loosely but with care, ", "Leaving nothing aside, "]

#: Words of invented clusters.
VERBS, FORMS = ["Summarize", "Rewrite", "Explain", "Compare", "Outline", "Check"], ["a table", "three points", "plain words", "one paragraph", "a list"]
TOPICS = ["the harvest report", "a travel diary", "the meeting notes", "a bridge survey", "the museum guide", "a river map", "the choir schedule"]
OPENINGS = ["", "Please ", "Kindly ", "As an editor, ", "For the archive, ", "Before noon, ", "With care, ", "Once more, ", "In this order, ", "For new readers, "]


def _lowered(text: Column) -> Column:
    """Without closing marks, the first letter small."""
    bare = F.regexp_replace(text, "[.!?]+$", "")
    return F.concat(F.lower(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.char_length(bare)))


def _picked(text: Column, options: list[str], seed: int) -> Column:
    return F.get(F.array(*map(F.lit, options)), (F.conv(F.substring(F.md5(F.concat(text, F.lit(str(seed)))), 1, 6), 16, 10).cast("long") % len(options)).cast("int"))


def conditional(text: Column) -> Column:
    """'Given the input below, ...'; null for a text that is conditional already."""
    starts = [F.lower(text).startswith(p) for p in _CONDITIONAL]
    return F.when(~(starts[0] | starts[1] | starts[2]), F.concat(F.lit(CONDITIONAL_LEAD), _lowered(text), F.lit(".")))


def purpose(text: Column, seed: int = 42) -> Column:
    """A purpose first."""
    return F.concat(_picked(text, PURPOSES, seed), F.lit(", "), _lowered(text), F.lit("."))


def passive(text: Column) -> Column:
    """'The following task should be completed: ...'; null unless the text starts with an action verb."""
    verb = F.lower(text).rlike("^(?:" + "|".join(ACTION_VERBS) + ")")
    return F.when(verb, F.concat(F.lit(PASSIVE_LEAD), _lowered(text), F.lit(".")))


def output_first(text: Column, seed: int = 42) -> Column:
    """The output first."""
    return F.concat(_picked(text, OUTPUTS, seed), F.lit(": "), _lowered(text), F.lit("."))


def negation(text: Column, seed: int = 42) -> Column:
    """What not to do first."""
    return F.concat(_picked(text, WARNINGS, seed), _lowered(text), F.lit("."))


#: Transforms in the order in which an expansion uses them.
TRANSFORMS = {"conditional": conditional, "purpose": purpose, "passive": passive, "output_first": output_first, "negation": negation}


def paraphrases(rows: DataFrame, key: str = "ord", text: str = "text") -> DataFrame:
    """(key, transform, text): every transform of every non-blank text that takes it."""
    body = strip(F.col(text))
    each = F.array(*[F.struct(F.lit(n).alias("transform"), f(body).alias("new")) for n, f in TRANSFORMS.items()])
    out = rows.where(body != "").select(key, F.explode(each).alias("t"))
    return out.select(key, "t.transform", F.col("t.new").alias(text)).where(F.col(text).isNotNull())


def expand(rows: DataFrame, target: int, cluster: str = "cluster_id", key: str = "ord", text: str = "text") -> DataFrame:
    """(cluster, variant_id, text): given texts first, then their transforms in turn, distinct, ``target`` at most.

    Texts that differ in white space only are the same. The order of transforms is fixed, so is the result.
    """
    place = F.element_at(F.create_map(*[x for i, n in enumerate(TRANSFORMS) for x in (F.lit(n), F.lit(i + 1))]), F.col("transform"))
    given = rows.select(cluster, F.col(key).alias("k"), F.lit(0).alias("turn"), strip(F.col(text)).alias(text))
    made = paraphrases(rows.select(F.struct(cluster, key).alias("id"), text), "id", text)
    made = made.select(F.col(f"id.{cluster}").alias(cluster), F.col(f"id.{key}").alias("k"), place.alias("turn"), text)
    flat = F.regexp_replace(text, r"\s+", " ")
    first = given.unionAll(made).where(F.col(text) != "").groupBy(cluster, flat.alias("f")).agg(F.min(F.struct("turn", "k", text)).alias("b"))
    nth = F.row_number().over(Window.partitionBy(cluster).orderBy("b.turn", "b.k")) - 1
    return first.withColumn("variant_id", nth).where(F.col("variant_id") < target).select(cluster, "variant_id", F.col(f"b.{text}").alias(text))


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order that depends on key and seed only."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def workload(contexts: DataFrame, tasks: DataFrame) -> DataFrame:
    """(cluster, paraphrase_index, text): each cluster's context with each of its task paraphrases."""
    joined = contexts.join(tasks, "cluster")
    return joined.select("cluster", "paraphrase_index", F.concat("context", F.lit("\n\nTask: "), "task").alias("text"))


def invented_clusters(spark: SparkSession, clusters: int = 50, variants: int = 10) -> DataFrame:
    """(id, category, cluster_id, variant_id, text, is_canonical, canonical): paraphrase records from word tables.

    A cluster is a verb, a form and a topic; a variant wraps them in other words. The shortest variant is canonical.
    """
    pick = lambda options, at: F.get(F.array(*map(F.lit, options)), (at % len(options)).cast("int"))
    c, v = F.col("id") % clusters, (F.col("id") / clusters).cast("long")
    rows = spark.range(clusters * variants).select(F.col("id").alias("id"), (c + 1).alias("cluster_id"), v.alias("variant_id"))
    c0, v = F.col("cluster_id") - 1, F.col("variant_id")
    verb, opening = pick(VERBS, c0), pick(OPENINGS, v)
    body = F.concat(F.when(opening == "", verb).otherwise(F.lower(verb)), F.lit(" "), pick(TOPICS, (c0 / len(VERBS)).cast("long") + c0), F.lit(" as "), pick(FORMS, c0), F.when(v >= len(OPENINGS), F.concat(F.lit(", part "), v.cast("string"))).otherwise(F.lit("")), F.lit("."))
    rows = rows.withColumn("category", F.lower(verb)).withColumn("text", F.concat(opening, body))
    shortest = F.min(F.struct(F.size(F.split("text", " ")).alias("n"), F.col("variant_id"), F.col("text"))).over(Window.partitionBy("cluster_id"))
    rows = rows.withColumn("b", shortest)
    return rows.select("id", "category", "cluster_id", "variant_id", "text", (F.col("b.variant_id") == F.col("variant_id")).alias("is_canonical"), F.col("b.text").alias("canonical"))
