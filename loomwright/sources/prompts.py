"""Prompt sources: line and JSON files of several shapes, clusters, paraphrases, chats and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.text import strip
from loomwright.operators.dedupe import first_occurrences
from loomwright.operators.routing import first_user_prompts
from loomwright.operators.storage import numbered


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ord from 0, by counts of ranges."""
    return numbered(rows.withColumn("__o", F.struct(*order)), "__o", "ord")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, text): one prompt a line, stripped, without blank lines.

    Files are split and read in parallel; within a split the row ids grow, and splits are ordered by file and place.
    """
    lines = spark.read.text(path, lineSep="\n").select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"), strip(F.col("value")).alias("text"))
    return _numbered(lines.where("text != ''"), ["file_path", "file_block_start", "at"]).select("ord", "text")


def _elements(spark: SparkSession, path: str, root: str = "$") -> DataFrame:
    """(file_path, at, item): the elements of a JSON file's list, or of a list inside its object, as variants."""
    whole = spark.read.text(path, wholetext=True).select("_metadata.file_path", F.try_parse_json("value").alias("v"))
    items = F.from_json(F.to_json(F.variant_get("v", root, "variant")), "array<variant>")
    return whole.select("file_path", F.posexplode(items).alias("at", "item"))


def _is_text(item: Column) -> Column:
    return F.schema_of_variant(item) == "STRING"


def _field(item: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.try_variant_get(item, f"$.{n}", "string") for n in names])


def json_prompts(spark: SparkSession, path: str, fields: list[str] | None = None, flatten_clusters: bool = False, drop_blank: bool = False) -> DataFrame:
    """(ord, text, cluster_id): prompts of a JSON file.

    A list of strings is taken as is; of objects, the first of ``fields`` (default: prompt, text) that is there, else ''.
    An object has its list under "prompts". With ``flatten_clusters`` the "prompts" of listed objects are prompts too;
    with ``drop_blank`` texts are stripped and blank ones left out. cluster_id defaults to the row number.
    """
    fields = fields or ["prompt", "text"]
    rows = _elements(spark, path)
    inner = _elements(spark, path, "$.prompts")
    rows = rows.unionAll(inner.join(rows.select("file_path").distinct(), "file_path", "left_anti"))
    text = F.when(_is_text(F.col("item")), F.col("item").cast("string")).otherwise(F.coalesce(_field(F.col("item"), fields), F.lit("")))
    if flatten_clusters:
        nested = F.try_variant_get("item", "$.prompts", "array<string>")
        texts = F.when(nested.isNotNull(), nested).otherwise(F.array(text))
        rows = rows.select("file_path", "at", "item", F.posexplode(texts).alias("sub", "text"))
    else:
        rows = rows.select("file_path", "at", "item", F.lit(0).alias("sub"), text.alias("text"))
    if drop_blank:
        rows = rows.withColumn("text", strip(F.col("text"))).where("text != ''")
    given = F.when(~_is_text(F.col("item")), F.try_variant_get("item", "$.cluster_id", "long")).alias("given")
    rows = _numbered(rows.select("file_path", "at", "sub", "text", given), ["file_path", "at", "sub"])
    return rows.select("ord", "text", F.coalesce("given", "ord").alias("cluster_id"))


def prompts_or_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, text): the prompts of files that are JSON lists, or objects with a list; the lines of all other files."""
    whole = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value", F.try_parse_json("value").alias("v"))
    whole_list, inner_list = (F.coalesce(F.schema_of_variant(F.try_variant_get("v", root, "variant")).startswith("ARRAY"), F.lit(False)) for root in ("$", "$.prompts"))
    lists = whole_list | inner_list
    plain = whole.where(~lists).select("file_path", F.posexplode(F.split("value", "\n")).alias("at", "text"))
    items = _elements(spark, path).unionAll(_elements(spark, path, "$.prompts"))
    named = items.select("file_path", "at", F.when(_is_text(F.col("item")), F.col("item").cast("string")).otherwise(F.coalesce(_field(F.col("item"), ["prompt", "text"]), F.lit(""))).alias("text"))
    rows = named.unionAll(plain).withColumn("text", strip(F.col("text"))).where("text != ''")
    return _numbered(rows, ["file_path", "at"]).select("ord", "text")


def workload_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, paraphrase_index, text) of a list of {cluster, prompts}."""
    rows = spark.read.schema("cluster string, prompts array<string>").json(path, multiLine=True)
    return rows.select("cluster", F.posexplode("prompts").alias("paraphrase_index", "text"))


def paraphrase_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, category, variants): texts of each cluster by variant_id, which defaults to 0."""
    rows = spark.read.schema("id long, category string, cluster_id int, variant_id int, text string").json(path, multiLine=True)
    member = F.struct(F.coalesce("variant_id", F.lit(0)).alias("v"), F.col("id"), F.col("text"))
    grouped = rows.groupBy("cluster_id").agg(F.min("category").alias("category"), F.array_sort(F.collect_list(member)).alias("m"))
    return grouped.select("cluster_id", "category", F.col("m.text").alias("variants"))


def chat_prompts(conversations: DataFrame, n: int, min_chars: int = 20, scan_cap: int | None = None) -> DataFrame:
    """(conv_id, prompt): the first n long enough user prompts in the order of conv_id, of the first ``scan_cap``
    conversations if given (a source that is read in slices scans min(10 * n, 50000))."""
    if scan_cap is not None:
        first = conversations.select("conv_id").distinct().orderBy("conv_id").limit(scan_cap)
        conversations = conversations.join(first, "conv_id", "left_semi")
    return first_user_prompts(conversations, min_chars=min_chars).orderBy("conv_id").limit(n)


def bundle(sources: list[DataFrame], n: int | None = None) -> DataFrame:
    """(ord, text): sources (ord, text) one after the other, each text once where it comes first, the first n."""
    ranked = None
    for i, df in enumerate(sources):
        rows = df.select(F.lit(i).alias("src"), F.col("ord").alias("at"), "text")
        ranked = rows if ranked is None else ranked.unionByName(rows)
    rows = first_occurrences(ranked, "text", ["src", "at"])
    if n is not None:
        return _numbered(rows.orderBy("src", "at").limit(n), ["src", "at"]).select("ord", "text")
    return numbered(rows.select(F.struct("src", "at").alias("o"), "text"), "o", "ord").select("ord", "text")
