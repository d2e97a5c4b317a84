"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it keeps is written as Parquet and
read again as the next stage's documents. Other columns of the input than those of documents are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import decontamination, line_dedup, near_copies, packing, store, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CAPACITY, END_ID = 1024, 2
#: Of the near-dedup stage: words of a shingle, and differing bits of 64 of a first guess. Shingle sets with a Jaccard
#: similarity of 0.8 differ in some 9 bits on average, so pairs beyond the guess are found by shared shingles.
SHINGLE, DISTANCE = 5, 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Each row is scored by its whole text alone, of any length; a null text counts as empty. Rows with null or equal ids,
    and repeated rows, are scored like others; their labels are those of their id. Without labels all have one score.
    """
    model = toxicity.fit(docs, store.read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.3).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds go; every document stays, with what is left of it.

    A null text is an empty one afterwards. Rows of one id are one document, but lose their own lines only; a row with
    a null id is a document of its own, after all others. Lines of any length count.
    """
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id; of rows with that id, one.

    Rows are told apart by id and text, so rows of one id with different texts stay, and so do rows with a null id,
    which come after all ids; of repeated rows one stays. Null and wordless texts are copies of each other. Whole texts are
    compared.
    """
    groups = near_copies.near_copies(docs, shingle=SHINGLE, max_distance=DISTANCE)
    # Null ids are compared as 0 and a flag: plain equalities, so that one exchange of the texts serves the join and the repeats.
    key = {"__id": F.coalesce("__k", F.lit(0)), "__null": F.isnull("__k")}
    first = groups.where("kept").select(F.col("doc_id").cast("long").alias("__k"), F.col("row").alias("__row")).withColumns(key).drop("__k").distinct()
    rows = docs.withColumn("__row", near_copies.row_hash("doc_id", "text")).withColumn("__k", F.col("doc_id").cast("long")).withColumns(key)
    same = ["__id", "__null", "__row"]
    return rows.join(first, same, "left_semi").dropDuplicates(same).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage of ten words, or a whole shorter item, go.

    Each row is judged by its own whole text, whatever its id; null and wordless texts stay, repeated rows go or stay
    together. Without benchmark items all stay.
    """
    found = decontamination.find_contamination(docs, store.read_table(spark, sf_dir, "benchmark"), window=10, row="row")
    dirty = found.where(F.size("hits") > 0).select(F.col("doc_id").alias("__id"), F.col("row").alias("__dirty")).distinct()
    mine = F.col("doc_id").eqNullSafe(F.col("__id")) & (decontamination.row_hash("doc_id", "text") == F.col("__dirty"))
    return docs.join(dirty, mine, "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences.

    A null or empty text is a piece of the end id only; a long one is cut, none is shortened; rows with null or equal ids
    are packed like others.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Label models, SimHash and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = store.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
