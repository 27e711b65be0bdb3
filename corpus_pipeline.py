"""A corpus pipeline: quality rules, line dedup, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, lines, packing, quality, suffixes
from tidemark.llm.queries import vocabulary
from tidemark.llm.shared import saved


def with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars (where there is one) of the new text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned rules reject go; null texts have no words and go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_rules(docs, labels).where("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on eight sites or more stay in their first document only; no document goes."""
    return with_text(lines.line_dedup(docs), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the row with the smallest id stays, null ids last.

    Every row is a document of its own, also if ids repeat or are null. Texts without a word stay."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        groups = jaccard.jaccard_join(docs, width=5, percent=80)
        return docs.join(groups.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    keyed = saved(docs.withColumn("row_key", F.monotonically_increasing_id()))  # saved, so that keys are the same in every job
    groups = jaccard.jaccard_join(keyed, id_col="row_key", width=5, percent=80)
    rows = keyed.select("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row_key").alias("place"))
    places = saved(groups.join(rows, "row_key").select("row_key", "component_id", "place"))
    first = places.groupBy("component_id").agg(F.min("place")["row_key"].alias("row_key"))
    return keyed.join(first.select("row_key"), "row_key", "left_semi").select(*docs.columns)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a 200-byte string that also starts elsewhere goes, with the rest of its character."""
    columns, rest = docs.columns, [c for c in docs.columns if c != "text"]
    row = F.struct(*rest, F.col("text").isNull().alias("no text"))
    kept = suffixes.suffix_dedup(docs.withColumn("row", row), id_col="row", whole_characters=True)
    text = F.when(~F.col("row.no text"), F.col("kept").cast("string")).alias("text")
    return with_text(kept.select(*(F.col(f"row.{c}") for c in rest), text), columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in the sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_stage),
    ("suffix-array dedup", passage_stage),
    ("packing", packing_stage),
]

#: Packing needs a tokenizer, which SQL does not have; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
