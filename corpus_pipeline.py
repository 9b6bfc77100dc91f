"""From documents to packed training sequences: five stages, each a written table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.line_dedup import dedup_lines
from lodestrata.llm.mixing import mix
from lodestrata.llm.near_duplicates import near_duplicates
from lodestrata.llm.packing import pack_documents
from lodestrata.llm.quality_rules import judge
from lodestrata.llm.shared import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to the base rules and to the thresholds of their language and source."""
    return judge(docs, workspace=Workspace(spark, "rules")).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has, in these or nearly these words. A document of which
    no word is left goes; n_chars is counted anew."""
    out = dedup_lines(docs, Workspace(spark, "lines"))
    left = out.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8), the one with the smallest doc_id.
    Of rows that share a doc_id one stays. Rows with null doc_id stay as they are."""
    near = near_duplicates(docs, Workspace(spark, "near"), percent=80, rows_per_band=5)
    keep = near.where("kept").select("doc_id").distinct()
    one = docs.join(keep, "doc_id").withColumn("same_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("same_id = 1")
    return one.select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights that follow the square root of their size, each document as often as a Poisson number says."""
    return mix(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens, with their ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: SQL expresses neither fuzzy links nor packing; tests/llm compares the operators of the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's table is written to the shared folder and read again by the next."""
    workspace = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = workspace.save(stage(spark, docs, sf_dir), name)
    return docs
