"""The stateless part of the analysis on a stream of documents, and a running count of exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import doc_stats
from ..operators.config import AnalysisConfig
from ..operators.corpus import flags, text_predicates


def flag_stream(docs: DataFrame, key: str = "path", config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(key, code, extra) of a stream with columns key and text, for append output."""
    return flags(doc_stats(docs, short_line_chars=config.short_line_chars), text_predicates(config), key)


def duplicate_stream(docs: DataFrame) -> DataFrame:
    """content_hash and size of groups of equal texts so far, for complete or update output."""
    return doc_stats(docs).where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count("*").alias("size")).where("size > 1")
