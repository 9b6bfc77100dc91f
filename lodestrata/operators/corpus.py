"""Corpus analysis: per-document flags, findings with bounded samples, exact duplicates, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .config import AnalysisConfig

# Finding codes with category and severity.
FINDINGS = {
    "DISCOVERY_ERRORS": ("inventory", "medium"),
    "EMPTY_DOCUMENTS": ("empty_documents", "high"),
    "EXACT_DUPLICATES": ("duplicates", "high"),
    "EXCESSIVE_WHITESPACE": ("text_quality", "low"),
    "HIGH_SYMBOL_RATIO": ("text_quality", "low"),
    "HTML_BOILERPLATE_DOMINATION": ("html", "medium"),
    "HTML_CODE_HEAVY": ("html", "info"),
    "HTML_LARGE_DOCUMENT": ("html", "info"),
    "HTML_LOW_MAIN_CONTENT_RATIO": ("html", "medium"),
    "HTML_REPEATED_NAVIGATION": ("html", "low"),
    "LOAD_ERRORS": ("inventory", "medium"),
    "LONG_UNINTERRUPTED_BLOCKS": ("chunkability", "medium"),
    "OVERLY_FRAGMENTED_LINES": ("chunkability", "low"),
    "PDF_EXTRACTION_ANOMALY": ("pdf", "low"),
    "PDF_LARGE_OR_COMPLEX": ("pdf", "info"),
    "PDF_OCR_LIKELY": ("pdf", "high"),
    "PDF_REPEATED_HEADER_FOOTER": ("pdf", "medium"),
    "PDF_TABLE_RICH": ("pdf", "info"),
    "PDF_UNEVEN_PAGE_TEXT": ("pdf", "medium"),
    "REPEATED_LINE_CONTENT": ("text_quality", "medium"),
    "UNSUPPORTED_FILES": ("inventory", "info"),
    "VERY_LARGE_DOCUMENTS": ("document_size", "medium"),
    "VERY_SMALL_DOCUMENTS": ("document_size", "medium"),
}
SEVERITIES = {"high": 0, "medium": 1, "low": 2, "info": 3}
TEXT_CODES = ("EMPTY_DOCUMENTS", "EXCESSIVE_WHITESPACE", "HIGH_SYMBOL_RATIO", "LONG_UNINTERRUPTED_BLOCKS", "OVERLY_FRAGMENTED_LINES", "REPEATED_LINE_CONTENT", "VERY_LARGE_DOCUMENTS", "VERY_SMALL_DOCUMENTS")


def text_predicates(c: AnalysisConfig = AnalysisConfig(), code_heavy: Column | None = None) -> dict[str, tuple[Column, Column]]:
    """Predicate and extra number of each text code, over the columns of doc_stats()."""
    col, some = F.col, ~F.col("is_empty")
    none = F.lit(None).cast("long")
    ratio = lambda a, b, least, r: (col(b) >= least) & F.coalesce(F.try_divide(col(a).cast("double"), col(b)) >= r, F.lit(False))
    return {
        "EMPTY_DOCUMENTS": (col("is_empty"), none),
        "VERY_SMALL_DOCUMENTS": (some & (col("meaningful_length") < c.small_document_chars), col("meaningful_length")),
        "VERY_LARGE_DOCUMENTS": (some & (col("meaningful_length") >= c.large_document_chars), col("meaningful_length")),
        "HIGH_SYMBOL_RATIO": (some & ratio("symbol_chars", "non_ws_chars", c.symbol_min_chars, c.symbol_ratio) & ~(F.lit(False) if code_heavy is None else F.coalesce(code_heavy, F.lit(False))), none),
        "EXCESSIVE_WHITESPACE": (some & ratio("whitespace_chars", "total_chars", c.whitespace_min_chars, c.whitespace_ratio), none),
        "REPEATED_LINE_CONTENT": (some & ratio("max_repeated_line_count", "line_count", c.repeated_min_lines, c.repeated_line_ratio), none),
        "LONG_UNINTERRUPTED_BLOCKS": (some & (col("max_paragraph_length") >= c.long_block_chars), none),
        "OVERLY_FRAGMENTED_LINES": (some & ratio("short_line_count", "line_count", c.fragmented_min_lines, c.fragmented_ratio), none),
    }


def flags(stats: DataFrame, predicates: dict[str, tuple[Column, Column]], key: str = "path") -> DataFrame:
    """One row (key, code, extra) per predicate that holds, in one scan."""
    some = F.array_compact(F.array(*(F.when(p, F.struct(F.lit(k).alias("code"), x.cast("long").alias("extra"))) for k, (p, x) in predicates.items())))
    return stats.select(key, F.explode(some).alias("f")).select(key, "f.code", "f.extra")


def flag_counts(flagged: DataFrame, codes=tuple(FINDINGS)) -> DataFrame:
    """(code, n_documents) for every code, zeros included."""
    spark = flagged.sparkSession
    every = spark.createDataFrame([(c,) for c in codes], "code string")
    n = flagged.groupBy("code").agg(F.count("*").alias("n"))
    return every.join(n, "code", "left").select("code", F.coalesce("n", F.lit(0)).cast("long").alias("n_documents"))


def findings(flagged: DataFrame, key: str = "path", most: int = 50, sample: int = 10) -> DataFrame:
    """One row per code that occurs: category, severity, exact count, the first `most` keys in order and their extras.

    The cap is a rank within a code that Spark applies before the shuffle, so a code that holds for all documents
    sends `most` rows per task.
    """
    spark = flagged.sparkSession
    known = spark.createDataFrame([(k, c, s, SEVERITIES[s]) for k, (c, s) in FINDINGS.items()], "code string, category string, severity string, severity_rank int")
    counts = flagged.groupBy("code").agg(F.count("*").alias("count"))
    w = Window.partitionBy("code").orderBy(key)
    first = flagged.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    lists = first.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("r", F.col(key).alias("k"), "extra"))).alias("s"))
    return known.join(counts, "code").join(lists, "code").select("code", "category", "severity", "severity_rank", "count", F.transform("s", lambda x: x["k"]).alias("affected"), F.slice(F.transform("s", lambda x: x["k"]), 1, sample).alias("samples"), F.transform("s", lambda x: x["extra"]).alias("extras")).orderBy("severity_rank", "code")


def severity_counts(found: DataFrame) -> DataFrame:
    every = found.sparkSession.createDataFrame([(k, v) for k, v in SEVERITIES.items()], "severity string, severity_rank int")
    n = found.groupBy("severity").agg(F.count("*").alias("n"))
    return every.join(n, "severity", "left").select("severity", "severity_rank", F.coalesce("n", F.lit(0)).alias("n_findings"))


def duplicates(stats: DataFrame, key: str = "path") -> DataFrame:
    """Groups of documents with equal normalised text: content_hash, size, first key; largest first, ties by first key."""
    return stats.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count("*").alias("size"), F.min(key).alias("first_key")).where("size > 1").orderBy(F.desc("size"), "first_key")


def duplicate_samples(stats: DataFrame, key: str = "path", groups: int = 10, keys: int = 10) -> DataFrame:
    """The first keys of the largest groups of duplicates."""
    top = duplicates(stats, key).limit(groups)
    w = Window.partitionBy("content_hash").orderBy(key)
    return stats.join(F.broadcast(top), "content_hash").withColumn("r", F.row_number().over(w)).where(F.col("r") <= keys).select("content_hash", "size", F.col("r").cast("long").alias("rank_in_group"), key)


def duplicate_members(stats: DataFrame, key: str = "path", most: int = 50) -> DataFrame:
    """The first `most` keys when groups are taken largest first and keys in order within a group, then sorted by key."""
    groups = duplicates(stats, key).limit(most)
    w = Window.partitionBy("content_hash").orderBy(key)
    capped = stats.join(F.broadcast(groups), "content_hash").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return capped.orderBy(F.desc("size"), "first_key", key).limit(most).select(key).orderBy(key)


def inventory(stats: DataFrame, size: str = "size_bytes") -> DataFrame:
    """One row: documents, total, mean, exact median, smallest and largest characters, bytes. An empty table gives 0, 0.0 and nulls."""
    chars = F.col("total_chars")
    return stats.agg(
        F.count("*").alias("n_documents"),
        F.coalesce(F.sum(chars), F.lit(0)).cast("long").alias("total_chars"),
        F.coalesce(F.avg(chars), F.lit(0.0)).alias("avg_chars"),
        F.coalesce(F.percentile(chars, 0.5), F.lit(0.0)).alias("median_chars"),
        F.min(chars).alias("min_chars"),
        F.max(chars).alias("max_chars"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"),
    )


def counts_by(docs: DataFrame, column: str, none: str = "(none)") -> DataFrame:
    return docs.groupBy(F.when(F.coalesce(F.col(column), F.lit("")) == "", none).otherwise(F.col(column)).alias(column)).agg(F.count("*").alias("n")).orderBy(column)
