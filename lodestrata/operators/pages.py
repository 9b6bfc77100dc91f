"""Operators on page-level text (the contract of PDF documents: path, page_index, text, has_images)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS_POINTS, doc_stats, strip
from .config import AnalysisConfig


def page_stats(pages: DataFrame) -> DataFrame:
    """pages with page_chars (stripped) and the edge lines: first and last non-empty line of 8 to 120 characters."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), strip), lambda x: F.length(x) > 0)
    fit = lambda x: F.when(F.length(x).between(8, 120), x)
    return pages.withColumn("page_chars", F.length(strip(F.coalesce("text", F.lit("")))).cast("long")).withColumn("_lines", lines).withColumn("header", fit(F.get("_lines", F.lit(0)))).withColumn("footer", fit(F.get("_lines", F.size("_lines") - 1))).drop("_lines")


def page_summary(pages: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """One row per path: pages, image pages, poor pages, smallest and largest page, and the length of the pages joined by blank lines."""
    p = page_stats(pages)
    return p.groupBy("path").agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.coalesce("has_images", F.lit(False))).alias("n_image_pages"),
        F.count_if(F.col("page_chars") < config.pdf_poor_page_chars).alias("n_poor_pages"),
        F.min("page_chars").alias("min_page_chars"),
        F.max("page_chars").alias("max_page_chars"),
        (F.sum(F.length(F.coalesce("text", F.lit("")))) + 2 * (F.count("*") - 1)).alias("n_chars"),
    )


def page_flags(summary: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(path, code) of PDF_OCR_LIKELY, PDF_UNEVEN_PAGE_TEXT and PDF_LARGE_OR_COMPLEX."""
    n, chars, poor = F.col("n_pages"), F.col("n_chars"), F.col("n_poor_pages")
    few = (n < 3) & (chars > 0)
    ocr = F.when(few, (chars < config.pdf_poor_page_chars) & (F.col("n_image_pages") > 0)).when(n == 0, chars < config.pdf_poor_page_chars).otherwise(F.try_divide(poor.cast("double"), n) >= config.pdf_poor_page_ratio)
    uneven = ~few & (n > 0) & (poor >= F.greatest(F.lit(2), F.floor(n * config.pdf_uneven_ratio))) & (poor < n)
    large = (n >= config.pdf_large_pages) | (chars >= config.large_document_chars)
    codes = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in (("PDF_OCR_LIKELY", ocr), ("PDF_UNEVEN_PAGE_TEXT", uneven), ("PDF_LARGE_OR_COMPLEX", large)))))
    return summary.select("path", F.explode(codes).alias("code"))


def repeated_edges(pages: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Repeated headers and footers: path, role, line, pages with it and their share; the most frequent line of each role, first seen first."""
    p = page_stats(pages)
    n = p.groupBy("path").agg(F.count("*").alias("n_pages"))
    edges = p.select("path", "page_index", F.explode(F.array(F.struct(F.lit("header").alias("role"), F.col("header").alias("line")), F.struct(F.lit("footer").alias("role"), F.col("footer").alias("line")))).alias("e")).where("e.line IS NOT NULL")
    counts = edges.groupBy("path", "e.role", "e.line").agg(F.count("*").alias("n_with"), F.min("page_index").alias("seen"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("path", "role").orderBy(F.desc("n_with"), "seen"))).where("r = 1")
    fit = (F.col("n_pages") >= config.pdf_edge_min_pages) & (F.col("n_with") >= config.pdf_edge_min_pages) & (F.try_divide(F.col("n_with").cast("double"), F.col("n_pages")) >= config.pdf_edge_ratio)
    return top.join(n, "path").where(fit).select("path", "role", F.substring("line", 1, 120).alias("line"), "n_with", F.round(F.col("n_with") / F.col("n_pages"), 3).alias("share"))


def layout_flags(joined: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(path, code) of PDF_EXTRACTION_ANOMALY and PDF_TABLE_RICH, over doc_stats() of the joined pages and n_pages."""
    lines, chars = F.col("line_count"), F.col("total_chars")
    anomaly = (F.col("n_pages") > 0) & (chars >= 200) & (lines >= 40) & (F.try_divide(F.col("very_short_line_count").cast("double"), lines) >= 0.8) & (chars < 80 * F.col("n_pages"))
    table = (lines >= 20) & (F.try_divide(F.col("table_like_line_count").cast("double"), lines) >= config.pdf_table_ratio)
    codes = F.array_compact(F.array(F.when(anomaly, F.lit("PDF_EXTRACTION_ANOMALY")), F.when(table, F.lit("PDF_TABLE_RICH"))))
    return joined.select("path", F.explode(codes).alias("code"))


def split_pages(docs: DataFrame, break_at: str = "\n") -> DataFrame:
    """Pages made of documents cut at a separator, one row per page, numbered from 0."""
    path = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return docs.select(path.alias("path"), F.posexplode(F.split("text", break_at)).alias("page_index", "text")).withColumn("has_images", F.col("page_index") % 3 == 0)


def _pages(spark, sf_dir: str) -> DataFrame:
    return split_pages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _layout(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    joined = doc_stats(docs.select(path.alias("path"), "text").withColumn("n_pages", F.size(F.split("text", "\n"))))
    return layout_flags(joined, AnalysisConfig(pdf_table_ratio=0.05))


_LOOSE = AnalysisConfig(pdf_poor_page_chars=60, pdf_edge_ratio=0.2, pdf_large_pages=20)
_P = """pages0 AS (SELECT 'doc-' || lpad(doc_id::VARCHAR, 12, '0') AS path, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page_index, unnest(string_split(text, chr(10))) AS text FROM documents),
p AS (SELECT *, page_index % 3 = 0 AS has_images, length(trim(text, w))::BIGINT AS page_chars, CASE WHEN length(trim(text, w)) BETWEEN 8 AND 120 THEN trim(text, w) END AS line FROM pages0, ws),
s AS (SELECT path, count(*) AS n_pages, count(*) FILTER (has_images) AS n_image_pages, count(*) FILTER (page_chars < 60) AS n_poor_pages, min(page_chars) AS min_page_chars, max(page_chars) AS max_page_chars, (sum(length(text)) + 2 * (count(*) - 1))::BIGINT AS n_chars FROM p GROUP BY path)"""


def _sql() -> dict[str, str]:
    head = f"WITH ws AS (SELECT {' || '.join(f'chr({x})' for x in WS_POINTS)} AS w), {_P}"
    few = "n_pages < 3 AND n_chars > 0"
    return {
        "page_summary": f"{head} SELECT * FROM s",
        "page_flags": f"""{head} SELECT path, 'PDF_OCR_LIKELY' AS code FROM s WHERE CASE WHEN {few} THEN n_chars < 60 AND n_image_pages > 0 WHEN n_pages = 0 THEN n_chars < 60 ELSE n_poor_pages::DOUBLE / n_pages >= 0.4::DOUBLE END
UNION ALL SELECT path, 'PDF_UNEVEN_PAGE_TEXT' FROM s WHERE NOT ({few}) AND n_poor_pages >= greatest(2, floor(n_pages * 0.25)) AND n_poor_pages < n_pages
UNION ALL SELECT path, 'PDF_LARGE_OR_COMPLEX' FROM s WHERE n_pages >= 20 OR n_chars >= 100000""",
        "page_repeated_edges": f"""{head}, e AS (SELECT path, page_index, role, line FROM p, (VALUES ('header'), ('footer')) AS r(role) WHERE line IS NOT NULL),
c AS (SELECT path, role, line, count(*) AS n_with, min(page_index) AS seen FROM e GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY path, role ORDER BY n_with DESC, seen) AS r FROM c)
SELECT path, role, substr(line, 1, 120) AS line, n_with, round(n_with / n_pages, 3) AS share FROM t JOIN s USING (path) WHERE r = 1 AND n_pages >= 4 AND n_with >= 4 AND n_with::DOUBLE / n_pages >= 0.2::DOUBLE""",
    }


QUERIES = {
    "page_summary": lambda s, d: page_summary(_pages(s, d), _LOOSE),
    "page_flags": lambda s, d: page_flags(page_summary(_pages(s, d), _LOOSE), _LOOSE),
    "page_repeated_edges": lambda s, d: repeated_edges(_pages(s, d), _LOOSE),
    "page_layout_flags": _layout,
}
ORACLE_SQL = _sql()
