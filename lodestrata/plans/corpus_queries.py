"""Corpus queries over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS_POINTS, doc_stats
from ..operators import compare, corpus, pages
from ..operators.config import AnalysisConfig
from ..sources import html

LOOSE = AnalysisConfig(large_document_chars=10_000, symbol_ratio=0.10, whitespace_ratio=0.18, repeated_line_ratio=0.2, fragmented_ratio=0.3)


def _path(key: str):
    return F.concat(F.lit("doc-"), F.lpad(F.col(key).cast("string"), 12, "0"))


def stats(spark, sf_dir: str, table: str = "documents", key: str = "doc_id", *more: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(_path(key).alias("path"), "text", *more)
    return doc_stats(docs.withColumn("size_bytes", F.octet_length("text").cast("long"))).drop("text")


def _flagged(s: DataFrame, config=AnalysisConfig()) -> DataFrame:
    return corpus.flags(s, corpus.text_predicates(config))


_WS = "".join(f"\\x{{{p:x}}}" for p in WS_POINTS)
_TRIM = " || ".join(f"chr({p})" for p in WS_POINTS)


def _stats_sql(table: str = "documents", key: str = "doc_id", more: str = "") -> str:
    return f"""
ws AS (SELECT {_TRIM} AS w),
t0 AS (SELECT 'doc-' || lpad({key}::VARCHAR, 12, '0') AS path, coalesce(text, '') AS t, strlen(text)::BIGINT AS size_bytes{more} FROM {table}),
t1 AS (SELECT *, regexp_replace(t, '[{_WS}]', '', 'g') AS nws, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, w)), lambda x: length(x) > 0) AS lines,
  length(trim(t, w))::BIGINT AS meaningful_length FROM t0, ws),
stats AS (SELECT path, size_bytes{more}, length(t)::BIGINT AS total_chars, meaningful_length, meaningful_length = 0 AS is_empty, length(nws)::BIGINT AS non_ws_chars,
  (length(t) - length(nws))::BIGINT AS whitespace_chars, length(regexp_replace(nws, '[\\p{{L}}\\p{{N}}]', '', 'g'))::BIGINT AS symbol_chars,
  len(lines)::BIGINT AS line_count, len(list_filter(lines, lambda x: length(x) < 40))::BIGINT AS short_line_count, len(list_filter(lines, lambda x: length(x) < 8))::BIGINT AS very_short_line_count,
  len(list_filter(lines, lambda x: contains(x, ' | ') OR (contains(x, '  ') AND len(regexp_split_to_array(x, '[{_WS}]+')) >= 4)))::BIGINT AS table_like_line_count,
  list_max(list_transform(string_split(t, chr(10) || chr(10)), lambda x: length(trim(x, w))))::BIGINT AS max_paragraph_length,
  coalesce(list_max(list_transform(list_distinct(lines), lambda x: len(list_filter(lines, lambda y: y = x)))), 0)::BIGINT AS max_repeated_line_count,
  substr(lines[1], 1, 160) AS first_line, CASE WHEN meaningful_length > 0 THEN sha256(regexp_replace(trim(t, w), '[{_WS}]+', ' ', 'g')) END AS content_hash FROM t1)"""


def _flags_sql(c: AnalysisConfig) -> str:
    r = lambda a, b, least, x: f"NOT is_empty AND {b} >= {least} AND CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} >= {x}::DOUBLE ELSE false END"
    tests = {
        "EMPTY_DOCUMENTS": "is_empty",
        "VERY_SMALL_DOCUMENTS": f"NOT is_empty AND meaningful_length < {c.small_document_chars}",
        "VERY_LARGE_DOCUMENTS": f"NOT is_empty AND meaningful_length >= {c.large_document_chars}",
        "HIGH_SYMBOL_RATIO": r("symbol_chars", "non_ws_chars", c.symbol_min_chars, c.symbol_ratio),
        "EXCESSIVE_WHITESPACE": r("whitespace_chars", "total_chars", c.whitespace_min_chars, c.whitespace_ratio),
        "REPEATED_LINE_CONTENT": r("max_repeated_line_count", "line_count", c.repeated_min_lines, c.repeated_line_ratio),
        "LONG_UNINTERRUPTED_BLOCKS": f"NOT is_empty AND max_paragraph_length >= {c.long_block_chars}",
        "OVERLY_FRAGMENTED_LINES": r("short_line_count", "line_count", c.fragmented_min_lines, c.fragmented_ratio),
    }
    return "flags AS (" + " UNION ALL ".join(f"SELECT path, '{k}' AS code, {'meaningful_length' if k.startswith('VERY') else 'NULL::BIGINT'} AS extra FROM stats WHERE {t}" for k, t in tests.items()) + ")"


def _codes_sql(codes) -> str:
    return "codes(code) AS (VALUES " + ", ".join(f"('{c}')" for c in codes) + ")"


def _joined(df: DataFrame) -> DataFrame:
    return df.select("code", "category", "severity", "count", F.array_join("affected", ",").alias("affected"), F.array_join(F.transform("extras", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("extras"))


def finding_rows(spark, sf_dir: str) -> DataFrame:
    return _joined(corpus.findings(_flagged(stats(spark, sf_dir), LOOSE)))


_KNOWN = "known(code, category, severity, severity_rank) AS (VALUES " + ", ".join(f"('{k}', '{c}', '{s}', {corpus.SEVERITIES[s]})" for k, (c, s) in corpus.FINDINGS.items()) + ")"
_FINDINGS = "ranked AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY path) AS r FROM flags), found AS (SELECT code, count(*) AS count, string_agg(path, ',' ORDER BY path) FILTER (r <= 50) AS affected, string_agg(coalesce(extra::VARCHAR, '-'), ',' ORDER BY path) FILTER (r <= 50) AS extras FROM ranked GROUP BY code)"


def run_diff(spark, sf_dir: str) -> DataFrame:
    """Findings of all documents against those of the documents of source src0, as two runs."""
    s = stats(spark, sf_dir, "documents", "doc_id", "source")
    one, two = (corpus.findings(_flagged(x, LOOSE)) for x in (s.where("source = 'src0'"), s))
    return compare.finding_diff(one, two)


def run_metrics(spark, sf_dir: str) -> DataFrame:
    s = stats(spark, sf_dir, "documents", "doc_id", "source")
    return compare.metric_deltas(corpus.inventory(s.where("source = 'src0'")), corpus.inventory(s), ["n_documents", "total_chars", "min_chars", "max_chars", "total_bytes", "median_chars"])


def _by(column: str, table: str = "documents", key: str = "doc_id"):
    def query(spark, sf_dir: str) -> DataFrame:
        s = stats(spark, sf_dir, table, key, column)
        f = corpus.flags(s.withColumn("k", F.coalesce(column, F.lit("(none)"))), corpus.text_predicates(LOOSE), "k")
        return f.groupBy(F.col("k").alias(column), "code").agg(F.count("*").alias("n"))

    sql = f"WITH {_stats_sql(table, key, ', ' + column)}, {_flags_sql(LOOSE).replace('SELECT path', f'SELECT coalesce({column}, ' + chr(39) + '(none)' + chr(39) + ') AS k')} SELECT k AS {column}, code, count(*) AS n FROM flags GROUP BY ALL"
    return query, sql


def labelled_flags(spark, sf_dir: str) -> DataFrame:
    """Flags against labels: how many documents of each quality a code holds for."""
    flagged = _flagged(stats(spark, sf_dir), LOOSE)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(_path("doc_id").alias("path"), "quality", "toxic")
    return flagged.join(labels, "path").groupBy("code", "quality", "toxic").agg(F.count("*").alias("n"))


_LANG, _LANG_SQL = _by("lang")
_SOURCE, _SOURCE_SQL = _by("source")
_ROLE, _ROLE_SQL = _by("role", "conversations", "conv_id")
_S = _stats_sql()
_COUNT = "SELECT code, coalesce(n, 0)::BIGINT AS n_documents FROM codes LEFT JOIN (SELECT code, count(*) AS n FROM flags GROUP BY code) USING (code)"
_INV = "count(*) AS n_documents, coalesce(sum(total_chars), 0)::BIGINT AS total_chars, coalesce(avg(total_chars), 0.0) AS avg_chars, coalesce(median(total_chars), 0.0)::DOUBLE AS median_chars, min(total_chars) AS min_chars, max(total_chars) AS max_chars, coalesce(sum(size_bytes), 0)::BIGINT AS total_bytes"
_DUP = "dup AS (SELECT content_hash, count(*) AS size, min(path) AS first_key FROM stats WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"

QUERIES = {
    "doc_stats": lambda s, d: stats(s, d),
    "doc_stats_benchmark": lambda s, d: stats(s, d, "benchmark", "item_id"),
    "doc_flag_rows": lambda s, d: _flagged(stats(s, d)),
    "doc_flag_counts": lambda s, d: corpus.flag_counts(_flagged(stats(s, d)), corpus.TEXT_CODES),
    "doc_flag_counts_loose": lambda s, d: corpus.flag_counts(_flagged(stats(s, d), LOOSE), corpus.TEXT_CODES),
    "doc_findings": finding_rows,
    "doc_severity_counts": lambda s, d: corpus.severity_counts(corpus.findings(_flagged(stats(s, d)))),
    "doc_duplicate_groups": lambda s, d: corpus.duplicates(stats(s, d)),
    "doc_duplicate_samples": lambda s, d: corpus.duplicate_samples(stats(s, d)),
    "doc_duplicate_members": lambda s, d: corpus.duplicate_members(stats(s, d)),
    "doc_inventory": lambda s, d: corpus.inventory(stats(s, d)),
    "doc_counts_by_source": lambda s, d: corpus.counts_by(s.read.parquet(f"{d}/documents.parquet"), "source"),
    "doc_flags_by_lang": _LANG,
    "doc_flags_by_source": _SOURCE,
    "doc_flags_by_role": _ROLE,
    "doc_labelled_flags": labelled_flags,
    "run_finding_diff": run_diff,
    "run_metric_deltas": run_metrics,
    **pages.QUERIES,
    **html.QUERIES,
}
ORACLE_SQL = {
    "doc_stats": f"WITH {_S} SELECT * FROM stats",
    "doc_stats_benchmark": f"WITH {_stats_sql('benchmark', 'item_id')} SELECT * FROM stats",
    "doc_flag_rows": f"WITH {_S}, {_flags_sql(AnalysisConfig())} SELECT * FROM flags",
    "doc_flag_counts": f"WITH {_S}, {_flags_sql(AnalysisConfig())}, {_codes_sql(corpus.TEXT_CODES)} {_COUNT}",
    "doc_flag_counts_loose": f"WITH {_S}, {_flags_sql(LOOSE)}, {_codes_sql(corpus.TEXT_CODES)} {_COUNT}",
    "doc_findings": f"WITH {_S}, {_flags_sql(LOOSE)}, {_KNOWN}, {_FINDINGS} SELECT code, category, severity, count, affected, extras FROM found JOIN known USING (code)",
    "doc_severity_counts": f"WITH {_S}, {_flags_sql(AnalysisConfig())}, {_KNOWN}, hit AS (SELECT DISTINCT code FROM flags) SELECT severity, severity_rank::INT AS severity_rank, count(hit.code) AS n_findings FROM known LEFT JOIN hit USING (code) GROUP BY 1, 2",
    "doc_duplicate_groups": f"WITH {_S}, {_DUP} SELECT * FROM dup",
    "doc_duplicate_samples": f"WITH {_S}, {_DUP}, top AS (SELECT * FROM dup ORDER BY size DESC, first_key LIMIT 10), r AS (SELECT content_hash, size, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS rank_in_group, path FROM stats JOIN top USING (content_hash)) SELECT * FROM r WHERE rank_in_group <= 10",
    "doc_duplicate_members": f"WITH {_S}, {_DUP} SELECT path FROM (SELECT path FROM stats JOIN dup USING (content_hash) ORDER BY size DESC, first_key, path LIMIT 50)",
    "doc_inventory": f"WITH {_S} SELECT {_INV} FROM stats",
    "doc_counts_by_source": "SELECT CASE WHEN coalesce(source, '') = '' THEN '(none)' ELSE source END AS source, count(*) AS n FROM documents GROUP BY 1",
    "doc_flags_by_lang": _LANG_SQL,
    "doc_flags_by_source": _SOURCE_SQL,
    "doc_flags_by_role": _ROLE_SQL,
    "doc_labelled_flags": f"WITH {_S}, {_flags_sql(LOOSE)} SELECT code, quality, toxic, count(*) AS n FROM flags JOIN labels ON path = 'doc-' || lpad(doc_id::VARCHAR, 12, '0') GROUP BY ALL",
    "run_finding_diff": f"""WITH {_stats_sql(more=', source')}, {_flags_sql(LOOSE).replace('SELECT path', 'SELECT path, source')},
b AS (SELECT code, count(*) AS count_b, list(path ORDER BY path)[1:50] AS l FROM flags GROUP BY 1), a AS (SELECT code, count(*) AS count_a, list(path ORDER BY path)[1:50] AS l FROM flags WHERE source = 'src0' GROUP BY 1)
SELECT code, CASE WHEN count_a IS NULL THEN 'new' WHEN count_b IS NULL THEN 'no_longer_detected' WHEN count_a = count_b AND a.l = b.l THEN 'unchanged' ELSE 'changed' END AS status, count_a, count_b,
coalesce(len(list_filter(b.l, lambda x: NOT list_contains(a.l, x))), 0)::BIGINT AS n_added, coalesce(len(list_filter(a.l, lambda x: NOT list_contains(b.l, x))), 0)::BIGINT AS n_removed FROM a FULL JOIN b USING (code)""",
    "run_metric_deltas": f"""WITH {_stats_sql(more=', source')}, a AS (SELECT {_INV} FROM stats WHERE source = 'src0'), b AS (SELECT {_INV} FROM stats),
m AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, a.{m}::DOUBLE AS before, b.{m}::DOUBLE AS after FROM a, b" for m in ('n_documents', 'total_chars', 'min_chars', 'max_chars', 'total_bytes', 'median_chars'))}) SELECT *, after - before AS delta FROM m""",
    **pages.ORACLE_SQL,
    **html.ORACLE_SQL,
}
