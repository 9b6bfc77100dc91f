"""Text statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 29 code points that count as white space.
WS_POINTS = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS_CHARS = "".join(map(chr, WS_POINTS))
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WS_CHARS))


def newlines(x: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(x, "\r\n?", "\n")


def decode_latin(content: Column) -> Column:
    """UTF-8 where valid, else latin-1; never fails."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def doc_stats(docs: DataFrame, text: str = "text", short_line_chars: int = 40) -> DataFrame:
    """docs with the statistics of its text column: one row per document, built-in expressions only.

    Null texts count as empty. content_hash is null for empty documents.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("_nws", F.regexp_replace(t, WS, "")).withColumn("_lines", F.filter(F.transform(F.split(t, "\n"), strip), lambda x: F.length(x) > 0))
    lines = F.col("_lines")
    table_like = lambda x: (F.instr(x, " | ") > 0) | ((F.instr(x, "  ") > 0) & (F.size(F.split(x, f"{WS}+")) >= 4))
    kinds = F.array_distinct(lines)
    mode = F.array_max(F.transform(kinds, lambda x: F.size(lines) - F.size(F.array_remove(lines, x))))
    # runs of equal lines in sorted order: n log n for documents with many lines
    ordered = F.sort_array(lines)
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))
    run = lambda acc, x: F.when(x.eqNullSafe(acc["last"]), F.struct(x.alias("last"), (acc["n"] + 1).alias("n"), F.greatest(acc["most"], acc["n"] + 1).alias("most"))).otherwise(F.struct(x.alias("last"), F.lit(1).alias("n"), F.greatest(acc["most"], F.lit(1)).alias("most")))
    long_mode = F.aggregate(ordered, start, run, lambda acc: acc["most"])
    most = F.when(F.size(lines) == 0, 0).when(F.size(kinds) == F.size(lines), 1).when(F.size(lines) <= 64, mode).otherwise(long_mode)
    big = lambda c: c.cast("long")
    mlen = F.length(strip(t))
    return step.withColumns(
        {
            "total_chars": big(F.length(t)),
            "meaningful_length": big(mlen),
            "is_empty": mlen == 0,
            "non_ws_chars": big(F.length("_nws")),
            "whitespace_chars": big(F.length(t) - F.length("_nws")),
            "symbol_chars": big(F.length(F.regexp_replace("_nws", r"[\p{L}\p{N}]", ""))),
            "line_count": big(F.size(lines)),
            "short_line_count": big(F.size(F.filter(lines, lambda x: F.length(x) < short_line_chars))),
            "very_short_line_count": big(F.size(F.filter(lines, lambda x: F.length(x) < 8))),
            "table_like_line_count": big(F.size(F.filter(lines, table_like))),
            "max_paragraph_length": big(F.array_max(F.transform(F.split(t, "\n\n"), lambda x: F.length(strip(x))))),
            "max_repeated_line_count": big(most),
            "first_line": F.substring(F.get(lines, F.lit(0)), 1, 160),
            "content_hash": F.when(mlen > 0, F.sha2(F.regexp_replace(strip(t), f"{WS}+", " "), 256)),
        }
    ).drop("_nws", "_lines")
