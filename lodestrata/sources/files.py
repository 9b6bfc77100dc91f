"""Document trees: listing, text decoding, and the whole corpus analysis over a folder."""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_stats
from ..operators import corpus
from ..operators.config import AnalysisConfig
from .html import extract, html_predicates

# Extensions that are read.
SUPPORTED = (".html", ".htm", ".md", ".pdf", ".txt")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path (relative, sorted), absolute, extension, supported, problem (null, unreadable_directory or inaccessible).

    Links to directories are not followed, and files that lead out of the root are left out.
    """
    top = Path(root).resolve()
    if not top.is_dir():
        raise NotADirectoryError(root)
    rows = []
    fail = lambda e: rows.append((os.path.relpath(e.filename, top), str(e.filename), "", False, "unreadable_directory"))
    for folder, _, names in os.walk(top, onerror=fail):
        for name in names:
            p = Path(folder, name)
            rel = p.relative_to(top).as_posix()
            try:
                if not p.resolve(strict=True).is_relative_to(top):
                    continue
            except OSError:
                rows.append((rel, str(p), p.suffix.lower(), False, "inaccessible"))
                continue
            rows.append((rel, str(p), p.suffix.lower(), p.suffix.lower() in SUPPORTED, None))
    return spark.createDataFrame(sorted(rows), "path string, absolute string, extension string, supported boolean, problem string")


def decode(raw: bytes) -> str:
    """UTF-8, else latin-1; a byte order mark stays; CRLF and CR become LF."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def load(spark: SparkSession, root: str) -> DataFrame:
    """Supported files below root: path, extension, size_bytes, text, load_error and the counts of HTML pages, in Arrow batches.

    A file that cannot be read is a row with load_error. PDF files need a parser of their own: without pypdf their
    load_error says so.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    own = files.select("path", ext.alias("extension"), F.col("length").alias("size_bytes"), "content").where(ext.isin(*SUPPORTED))

    def run(batches):
        for batch in batches:
            rows = []
            for e, raw in zip(batch.column("extension").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    if e in (".html", ".htm"):
                        _, text, *counts = extract(decode(raw))
                        rows.append((text, None, *counts))
                    elif e == ".pdf":
                        import io

                        import pypdf

                        rows.append(("\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(raw)).pages), None, 0, 0, 0))
                    else:
                        rows.append((decode(raw), None, 0, 0, 0))
                except Exception as error:  # one unreadable file is a row, not the end of the run
                    rows.append((None, f"{type(error).__name__}: {error}"[:500], 0, 0, 0))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "extension", "size_bytes")), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["path", "extension", "size_bytes", "text", "load_error", "content_chars", "boilerplate_chars", "code_chars"])

    return own.mapInArrow(run, "path string, extension string, size_bytes long, text string, load_error string, content_chars long, boilerplate_chars long, code_chars long")


def analyze(spark: SparkSession, root: str, config: AnalysisConfig = AnalysisConfig()) -> dict[str, DataFrame]:
    """The corpus analysis of a folder: documents, findings, inventory, duplicates, errors."""
    found, loaded = discover(spark, root), load(spark, root)
    good = doc_stats(loaded.where("load_error IS NULL").withColumn("raw_bytes", F.col("size_bytes")).withColumn("code_heavy", (F.col("content_chars") > 0) & (F.col("code_chars") >= 0.25 * F.col("content_chars"))), short_line_chars=config.short_line_chars)
    text = corpus.text_predicates(config, F.col("code_heavy"))
    page = F.col("extension").isin(".html", ".htm")
    html = {k: (page & p, x) for k, (p, x) in html_predicates(config).items()}
    flagged = corpus.flags(good, {**text, **html})
    groups = corpus.duplicates(good)
    copies = good.join(groups.select("content_hash"), "content_hash", "left_semi").select("path", F.lit("EXACT_DUPLICATES").alias("code"), F.lit(None).cast("long").alias("extra"))
    side = lambda df, code: df.select("path", F.lit(code).alias("code"), F.lit(None).cast("long").alias("extra"))
    every = flagged.union(copies).union(side(found.where("problem IS NOT NULL"), "DISCOVERY_ERRORS")).union(side(found.where("problem IS NULL AND NOT supported"), "UNSUPPORTED_FILES")).union(side(loaded.where("load_error IS NOT NULL"), "LOAD_ERRORS"))
    return {"documents": good, "findings": corpus.findings(every, most=config.max_affected), "inventory": corpus.inventory(good), "duplicates": groups, "errors": loaded.where("load_error IS NOT NULL").select("path", "load_error"), "extensions": corpus.counts_by(found, "extension")}


def text_report(parts: dict[str, DataFrame]) -> str:
    """A report of the findings (some rows per code) and the inventory."""
    one = parts["inventory"].first().asDict()
    lines = ["Inventory", *(f"  {k}: {v}" for k, v in one.items()), "Findings"]
    for r in parts["findings"].collect():
        lines.append(f"  [{r['severity']}] {r['code']}: {r['count']} documents")
        lines += [f"    {p}" for p in r["affected"][:5]]
    return "\n".join(lines)
