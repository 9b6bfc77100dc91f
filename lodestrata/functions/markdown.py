"""Markdown of provider documentation: sections, tables, links, values. Plain functions, and a batch form over captured sources."""

from __future__ import annotations

import re
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame


def sections(body: str) -> list[tuple[int, str, str]]:
    """(level, heading, text below it up to the next heading); text before the first heading has level 0."""
    out, fence = [(0, "", [])], False
    for line in body.split("\n"):
        fence ^= line.lstrip().startswith("```")
        m = None if fence else re.match(r"(#{1,6})[ \t]+(.*?)[ \t#]*$", line)
        if m:
            out.append((len(m[1]), m[2], []))
        else:
            out[-1][2].append(line)
    return [(n, h, "\n".join(t).strip("\n")) for n, h, t in out if n or any(x.strip() for x in t)]


def cells(line: str) -> list[str]:
    """Cells of a table row; a pipe after a backslash belongs to its cell."""
    parts = re.split(r"(?<!\\)\|", line.strip())
    if parts and not parts[0].strip():
        parts = parts[1:]
    if parts and not parts[-1].strip():
        parts = parts[:-1]
    return [p.strip() for p in parts]


def tables(body: str) -> list[list[dict[str, str]]]:
    """Pipe tables as lists of rows by header; separator rows are left out, short rows filled with empty cells."""
    out, block = [], []
    for line in [*body.split("\n"), ""]:
        line = re.sub(r"^\s*>\s?", "", line)
        if line.strip().startswith("|"):
            block.append(cells(line))
            continue
        rows = [r for r in block if not all(re.fullmatch(r":?-+:?", c) for c in r)]
        if len(rows) > 1 and len(rows) < len(block):
            head = rows[0]
            out.append([dict(zip(head, [*r, *[""] * len(head)], strict=False)) for r in rows[1:]])
        block = []
    return out


def links(text: str) -> list[tuple[str, str]]:
    return re.findall(r"\[([^\]]*)\]\(([^)\s]+)\)", text)


def code_spans(text: str) -> list[str]:
    return re.findall(r"`([^`]+)`", text)


def labelled(text: str, label: str) -> str | None:
    m = re.search(rf"(?im)^\W*{re.escape(label)}\W*:\**\s*(.+?)\s*$", text)
    return m[1] if m else None


def tokens(text: str) -> int | None:
    """1,050,000, 200K or 1M as a number of tokens."""
    m = re.search(r"(\d[\d,]*(?:\.\d+)?)\s*([KkMm])?\b", text)
    if not m:
        return None
    n = float(m[1].replace(",", "")) * {"k": 1e3, "m": 1e6}.get((m[2] or "").lower(), 1)
    return int(n) if n > 0 else None


def iso_date(text: str) -> str | None:
    """2026-12-11 or Dec 11th, 2026 as an ISO date; statements of a soonest date are not dates."""
    if re.search(r"(?i)not sooner than|no earlier than", text):
        return None
    text = re.sub(r"[‐-―]", "-", text)
    if m := re.search(r"\d{4}-\d{2}-\d{2}", text):
        try:
            return datetime.strptime(m[0], "%Y-%m-%d").date().isoformat()
        except ValueError:
            return None
    if m := re.search(r"([A-Z][a-z]{2})[a-z]*\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})", text):
        try:
            return datetime.strptime(f"{m[1]} {m[2]} {m[3]}", "%b %d %Y").date().isoformat()
        except ValueError:
            return None
    return None


def tristate(text: str) -> bool | None:
    word = re.sub(r"\W", "", text).lower()
    return True if word in ("yes", "supported", "true") or "✅" in text else False if word in ("no", "notsupported", "unsupported", "false") or "❌" in text else None


def table_rows(captured: DataFrame) -> DataFrame:
    """source_id, section, table_no, row_no, header, cell of every table cell of captured sources (source_id, body)."""

    def run(batches):
        for batch in batches:
            rows = []
            for source, body in zip(batch.column("source_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                for _, heading, text in sections(body or ""):
                    for t, table in enumerate(tables(text)):
                        rows += [(source, heading, t, r, k, v) for r, row in enumerate(table) for k, v in row.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k in (2, 3) else pa.string()) for k in range(6)], names=["source_id", "section", "table_no", "row_no", "header", "cell"])

    return captured.select("source_id", "body").mapInArrow(run, "source_id string, section string, table_no long, row_no long, header string, cell string")
