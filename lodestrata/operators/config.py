"""Thresholds of the corpus analysis, validated when made."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class AnalysisConfig:
    small_document_chars: int = 100
    large_document_chars: int = 100_000
    symbol_min_chars: int = 40
    symbol_ratio: float = 0.55
    whitespace_min_chars: int = 80
    whitespace_ratio: float = 0.45
    repeated_min_lines: int = 8
    repeated_line_ratio: float = 0.60
    long_block_chars: int = 5000
    short_line_chars: int = 40
    fragmented_min_lines: int = 15
    fragmented_ratio: float = 0.70
    pdf_poor_page_chars: int = 20
    pdf_poor_page_ratio: float = 0.40
    pdf_uneven_ratio: float = 0.25
    pdf_edge_min_pages: int = 4
    pdf_edge_ratio: float = 0.60
    pdf_large_pages: int = 100
    pdf_table_ratio: float = 0.25
    html_boilerplate_ratio: float = 0.45
    html_low_content_ratio: float = 0.05
    html_large_chars: int = 80_000
    html_navigation_ratio: float = 0.15
    max_affected: int = 50

    def __post_init__(self):
        for f in fields(self):
            x = getattr(self, f.name)
            if isinstance(x, bool) or not isinstance(x, (int, float)) or (f.type == "int" and not isinstance(x, int)):
                raise ValueError(f"{f.name} must be a number")
            if f.type == "float" and not 0 <= x <= 1:
                raise ValueError(f"{f.name} must lie between 0 and 1")
            if f.type == "int" and x < 0:
                raise ValueError(f"{f.name} must not be negative")
        if self.large_document_chars < self.small_document_chars:
            raise ValueError("large_document_chars must not be below small_document_chars")
