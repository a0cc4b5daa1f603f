"""Parser registry: one row per file extension, small enough to be a literal relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docstrata.frames import values_frame

# Extension, parser, label, category, current parser version.
PARSERS = [
    ("pdf", "pdf", "PDF", "document", 3),
    ("docx", "docx", "DOCX", "document", 1),
    ("doc", "doc", "DOC", "document", 2),
    ("rtf", "rtf", "RTF", "document", 1),
    ("xlsx", "excel", "Excel", "spreadsheet", 1),
    ("xls", "excel", "Excel", "spreadsheet", 1),
    ("xlsm", "excel", "Excel", "spreadsheet", 1),
    ("csv", "csv", "CSV", "spreadsheet", 1),
    ("tsv", "tsv", "TSV", "spreadsheet", 1),
    ("txt", "text", "Text", "text", 4),
    ("md", "markdown", "Markdown", "text", 4),
]

EXTENSIONS = [row[0] for row in PARSERS]


def registry_frame(spark: SparkSession, disabled: tuple[str, ...] = ()) -> DataFrame:
    """`(ext, parser, label, category, version, enabled)`; `disabled` names parsers."""
    rows = [(*row, row[1] not in disabled) for row in PARSERS]
    return values_frame(
        spark,
        rows,
        "ext string, parser string, label string, category string, version int, enabled boolean",
    )
