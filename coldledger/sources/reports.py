"""Text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(lines: DataFrame, path: str, column: str = "line") -> None:
    """Write numbered lines as text; the part files in name order are the report."""
    lines.orderBy("position").select(column).write.text(path)
