"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write rows as CSV with a header, or as JSON lines."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"unknown result format: {fmt}")
