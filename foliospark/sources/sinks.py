"""Sinks for reports and converted corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Each table under its name; issues are laid out by issue code, so one kind is read without the others."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        (writer.partitionBy("issue_code") if name == "issues" else writer).save(f"{path}/{name}")


def write_converted(converted: DataFrame, path: str) -> None:
    """Rewritten articles and reference lists, one row a document."""
    converted.select("doc_id", "article", "reference_text").write.mode("overwrite").parquet(path)
