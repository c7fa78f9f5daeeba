"""Sinks (A7, A8)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyspark.sources.files import extension


def save_processed(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """``.parquet`` -> Parquet; ``.csv`` and any other suffix -> CSV with a
    header (an unknown suffix is replaced by ``.csv``).  Each task writes
    its own part file; nothing is funnelled through one writer."""
    ext = extension(path)
    if ext == ".parquet":
        df.write.mode(mode).parquet(path)
        return path
    if ext != ".csv":
        path = path[: len(path) - len(ext)] + ".csv" if ext else path + ".csv"
    # Spark's CSV writer trims blanks by default; values must round-trip, quotes doubled as the reader expects
    (df.write.mode(mode).option("header", True).option("encoding", "UTF-8").option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def save_report_json(report: DataFrame, path: str, mode: str = "overwrite") -> str:
    """The one-row nested report (E14) as JSON (one small file)."""
    report.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)
    return path
