"""Report sink (S6): round, then write a result table with its caption."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every double column to ``digits`` (what a printed table shows)."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_report(df: DataFrame, caption: str, folder: str, fmt: str = "parquet", digits: int | None = None) -> str:
    """Write ``df`` under ``folder/<caption>-<unique id>`` and return the path.

    The result's own partitions are written, so any table can be a report;
    AQE has already merged a small one's. A unique suffix keeps concurrent
    runs from overwriting each other.
    """
    out = rounded(df, digits) if digits is not None else df
    path = f"{folder.rstrip('/')}/reports/{caption}-{uuid.uuid4().hex[:12]}"
    writer = out.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path
