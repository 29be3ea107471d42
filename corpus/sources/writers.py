"""Writers. Folders are replaced as a whole; single files are for small results that a person reads."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """A parquet folder, replaced or appended to; by: columns that become folders."""
    (df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)).parquet(path)


def csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """A CSV folder with a header; with digits, doubles are written with so many significant ones."""
    if digits:
        df = df.select(*(F.format_string(f"%.{digits}g", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def csv_file(df: DataFrame, path: str, bom: bool = False, limit: int = 1_000_000) -> None:
    """One CSV file on the driver, with a byte-order mark if asked; raises beyond `limit` rows instead of cutting them off."""
    rows = df.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report: write a folder")
    rows.to_csv(path, index=False, encoding="utf-8-sig" if bom else "utf-8")


def manifest(values: dict, path: str) -> None:
    """A JSON document of settings and counts."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, ensure_ascii=False, indent=2)


def requests(df: DataFrame, path: str, url: str = "/v1/chat/completions") -> None:
    """A folder of JSON lines {custom_id, method, url, body}; df: custom_id, body (a struct)."""
    line = F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit(url).alias("url"), "body"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
