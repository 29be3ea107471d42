"""A bounded sample of rows for fitting a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of least hash of the key; of larger tables a hash bound that lets through about 2n rows comes first, so that a task sends few rows, whatever the number of tasks."""
    total = df.count()
    lot = F.xxhash64(key)
    if total > 2 * n:
        df = df.where(lot <= int(-(1 << 63) + 2 * n / total * (1 << 64)))
    return df.orderBy(lot, key).limit(n)
