"""Small column helpers with one fixed meaning across the library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Age bins and their names.
AGE_EDGES = (15, 25, 35, 45, 55, 65, 100)
AGE_LABELS = ("16-24", "25-34", "35-44", "45-54", "55-64", "65+")


def age_group(age: Column, edges: Sequence[int] = AGE_EDGES, labels: Sequence[str] = AGE_LABELS) -> Column:
    """Right-closed bins: (15, 25] is "16-24". Null outside and for null."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((age > lo) & (age <= hi), label).otherwise(out)
    return out


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """df with a rank from 1 within keys, cut at k. The cut is made before the shuffle where it can be."""
    df = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return df if k is None else df.where(F.col(rank) <= k)

