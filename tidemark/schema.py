"""Canonical column names and the boundary at which NaN becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_nan(c: Column | str) -> Column:
    """NaN as NULL, so that Spark's null-skipping aggregates are the nan-aware ones."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """Every float or double column with NaN as NULL."""
    return df.select(*[null_nan(n).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def unnest_vectors(df: DataFrame, keys: list[str], k: str, psd: str) -> DataFrame:
    """Long form (keys, ik, k, psd) of two equally long arrays; null or NaN values are dropped."""
    return (
        df.select(*keys, F.posexplode(F.arrays_zip(F.col(k).alias("k"), F.col(psd).alias("p"))).alias("ik", "z"))
        .select(*keys, "ik", F.col("z.k").alias("k"), F.col("z.p").cast("double").alias("psd"))
        .where(F.col("psd").isNotNull() & ~F.isnan("psd"))
    )
