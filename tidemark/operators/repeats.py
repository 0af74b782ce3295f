"""Rows that come more than once, without moving those that come once.

Repeats are found on the key column alone: keys are counted (map-side first) and those that come
more than once set a bit each in a bitmap of fixed size.  Rows whose bit is not set are certainly
alone and stay where they are; only the others, the repeats and a few rows that share a bit with
them, are shuffled with all their columns.  The bitmap is broadcast as words of 64 bits, at most
``BITS`` / 64 rows whatever the data; once most bits are set, most rows are shuffled, as they would
be without it.

Defined cases: null keys are one key; NULL and NaN are ordinary values of other columns; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def split_repeats(df: DataFrame, key: str, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose key certainly comes once, all others). ``counted`` is a narrower read of the same
    rows to count keys in, where ``df`` is not cheap."""
    place = F.pmod(F.xxhash64("_key"), F.lit(BITS))
    again = (counted if counted is not None else df).select(F.col(key).alias("_key")).groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1")
    bits = again.select(place.alias("_h")).groupBy(F.shiftright("_h", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_h & 63 as int)))").alias("_bits"))
    x = df.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(BITS))).withColumn("_word", F.shiftright("_h", 6))
    x = x.join(F.broadcast(bits), "_word", "left")  # at most BITS / 64 rows
    hit = F.expr("coalesce(_bits & shiftleft(1L, cast(_h & 63 as int)), 0L) != 0")
    names = [c for c in df.columns]
    return x.where(~hit).select(*names), x.where(hit).select(*names)


def latest(df: DataFrame, key: str, order: str, counted: DataFrame | None = None) -> DataFrame:
    """Each key once, with the row whose ``order`` and then other columns are greatest; ``order`` drops out."""
    rest = [c for c in df.columns if c not in (key, order)]
    once, again = split_repeats(df, key, counted)
    chosen = again.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_s")).select(key, *[F.col(f"_s.{c}").alias(c) for c in rest])
    return once.select(key, *rest).unionByName(chosen)


def distinct_rows(df: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """Distinct rows, where rows with different keys are different anyway."""
    once, again = split_repeats(df, key, counted)
    return once.unionByName(again.distinct())
