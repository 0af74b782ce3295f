"""Repeated rows against pandas, with a bitmap far too small as well."""

import numpy as np
import pytest

from tidemark.operators import repeats

SCHEMA = "id long, at int, v double, _h int, _word string, x array<double>"


def rows(n=400, seed=0):
    r = np.random.default_rng(seed)
    ids = [int(i) for i in r.integers(0, n // 2, n)] + [None, None, 10_000]
    return [(i, int(r.integers(0, 5)), None if r.random() < 0.1 else float(r.integers(0, 9)), 1, "w", [1.0]) for i in ids]


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_latest(spark, monkeypatch, bits):
    monkeypatch.setattr(repeats, "BITS", bits)
    data = rows()
    df = spark.createDataFrame(data + data[:50], SCHEMA).repartition(5)
    got = sorted(((r.id, r.v) for r in repeats.latest(df.select("id", "at", "v"), "id", "at").collect()), key=repr)
    best = {}
    for i, at, v, *_ in data:
        best[i] = max(best.get(i, (-1, -1.0)), (at, -1.0 if v is None else v))
    assert got == sorted(((i, None if v < 0 else v) for i, (_, v) in best.items()), key=repr)


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_distinct(spark, monkeypatch, bits):
    monkeypatch.setattr(repeats, "BITS", bits)
    data = rows(seed=1)
    df = spark.createDataFrame(data + data[:80], SCHEMA).drop("_h", "_word", "x").repartition(5)
    got = [tuple(r) for r in repeats.distinct_rows(df, "id").collect()]
    assert len(got) == len(set(got)) and set(got) == {r[:3] for r in data}


def test_lone_rows_stay(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as int) v")
    once, again = repeats.split_repeats(df.unionByName(df.where("id < 10")), "id")
    assert again.where("id < 10").count() == 20 and once.count() + again.count() == 1010
    assert once.count() >= 980


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA).select("id", "at", "v")
    assert repeats.latest(df, "id", "at").count() == 0 and repeats.distinct_rows(df, "id").count() == 0
