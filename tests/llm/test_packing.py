import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing as pk


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.booleans())
def test_plans_never_overfill_or_overuse(lengths, finish):
    counts = np.bincount(lengths, minlength=41)[:41] if lengths else np.zeros(41, int)
    used = np.zeros(41, int)
    for pattern, copies in pk.plan_histogram(counts, finish):
        assert copies > 0 and (sum(pattern) <= 40 if finish else sum(pattern) == 40)
        for n in pattern:
            used[n] += copies
    assert (used == counts).all() if finish else (used <= counts).all()


def test_close_to_the_bound():
    r = np.random.default_rng(0)
    n = np.clip(r.lognormal(5, 1, 20_000).astype(int), 1, 2048)
    plan = pk.plan_histogram(np.bincount(n, minlength=2049), True)
    assert sum(c for _, c in plan) <= -(-n.sum() // 2048) + 1


def check(rows, items, capacity):
    load, seen = {}, {}
    for r in rows:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["length"]
        seen.setdefault(r["id"], []).append((r["piece_no"], r["start"], r["length"]))
    assert max(load.values(), default=0) <= capacity
    for i, n in items:
        pieces = sorted(seen[i])
        assert sum(p[2] for p in pieces) == (n or 0)
        assert len(pieces) == max(1, -(-(n or 0) // capacity))
        assert [p[1] for p in pieces] == [capacity * j for j in range(len(pieces))]
    return load


@pytest.mark.parametrize("shard_items", [1_000_000, 300])
def test_items(spark, shard_items):
    r = np.random.default_rng(1)
    items = [(i, int(n)) for i, n in enumerate(np.clip(r.lognormal(3, 1.2, 2000), 0, 900))]
    items += [(5000 + i, 7) for i in range(900)] + [(9000, None), (9001, 0), (9002, 100), (9003, 200)]
    df = spark.createDataFrame([(i, n, 1, "x") for i, n in items], "id long, n int, shard int, rank string")
    load = check(pk.pack_items(df, "id", "n", 100, shard_items).collect(), items, 100)
    total = sum(n or 0 for _, n in items)
    assert len([c for c in load.values() if c]) <= -(-total // 100) + 2


def test_empty_and_nothing_to_pack(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "id long, n int")
    assert pk.pack_items(df.limit(0), "id", "n", 10).count() == 0
    assert {r["container_id"] for r in pk.pack_items(df, "id", "n", 10).collect()} == {0}


def test_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = pk.pack_documents(df).collect()
    load = {}
    for r in rows:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
    total = sum(load.values())
    assert max(load.values()) <= 2048 and len(load) <= -(-total // 2048) + 1
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in df.select("doc_id").collect()}


def stock(lengths, capacity):
    return pk._Stock(np.bincount(lengths, minlength=capacity + 1))


def test_a_triple_beyond_the_longest_lengths_is_found():
    a = [401, 402, 404, 405, 410, 411, 413, 414, 428]
    assert sorted(stock(a + [1000 - 2 * x for x in a] + [310, 340, 350], 1000).complement(1000, [])) == [310, 340, 350]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(1, 60), st.integers(0, 30))
def test_complements_are_found_whenever_there_are_any(lengths, gap, held):
    """Against all combinations of up to three items, one more of them already in the container."""
    from itertools import combinations

    base = [held] if held in lengths else []
    free = list(lengths)
    for n in base:
        free.remove(n)
    possible = any(sum(c) == gap for k in (1, 2, 3) for c in combinations(free, k))
    found = stock(lengths, 60).complement(gap, base)
    assert (found is not None) == possible
    if found:
        assert sum(found) == gap and all(found.count(n) <= free.count(n) for n in found)
