import numpy as np
import pytest

from tidemark.llm import quantiles as qt

QS = [0.1, 0.5, 0.9, 0.99]


def rank_error(values, q, answer):
    v = np.sort(values)
    lo, hi = np.searchsorted(v, answer, "left"), np.searchsorted(v, answer, "right")
    return max(lo - q * len(v), q * len(v) - hi, 0) / (len(v) * min(q, 1 - q))


@pytest.mark.parametrize("shape", ["lognormal", "sorted", "reversed", "ties", "zeros"])
@pytest.mark.parametrize("pieces", [1, 37])
def test_error_in_both_tails(shape, pieces):
    r = np.random.default_rng(1)
    v = r.lognormal(0, 3, 300_000)
    v = {"lognormal": v, "sorted": np.sort(v), "reversed": np.sort(v)[::-1], "ties": np.round(v), "zeros": v * (r.random(len(v)) < 0.3)}[shape]
    for tail in ("high", "low"):
        whole = qt.TailSketch(tail)
        for part in np.array_split(v, pieces):
            s = qt.TailSketch(tail)
            for batch in np.array_split(part, 5):
                s.update(batch)
            whole.merge(qt.TailSketch.from_bytes(s.to_bytes()))
        assert whole.n == len(v) and whole.retained < 20_000
        mine = [q for q in (0.001, 0.01, *QS, 0.999) if (q >= 0.5) == (tail == "high")]
        for q, a in zip(mine, whole.quantiles(mine)):
            assert rank_error(v, q, a) < 0.01


SCHEMA = "segment_id long, processed_at timestamp, swath string, lat_mean double, month int, psd array<double>, key string, tail string, values int"


def test_groups_and_dirt(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, None, s, 5.0, 1, [float(i), None, nan, inf, -1.0], "k", "t", 1) for i, s in enumerate(["left", "LEFT ", "Left", "right", "middle", None])]
    rows += rows[:2] * 3
    rows += [(10, None, "left", None, 1, [5.0], "", "", 0), (11, None, "left", nan, 1, [5.0], "", "", 0), (12, None, "left", 5.0, None, [7.0], "", "", 0), (13, None, "left", 90.0, 2, [3.0], "", "", 0), (14, None, "left", 5.0, 1, None, "", "", 0), (None, None, "left", 5.0, 1, [9.0], "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["scope"], r["swath"], r["lat_band"], r["month"], r["q"]): (r["value"], r["n"]) for r in qt.spectrum_percentiles(df).collect()}
    assert got["month", "left", 0, 1, 0.5] == (1.0, 3)
    assert got["month", "left", 0, None, 0.5] == (7.0, 1)
    assert got["all", "left", 0, None, 0.99] == (7.0, 4)
    assert got["all", "right", 0, None, 0.1] == (3.0, 1)
    assert got["month", "left", 80, 2, 0.9] == (3.0, 1)
    assert {k[1] for k in got} == {"left", "right"}
    assert qt.spectrum_percentiles(df.limit(0)).count() == 0


def test_flushing_keeps_everything(spark, monkeypatch):
    monkeypatch.setattr(qt, "HELD_VALUES", 500)
    rows = [(i, None, "left", 5.0, i % 7 + 1, [float(i * 50 + j) for j in range(50)], "", "", 0) for i in range(200)]
    got = {r["q"]: (r["value"], r["n"]) for r in qt.spectrum_percentiles(spark.createDataFrame(rows, SCHEMA)).where("scope = 'all'").collect()}
    for q in QS:
        assert got[q][1] == 10_000 and abs(got[q][0] - q * 10_000) <= 100 * min(q, 1 - q) + 1
