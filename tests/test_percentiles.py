"""Exact percentiles against numpy."""

import numpy as np

from tidemark.operators import spectral_stats as st

SCHEMA = "g string, h int, psd double, _v int, q int"


def test_percentiles(spark):
    r = np.random.default_rng(0)
    groups = {
        ("a", 1): r.lognormal(0, 4, 500),
        ("a", None): r.normal(0, 3, 301),
        (None, 2): np.round(r.normal(0, 1, 200), 1),
        ("b", 1): np.array([7.5]),
        ("c", 3): np.r_[np.zeros(50), -np.zeros(3), -2.0, 1e-300, 1e300],
        ("d", 4): np.full(99, 2.0),
    }
    data = [(g, h, float(v), 1, 1) for (g, h), x in groups.items() for v in x] + [("b", 1, None, 1, 1), ("b", 1, float("nan"), 1, 1), ("e", 1, None, 1, 1)]
    df = spark.createDataFrame(data, SCHEMA)
    qs = [0.0, 0.05, 0.25, 0.5, 0.99, 1.0]
    got = {(x.g, x.h, x.q): x.value for x in st.percentiles(df, ["g", "h"], qs).collect()}
    assert len(got) == len(groups) * len(qs)
    for (g, h), x in groups.items():
        assert np.allclose([got[g, h, q] for q in qs], np.quantile(x, qs), rtol=1e-12, atol=0)


def test_no_keys_and_names(spark):
    x = np.random.default_rng(1).exponential(5, 777)
    df = spark.createDataFrame([(float(v),) for v in x], "e double")
    row = st.percentile_row(df, [], {"low": 0.05, "high": 0.95}, "e").first()
    assert np.allclose([row.low, row.high], np.quantile(x, [0.05, 0.95]))
    assert st.percentiles(df.limit(0), [], [0.5], "e").count() == 0
