"""Spectral operators against numpy and known truths."""

import numpy as np
import pytest

from tidemark.functions import dsp
from tidemark.operators import spectra as sp
from tidemark.operators import spectral_stats as st
from tidemark.operators import tracks as t


def test_half_power_wavelength():
    assert 1 / dsp.half_power(17, 0.25) == pytest.approx(6.28, rel=0.02)
    assert 1 / dsp.half_power(9, 0.25) == pytest.approx(3.2, rel=0.03)


def test_parseval():
    x = np.random.default_rng(0).normal(0, 2, (200, 256))
    p = dsp.periodograms(x, 0.5, detrend="constant")
    assert (p.sum(axis=1) / (256 * 0.5)).mean() == pytest.approx(4.0, rel=0.05)


def test_tone_on_a_bin():
    x = np.sin(2 * np.pi * 8 * np.arange(128) / 128)[None]
    assert dsp.periodograms(x, 1.0)[0].argmax() == 8


def test_transfer_column_is_the_transfer(spark):
    k = np.linspace(0, 2, 50)
    df = spark.createDataFrame([(float(v),) for v in k], "k double")
    got = [r[0] for r in df.select(dsp.transfer_column(df.k, 17, 0.25)).collect()]
    assert np.allclose(got, dsp.transfer_power(k, 17, 0.25))


def test_array_dft_is_rfft(spark):
    x = np.random.default_rng(1).normal(size=(5, 64))
    df = spark.createDataFrame([([float(c) for c in r],) for r in x], "v array<double>")
    got = np.array([r[0] for r in df.select(dsp.dft_power(df.v, 64, 2.0)).collect()])
    assert np.allclose(got, dsp.periodograms(x, 2.0), rtol=1e-9)


def test_udf_dirt(spark):
    df = spark.createDataFrame([(None,), ([],), ([1.0],), ([1.0, None, 2.0],), ([1.0, float("nan")],), ([1.0, 2.0, 4.0],)], "v array<double>")
    got = [r[0] for r in df.select(dsp.periodogram_udf(1.0)("v")).collect()]
    assert got[:5] == [None] * 5 and len(got[5]) == 2
    assert df.limit(0).select(dsp.welch_udf(1.0, 8)("v")).count() == 0


def patch_frame(spark, z):
    return spark.createDataFrame([(1, i, j, float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1])], "id int, r int, c int, v double")


def test_alias_identity(spark):
    z = dsp.gaussian_field(32, 64, 0.25, 0.25, lambda kx, ky: dsp.matern_psd(kx, ky, 1.5, 5.0, 1.0))
    p = sp.power_2d(patch_frame(spark, z), ["id"], "r", "c", "v", 32, 64, 0.25, 0.25)
    share = {}
    for centred in (False, True):
        rows = sp.alias_decomposition(p, ["id"], 32, 64, 0.25, 0.25, (4, 8), 9, centred).collect()
        for r in rows:
            assert r["total"] == pytest.approx(r["direct"] + r["aliased"], rel=1e-9) and r["aliased"] >= 0
        share[centred] = sum(r["direct"] for r in rows) / sum(r["total"] for r in rows)
    assert 0 < share[False] < share[True] <= 1
    with pytest.raises(ValueError):
        sp.alias_decomposition(p, ["id"], 32, 64, 0.25, 0.25, (16, 8))
    with pytest.raises(ValueError):
        sp.alias_decomposition(p, ["id"], 32, 65, 0.25, 0.25, (4, 8))
    cells, n1, n2 = sp.trim_patch(patch_frame(spark, np.zeros((35, 65))), "r", "c", 35, 65, (4, 8))
    assert (n1, n2) == (32, 64) and cells.count() == 32 * 64


def test_field_has_its_variance():
    density = lambda kx, ky: dsp.matern_psd(kx, ky, 1.5, 5.0, 4.0)
    v = [dsp.gaussian_field(128, 128, 1.0, 1.0, density, seed).var() for seed in range(20)]
    assert np.mean(v) == pytest.approx(4.0, rel=0.15)


def test_track_tail_is_covered(spark):
    for total, length in ((237.0, 100.0), (99.0, 100.0), (100.0, 100.0), (301.0, 100.0)):
        df = spark.createDataFrame([(1, i, float(k)) for i, k in enumerate(np.arange(0, total + 1e-9, 1.0))], "g int, idx int, km double")
        segs = t.distance_segments(df, ["g"], "km", "idx", length).collect()
        assert max(s["i1"] for s in segs) == int(total) + 1 and min(s["i0"] for s in segs) == 0


def test_band_needs_two_points(spark):
    df = spark.createDataFrame([(1, 0.1, 5.0), (2, 0.1, 1.0), (2, 0.2, 3.0)], "g int, k double, psd double")
    got = {r["g"]: r["energy"] for r in st.band_energy(df, ["g"], 0.0, 1.0).collect()}
    assert got == {1: None, 2: pytest.approx(0.2)}
