"""Queries over whole inputs: what a bound, a row subset or a candidate cap would leave out."""

import numpy as np
import pandas as pd
import pytest

from tidemark.plans import ref_grids, ref_stats


@pytest.fixture(scope="module")
def values(small):
    """Finite, non-negative values of every segment once, in cm2: no size is too large."""
    s = pd.read_parquet(f"{small}/segment_spectra.parquet").sort_values("processed_at").groupby("segment_id").tail(1)
    s = s[s.psd.notna()].assign(swath=s.swath.str.strip().str.lower(), ik=lambda x: x.psd.map(lambda v: range(len(v))))
    x = s[["segment_id", "granule", "swath", "lat_mean", "lon_mean", "ik", "psd"]].explode(["ik", "psd"]).astype({"ik": int, "psd": float})
    x = x[np.isfinite(x.psd) & (x.psd >= 0)].assign(psd=lambda x: x.psd * 1e4)
    assert (x.psd >= 1e5).sum() > 40
    return x


def test_large_values_enter_means(spark, small, values):
    got = ref_stats.queries()["pass_mean"](spark, small).toPandas().set_index(["granule", "swath", "ik"]).sort_index()
    want = values.groupby(["granule", "swath", "ik"]).psd.agg(["mean", "size"])
    assert len(got) == len(want)
    assert (got.n == want["size"].reindex(got.index)).all()
    assert np.allclose(got["mean"], want["mean"].reindex(got.index), rtol=1e-9, atol=1e-6)


def test_large_values_enter_percentiles(spark, small, values):
    got = ref_stats.queries()["psd_percentiles"](spark, small).toPandas().set_index(["swath", "ik", "q"]).value
    for (swath, ik), v in values.groupby(["swath", "ik"]).psd:
        for q in (0.05, 0.5, 0.95):
            assert got[swath, ik, q] == pytest.approx(np.quantile(v, q), rel=1e-9, abs=1e-6)


def test_large_values_enter_boxes(spark, small, values):
    x = values[np.isfinite(values.lat_mean) & np.isfinite(values.lon_mean)]
    lon = (x.lon_mean + 180) % 360 - 180
    want = x.assign(ilat=np.floor(x.lat_mean / 2), ilon=np.floor(lon / 2)).groupby(["ilat", "ilon", "ik"]).psd.mean()
    got = ref_grids.queries()["box_mean_psd"](spark, small).toPandas().set_index(["ilat", "ilon", "ik"]).mean_psd_cm2
    assert len(got) == len(want)
    assert np.allclose(got, want.reindex(got.index), rtol=1e-9, atol=1e-6)
    got = ref_grids.queries()["zonal_mean"](spark, small).toPandas().set_index(["ilat", "ik"]).mean_cm2
    box = x.assign(ilat=np.floor(x.lat_mean / 10), ilon=np.floor(lon / 10)).groupby(["ilat", "ilon", "ik"]).psd.mean()
    want = box.groupby(["ilat", "ik"]).mean()
    assert len(got) == len(want)
    assert np.allclose(got, want.reindex(got.index), rtol=1e-9, atol=1e-6)


def test_outputs_of_every_month_count(spark, small, tmp_path):
    """Only the granule that lost all its segments is missing, whatever months the others have."""
    for name in ("granule_manifest", "segment_spectra"):
        x = spark.read.parquet(f"{small}/{name}.parquet")
        if name == "segment_spectra":
            m = pd.read_parquet(f"{small}/granule_manifest.parquet")
            gone = m[m.error.isna() | (m.error.str.strip() == "")].granule.min()
            x = x.where(x.granule != gone)
        x.write.parquet(f"{tmp_path}/{name}.parquet")
    got = ref_grids.queries()["manifest_missing"](spark, str(tmp_path)).collect()
    assert [r.granule for r in got] == [gone]
    assert ref_grids.queries()["manifest_missing"](spark, small).count() == 0
