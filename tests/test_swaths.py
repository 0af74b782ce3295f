"""Spectra, slopes and alias segments of swaths against walks in numpy over the whole array."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dsp
from tidemark.functions.geo import EARTH_KM
from tidemark.operators import alias as al
from tidemark.operators import gridding as g
from tidemark.operators import spectra as sp
from tidemark.operators import tracks as t
from tidemark.sources import granules

KM = 180 / math.pi / EARTH_KM  # degrees of latitude in a kilometre
SCHEMA = "granule string, swath string, pixel int, line int, xt double, lat double, lon double, v double, segment_index string"


def field(seed=3, n=140, width=5):
    """Values (NaN: missing) and positions (NaN: the row is absent): uneven steps, a late column, gaps."""
    r = np.random.default_rng(seed)
    lat = np.cumsum(r.uniform(1.6, 2.4, n)) * KM - 1.0
    z = r.normal(0, 0.1, (n, width)) + np.cumsum(r.normal(0, 0.05, n))[:, None]
    here = np.ones((n, width), bool)
    here[:40, 0] = False  # a column that starts late
    here[60:63] = False  # lines that are absent
    z[30:36, 1] = np.nan
    z[90:120, 3] = np.nan
    here[70, width // 2] = False  # a hole in the middle column
    lats = np.repeat(lat[:, None], width, 1) + np.arange(width) * 1e-3
    return z, np.where(here, lats, np.nan), here


def frame(spark, z, lats, here):
    n, width = z.shape
    rows = [("g", "left", j, i, j * 0.5 - 3.0, float(lats[i, j]), 359.9 + 0.002 * i - (360 if i > 50 else 0), None if np.isnan(z[i, j]) else float(z[i, j]), "x") for i in range(n) for j in range(width) if here[i, j]]
    return spark.createDataFrame(rows, SCHEMA)


def distance(lats):
    """km along the middle column, missing positions interpolated."""
    n = len(lats)
    lat, lon = lats[:, lats.shape[1] // 2].copy(), 359.9 + 0.002 * np.arange(n)
    bad = np.isnan(lat)
    lat[bad] = np.interp(np.flatnonzero(bad), np.flatnonzero(~bad), lat[~bad])
    a, b = np.radians(lat), np.radians(lon)
    h = np.sin(np.diff(a) / 2) ** 2 + np.cos(a[:-1]) * np.cos(a[1:]) * np.sin(np.diff(b) / 2) ** 2
    return np.r_[0, np.cumsum(2 * EARTH_KM * np.arcsin(np.sqrt(h)))]


def bounds(km, length, overlap):
    starts = list(np.arange(km[0], km[-1] - length + 1e-9, length * (1 - overlap))) or [km[0]]
    if km[-1] - length > starts[-1] + 1e-9:
        starts.append(km[-1] - length)
    out = []
    for s in starts:
        i0, i1 = np.searchsorted(km, s), np.searchsorted(km, s + length, side="right")
        if i1 - i0 >= 8 and i1 not in [b for _, b in out]:
            out.append((int(i0), int(i1)))
    return out


def test_swath_spectra(spark):
    z, lats, here = field()
    km = distance(lats)
    dx, length = float(np.median(np.diff(km))), 60.0
    n = max(8, round(length / dx))
    got = {r.segment_index: r for r in sp.swath_spectra(frame(spark, z, lats, here), ["granule", "swath"], "pixel", "line", "v", length, overlap=0.5, min_pixels=2).collect()}
    values = np.where(here, z, np.nan)
    seen = 0
    for k, (i0, i1) in enumerate(bounds(km, length, 0.5)):
        d, grid, rows, shares, filled = km[i0:i1], km[i0] + dx * np.arange(n), [], [], False
        for c in range(z.shape[1]):
            y = values[i0:i1, c]
            ok = ~np.isnan(y)
            shares.append(ok.mean())
            if ok.mean() < 0.75 or ok.sum() < 8 or d[ok][0] - grid[0] > 15 or grid[-1] - d[ok][-1] > 15:
                continue
            rows.append(np.interp(grid, d[ok], y[ok]))
            filled |= not ok.all()
        if grid[-1] > d[-1] + max(10 * dx, 0.01 * length) or len(rows) < 2:
            assert k not in got
            continue
        seen += 1
        r = got[k]
        assert (r.n_pixels_used, r.gap_filled, r.n_total) == (len(rows), filled, len(bounds(km, length, 0.5)))
        assert [r.first_km, r.last_km, r.valid_fraction] == pytest.approx([d[0], d[-1], np.mean(shares)], rel=1e-9)
        assert [r.lat_mean, r.lat_min, r.lat_max] == pytest.approx([f(lats[i0:i1]) for f in (np.nanmean, np.nanmin, np.nanmax)])
        assert np.allclose(r.psd, dsp.periodograms(np.stack(rows), dx).mean(axis=0), rtol=1e-7)
        assert np.allclose(r.wavenumber, np.fft.rfftfreq(n, dx))
    assert seen == len(got) > 3


def test_two_dimensional_spectra(spark):
    z, lats, here = field(5, 140, 8)
    here[:40, 0] = True
    z[:, 0] = np.nan  # columns without any value: an outer and an inner one
    z[:, 4] = np.nan
    km = distance(lats)
    length, dx = 50.0, float(np.median(np.diff(km)))
    n = round(length / dx)
    out = sp.swath_spectra_2d(frame(spark, z, lats, here), ["granule", "swath"], "pixel", "line", "v", length)
    got = {r.segment_index: r for r in out.collect()}
    values = np.where(here, z, np.nan)
    for k, r in got.items():
        i0, i1 = bounds(km, length, 0.0)[k]
        d, grid, f = km[i0:i1], km[i0] + dx * np.arange(n), np.full((n, 8), np.nan)
        for c in range(8):
            ok = ~np.isnan(values[i0:i1, c])
            if ok.mean() >= 0.75 and d[ok][0] - grid[0] <= 12.5 and grid[-1] - d[ok][-1] <= 12.5:
                f[:, c] = np.interp(grid, d[ok], values[i0:i1, c][ok])
        good = ~np.isnan(f[0])
        assert (r.n_columns_used, r.n_columns, r.gap_filled) == (good.sum(), 8, True)
        for row in f:
            row[~good] = np.interp(np.flatnonzero(~good), np.flatnonzero(good), row[good])
        j = np.arange(n)
        f = f - np.stack([np.polyval(np.polyfit(j, c, 1), j) for c in f.T], axis=1)
        f = f - f.mean(axis=1, keepdims=True)
        w = np.multiply.outer(dsp.hann(n), dsp.hann(8))
        power = np.fft.fftshift(np.abs(np.fft.fft2(f * w)) ** 2) * dx * 0.5 / (n * 8) / np.mean(w**2)
        assert np.allclose(np.array(r.psd_2d), power, rtol=1e-6, atol=1e-12)
        # Parseval: the integral is the tapered variance
        assert np.sum(r.psd_2d) / (n * dx * 8 * 0.5) == pytest.approx(np.mean((f * w) ** 2) / np.mean(w**2))
        assert r.wavenumber_y == pytest.approx(np.fft.fftshift(np.fft.fftfreq(8, 0.5)))
    assert len(got) >= 3
    mean = sp.pass_spectra_2d(out, ["granule", "swath"]).orderBy("ix", "iy").collect()
    assert np.allclose([m.power for m in mean], np.mean([np.ravel(r.psd_2d) for r in got.values()], axis=0))
    assert {m.n_segments_used for m in mean} == {len(got)}


def test_slope_segments(spark):
    z, lats, here = field(7)
    km = distance(lats)
    df = frame(spark, z, lats, here).withColumnRenamed("v", "slope").withColumn("velocity", F.when(F.abs("lat") >= 0.5, 3 * F.col("slope")))
    got = {r.segment_index: r for r in sp.slope_segments(df, ["granule", "swath"], "pixel", "line", 60.0, 0.5, min_pixels=3).collect()}
    v = np.where(here, z, np.nan)
    for k, (i0, i1) in enumerate(bounds(km, 60.0, 0.5)):
        cols = [c for c in range(5) if (~np.isnan(v[i0:i1, c])).mean() >= 0.75]
        if len(cols) < 3:
            assert k not in got
            continue
        x = v[i0:i1, cols]
        far = x[np.abs(lats[i0:i1][:, cols]) >= 0.5]
        r = got[k]
        assert r.n_pixels_used == len(cols)
        assert [r.slope_mean, r.slope_variance, r.slope_rms] == pytest.approx([np.nanmean(x), np.nanvar(x), np.sqrt(np.nanmean(x**2))])
        assert r.velocity_rms == (pytest.approx(3 * np.sqrt(np.nanmean(far**2))) if np.isfinite(far).any() else None)
    assert got


def walk_alias(p, every, taps):
    n1, n2 = (n // m * m for n, m in zip(p.shape, every))
    p = p[:n1, :n2]
    w = np.outer(np.hanning(n1), np.hanning(n2))
    s = 0.0625 / (n1 * n2) * np.abs(np.fft.fft2(p * w)) ** 2 / np.mean(w**2)
    s = s * dsp.transfer_power(np.fft.fftfreq(n1, 0.25), taps, 0.25)[:, None] * dsp.transfer_power(np.fft.fftfreq(n2, 0.25), taps, 0.25)
    t1, t2 = n1 // every[0], n2 // every[1]
    total, direct = np.zeros(t1), np.zeros(t1)
    for i in range(n1):
        for j in range(n2):
            total[i % t1] += s[i, j] / (n2 * 0.25)
            direct[i % t1] += s[i, j] / (n2 * 0.25) if i < t1 and j < t2 else 0
    keep = np.fft.fftfreq(t1) >= 0
    two = np.where(np.arange(t1)[keep] > 0, 2, 1)
    return direct[keep] * two, total[keep] * two


def test_alias_segments(spark):
    r = np.random.default_rng(9)
    n, width = 90, 18  # 18 columns by 4: two are trimmed
    z = r.normal(0, 1, (n, width))
    z[40:44] = np.nan  # a gap of four lines
    z[r.random((n, width)) < 0.03] = np.nan
    z[70:, :12] = np.nan
    here = np.ones((n, width), bool)
    here[5] = False
    lats = np.repeat((np.arange(n) * 0.25 * KM)[:, None], width, 1)
    df = frame(spark, z, np.where(here, lats, np.nan), here)
    x = al.alias_segments(df, ["granule", "swath"], "pixel", "line", "v", 16.0, (0.25, 0.25), (1.0, 1.0), overlap=0.75, max_gap=0.1, taps=9, max_nan=0.3)
    got = {s.segment_index: s for s in x.collect()}
    rows = 16 * 4
    assert [s.n_lines for s in got.values()] == [rows] * len(got)
    values = np.where(here, z, np.nan)
    starts = [0, 16, 26]
    assert sorted(got) == [0, 1, 2]
    for k, i in enumerate(starts):
        p, s = values[i : i + rows], got[k]
        assert s.valid_fraction == pytest.approx(np.isfinite(p).mean()) and s.n_pixels == width
        if np.isnan(p).mean() > 0.3:
            assert (s.reason, s.direct) == ("nan_fraction", None)
            continue
        bad = np.isnan(p).mean(axis=1) > 0.5
        run = max(len(b) for b in "".join("x" if b else " " for b in bad).split(" "))
        assert s.gap_fraction == pytest.approx(run / rows)
        if run / rows > 0.1:
            assert s.reason == "gap"
            continue
        y, c = np.mgrid[0:rows, 0:width]
        f = al.filled_patch(p)
        a = np.column_stack([np.ones(f.size), c.ravel(), y.ravel()])
        f = f - (a @ np.linalg.lstsq(a, f.ravel(), rcond=None)[0]).reshape(f.shape)
        direct, total = walk_alias(f, (4, 4), 9)
        assert s.reason == "used" and s.gap_filled
        assert np.allclose(s.direct, direct) and np.allclose(s.total, total) and np.allclose(s.aliased, np.maximum(total - direct, 0))
    counters = al.drop_counters(x, ["swath"]).first()
    assert counters.total == 3 and counters.used + counters.nan_fraction + counters.gap == 3 and counters.used >= 1
    at = al.alias_segments(df, ["granule", "swath"], "pixel", "line", "v", 4.0, (0.25, 0.25), (1.0, 1.0), targets={"left": [99.0, 30 * 0.25 * KM, 0.0], "right": [0.0]})
    assert [(s.segment_index, s.first_km) for s in at.collect()] == [(0, pytest.approx(distance(np.where(here, lats, np.nan))[22]))]
    narrow = al.alias_segments(df.where("pixel < 8"), ["granule", "swath"], "pixel", "line", "v", 4.0, (0.25, 0.25), (1.0, 1.0))
    assert {s.reason for s in narrow.collect()} >= {"decompose_failed"}
    assert al.alias_segments(df.limit(0), ["granule", "swath"], "pixel", "line", "v", 4.0, (0.25, 0.25), (1.0, 1.0)).count() == 0


def test_matched_rows_and_validation(spark):
    """The other product is the same field every second line: its rows and spectra are known."""
    n, width = 64, 16
    z = np.random.default_rng(11).normal(0, 1, (n, width))
    here, lats = np.ones((n, width), bool), np.repeat((np.arange(n) * 0.25 * KM)[:, None], width, 1)
    df = frame(spark, z, lats, here).withColumn("lon", F.lit(10.0))
    x = al.alias_segments(df, ["granule", "swath"], "pixel", "line", "v", 8.0, (0.25, 0.25), (0.5, 1.0))
    other = df.where("line % 2 = 0").withColumn("idx", (F.col("line") / 2).cast("int"))
    ends = spark.createDataFrame([("g", "left", 0, 0.0, 10.0, float(lats[31, 0]), 10.0), ("g", "left", 1, float(lats[63, 0]), 10.0, float(lats[32, 0]), 10.0)], "granule string, swath string, segment_index int, lat0 double, lon0 double, lat1 double, lon1 double")
    rows = al.matched_rows(ends, other.select("granule", "swath", "idx", "lat", "lon").distinct(), ["granule", "swath"], "segment_index", "idx")
    got = {r.segment_index: (r.j0, r.j1) for r in rows.collect()}
    assert got[0] in ((0, 16), (0, 17)) and got[1] == (17, 31)  # ends in reverse order: the later one is not moved on
    y = al.matched_validation(x, rows, other, ["granule", "swath"], "pixel", "idx", "v", 0.5, min_rows=8).where("segment_index = 0").orderBy("ik").collect()
    j = got[0][1]
    want = dsp.periodograms(z[0 : 2 * j : 2].T, 0.5).mean(axis=0)
    k = np.fft.rfftfreq(j, 0.5)
    for r in y:
        assert r.measured == (pytest.approx(np.interp(r.k, k, want)) if r.k <= k[-1] else None)
    assert len(y) == 8


def test_nearest_line_is_exact(spark):
    r = np.random.default_rng(1)
    i = np.arange(2000)
    lat, lon = 60 * np.sin(i / 300), (i * 0.2) % 360
    lines = spark.createDataFrame([("g", int(a), float(b), float(c)) for a, b, c in zip(i, lat, lon)], "g string, idx int, lat double, lon double")
    la, lo = r.uniform(-90, 90, 60), r.uniform(-180, 360, 60)
    points = spark.createDataFrame([("g", k, float(a), float(b)) for k, (a, b) in enumerate(zip(la, lo))] + [("g", 99, None, 1.0)], "g string, id int, la double, lo double")
    got = {x.id: x.idx for x in t.nearest_line(points, lines, ["g"], ["id"], ("la", "lat"), ("lo", "lon"), "idx").collect()}
    a, b = np.radians(lat), np.radians(lon)
    for k in range(60):
        p, q = np.radians(la[k]), np.radians(lo[k])
        h = np.sin((a - p) / 2) ** 2 + np.cos(a) * np.cos(p) * np.sin((b - q) / 2) ** 2
        assert h[got[k]] <= h.min() + 1e-15
    assert len(got) == 60


def test_small_operators(spark, tmp_path):
    df = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate([-4.0, -3.0, -2.0, 1.0, 2.0, 3.0, 9.0])], "g string, pixel int, xt double")
    assert sorted(r.pixel for r in t.trim_pixels(df, ["g"], "pixel", 2).collect()) == [2, 3, 4]
    assert sorted(r.pixel for r in t.every_nth(df, ["g"], "pixel", 3).collect()) == [0, 3, 6]
    assert sorted(r.xt for r in t.across_between(df, "xt", 2.0, 4.0).collect()) == [-3.0, -2.0, 2.0, 3.0]
    sided = df.withColumn("swath", F.lit("right")).where("xt > 0")
    assert sorted(r.xt for r in t.trim_swaths_median(sided, ["g"], "pixel", "xt", 2.0).collect()) == [1.0, 2.0, 3.0]  # median 2.5, half floor(3)
    assert t.spread_targets([1.0, 2.0, 3.0, 4.0, 5.0], 3) == [1.0, 3.0, 5.0] and t.spread_targets([1.0], 3) == [1.0]
    pos = spark.createDataFrame([(1, 30.0, 0.0), (2, 60.0, 5.0), (3, None, 9.0), (4, 45.0, None)], "id int, lat double, lon double")
    assert sorted(r.id for r in g.roi(pos, "lat", "lon", lat_min=40.0).collect()) == [2, 3, 4]
    assert sorted(r.id for r in g.roi(pos, "lat", "lon", lon_max=0.0).collect()) == [1, 4]
    assert sorted(r.id for r in g.zone(pos, "lat", 30.0, 60.0).collect()) == [2, 4]
    for name in ("a", "b"):
        spark.range(2).withColumn(name, F.lit(1)).write.parquet(f"{tmp_path}/{name}")
    whole = granules.concatenated(spark, {"001": f"{tmp_path}/a", "002": f"{tmp_path}/b"})
    assert {(r.cycle, r.a, r.b) for r in whole.collect()} == {("001", 1, None), ("002", None, 1)}
    with pytest.raises(Exception, match="no month in"):
        spark.range(1).select(*granules.month_of_folder(F.lit("/data/none/"), strict=True)).collect()
    means = spark.createDataFrame([("p", "left", 1.0), ("p", "right", 2.0), ("q", "left", 3.0)], "pass string, swath string, psd double")
    assert {r["pass"] for r in sp.complete_passes(means, ["pass"]).collect()} == {"p"}


def test_segments_around_targets(spark):
    df = spark.createDataFrame([("g", i, i * 2.0, i * 2 * KM) for i in range(60)], "g string, idx int, km double, lat double")
    got = {r.target: (r.center, r.i0, r.i1) for r in t.segments_around(df, ["g"], "idx", "km", "lat", [0.0, 60 * KM, 60.9 * KM, 119 * KM], 40.0).collect()}
    assert got == {60 * KM: (30, 20, 41), 60.9 * KM: (30, 20, 41)}


def test_reflected_edges_never_matter(spark):
    z = np.random.default_rng(2).normal(0, 1, (40, 44))
    df = spark.createDataFrame([(1, i, j, float(z[i, j])) for i in range(40) for j in range(44)], "id int, r int, c int, v double")
    taps = np.array(t.hamming_taps(5))
    full = np.pad(z, 2, mode="symmetric")
    full = np.apply_along_axis(lambda x: np.convolve(x, taps, "valid"), 0, full)
    full = np.apply_along_axis(lambda x: np.convolve(x, taps, "valid"), 1, full)
    want = full[5:-5, 5:-5][::3, ::3]
    got = t.fir_decimate_2d(df, ["id"], "r", "c", "v", list(taps), 3).orderBy("r", "c").collect()
    assert np.allclose([r.v for r in got], want.ravel()) and (got[0].r, got[0].c) == (5, 5)


def test_anisotropy(spark, small):
    """Along over across from the two spectra that have SQL of their own."""
    from tidemark.plans import ref_spectra as q

    along = sp.swath_spectra(q.patch_lines(spark, small), q.PASS, "pixel_no", "line_no", "v", 4.0, overlap=0.5).collect()
    across = sp.cross_track_spectra(q.patch_lines(spark, small), q.PASS, "pixel_no", "line_no", "v", 0.25, 3, 20).collect()
    got = {(r.label, r.swath, r.ik): r.ratio for r in q.queries()["anisotropy"](spark, small).collect()}
    seen = 0
    for key in {(r.label, r.swath) for r in along}:
        mine = [r for r in along if (r.label, r.swath) == key]
        rows = sorted((r.k, r.psd) for r in across if (r.label, r.swath) == key)
        p, k = np.mean([r.psd for r in mine], axis=0), np.array(mine[0].wavenumber)
        there = np.interp(k, *zip(*rows), left=np.nan, right=np.nan)
        for i in range(len(k)):
            want = p[i] / there[i]
            assert got[(*key, i)] == (pytest.approx(want, rel=1e-5, abs=2e-6) if np.isfinite(want) else None)
            seen += np.isfinite(want)
    assert seen > 50
