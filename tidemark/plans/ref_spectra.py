"""Registered queries: periodograms, swath spectra, alias decomposition, prediction."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dsp
from tidemark.operators import alias as al
from tidemark.operators import gridding as g
from tidemark.operators import spectra as sp
from tidemark.operators import spectral_stats as stats
from tidemark.operators import tracks as t
from tidemark.plans import ref_series, ref_stats
from tidemark.functions.geo import geostrophic_velocity, lon_360
from tidemark.plans.common import EXP, SEG, clean0, hav_sql, heights, segments, significant, significant_sql, table, tie_free

N, ROWS, COLS = 64, 16, 64


def vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def cells(s, d):
    """Patches of ROWS consecutive vectors of a label."""
    r = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    x = vectors(s, d).withColumn("r", r).withColumn("patch", F.floor(F.col("r") / ROWS).cast("int")).withColumn("row", (F.col("r") % ROWS).cast("int"))
    return x.select("label", "patch", "row", F.posexplode("v").alias("col", "v"))


def power(s, d):
    return sp.power_2d(cells(s, d), ["label", "patch"], "row", "col", "v", ROWS, COLS, 0.25, 0.25)


SWATH = ["granule", "swath"]
LENGTH = 100.0


def swath_lines(s, d):
    """Heights of both swaths, every line and pixel in the table."""
    h = heights(s, d).select("granule", "pixel_no", "line_no", F.col("latitude").alias("lat"), lon_360(F.col("longitude")).alias("lon"), F.col("cross_track_distance").alias("xt"), "ssh")
    return t.split_swaths(h, ["granule"], "pixel_no", "xt").where("swath is not null")


def slope_lines(s, d):
    """Slopes (1e-6) and velocities of both swaths."""
    x = t.centred_slope(t.interpolate(ref_series.with_km(s, d), ref_series.K, "line_no", "ssh", x="km", clamp=False, max_run=5), ref_series.K, "line_no", "km", "ssh")
    x = x.withColumn("velocity", geostrophic_velocity(F.col("slope"), F.col("lat"))).withColumn("slope", F.col("slope") * 1e6)
    return t.split_swaths(x, ["granule"], "pixel_no", "xt").where("swath is not null").drop("km", "idx")


def swath(s, d):
    return sp.swath_spectra(swath_lines(s, d), SWATH, "pixel_no", "line_no", "ssh", LENGTH, overlap=0.5, min_pixels=1)


def patch_lines(s, d):
    """Embeddings as two swaths of 32 columns: a row of a label is a line 0.25 km after the last, an
    element a column 0.25 km beside the last; two columns of some lines are missing."""
    e = table(s, d, "embeddings").withColumn("line_no", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int"))
    e = e.select("label", "line_no", F.posexplode("embedding").alias("pixel_no", "v")).withColumn("xt", (F.col("pixel_no") - 31.5) * 0.25)
    gone = F.col("pixel_no").isin(5, 40) & (F.pmod(F.col("label") + F.col("line_no"), F.lit(3)) > 0)
    return e.select(
        "label", F.when(F.col("xt") < 0, "left").otherwise("right").alias("swath"), "line_no", "pixel_no", "xt",
        (F.col("label") * 9 - 40 + F.col("line_no") * 0.25 / 111).alias("lat"), (F.col("label") * 11.0 - 130).alias("lon"), F.when(~gone, F.col("v").cast("double")).alias("v"),
    )


PASS = ["label", "swath"]
NATIVE, TARGET, ALIAS_KM = (0.25, 0.25), (0.5, 1.0), 8.0


def alias_lines(s, d):
    """The same with a band of missing lines in every fourth label and scattered gaps in some others."""
    gone = ((F.col("label") % 4 == 1) & F.col("line_no").between(20, 25)) | ((F.col("label") % 4 == 2) & (F.pmod(F.col("line_no") * 7 + F.col("pixel_no") * 13, F.lit(4)) == 0))
    return patch_lines(s, d).withColumn("v", F.when(~gone, F.col("v")))


def aliases(s, d, targets=None):
    return al.alias_segments(alias_lines(s, d), PASS, "pixel_no", "line_no", "v", ALIAS_KM, NATIVE, TARGET, overlap=0.5, targets=targets)


TARGETS = {"left": [-39.96, -31.0, 5.04, 5.06, 23.0], "right": [-39.95, 14.05, 41.04]}


def emulated(s, d):
    """The product with twice the spacing along the track and four times across that filtering gives."""
    x = t.fir_decimate_2d(patch_lines(s, d).withColumn("v", F.coalesce("v", F.lit(0.0))), PASS, "line_no", "pixel_no", "v", t.hamming_taps(9), 2)
    return x.select(*PASS, "line_no", "pixel_no", "v")


def swath_2d(s, d):
    return sp.swath_spectra_2d(patch_lines(s, d), ["label", "swath"], "pixel_no", "line_no", "v", 4.0, overlap=0.5)


def holed(s, d):
    """Patches with scattered gaps and, in every fifth, a band of missing rows."""
    gone = ((F.col("row") * 7 + F.col("col") * 13 + F.col("patch")) % 11 == 0) | ((F.col("patch") % 5 == 1) & F.col("row").between(4, 5 + F.col("label") % 3))
    return cells(s, d).withColumn("v", F.when(~gone, F.col("v")))


def queries():
    def spread(column):
        def q(s, d):
            x = vectors(s, d).select("vec_id", F.posexplode(column(F.col("v"))).alias("ik", "psd"))
            return x.select("vec_id", "ik", clean0("psd").alias("psd"))

        return q

    def long_spectra(x, scale=1e4):
        keep = [c for c in ("segment_index", "n_total", "n_pixels_used", "gap_filled") if c in x.columns]
        meta = [clean0(c, 4).alias(c) for c in ("first_km", "last_km", "lat_mean", "lon_mean", "valid_fraction")]
        x = x.select(*SWATH, *keep, *meta, F.posexplode(F.arrays_zip(F.col("wavenumber").alias("k"), F.col("psd").alias("p"))).alias("ik", "z"))
        return x.select("*", significant("z.k").alias("k"), clean0(F.col("z.p") * scale, 4).alias("psd")).drop("z")

    def slope_spectra(s, d):
        x = sp.swath_spectra(slope_lines(s, d), SWATH, "pixel_no", "line_no", "slope", LENGTH, overlap=0.5, min_pixels=1)
        return long_spectra(x, 1.0).select(*SWATH, "segment_index", "n_pixels_used", "ik", "psd")

    def pass_mean(s, d):
        x = sp.pass_means(swath(s, d), SWATH)
        return x.select(*SWATH, "n_segments_used", "n_segments_total", F.posexplode("psd").alias("ik", "psd")).withColumn("psd", clean0(F.col("psd") * 1e4, 4))

    def slope_segments(s, d):
        x = sp.slope_segments(slope_lines(s, d), SWATH, "pixel_no", "line_no", LENGTH, 0.5, min_pixels=1)
        return x.select(*SWATH, "segment_index", "n_pixels_used", *[clean0(c, 4).alias(c) for c in ("first_km", "last_km", "lat_mean", "lat_min", "lat_max", "lon_mean", "valid_fraction", "slope_mean", "slope_rms", "slope_variance", "velocity_rms")])

    def spectra_2d(s, d):
        c = sp.cells_2d(swath_2d(s, d), ["label", "swath", "segment_index", "n_columns_used", "gap_filled", "valid_fraction"])
        return c.select("label", "swath", "segment_index", "n_columns_used", "gap_filled", clean0("valid_fraction").alias("valid_fraction"), "ix", "iy", *[clean0(c).alias(c) for c in ("kx", "ky", "power")])

    def pass_2d(s, d):
        x = sp.pass_spectra_2d(swath_2d(s, d), ["label", "swath"])
        return x.select("label", "swath", "ix", "iy", "n_segments_used", "n_segments_total", *[clean0(c).alias(c) for c in ("kx", "ky", "power")])

    def alias(centred):
        def q(s, d):
            x = sp.alias_decomposition(power(s, d), ["label", "patch"], ROWS, COLS, 0.25, 0.25, (2, 4), 9, centred)
            return x.select("label", "patch", "k", *[clean0(c).alias(c) for c in ("direct", "aliased", "total")])

        return q

    def predict(s, d):
        x = sp.predict_target(ref_stats.long(s, d), ["segment_id"], "k", "psd", 0.06, 0.124, 2, 5, 2.0)
        return x.select("segment_id", "k", significant("predicted").alias("predicted"))

    def rejects(s, d):
        return sp.granule_rejects(table(s, d, "granule_manifest"), ref_stats.long(s, d))

    def transfer(s, d):
        x = ref_stats.long(s, d).where("ik > 0").select("segment_id", "ik", "k", "psd")
        return x.select("segment_id", "ik", significant(F.col("psd") * dsp.transfer_column(F.col("k"), 9, 2.0)).alias("filtered"))

    parts = ("direct", "aliased", "total")

    def alias_spectra(targets=None):
        def q(s, d):
            x = al.alias_long(aliases(s, d, targets), [*PASS, "segment_index"])
            return x.select(*PASS, "segment_index", "ik", "k", *[clean0(c).alias(c) for c in parts])

        return q

    def alias_meta(s, d):
        x = aliases(s, d)
        return x.select(*PASS, "segment_index", "reason", "n_lines", "n_pixels", "gap_filled", *[clean0(c).alias(c) for c in ("first_km", "last_km", "lat_mean", "lat_min", "lat_max", "lon_mean", "valid_fraction", "gap_fraction")])

    def alias_means(s, d):
        return al.alias_pass_means(aliases(s, d), PASS).select(*PASS, "ik", "k", "n_segments", *[clean0(c).alias(c) for c in parts])

    def box_three(s, d):
        x = aliases(s, d).where("reason = 'used'")
        b = g.box_mean_spectra(x, "lat_mean", "lon_mean", "k", list(parts), box=20.0, min_count=2)
        return b.select("ilat", "ilon", "n_segments", "ik", *[clean0(f"mean_{p}").alias(f"mean_{p}") for p in parts])

    def aliased_fraction(s, d):
        x, keys = al.alias_long(aliases(s, d), [*PASS, "segment_index"]), [*PASS, "segment_index"]
        e = [stats.band_energy(x.select(*keys, "k", F.col(c).alias("psd")), keys, 0.1, 0.9).withColumnRenamed("energy", c) for c in ("aliased", "direct")]
        return e[0].join(e[1], keys).select(*keys, clean0(F.try_divide(F.col("aliased"), F.col("aliased") + F.col("direct"))).alias("aliased_fraction"))

    def anisotropy(s, d):
        along = sp.pass_means(sp.swath_spectra(patch_lines(s, d), PASS, "pixel_no", "line_no", "v", 4.0, overlap=0.5), PASS).select(*PASS, F.posexplode("psd").alias("ik", "along"))
        dx = t.swath_axis(patch_lines(s, d), PASS, "pixel_no", "line_no", "lat", "lon")
        dx = t.median_spacing(dx, PASS, "line_no", "km")
        along = along.join(dx, PASS).withColumn("k", F.col("ik") / (F.greatest(F.lit(8), F.bround(4.0 / F.col("spacing"))) * F.col("spacing")))
        across = sp.cross_track_spectra(patch_lines(s, d), PASS, "pixel_no", "line_no", "v", 0.25, 3, 20).select(*PASS, "k", F.col("psd").alias("across"))
        there = t.resample(across, along.select(*PASS, "k"), PASS, "k", "across", "null")
        return along.join(there, [*PASS, "k"]).select(*PASS, "ik", clean0(F.try_divide(F.col("along"), F.col("across"))).alias("ratio"))

    def cross_track(s, d):
        x = sp.cross_track_spectra(patch_lines(s, d), PASS, "pixel_no", "line_no", "v", 0.25, 3, 20)
        return x.select(*PASS, "ik", "k", "n_rows", clean0("psd").alias("psd"))

    def explicit(s, d):
        x = sp.explicit_segments(t.indexed(patch_lines(s, d), [*PASS, "pixel_no"], "line_no"), PASS, "pixel_no", "idx", "v", 4.0, 0.25)
        return sp.explicit_spectra(x, PASS, "pixel_no", 16, 0.25).select(*PASS, "ik", "k", "n_tracks", clean0("mean").alias("mean"), clean0("error").alias("error"))

    def whole_track(s, d):
        x = t.interpolate(ref_series.series(s, d), ref_series.K, "line_no", "ssh").where("pixel_no % 2 = 0")
        return sp.track_spectrum(x, ref_series.K, "idx", "ssh", 2.0).select(*ref_series.K, "ik", significant("k").alias("k"), clean0(F.col("psd") * 1e4, 4).alias("psd"))

    def only_aliased(s, d):
        x = al.alias_only(ref_stats.long(s, d), ["segment_id"], "k", "psd", 0.06, 0.124, 2, 5, 2.0)
        return x.select("segment_id", "k", significant("aliased").alias("aliased"))

    def ratio(s, d):
        m = ref_stats.long(s, d).groupBy("granule", "swath", "ik").agg(F.max("k").alias("k"), F.avg("psd").alias("psd"))
        x = al.observed_ratio(m.where("swath = 'right'"), m.where("swath = 'left'"), ["granule"], "k", "psd", 0.1, 5, 2.0)
        return x.select("granule", "k", significant("ratio").alias("ratio"))

    def emulated_spectra(s, d):
        x = emulated(s, d).groupBy(*PASS, "pixel_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "v"))).getField("v").alias("v"))
        x = x.select(*PASS, "pixel_no", F.posexplode(dsp.periodogram_udf(0.5)("v")).alias("ik", "p"))
        return x.groupBy(*PASS, "ik").agg(clean0(F.avg("p")).alias("psd"), F.count("*").alias("n"))

    def matched(s, d):
        """Patches of the native product against the emulated one on the same footprint."""
        x = aliases(s, d)
        axis = t.swath_axis(alias_lines(s, d), PASS, "pixel_no", "line_no", "lat", "lon")
        ends = x.where("reason = 'used'").select(*PASS, "segment_index", "first_km", "last_km")
        at = axis.select(*PASS, "km", "lat", "lon")
        for i, c in enumerate(("first_km", "last_km")):
            ends = ends.join(at.select(*PASS, F.col("km").alias(c), F.col("lat").alias(f"lat{i}"), F.col("lon").alias(f"lon{i}")), [*PASS, c])
        other = emulated(s, d)
        rank = F.dense_rank().over(Window.partitionBy(*PASS).orderBy("line_no")) - 1
        other = other.withColumn("idx", rank.cast("int")).join(axis.select(*PASS, "line_no", "lat", "lon"), [*PASS, "line_no"])
        rows = al.matched_rows(ends, other.select(*PASS, "idx", "lat", "lon").distinct(), PASS, "segment_index", "idx")
        y = al.matched_validation(x, rows, other, PASS, "pixel_no", "idx", "v", 0.5, min_rows=8)
        return y.select(*PASS, "segment_index", "ik", clean0("k").alias("k"), clean0("predicted").alias("predicted"), clean0("measured").alias("measured"))

    def alias_drops(s, d):
        x = sp.screen_patches(holed(s, d), ["label", "patch"], "row", "v", 0.2, 0.1)
        return x.groupBy("reason").agg(F.count("*").alias("n"))

    def pairs(s, d):
        x = segments(s, d, "segment_index", "valid_fraction")
        one = x.groupBy("granule", "segment_index", "swath").agg(F.avg("valid_fraction").alias("valid"), F.count("*").alias("n"))
        left, right = (one.where(F.col("swath") == w) for w in ("left", "right"))
        j = sp.paired_segments(left, right, ["granule", "segment_index"], ["valid", "n"])
        return j.select("granule", "segment_index", clean0(F.col("valid_a") - F.col("valid_b")).alias("difference"), "n_a", "n_b")

    return {
        "alias_swath": alias_spectra(),
        "alias_targets": alias_spectra(TARGETS),
        "alias_segments": alias_meta,
        "alias_pass_mean": alias_means,
        "alias_counters": lambda s, d: al.drop_counters(aliases(s, d), PASS),
        "box_three_psd": box_three,
        "aliased_fraction": aliased_fraction,
        "anisotropy": anisotropy,
        "cross_track_spectrum": cross_track,
        "explicit_spectrum": explicit,
        "track_spectrum": whole_track,
        "alias_only": only_aliased,
        "alias_ratio": ratio,
        "emulated_spectra": emulated_spectra,
        "matched_validation": matched,
        "alias_drop_counters": alias_drops,
        "segment_pairs": pairs,
        "periodogram_1d": spread(lambda v: dsp.dft_power(v, N, 2.0)),
        "periodogram_arrow": spread(lambda v: dsp.periodogram_udf(2.0)(v)),
        "periodogram_undoubled": spread(lambda v: dsp.periodogram_udf(2.0, doubled=False)(v)),
        "periodogram_raw": spread(lambda v: dsp.periodogram_udf(2.0, periodic=False, raw=True)(v)),
        "welch": spread(lambda v: dsp.welch_udf(2.0, 32)(v)),
        "periodogram_2d": lambda s, d: power(s, d).select("label", "patch", "i1", "i2", clean0("power").alias("power")),
        "alias_decompose": alias(False),
        "alias_decompose_centred": alias(True),
        "predict_no_alias": lambda s, d: sp.integrate_across(power(s, d), ["label", "patch"], ROWS, COLS, 0.25, 0.25, 9).select("label", "patch", "k", clean0("psd").alias("psd")),
        "sector_energy": lambda s, d: sp.sector_energy(power(s, d), ["label", "patch"], ROWS, COLS, 0.25, 0.25).select("label", "patch", clean0("along").alias("along"), clean0("across").alias("across")),
        "predict_psd": predict,
        "transfer_function": transfer,
        "swath_spectra": lambda s, d: long_spectra(swath(s, d)),
        "swath_pass_mean": pass_mean,
        "slope_spectra": slope_spectra,
        "slope_segments": slope_segments,
        "swath_spectra_2d": spectra_2d,
        "pass_spectra_2d": pass_2d,
        "rejects": rejects,
    }


def _dft(n, window, detrend, scale, doubled, of="v"):
    """Periodogram of every vector by a join with the wavenumbers."""
    y = "x - ax - coalesce(b, 0) * (i - ai)" if detrend == "linear" else "x - ax" if detrend == "constant" else "x"
    den = n if window == "periodic" else n - 1
    return f"""de as (select *, ({y}) * (5e-1 - 5e-1 * cos(2 * pi() * i / {den}e0)) w from (select *, avg(x) over (partition by id) ax, avg(i) over (partition by id) ai, regr_slope(x, i) over (partition by id) b from {of})),
      ft as (select id, k, sum(w * cos(2 * pi() * i * k / {n}e0)) re, sum(w * sin(2 * pi() * i * k / {n}e0)) im from de, range(0, {n // 2 + 1}) r(k) group by 1, 2),
      pw as (select id, cast(k as integer) ik, (re * re + im * im) * {scale!r}e0 * {'(case when k > 0 and k < ' + str((n + 1) // 2) + ' then 2 else 1 end)' if doubled else '1'} psd from ft)"""


_X = "v as (select vec_id id, i - 1 i, cast(embedding[i] as double) x from embeddings, range(1, 65) r(i))"
_S64 = 2.0 / (64 * float(np.mean(dsp.hann(64) ** 2)))
_S32 = 2.0 / (32 * float(np.mean(dsp.hann(32) ** 2)))
_W2 = float(np.mean(np.multiply.outer(dsp.hann(ROWS, False), dsp.hann(COLS, False)) ** 2))
_P2 = f"""e0 as (select label, cast(floor((row_number() over (partition by label order by vec_id) - 1) / {ROWS}e0) as integer) patch, (row_number() over (partition by label order by vec_id) - 1) % {ROWS} r, embedding from embeddings),
  e1 as (select * from e0 where (label, patch) in (select (label, patch) from e0 group by label, patch having count(*) = {ROWS})),
  c as (select label, patch, r, j - 1 c, cast(embedding[j] as double) * (5e-1 - 5e-1 * cos(2 * pi() * r / {ROWS - 1}e0)) * (5e-1 - 5e-1 * cos(2 * pi() * (j - 1) / {COLS - 1}e0)) v from e1, range(1, {COLS + 1}) q(j)),
  f1 as (select label, patch, r, k i2, sum(v * cos(2 * pi() * c * k / {COLS}e0)) re, -sum(v * sin(2 * pi() * c * k / {COLS}e0)) im from c, range(0, {COLS}) q(k) group by 1, 2, 3, 4),
  f2 as (select label, patch, k i1, i2, sum(re * cos(2 * pi() * r * k / {ROWS}e0) + im * sin(2 * pi() * r * k / {ROWS}e0)) re, sum(im * cos(2 * pi() * r * k / {ROWS}e0) - re * sin(2 * pi() * r * k / {ROWS}e0)) im from f1, range(0, {ROWS}) q(k) group by 1, 2, 3, 4),
  pw as (select label, patch, cast(i1 as integer) i1, cast(i2 as integer) i2, (re * re + im * im) * {0.0625 / (ROWS * COLS) / _W2!r}e0 power from f2)"""


def _h(n, taps, name):
    h = dsp.transfer_power(np.fft.fftfreq(n, 0.25), taps, 0.25)
    return f"{name}(i, h) as (values {', '.join(f'({i}, {float(v)!r}::double)' for i, v in enumerate(h))})"


def _alias_sql(direct):
    n1, n2 = ROWS // 2, COLS // 4
    dk = 1.0 / (n2 * 1.0)
    return f"""with {_P2}, {_h(ROWS, 9, 'h1')}, {_h(COLS, 9, 'h2')}, fi as (select label, patch, i1, i2, i1 % {n1} p, power * h1.h * h2.h f from pw join h1 on h1.i = i1 join h2 on h2.i = i2),
      sm as (select label, patch, p, sum(f) * {dk!r} t, sum(case when {direct} then f else 0 end) * {dk!r} d from fi group by 1, 2, 3),
      kk as (select *, (case when p < {(n1 + 1) // 2} then p else p - {n1} end) / ({n1} * 5e-1) k from sm)
      select label, patch, k, round(d * g, 6) + 0e0 direct, round(greatest(t - d, 0) * g, 6) + 0e0 aliased, round(t * g, 6) + 0e0 total from (select *, case when k > 0 and k < {float(np.abs(np.fft.fftfreq(n1, 0.5)).max())!r} - 1e-12 then 2 else 1 end g from kk where k >= 0)"""


_BOUNDS = "tot"


def _segments_sql(lines, length, group="granule, swath", with_=""):
    """Segments of the swaths of a relation (group, pixel_no, line_no, lat, lon): the track of the middle
    column line by line, its km, and the bounds of the segments of ``length`` at half overlap."""
    on = " and ".join(f"{{0}}.{c.strip()} = {{1}}.{c.strip()}" for c in group.split(","))
    hav = hav_sql("lag(lat) over w", "lag(lon) over w", "lat", "lon")
    short = "((b.lon - a.lon + 180e0) - 360e0 * floor((b.lon - a.lon + 180e0) / 360e0) - 180e0)"
    return f"""{with_}ln as materialized (select * from {lines}),
      cl as (select {group}, pixel_no, count(*) filter (where lat is not null and lon is not null) n, min(line_no) lo, max(line_no) hi from ln group by all),
      rf as (select {group}, list(pixel_no order by pixel_no) p, list(n order by pixel_no) nn, list(pixel_no order by pixel_no) filter (where n > 0) v, min(lo) lo, max(hi) hi, count(*) nc from cl group by {group}),
      rp as (select {group}, lo, hi, nc, case when nn[nc // 2 + 1] > 0 then p[nc // 2 + 1] else v[len(v) // 2 + 1] end pix from rf),
      tp as materialized (select ln.* from ln join rp on {on.format('ln', 'rp')} and ln.pixel_no = rp.pix where lat is not null and lon is not null),
      al as (select {group}, nc, unnest(range(lo, hi + 1)) line_no from rp),
      ax as (select {', '.join('al.' + c.strip() for c in group.split(','))}, al.nc, al.line_no, coalesce(case when b.line_no > a.line_no then a.lat + (b.lat - a.lat) * (al.line_no - a.line_no) / (b.line_no - a.line_no) else a.lat end, b.lat) lat,
        coalesce(case when b.line_no > a.line_no then a.lon + {short} * (al.line_no - a.line_no) / (b.line_no - a.line_no) else a.lon end, b.lon) lon
        from al asof left join tp a on {on.format('al', 'a')} and al.line_no >= a.line_no asof left join tp b on {on.format('al', 'b')} and al.line_no <= b.line_no),
      sp as (select *, coalesce({hav}, 0) step from ax where lat is not null window w as (partition by {group} order by line_no)),
      trk as materialized (select *, sum(step) over (partition by {group} order by line_no) km from sp),
      {_BOUNDS} as (select {group}, nc, max(km) total, coalesce(quantile_cont(step, 0.5) filter (where step > 0), 2e0) dx from trk group by all),
      reg as (select *, i * {length / 2}e0 s from (select *, unnest(range(0, greatest(cast(ceil((total - {length}e0 + 1e-9) / {length / 2}e0) as bigint), 1))) i from tot)),
      stt as (select {group}, dx, s from reg union all select {group}, dx, total - {length}e0 from reg group by {group}, dx, total having total - {length}e0 > max(s) + 1e-9),
      bd as (select {', '.join('stt.' + c.strip() for c in group.split(','))}, stt.dx, s, trk.nc, min(line_no) i0, max(line_no) + 1 i1, min(km) first_km, max(km) last_km from stt join trk on {on.format('stt', 'trk')} and trk.km >= s and trk.km <= s + {length}e0 group by all),
      sg as materialized (select *, row_number() over (partition by {group} order by s) - 1 segment_index, count(*) over (partition by {group}) n_total, cast(greatest(8, round_even({length}e0 / dx, 0)) as integer) n
        from (select *, row_number() over (partition by {group}, i1 order by s) r from bd where i1 - i0 >= 8) where r = 1),
      mem as materialized (select sg.*, ln.* exclude ({group}), trk.km from sg join ln on {on.format('sg', 'ln')} and ln.line_no >= sg.i0 and ln.line_no < sg.i1 join trk on {on.format('trk', 'ln')} and trk.line_no = ln.line_no)"""


def _swath_sql(lines, length, value, group="granule, swath", with_=""):
    """Spectra of the usable columns of every segment and their mean."""
    key = f"{group}, segment_index"
    on = " and ".join(f"{{0}}.{c.strip()} = {{1}}.{c.strip()}" for c in f"{key}, pixel_no".split(","))
    names = ", ".join("gr." + c.strip() for c in f"{key}, pixel_no".split(","))
    return f"""{_segments_sql(lines, length, group, with_)},
      cs as (select {key}, pixel_no, n, dx, nc, n_total, i0, i1, first_km, last_km, count({value}) valid, min(km) filter (where {value} is not null) x0, max(km) filter (where {value} is not null) x1,
        sum(lat) lat, count(lat) nlat, min(lat) la, max(lat) lb, sum(lon) lon, count(lon) nlon from mem group by all),
      us as (select *, coalesce(valid >= 75e-2 * (i1 - i0) and valid >= 8 and first_km + (n - 1) * dx <= last_km + greatest(10 * dx, {length / 100}e0) and x0 - first_km <= {length / 4}e0
        and first_km + (n - 1) * dx - x1 <= {length / 4}e0, false) ok from cs),
      sm as (select {key}, n_total, first_km, last_km, count(*) filter (where ok) n_pixels_used, sum(lat) / sum(nlat) lat_mean, sum(lon) / sum(nlon) lon_mean, sum(valid / cast(i1 - i0 as double)) / max(nc) valid_fraction,
        bool_or(ok and valid < i1 - i0) gap_filled from us group by all),
      gr as (select us.*, unnest(range(0, n)) j from us where ok),
      pt as materialized (select * from mem where {value} is not null),
      iv as (select {names}, gr.n, gr.dx, gr.j, coalesce(case when b.km > a.km then a.{value} + (b.{value} - a.{value}) * (gr.first_km + gr.j * gr.dx - a.km) / (b.km - a.km) else a.{value} end, b.{value}) x
        from gr asof left join pt a on {on.format('gr', 'a')} and gr.first_km + gr.j * gr.dx >= a.km asof left join pt b on {on.format('gr', 'b')} and gr.first_km + gr.j * gr.dx <= b.km),
      de as (select *, (x - avg(x) over w - regr_slope(x, j) over w * (j - avg(j) over w)) * (5e-1 - 5e-1 * cos(2 * pi() * j / n)) y from iv window w as (partition by {key}, pixel_no)),
      ft as (select {key}, pixel_no, n, dx, q ik, sum(y * cos(2 * pi() * j * q / n)) re, sum(y * sin(2 * pi() * j * q / n)) im from (select *, unnest(range(0, n // 2 + 1)) q from de) group by all),
      pm as (select {key}, cast(ik as integer) ik, ik / (n * dx) k, avg((re * re + im * im) * dx / (n * 375e-3) * (case when ik > 0 and ik < (n + 1) // 2 then 2 else 1 end)) psd from ft group by {key}, ik, n, dx)"""


_SW = f"""(select hh.granule, hh.pixel_no, line_no, latitude lat, longitude - 360e0 * floor(longitude / 360e0) lon, case when m < 0 then 'left' else 'right' end swath, ssh from hh
  join (select granule, pixel_no, median(cross_track_distance) m from hh group by 1, 2) using (granule, pixel_no) where m <> 0)"""
_SL = """(select sl.granule, sl.pixel_no, line_no, lat, lon, case when m < 0 then 'left' else 'right' end swath, slope * 1e6 slope, case when abs(lat) >= 2 then 981e-2 * slope / (2 * 7.2921150e-5 * sin(radians(lat))) end velocity from sl
  join (select granule, pixel_no, median(xt) m from sl group by 1, 2) using (granule, pixel_no) where m <> 0)"""
_PL = """(select label, case when c < 32 then 'left' else 'right' end swath, l line_no, c pixel_no, label * 9 - 40 + l * 25e-2 / 111 lat, label * 11e0 - 130 lon, case when not (c in (5, 40) and (label + l) % 3 > 0) then cast(embedding[c + 1] as double) end v
  from (select label, embedding, row_number() over (partition by label order by vec_id) - 1 l from embeddings), range(0, 64) r(c))"""


def _patch_sql():
    """Two-dimensional densities of the segments of the embeddings' swaths: usable columns resampled, the
    others from their neighbours, detrended along and centred across, tapered, transformed and shifted."""
    key = "label, swath, segment_index"
    one = _swath_sql(_PL, 4.0, "v", "label, swath")
    one = one[: one.index("de as (select")].replace("greatest(10 * dx, 0.04e0)", "dx")
    n2 = 32
    return f"""with {one}
      col as (select *, pixel_no % {n2} c from iv), good as (select distinct {key}, c from col), use as (select {key}, count(*) n_ok from good group by all having count(*) >= {n2 // 2}),
      al2 as (select sg.label, sg.swath, sg.segment_index, sg.n, sg.dx, c from sg join use using (label, swath, segment_index), range(0, {n2}) r(c)),
      nb as (select al2.*, a.c ca, b.c cb from al2 asof left join good a on a.label = al2.label and a.swath = al2.swath and a.segment_index = al2.segment_index and al2.c >= a.c
        asof left join good b on b.label = al2.label and b.swath = al2.swath and b.segment_index = al2.segment_index and al2.c <= b.c),
      fi as (select nb.label, nb.swath, nb.segment_index, nb.n, nb.dx, nb.c, a.j, case when ca is null then b.x when cb is null or cb = ca then a.x else a.x + (b.x - a.x) * (nb.c - ca) / cast(cb - ca as double) end x
        from nb join col a on a.label = nb.label and a.swath = nb.swath and a.segment_index = nb.segment_index and a.c = coalesce(ca, cb) join col b on b.label = nb.label and b.swath = nb.swath and b.segment_index = nb.segment_index and b.c = coalesce(cb, ca) and b.j = a.j),
      d1 as (select *, x - avg(x) over w - regr_slope(x, j) over w * (j - avg(j) over w) y from fi window w as (partition by {key}, c)),
      d2 as (select *, (y - avg(y) over (partition by {key}, j)) * (5e-1 - 5e-1 * cos(2 * pi() * j / n)) * (5e-1 - 5e-1 * cos(2 * pi() * c / {n2}e0)) z from d1),
      f1 as (select {key}, n, dx, j, q qy, sum(z * cos(2 * pi() * c * q / {n2}e0)) re, -sum(z * sin(2 * pi() * c * q / {n2}e0)) im from d2, range(0, {n2}) r(q) group by all),
      f2 as (select {key}, n, dx, qy, qx, sum(re * cos(2 * pi() * j * qx / n) + im * sin(2 * pi() * j * qx / n)) re, sum(im * cos(2 * pi() * j * qx / n) - re * sin(2 * pi() * j * qx / n)) im
        from (select *, unnest(range(0, n)) qx from f1) group by all),
      p2 as (select {key}, cast((qx + n // 2) % n as integer) ix, cast((qy + {n2 // 2}) % {n2} as integer) iy, (re * re + im * im) * dx * 25e-2 / (n * {n2}) / (375e-3 * 375e-3) power,
        (case when qx < (n + 1) // 2 then qx else qx - n end) / (n * dx) kx, (case when qy < {n2 // 2} then qy else qy - {n2} end) / ({n2} * 25e-2) ky from f2),
      s2 as (select {key}, n_total, valid_fraction, n_ok n_columns_used, n_ok < {n2} or valid_fraction < 1 - 1e-12 gap_filled from sm join use using (label, swath, segment_index))"""


_TAPS = dsp.hamming(9)
_H9 = "(" + " + ".join(f"{float(w)!r} * cos(2 * pi() * 2 * {i} * k)" for i, w in enumerate(_TAPS)) + ")", "(" + " + ".join(f"{float(w)!r} * sin(2 * pi() * 2 * {i} * k)" for i, w in enumerate(_TAPS)) + ")"
_T5 = dsp.hamming(5)
_H5 = "pow(" + " + ".join(f"{float(w)!r} * cos(4 * pi() * {i} * kf)" for i, w in enumerate(_T5)) + ", 2) + pow(" + " + ".join(f"{float(w)!r} * sin(4 * pi() * {i} * kf)" for i, w in enumerate(_T5)) + ", 2)"

_PLA = f"(select * replace (case when not ((label % 4 = 1 and line_no between 20 and 25) or (label % 4 = 2 and (line_no * 7 + pixel_no * 13) % 4 = 0)) then v end as v) from {_PL})"
_R, _N1, _N2 = 32, 16, 8


def _alias_segments_sql(targets=None):
    """Alias spectra of every segment of rows: gates, fill, plane, transform, fold."""
    track = _segments_sql(_PLA, 8.0, "label, swath")
    track = track[: track.index(f"{_BOUNDS} as (select")].rstrip().rstrip(",")
    key = "label, swath, segment_index"
    if targets is None:
        segs = f"""nr as (select label, swath, min(line_no) lo, count(*) n from trk group by all),
      sg as (select *, row_number() over (partition by label, swath order by i0) - 1 segment_index from
        (select distinct label, swath, lo + i0 i0 from (select *, unnest(range(0, n - {_R} + 1, {_R // 2})) i0 from nr where n >= {_R} union all select *, n - {_R} from nr where n >= {_R})))"""
    else:
        rows = ", ".join(f"('{w}', {float(v)!r}::double, {i})" for w, vs in targets.items() for i, v in enumerate(vs))
        segs = f"""tg(swath, target, no) as (values {rows}), ce as (select label, swath, target, no, arg_min(line_no, (abs(lat - target), line_no)) c from trk join tg using (swath) group by all),
      nr as (select label, swath, min(line_no) lo, count(*) n from trk group by all),
      sg as (select label, swath, c - {_R // 2} i0, row_number() over (partition by label, swath order by no) - 1 segment_index from ce join nr using (label, swath) where c - {_R // 2} >= lo and c + {_R // 2} <= lo + n)"""
    fill = ref_series._ends("c0", "c", f"{key}, r", "c", "v"), ref_series._ends("r1", "r", f"{key}, c", "r", "v").replace("br as", "br2 as")
    blend = ref_series._BLEND
    h = [_h(32, 9, n) for n in ("h1", "h2")]
    return f"""with {track}, {segs},
      me as (select {key}, min(km) first_km, max(km) last_km, count(*) n_lines from sg join trk using (label, swath) where line_no >= i0 and line_no < i0 + {_R} group by all),
      po as (select {key}, avg(lat) lat_mean, min(lat) lat_min, max(lat) lat_max, avg(lon) lon_mean from sg join ln using (label, swath) where line_no >= i0 and line_no < i0 + {_R} group by all),
      c0 as materialized (select sg.label, sg.swath, segment_index, line_no - i0 r, pixel_no % 32 c, v from sg join ln using (label, swath) where line_no >= i0 and line_no < i0 + {_R}),
      rw as (select {key}, r, avg(case when v is null then 1e0 else 0e0 end) > 5e-1 bad from c0 group by all),
      gp as (select {key}, max(len) / {_R}e0 gap from (select {key}, g, count(*) len from (select *, r - row_number() over (partition by {key} order by r) g from rw where bad) group by all) group by all),
      ju as materialized (select *, case when valid_fraction < 85e-2 then 'nan_fraction' when gap_fraction > 1e-1 then 'gap' else 'used' end reason from
        (select {key}, avg(case when v is null then 0e0 else 1e0 end) valid_fraction, max(coalesce(gap, 0e0)) gap_fraction from c0 left join gp using ({key}) group by {key})),
      {fill[0]}, r1 as (select {key}, r, c, coalesce({blend.format(y='v', x='c')}, py, ny) v from br),
      {fill[1]}, fi as (select {key}, r, c, coalesce({blend.format(y='v', x='r')}, py, ny) v from br2 join ju using ({key}) where reason = 'used'),
      pl as (select {key}, r, c, (v - avg(v) over w - regr_slope(v, r) over w * (r - avg(r) over w) - regr_slope(v, c) over w * (c - avg(c) over w)) * (5e-1 - 5e-1 * cos(2 * pi() * r / 31e0)) * (5e-1 - 5e-1 * cos(2 * pi() * c / 31e0)) v from fi window w as (partition by {key})),
      f1 as (select {key}, r, k i2, sum(v * cos(2 * pi() * c * k / 32e0)) re, -sum(v * sin(2 * pi() * c * k / 32e0)) im from pl, range(0, 32) q(k) group by all),
      f2 as (select {key}, k i1, i2, sum(re * cos(2 * pi() * r * k / 32e0) + im * sin(2 * pi() * r * k / 32e0)) re, sum(im * cos(2 * pi() * r * k / 32e0) - re * sin(2 * pi() * r * k / 32e0)) im from f1, range(0, 32) q(k) group by all),
      {h[0]}, {h[1]}, fo as (select {key}, i1 % {_N1} p, sum(f) t, sum(case when i1 < {_N1} and i2 < {_N2} then f else 0 end) d from
        (select {key}, i1, i2, (re * re + im * im) * {0.0625 / 1024 / float(np.mean(np.multiply.outer(dsp.hann(32, False), dsp.hann(32, False)) ** 2))!r}e0 * h1.h * h2.h / 8e0 f from f2 join h1 on h1.i = i1 join h2 on h2.i = i2) group by all),
      asp as materialized (select {key}, cast(p as integer) ik, p / 8e0 k, d * m direct, greatest(t - d, 0) * m aliased, t * m total from (select *, case when p > 0 then 2 else 1 end m from fo where p < {_N1 // 2}))"""


_SMETA = "round(first_km, 4) + 0e0 first_km, round(last_km, 4) + 0e0 last_km, round(lat_mean, 4) + 0e0 lat_mean, round(lon_mean, 4) + 0e0 lon_mean, round(valid_fraction, 4) + 0e0 valid_fraction"
_K8 = significant_sql("round(k, 6) + 0e0")

_SQL = {
    "swath_spectra": f"""with {_swath_sql(_SW, 100.0, "ssh", with_=EXP + ", ")} select granule, swath, cast(segment_index as integer) segment_index, n_total, n_pixels_used, gap_filled, {_SMETA}, ik, {_K8} k, round(psd * 1e4, 4) + 0e0 psd
      from pm join sm using (granule, swath, segment_index)""",
    "swath_pass_mean": f"""with {_swath_sql(_SW, 100.0, "ssh", with_=EXP + ", ")} select granule, swath, count(*) n_segments_used, max(n_total) n_segments_total, ik, round(avg(psd) * 1e4, 4) + 0e0 psd
      from pm join sm using (granule, swath, segment_index) group by granule, swath, ik""",
    "slope_spectra": f"""with {_swath_sql(_SL, 100.0, "slope", with_=ref_series._SLOPE + ", ")} select granule, swath, cast(segment_index as integer) segment_index, n_pixels_used, ik, round(psd, 4) + 0e0 psd
      from pm join sm using (granule, swath, segment_index)""",
    "slope_segments": f"""with {_segments_sql(_SL, 100.0, with_=ref_series._SLOPE + ", ")},
      cs as (select granule, swath, segment_index, first_km, last_km, nc, i0, i1, pixel_no, count(slope) valid from mem group by all),
      us as (select *, valid >= 75e-2 * (i1 - i0) and valid >= 3 ok from cs),
      sm as (select granule, swath, segment_index, first_km, last_km, count(*) filter (where ok) n_pixels_used, sum(valid / cast(i1 - i0 as double)) / max(nc) valid_fraction from us group by all having count(*) filter (where ok) >= 1),
      al3 as (select granule, swath, segment_index, avg(lat) lat_mean, min(lat) lat_min, max(lat) lat_max, avg(lon) lon_mean from mem group by all),
      mo as (select granule, swath, segment_index, avg(slope) slope_mean, sqrt(avg(slope * slope)) slope_rms, var_pop(slope) slope_variance, sqrt(avg(velocity * velocity)) velocity_rms from mem join us using (granule, swath, segment_index, pixel_no) where ok and slope is not null group by all)
      select granule, swath, cast(segment_index as integer) segment_index, n_pixels_used, {_SMETA}, round(lat_min, 4) + 0e0 lat_min, round(lat_max, 4) + 0e0 lat_max, round(slope_mean, 4) + 0e0 slope_mean, round(slope_rms, 4) + 0e0 slope_rms,
      round(slope_variance, 4) + 0e0 slope_variance, round(velocity_rms, 4) + 0e0 velocity_rms from sm join al3 using (granule, swath, segment_index) join mo using (granule, swath, segment_index)""",
    "alias_swath": f"{_alias_segments_sql()} select label, swath, cast(segment_index as integer) segment_index, ik, k, round(direct, 6) + 0e0 direct, round(aliased, 6) + 0e0 aliased, round(total, 6) + 0e0 total from asp",
    "alias_targets": f"{_alias_segments_sql(TARGETS)} select label, swath, cast(segment_index as integer) segment_index, ik, k, round(direct, 6) + 0e0 direct, round(aliased, 6) + 0e0 aliased, round(total, 6) + 0e0 total from asp",
    "alias_segments": f"""{_alias_segments_sql()} select label, swath, cast(segment_index as integer) segment_index, reason, n_lines, 32 n_pixels, valid_fraction < 1 gap_filled, round(first_km, 6) + 0e0 first_km, round(last_km, 6) + 0e0 last_km, round(lat_mean, 6) + 0e0 lat_mean,
      round(lat_min, 6) + 0e0 lat_min, round(lat_max, 6) + 0e0 lat_max, round(lon_mean, 6) + 0e0 lon_mean, round(valid_fraction, 6) + 0e0 valid_fraction, round(gap_fraction, 6) + 0e0 gap_fraction from me join po using (label, swath, segment_index) join ju using (label, swath, segment_index)""",
    "alias_pass_mean": f"{_alias_segments_sql()} select label, swath, ik, k, count(*) n_segments, round(avg(direct), 6) + 0e0 direct, round(avg(aliased), 6) + 0e0 aliased, round(avg(direct) + avg(aliased), 6) + 0e0 total from asp group by label, swath, ik, k",
    "alias_counters": f"{_alias_segments_sql()} select label, swath, count(*) total, count(*) filter (where reason = 'used') used, count(*) filter (where reason = 'nan_fraction') nan_fraction, count(*) filter (where reason = 'gap') gap, cast(0 as bigint) fill_failed, cast(0 as bigint) decompose_failed from ju group by all",
    "box_three_psd": f"""{_alias_segments_sql()}, bx as (select asp.*, cast(floor(lat_mean / 2e1) as integer) ilat, cast(floor(lon_mean / 2e1) as integer) ilon from asp join po using (label, swath, segment_index))
      select ilat, ilon, count(*) n_segments, ik, round(avg(direct), 6) + 0e0 mean_direct, round(avg(aliased), 6) + 0e0 mean_aliased, round(avg(total), 6) + 0e0 mean_total from bx group by ilat, ilon, ik having count(*) >= 2""",
    "aliased_fraction": f"""{_alias_segments_sql()}, tz as (select label, swath, segment_index, (aliased + lag(aliased) over w) / 2 * (k - lag(k) over w) a, (direct + lag(direct) over w) / 2 * (k - lag(k) over w) b from asp where k between 0.1 and 0.9 window w as (partition by label, swath, segment_index order by k))
      select label, swath, cast(segment_index as integer) segment_index, round(sum(a) / nullif(sum(a) + sum(b), 0), 6) + 0e0 aliased_fraction from tz group by 1, 2, 3""",
    "cross_track_spectrum": f"""with ln as (select * from {_PL}), ra as (select label, swath, min(line_no) lo, greatest(max(line_no) - min(line_no) + 1 - 20, 0) room from ln group by 1, 2),
      rt as (select label, swath, line_no, count(*) t from ln join ra using (label, swath), range(0, 3) c(i) where pixel_no % 32 = 0 and line_no - lo >= floor(i * room / 2e0 + 1e-9) and line_no - lo < floor(i * room / 2e0 + 1e-9) + 20 group by 1, 2, 3),
      cc as (select label, swath, line_no, t, pixel_no % 32 c, v, count(v) over (partition by label, swath, line_no) / 32e0 share from ln join rt using (label, swath, line_no)), ok as (select * from cc where share >= 9e-1),
      {ref_series._ends("ok", "c", "label, swath, line_no", "c", "v")}, fi as (select label, swath, line_no, t, c, coalesce({ref_series._BLEND.format(y="v", x="c")}, py, ny) v from br),
      de as (select *, (v - avg(v) over (partition by label, swath, line_no)) * (5e-1 - 5e-1 * cos(2 * pi() * c / 32e0)) y from fi),
      ft as (select label, swath, line_no, t, q ik, sum(y * cos(2 * pi() * c * q / 32e0)) re, sum(y * sin(2 * pi() * c * q / 32e0)) im from de, range(0, 17) r(q) group by all)
      select label, swath, cast(ik as integer) ik, ik / 8e0 k, cast(sum(t) as bigint) n_rows, round(sum(t * (re * re + im * im) * 25e-2 / (32 * 375e-3) * (case when ik > 0 and ik < 16 then 2 else 1 end)) / sum(t), 6) + 0e0 psd from ft group by label, swath, ik""",
    "explicit_spectrum": f"""with ln as (select *, row_number() over (partition by label, swath, pixel_no order by line_no) - 1 idx from {_PL}), {ref_series._ends("ln", "idx", "label, swath, pixel_no", "idx", "v")},
      fi as (select label, swath, pixel_no, idx, {ref_series._BLEND.format(y="v", x="idx")} v from br), pr as (select *, avg(case when v is null then 0e0 else 1e0 end) over p share, count(*) over p n from fi window p as (partition by label, swath, pixel_no)),
      sg as (select label, swath, pixel_no, i0, idx - i0 j, v, count(v) over (partition by label, swath, pixel_no, i0) / 16e0 f from pr, range(0, 10000, 8) r(i0) where share >= 8e-1 and i0 + 16 <= n and idx >= i0 and idx < i0 + 16),
      g9 as (select * from sg where f >= 9e-1), {ref_series._ends("g9", "j", "label, swath, pixel_no, i0", "j", "v").replace("br as", "br3 as")}, f3 as (select label, swath, pixel_no, i0, j, coalesce({ref_series._BLEND.format(y="v", x="j")}, py, ny) v from br3),
      de as (select *, (v - avg(v) over w - regr_slope(v, j) over w * (j - avg(j) over w)) * (5e-1 - 5e-1 * cos(2 * pi() * j / 16e0)) y from f3 window w as (partition by label, swath, pixel_no, i0)),
      ft as (select label, swath, pixel_no, i0, q ik, sum(y * cos(2 * pi() * j * q / 16e0)) re, sum(y * sin(2 * pi() * j * q / 16e0)) im from de, range(0, 9) r(q) group by all),
      tr as (select label, swath, pixel_no, ik, avg((re * re + im * im) / (6 / 25e-2)) p from ft group by all)
      select label, swath, cast(ik as integer) ik, ik / 4e0 k, count(*) n_tracks, round(avg(p), 6) + 0e0 mean, round(stddev_pop(p) / sqrt(count(*)), 6) + 0e0 error from tr group by label, swath, ik""",
    "track_spectrum": f"""with {ref_series._FULL}, tk as materialized (select granule, pixel_no, n, row_number() over (partition by granule, pixel_no order by idx) - 1 j, ssh from ok where pixel_no % 2 = 0 and n > 1),
      de as (select *, (ssh - avg(ssh) over w - regr_slope(ssh, j) over w * (j - avg(j) over w)) * (5e-1 - 5e-1 * cos(2 * pi() * j / (n - 1))) y from tk window w as (partition by granule, pixel_no)),
      ft as (select granule, pixel_no, n, q ik, sum(y * cos(2 * pi() * ((j * q) % n) / n)) re, sum(y * sin(2 * pi() * ((j * q) % n) / n)) im from (select *, unnest(range(1, n // 2 + 1)) q from de) group by all)
      select granule, pixel_no, cast(ik as integer) ik, {significant_sql("round(ik / (n * 2e0), 6) + 0e0")} k, round((re * re + im * im) * 2 / n * 1e4, 4) + 0e0 psd from ft""",
    "emulated_spectra": f"""with ln as (select label, swath, line_no l, pixel_no p, coalesce(v, 0) v from {_PL}), nn as (select label, max(l) + 1 n from ln group by 1), tp(o, w) as (values {ref_series._taps_sql(9)}),
      de0 as (select x.label, x.swath, x.l, x.p, sum(a.w * b.w * y.v) v from ln x join nn on nn.label = x.label join tp a on true join tp b on true join ln y on y.label = x.label and y.swath = x.swath and y.l = x.l + a.o and y.p = x.p + b.o
        where x.l >= 9 and x.l < n - 9 and (x.l - 9) % 2 = 0 and x.p % 32 >= 9 and x.p % 32 < 23 and (x.p % 32 - 9) % 2 = 0 group by 1, 2, 3, 4),
      tk as (select label, swath, p, row_number() over (partition by label, swath, p order by l) - 1 j, count(*) over (partition by label, swath, p) n, v from de0),
      de as (select *, (v - avg(v) over w - regr_slope(v, j) over w * (j - avg(j) over w)) * (5e-1 - 5e-1 * cos(2 * pi() * j / n)) y from tk window w as (partition by label, swath, p)),
      ft as (select label, swath, p, n, q ik, sum(y * cos(2 * pi() * j * q / n)) re, sum(y * sin(2 * pi() * j * q / n)) im from (select *, unnest(range(0, n // 2 + 1)) q from de) group by all)
      select label, swath, cast(ik as integer) ik, count(*) n, round(avg((re * re + im * im) * 5e-1 / (n * 375e-3) * (case when ik > 0 and ik < (n + 1) // 2 then 2 else 1 end)), 6) + 0e0 psd from ft group by label, swath, ik""",
    "alias_only": f"""with {ref_stats.G}, f as (select segment_id, k, m, abs(k + m * 0.124e0) kf from g, (values (-2), (-1), (1), (2)) r(m) where k <= 0.06), br as (select f.segment_id, f.k, f.m, f.kf, max(case when g.k <= f.kf then (g.k, g.psd) end) lo, min(case when g.k >= f.kf then (g.k, g.psd) end) hi
        from f join g using (segment_id) group by 1, 2, 3, 4)
        select segment_id, k, round(sum((case when lo is null or hi is null then 0 when lo[1] = kf then lo[2] else lo[2] + (hi[2] - lo[2]) * (kf - lo[1]) / (hi[1] - lo[1]) end) * ({_H5})), 6) + 0e0 aliased from br group by 1, 2""",
    "alias_ratio": f"""with {ref_stats.G}, m as (select granule, swath, ik, max(k) k, avg(psd) psd from g group by 1, 2, 3), l as (select granule, k, psd * ({_H5.replace("kf", "k")}) psd from m where swath = 'left' and k <= 0.1), r as (select * from m where swath = 'right'),
        br as (select l.granule, l.k, l.psd, max(case when r.k <= l.k then (r.k, r.psd) end) lo, min(case when r.k >= l.k then (r.k, r.psd) end) hi from l join r using (granule) group by 1, 2, 3)
        select granule, k, round((case when lo is null then hi[2] when hi is null or lo[1] = k then lo[2] else lo[2] + (hi[2] - lo[2]) * (k - lo[1]) / (hi[1] - lo[1]) end) / psd, 6) + 0e0 ratio from br
        union all select granule, k, null from l where granule not in (select granule from r)""",
    "swath_spectra_2d": f"""{_patch_sql()} select label, swath, cast(segment_index as integer) segment_index, n_columns_used, gap_filled, round(valid_fraction, 6) + 0e0 valid_fraction, ix, iy, round(kx, 6) + 0e0 kx, round(ky, 6) + 0e0 ky, round(power, 6) + 0e0 power
      from p2 join s2 using (label, swath, segment_index)""",
    "pass_spectra_2d": f"""{_patch_sql()} select label, swath, ix, iy, count(*) n_segments_used, max(n_total) n_segments_total, round(min(kx), 6) + 0e0 kx, round(min(ky), 6) + 0e0 ky, round(avg(power), 6) + 0e0 power
      from p2 join s2 using (label, swath, segment_index) group by label, swath, ix, iy""",
    "alias_drop_counters": f"""with e0 as (select label, row_number() over (partition by label order by vec_id) - 1 g, embedding from embeddings), e1 as (select label, g // {ROWS} patch, g % {ROWS} r from e0),
      c as (select label, patch, r, ((r * 7 + j * 13 + patch) % 11 = 0) or (patch % 5 = 1 and r between 4 and 5 + label % 3) gone from e1, range(0, {COLS}) q(j)),
      m as (select label, patch, avg(case when gone then 1e0 else 0e0 end) missing, count(distinct r) n from c group by 1, 2),
      b as (select label, patch, r from c group by 1, 2, 3 having avg(case when gone then 1e0 else 0e0 end) > 5e-1),
      i as (select label, patch, count(*) len from (select *, r - row_number() over (partition by label, patch order by r) g from b) group by label, patch, g),
      l as (select label, patch, max(len) len from i group by 1, 2)
      select case when missing > 0.2 then 'nan_fraction' when coalesce(len, 0) / cast(n as double) > 0.1 then 'gap' else 'used' end reason, count(*) n from m left join l using (label, patch) group by 1""",
    "segment_pairs": f"""with {SEG}, o as (select granule, segment_index, swath, avg(valid_fraction) v, count(*) n from seg group by 1, 2, 3)
      select a.granule, a.segment_index, round(a.v - b.v, 6) + 0e0 difference, a.n n_a, b.n n_b from o a join o b on a.granule = b.granule and a.segment_index = b.segment_index and a.swath = 'left' and b.swath = 'right'""",
    "periodogram_1d": f"with {_X}, {_dft(64, 'periodic', 'linear', _S64, True)} select id vec_id, ik, round(psd, 6) + 0e0 psd from pw",
    "periodogram_arrow": f"with {_X}, {_dft(64, 'periodic', 'linear', _S64, True)} select id vec_id, ik, round(psd, 6) + 0e0 psd from pw",
    "periodogram_undoubled": f"with {_X}, {_dft(64, 'periodic', 'linear', _S64, False)} select id vec_id, ik, round(psd, 6) + 0e0 psd from pw",
    "periodogram_raw": f"with {_X}, {_dft(64, 'symmetric', 'linear', 1.0, False)} select id vec_id, ik, round(psd, 6) + 0e0 psd from pw",
    "welch": f"""with x as ({_X[6:-1]}), v as (select id * 10 + s id, i - s * 16 i, x from x, range(0, 3) q(s) where i >= s * 16 and i < s * 16 + 32), {_dft(32, 'periodic', 'constant', _S32, True)}
      select id // 10 vec_id, ik, round(avg(psd), 6) + 0e0 psd from pw group by 1, 2""",
    "periodogram_2d": f"with {_P2} select label, patch, i1, i2, round(power, 6) + 0e0 power from pw",
    "alias_decompose": _alias_sql(f"i1 < {ROWS // 2} and i2 < {COLS // 4}"),
    "alias_decompose_centred": _alias_sql(f"(i1 < {ROWS // 4} or i1 >= {ROWS - ROWS // 4}) and (i2 < {COLS // 8} or i2 >= {COLS - COLS // 8})"),
    "predict_no_alias": f"""with {_P2}, {_h(ROWS, 9, 'h1')}, {_h(COLS, 9, 'h2')}, s as (select label, patch, i1, sum(power * h1.h * h2.h) / {COLS * 0.25!r} psd from pw join h1 on h1.i = i1 join h2 on h2.i = i2 group by 1, 2, 3)
      select label, patch, k, round(case when k > 0 then 2 * psd else psd end, 6) + 0e0 psd from (select *, (case when i1 < {(ROWS + 1) // 2} then i1 else i1 - {ROWS} end) / {ROWS * 0.25!r} k from s) where k >= 0""",
    "sector_energy": f"""with {_P2}, q as (select *, abs((case when i1 < {ROWS // 2} then i1 else i1 - {ROWS} end) / {ROWS * 0.25!r}) kx, abs((case when i2 < {COLS // 2} then i2 else i2 - {COLS} end) / {COLS * 0.25!r}) ky from pw)
      select label, patch, round(sum(case when ky < 0.5 * kx then power end), 6) + 0e0 along, round(sum(case when kx < 0.5 * ky then power end), 6) + 0e0 across from q group by 1, 2""",
    "predict_psd": f"""with {ref_stats.G}, f as (select segment_id, k, k + n * 0.124e0 kf from g, range(0, 2) r(n) where k <= 0.06), br as (select f.segment_id, f.k, f.kf, max(case when g.k <= f.kf then (g.k, g.psd) end) lo, min(case when g.k >= f.kf then (g.k, g.psd) end) hi
        from f join g using (segment_id) group by 1, 2, 3)
        select segment_id, k, round(sum((case when lo is null or hi is null then 0 when lo[1] = kf then lo[2] else lo[2] + (hi[2] - lo[2]) * (kf - lo[1]) / (hi[1] - lo[1]) end) * ({_H5})), 6) + 0e0 predicted from br group by 1, 2""",
    "transfer_function": f"with {ref_stats.G} select segment_id, ik, round(psd * ({_H9[0]} * {_H9[0]} + {_H9[1]} * {_H9[1]}), 6) + 0e0 filtered from g where ik > 0",
    "rejects": f"""with {ref_stats.G}, m as (select granule, max(case when trim(error) <> '' then error end) error from granule_manifest group by 1)
        select granule, 'read' stage, error from m where error is not null union all select granule, 'spectra', 'no usable segment' from m where error is null and granule not in (select granule from g)""",
}
ORACLE = tie_free({name: significant_sql(sql) if name in ("predict_psd", "transfer_function", "alias_only", "alias_ratio") else sql for name, sql in _SQL.items()})
