"""Spectra of swaths and patches, alias decomposition and prediction.

A group that is gathered for a transform is a segment or a patch, whose size is a parameter; it
never grows with the data.  Folding and averaging stay relational.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from tidemark.functions import dsp
from tidemark.operators import tracks


def _segment_udf(gap: float, length: float, detrend: str | None):
    """Arrow UDF: the km and values of one column of one segment to a periodogram on the uniform grid.

    Null where the grid runs past the segment, the column has under 1 - gap of its values or under 8,
    or either end is missing by more than gap * length.
    """

    def run(first: pd.Series, last: pd.Series, lines: pd.Series, dx: pd.Series, km: pd.Series, value: pd.Series) -> pd.Series:
        out = np.empty(len(km), dtype=object)
        ready: dict[tuple[int, float], list[tuple[int, np.ndarray]]] = {}
        for i, (s, e, m, d, x, y) in enumerate(zip(first, last, lines, dx, km, value)):
            n = max(8, round(length / d))
            grid = s + d * np.arange(n)
            if x is None or len(x) < 8 or len(x) < (1 - gap) * m or grid[-1] > e + max(10 * d, 0.01 * length):
                continue
            if x[0] - s > gap * length or grid[-1] - x[-1] > gap * length:
                continue
            ready.setdefault((n, d), []).append((i, np.interp(grid, x, y)))
        for (_, d), rows in ready.items():
            for (i, _), p in zip(rows, dsp.periodograms(np.stack([r for _, r in rows]), d, detrend)):
                out[i] = p
        return pd.Series(out, index=km.index)

    return F.pandas_udf(run, ArrayType(DoubleType()))


def swath_members(lines: DataFrame, group: list[str], pixel: str, order: str, values: list[str], length: float, dx: float | None, overlap: float) -> DataFrame:
    """Every row with each segment of its swath that holds it (``segment_axis``); other columns go."""
    lines = lines.select(*group, pixel, order, "lat", "lon", *values)
    axis = tracks.segment_axis(lines, group, pixel, order, "lat", "lon", length, overlap, dx)
    m = lines.join(axis, [*group, order]).withColumn("_s", F.explode("segments")).drop("segments")
    return m.select("*", "_s.*").drop("_s")


SEGMENT = ["segment_index", "i0", "i1", "first_km", "last_km", "dx", "n_columns", "n_total"]


def _where(n_rows: str = "i1 - i0") -> list:
    """Position of a segment and its share of valid values, from sums of its columns: the share is the
    mean over all columns of the swath, lines and columns that are absent count as missing."""
    return [
        (F.sum("lat") / F.sum("n_lat")).alias("lat_mean"), F.min("lat_min").alias("lat_min"), F.max("lat_max").alias("lat_max"), (F.sum("lon") / F.sum("n_lon")).alias("lon_mean"),
        (F.sum(F.col("valid") / F.expr(n_rows)) / F.max("n_columns")).alias("valid_fraction"),
    ]


def _column_sums(value: str, x: str) -> list:
    ok = F.col(value).isNotNull()
    return [
        F.count_if(ok).alias("valid"), F.sort_array(F.collect_list(F.when(ok, F.struct(F.col(x).alias("x"), F.col(value).alias("y"))))).alias("p"),
        F.sum("lat").alias("lat"), F.count("lat").alias("n_lat"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.sum("lon").alias("lon"), F.count("lon").alias("n_lon"),
    ]


def swath_spectra(lines: DataFrame, group: list[str], pixel: str, order: str, value: str, length: float, dx: float | None = None, overlap: float = 0.0, gap: float = 0.25, detrend: str | None = "linear", min_pixels: int = 3) -> DataFrame:
    """(group, segment_index, first_km, last_km, n_total, wavenumber, psd, n_pixels_used, lat_mean,
    lat_min, lat_max, lon_mean, valid_fraction, gap_filled): mean spectrum of the usable columns of
    every segment of a swath.

    ``lines`` has lat, lon and ``value`` per line and pixel.  A segment needs ``min_pixels`` usable
    columns; without ``dx`` the spacing is the swath's own median.  n_total counts the swath's
    segments, used or not.
    """
    m = swath_members(lines, group, pixel, order, [value], length, dx, overlap)
    column = m.groupBy(*group, *SEGMENT, pixel).agg(*_column_sums(value, "km"))
    udf = _segment_udf(gap, length, detrend)
    column = column.withColumn("psd", udf("first_km", "last_km", (F.col("i1") - F.col("i0")).cast("int"), "dx", F.col("p.x"), F.col("p.y")))
    # a segment has as many spectra as the swath has pixels
    out = column.groupBy(*group, *SEGMENT).agg(
        F.collect_list("psd").alias("all"), F.count("psd").cast("int").alias("n_pixels_used"), *_where(),
        F.coalesce(F.bool_or(F.col("psd").isNotNull() & (F.col("valid") < F.col("i1") - F.col("i0"))), F.lit(False)).alias("gap_filled"),
    ).where(F.col("n_pixels_used") >= min_pixels)
    bins = F.sequence(F.lit(0), (F.size(F.get("all", F.lit(0))) - 1).cast("int"))
    mean = F.transform(bins, lambda i: F.aggregate("all", F.lit(0.0), lambda s, v: s + F.get(v, i)) / F.col("n_pixels_used"))
    n = F.greatest(F.lit(8), F.bround(F.lit(float(length)) / F.col("dx")).cast("int"))
    out = out.withColumn("psd", mean).withColumn("wavenumber", F.transform(bins, lambda i: i / (n * F.col("dx"))))
    return out.drop("all", "i0", "i1", "n_columns")


def _patch_udf(gap: float, column_gap: float, length: float, detrend: str | None, across: bool):
    """Arrow UDF: the columns of one segment (pixel, km, values) to the shifted two-dimensional density,
    row by row, with the number of usable columns and whether anything was filled."""
    kind = StructType([StructField("power", ArrayType(DoubleType())), StructField("rows", IntegerType()), StructField("n_columns_used", IntegerType()), StructField("gap_filled", BooleanType())])

    def run(first: pd.Series, last: pd.Series, lines: pd.Series, dx: pd.Series, dy: pd.Series, order: pd.Series, columns: pd.Series) -> pd.DataFrame:
        out = []
        for s, e, m, d, d2, pixels, cols in zip(first, last, lines, dx, dy, order, columns):
            n, width = max(8, round(length / d)), len(pixels)
            grid, at = s + d * np.arange(n), {p: i for i, p in enumerate(pixels)}
            field = np.full((n, width), np.nan)
            whole = len(cols) == width
            for c in cols:
                x = np.array([v["x"] for v in c["p"]])
                whole &= len(x) == m
                if len(x) < 8 or len(x) < (1 - gap) * m or x[0] - s > gap * length or grid[-1] - x[-1] > gap * length:
                    continue
                field[:, at[c["pixel"]]] = np.interp(grid, x, [v["y"] for v in c["p"]])
            ok = ~np.isnan(field).all(axis=0)
            if m < 8 or grid[-1] > e + d or ok.sum() < max(1, int(np.ceil((1 - column_gap) * width))):
                out.append((None, None, None, None))
                continue
            if not ok.all():  # missing columns, from their neighbours across the track, the end ones as their nearest
                i = np.arange(width)
                hi = np.clip(np.searchsorted(i[ok], i), 1, max(1, ok.sum() - 1))
                a, b = i[ok][hi - 1], i[ok][np.minimum(hi, ok.sum() - 1)]
                t = np.clip((i - a) / np.maximum(b - a, 1), 0, 1)
                field = np.where(ok, field, field[:, a] * (1 - t) + field[:, b] * t)
            if detrend:
                field = dsp._detrended(field.T, detrend).T
            if across:
                field = field - field.mean(axis=1, keepdims=True)
            w1, w2 = dsp.hann(n), dsp.hann(width)
            p = np.abs(np.fft.fft2(field * np.multiply.outer(w1, w2))) ** 2 * d * d2 / (n * width) / (np.mean(w1**2) * np.mean(w2**2))
            out.append((np.fft.fftshift(p).ravel(), n, int(ok.sum()), bool(not whole or not ok.all())))
        return pd.DataFrame(out, columns=["power", "rows", "n_columns_used", "gap_filled"])

    return F.pandas_udf(run, kind)


def swath_spectra_2d(lines: DataFrame, group: list[str], pixel: str, order: str, value: str, length: float, dx: float | None = None, dy: float | None = None, overlap: float = 0.0, gap: float = 0.25, column_gap: float = 0.5, detrend: str | None = "linear", across: bool = True) -> DataFrame:
    """(group, segment_index, first_km, last_km, n_total, n_columns_used, n_columns, dx, dy, lat_mean,
    lat_min, lat_max, lon_mean, valid_fraction, gap_filled, wavenumber_x, wavenumber_y, psd_2d):
    two-dimensional density of every segment of a swath, both axes ascending.

    ``lines`` has lat, lon, xt (km across the track) and ``value``.  Columns stand in the order of
    their median xt, its median step is the spacing unless ``dy`` is given.  A column that is not
    usable along the track (``swath_spectra``) is interpolated from its neighbours across it, a
    segment with more than ``column_gap`` of such columns drops out.  What is gathered is one segment
    of one swath, whose size is a parameter.
    """
    m = swath_members(lines, group, pixel, order, [value], length, dx, overlap)
    column = m.groupBy(*group, *SEGMENT, pixel).agg(*_column_sums(value, "km"))
    segment = column.groupBy(*group, *SEGMENT).agg(F.collect_list(F.struct(F.col(pixel).alias("pixel"), "p")).alias("columns"), *_where())
    place = lines.groupBy(*group, pixel).agg(F.percentile("xt", 0.5).alias("xt")).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("xt", F.col(pixel).alias("pixel")))).alias("_c"))
    step = F.array_sort(F.filter(F.transform(F.sequence(F.lit(1), F.size("_c") - 1), lambda i: F.get(F.col("_c.xt"), i) - F.get(F.col("_c.xt"), i - 1)), lambda v: v > 0))
    place = place.withColumn("_d", F.when(F.size("_c") > 1, step).otherwise(F.array().cast("array<double>")))
    half = F.floor((F.size("_d") - 1) / 2).cast("int"), F.floor(F.size("_d") / 2).cast("int")
    middle = F.coalesce((F.get("_d", half[0]) + F.get("_d", half[1])) / 2, F.lit(0.25))
    place = place.select(*group, F.col("_c.pixel").alias("_order"), (F.lit(float(dy)) if dy else middle).alias("dy"))
    udf = _patch_udf(gap, column_gap, length, detrend, across)
    x = segment.join(place, group).withColumn("_z", udf("first_km", "last_km", (F.col("i1") - F.col("i0")).cast("int"), "dx", "dy", "_order", "columns"))
    x = x.where("_z.power is not null").select("*", "_z.*")

    def axis(n, d):
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i - F.floor(n / 2)) / (n * d))

    width = F.col("n_columns").cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.slice("power", i * width + 1, width))
    x = x.withColumn("psd_2d", rows).withColumn("wavenumber_x", axis(F.col("rows"), F.col("dx"))).withColumn("wavenumber_y", axis(width, F.col("dy")))
    return x.drop("columns", "_order", "_z", "power", "rows", "i0", "i1")


def cells_2d(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ix, iy, kx, ky, power): two-dimensional densities in long form."""
    r = spectra.select(*keys, "wavenumber_y", F.posexplode(F.arrays_zip(F.col("wavenumber_x").alias("kx"), F.col("psd_2d").alias("r"))).alias("ix", "z"))
    c = r.select(*keys, "ix", F.col("z.kx").alias("kx"), F.posexplode(F.arrays_zip(F.col("wavenumber_y").alias("ky"), F.col("z.r").alias("power"))).alias("iy", "y"))
    return c.select(*keys, "ix", "iy", "kx", "y.ky", "y.power")


def pass_spectra_2d(spectra: DataFrame, group: list[str]) -> DataFrame:
    """(group, ix, iy, kx, ky, power, n_segments_used, n_segments_total): mean of the segments of each swath."""
    c = cells_2d(spectra, [*group, "n_total"])
    return c.groupBy(*group, "ix", "iy").agg(
        F.min("kx").alias("kx"), F.min("ky").alias("ky"), F.avg("power").alias("power"), F.count("*").alias("n_segments_used"), F.max("n_total").cast("long").alias("n_segments_total")
    )


def slope_segments(lines: DataFrame, group: list[str], pixel: str, order: str, length: float, overlap: float = 0.0, gap: float = 0.25, min_pixels: int = 3) -> DataFrame:
    """(group, segment_index, first_km, last_km, lat_mean, lat_min, lat_max, lon_mean, n_pixels_used,
    valid_fraction, slope_mean, slope_rms, slope_variance, velocity_rms): statistics of the slopes of
    every segment of a swath.

    ``lines`` has lat, lon, slope and velocity.  A column counts with at least 1 - gap of its slopes
    and at least three, a segment with ``min_pixels`` such columns; moments are pooled over these.
    """
    m = swath_members(lines, group, pixel, order, ["slope", "velocity"], length, None, overlap)
    ok = F.col("slope").isNotNull()
    column = m.groupBy(*group, *SEGMENT, pixel).agg(
        F.count_if(ok).alias("valid"), F.avg("slope").alias("mean"), F.var_pop("slope").alias("var"), F.sum(F.when(ok, F.col("velocity") * F.col("velocity"))).alias("v2"), F.count(F.when(ok, F.col("velocity"))).alias("n_v"),
        F.sum("lat").alias("lat"), F.count("lat").alias("n_lat"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.sum("lon").alias("lon"), F.count("lon").alias("n_lon"),
    ).where("i1 - i0 >= 3")
    used = (F.col("valid") >= (1 - gap) * (F.col("i1") - F.col("i0"))) & (F.col("valid") >= 3)
    n = F.sum(F.when(used, F.col("valid")))
    mean = F.sum(F.when(used, F.col("valid") * F.col("mean"))) / n
    square = F.sum(F.when(used, F.col("valid") * (F.col("var") + F.col("mean") * F.col("mean")))) / n
    out = column.groupBy(*group, *SEGMENT).agg(
        F.count_if(used).cast("int").alias("n_pixels_used"), *_where(), mean.alias("slope_mean"), square.alias("_square"),
        F.sqrt(F.try_divide(F.sum(F.when(used, F.col("v2"))), F.sum(F.when(used, F.col("n_v"))))).alias("velocity_rms"),
    ).where(F.col("n_pixels_used") >= min_pixels)
    variance = F.greatest(F.col("_square") - F.col("slope_mean") * F.col("slope_mean"), F.lit(0.0))
    return out.withColumn("slope_rms", F.sqrt("_square")).withColumn("slope_variance", variance).drop("_square", "i0", "i1", "dx", "n_columns", "n_total")


def pass_means(spectra: DataFrame, group: list[str]) -> DataFrame:
    """(group, psd, n_segments_used, n_segments_total): mean of the segments of each swath; a swath
    without a usable segment has no row (``complete_passes`` drops the pass then)."""
    e = spectra.select(*group, "n_total", F.posexplode("psd").alias("ik", "v")).groupBy(*group, "ik").agg(F.avg("v").alias("v"), F.count("*").alias("n"), F.max("n_total").alias("t"))
    return e.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("ik", "v"))).getField("v").alias("psd"), F.max("n").alias("n_segments_used"), F.max("t").cast("long").alias("n_segments_total")
    )


def complete_passes(means: DataFrame, keys: list[str], swaths: tuple[str, ...] = ("left", "right")) -> DataFrame:
    """Rows of the passes that have every swath: a pass with an empty swath is left out whole."""
    n = F.size(F.collect_set(F.when(F.col("swath").isin(*swaths), F.col("swath"))).over(Window.partitionBy(*keys)))
    return means.withColumn("_n", n).where(F.col("_n") == len(swaths)).drop("_n")


def power_2d(cells: DataFrame, keys: list[str], row: str, col: str, value: str, rows: int, cols: int, dx: float, dy: float) -> DataFrame:
    """(keys, i1, i2, power) of every complete patch of rows x cols."""
    flat = cells.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(row).alias("r"), F.col(col).alias("c"), F.col(value).alias("v")))), lambda z: z["v"]).alias("v"))
    p = flat.where(F.size("v") == rows * cols).select(*keys, F.posexplode(dsp.periodogram_2d_udf(rows, cols, dx, dy)("v")).alias("i", "power"))
    return p.select(*keys, F.floor(F.col("i") / cols).cast("int").alias("i1"), (F.col("i") % cols).alias("i2"), "power")


def trim_patch(cells: DataFrame, row: str, col: str, rows: int, cols: int, every: tuple[int, int]) -> tuple[DataFrame, int, int]:
    """Cells without the last rows and columns beyond whole multiples of the decimation, and the size left."""
    n1, n2 = rows // every[0] * every[0], cols // every[1] * every[1]
    return cells.where((F.col(row) < n1) & (F.col(col) < n2)), n1, n2


def frequency(i, n: int, dx: float):
    """Wavenumber of an unshifted transform index."""
    return F.when(i < (n + 1) // 2, i).otherwise(i - n) / (n * dx)


def alias_decomposition(power: DataFrame, keys: list[str], rows: int, cols: int, dx: float, dy: float, every: tuple[int, int], taps: int = 17, centred: bool = False) -> DataFrame:
    """(keys, k, direct, aliased, total): what filtering and keeping every m-th sample does.

    The filtered density is folded on the target's grid by a groupBy of indices modulo its size;
    the direct part is the block of the low indices, with ``centred`` the block around zero across
    the track.  Both are integrated across the track and made one-sided.
    """
    if rows % every[0] or cols % every[1]:
        raise ValueError("trim the patch to whole multiples of the decimation first (trim_patch)")
    n1, n2 = rows // every[0], cols // every[1]
    if rows < 4 * every[0] or cols < 4 * every[1]:
        raise ValueError("the patch is too small for this decimation")
    h1 = F.array(*[F.lit(float(v)) for v in dsp.transfer_power(np.fft.fftfreq(rows, dx), taps, dx)])
    h2 = F.array(*[F.lit(float(v)) for v in dsp.transfer_power(np.fft.fftfreq(cols, dy), taps, dy)])
    filtered = F.col("power") * F.element_at(h1, F.col("i1") + 1) * F.element_at(h2, F.col("i2") + 1)
    low1 = F.col("i1") < n1
    low2 = ((F.col("i2") < (n2 + 1) // 2) | (F.col("i2") >= cols - n2 // 2)) if centred else (F.col("i2") < n2)
    if centred:
        low1 = (F.col("i1") < (n1 + 1) // 2) | (F.col("i1") >= rows - n1 // 2)
    d = power.withColumn("f", filtered).withColumn("p", F.col("i1") % n1)
    dk2 = 1.0 / (n2 * dy * every[1])
    sums = d.groupBy(*keys, "p").agg((F.sum("f") * dk2).alias("total"), (F.sum(F.when(low1 & low2, F.col("f")).otherwise(0.0)) * dk2).alias("direct"))
    k = frequency(F.col("p"), n1, dx * every[0])
    out = sums.withColumn("k", k).where("k >= 0")
    top = float(np.abs(np.fft.fftfreq(n1, dx * every[0])).max())
    double = F.when((F.col("k") > 0) & (F.col("k") < top - 1e-12), 2.0).otherwise(1.0)
    return out.select(*keys, "k", (F.col("direct") * double).alias("direct"), (F.greatest(F.col("total") - F.col("direct"), F.lit(0.0)) * double).alias("aliased"), (F.col("total") * double).alias("total"))


def integrate_across(power: DataFrame, keys: list[str], rows: int, cols: int, dx: float, dy: float, taps: int = 17) -> DataFrame:
    """(keys, k, psd): filtered two-dimensional density summed across the track, one-sided: the
    prediction without aliasing."""
    h1 = F.array(*[F.lit(float(v)) for v in dsp.transfer_power(np.fft.fftfreq(rows, dx), taps, dx)])
    h2 = F.array(*[F.lit(float(v)) for v in dsp.transfer_power(np.fft.fftfreq(cols, dy), taps, dy)])
    s = power.groupBy(*keys, "i1").agg((F.sum(F.col("power") * F.element_at(h1, F.col("i1") + 1) * F.element_at(h2, F.col("i2") + 1)) / (cols * dy)).alias("psd"))
    s = s.withColumn("k", frequency(F.col("i1"), rows, dx)).where("k >= 0")
    return s.select(*keys, "k", F.when(F.col("k") > 0, 2 * F.col("psd")).otherwise(F.col("psd")).alias("psd"))


def sector_energy(power: DataFrame, keys: list[str], rows: int, cols: int, dx: float, dy: float) -> DataFrame:
    """(keys, along, across): power where one wavenumber is under half the other."""
    kx, ky = F.abs(frequency(F.col("i1"), rows, dx)), F.abs(frequency(F.col("i2"), cols, dy))
    return power.groupBy(*keys).agg(F.sum(F.when(ky < 0.5 * kx, F.col("power"))).alias("along"), F.sum(F.when(kx < 0.5 * ky, F.col("power"))).alias("across"))


def predict_target(long: DataFrame, keys: list[str], k: str, psd: str, k_max: float, fs: float, folds: int, taps: int, dx: float) -> DataFrame:
    """(keys, k, predicted): sum over replicas of |H(k + n fs)|**2 times the native spectrum there;
    terms beyond the native axis are nothing."""
    f = long.where(F.col(k) <= k_max).select(*keys, F.col(k).alias("k0"), F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("n"))
    f = f.withColumn(k, F.col("k0") + F.col("n") * fs)
    there = tracks.resample(long.select(*keys, k, psd), f.select(*keys, k).distinct(), keys, k, psd, "zero")
    j = f.join(there, [*keys, k])
    return j.groupBy(*keys, "k0").agg(F.sum(F.col(psd) * dsp.transfer_column(F.col(k), taps, dx)).alias("predicted")).withColumnRenamed("k0", k)


def granule_rejects(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """(granule, stage, error): granules that gave nothing, and why."""
    m = manifest.groupBy("granule").agg(F.max(F.when(F.trim("error") != "", F.col("error"))).alias("error"))
    silent = m.where("error is null").join(results.select("granule").distinct(), "granule", "left_anti")
    return m.where("error is not null").select("granule", F.lit("read").alias("stage"), "error").unionByName(
        silent.select("granule", F.lit("spectra").alias("stage"), F.lit("no usable segment").alias("error"))
    )


def screen_patches(cells: DataFrame, keys: list[str], row: str, value: str, max_nan: float = 0.15, max_gap: float = 0.1) -> DataFrame:
    """(keys, reason): why a patch drops out, cheap gates first: nan_fraction, gap, else used."""
    share = cells.groupBy(*keys).agg(F.avg(F.col(value).isNull().cast("double")).alias("missing"))
    gap = tracks.longest_bad_run(cells, keys, row, value).drop("n")
    reason = F.when(F.col("missing") > max_nan, "nan_fraction").when(F.col("gap_fraction") > max_gap, "gap").otherwise("used")
    return share.join(gap, keys).select(*keys, reason.alias("reason"))


def cross_track_spectra(lines: DataFrame, group: list[str], pixel: str, order: str, value: str, dx: float, chunks: int = 10, chunk_lines: int = 200, min_valid: float = 0.9) -> DataFrame:
    """(group, ik, k, psd, n_rows): mean spectrum across the track over the lines of evenly spaced chunks.

    A line counts with at least ``min_valid`` of the swath's columns; gaps are interpolated, the mean
    goes, the taper is a periodic Hann. A line in two chunks counts twice.
    """
    w = Window.partitionBy(*group)
    width = lines.groupBy(*group).agg(F.sort_array(F.collect_set(pixel)).alias("_pixels"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    row = lines.groupBy(*group, order).agg(F.map_from_entries(F.collect_list(F.struct(F.col(pixel), F.col(value).cast("double")))).alias("_m"))
    row = row.join(width, group).withColumn("v", F.transform("_pixels", lambda p: F.get(F.map_values(F.map_filter("_m", lambda k, _: k == p)), F.lit(0))))
    row = row.withColumn("_room", F.greatest(F.col("_hi") - F.col("_lo") + 1 - chunk_lines, F.lit(0)))
    starts = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda i: F.floor(i * F.col("_room") / F.lit(max(1, chunks - 1)) + 1e-9))
    at = F.col(order) - F.col("_lo")
    times = F.size(F.filter(starts, lambda s: (at >= s) & (at < s + chunk_lines)))
    valid = F.size(F.filter("v", lambda x: x.isNotNull())) / F.size("v")
    row = row.withColumn("_times", times).where((F.col("_times") > 0) & (valid >= min_valid))

    def run(v: pd.Series) -> pd.Series:
        out = np.empty(len(v), dtype=object)
        for i, a in enumerate(v):
            x = np.asarray(a, dtype=float)
            j, ok = np.arange(len(x)), np.isfinite(x)
            out[i] = dsp.periodograms(np.interp(j, j[ok], x[ok])[None], dx, "constant")[0]
        return pd.Series(out, index=v.index)

    p = row.select(*group, "_times", F.size("v").alias("n"), F.posexplode(F.pandas_udf(run, ArrayType(DoubleType()))("v")).alias("ik", "p"))
    return p.groupBy(*group, "ik").agg((F.first("ik") / (F.first("n") * dx)).alias("k"), (F.sum(F.col("p") * F.col("_times")) / F.sum("_times")).alias("psd"), F.sum("_times").alias("n_rows"))


def explicit_segments(series: DataFrame, group: list[str], pixel: str, idx: str, value: str, length: float, dx: float, min_profile: float = 0.8, min_segment: float = 0.9) -> DataFrame:
    """(group, pixel, i0, lat_mean, p): spectra of half-overlapping segments of every column, not doubled:
    squared transform over (sum of squared taper / dx). Interior gaps are filled before; columns and
    segments need a share of values."""
    n = int(length / dx)
    x = tracks.interpolate(series, [*group, pixel], idx, value, clamp=False)
    share = F.avg(F.col(value).isNotNull().cast("double"))
    x = x.withColumn("_share", share.over(Window.partitionBy(*group, pixel))).where(F.col("_share") >= min_profile)
    m = tracks.segment_members(x, [*group, pixel], idx, n, (n // 2) / n).where(F.col("i0") % (n - n // 2) == 0)
    g = m.groupBy(*group, pixel, "i0").agg(share.alias("_v"), F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))).alias("s"), F.avg("lat").alias("lat_mean"), F.count("*").alias("_n"))

    def run(v: pd.Series) -> pd.Series:
        out = np.empty(len(v), dtype=object)
        w = dsp.hann(n)
        for i, a in enumerate(v):
            y = np.asarray(a, dtype=float)
            j, ok = np.arange(n), np.isfinite(y)
            y = dsp._detrended(np.interp(j, j[ok], y[ok])[None], "linear")[0]
            out[i] = np.abs(np.fft.rfft(y * w)) ** 2 / (np.sum(w**2) / dx)
        return pd.Series(out, index=v.index)

    return g.where((F.col("_v") >= min_segment) & (F.col("_n") == n)).select(*group, pixel, "i0", "lat_mean", F.pandas_udf(run, ArrayType(DoubleType()))(F.col("s.v")).alias("p"))


def explicit_spectra(segments: DataFrame, group: list[str], pixel: str, n: int, dx: float) -> DataFrame:
    """(group, ik, k, mean, error, n_tracks): mean over columns of their mean segments, with the standard
    error over columns (population form)."""
    t = segments.select(*group, pixel, F.posexplode("p").alias("ik", "p")).groupBy(*group, pixel, "ik").agg(F.avg("p").alias("p"))
    return t.groupBy(*group, "ik").agg((F.first("ik") / (n * dx)).alias("k"), F.avg("p").alias("mean"), (F.stddev_pop("p") / F.sqrt(F.count("p"))).alias("error"), F.count("p").alias("n_tracks"))


def track_spectrum(series: DataFrame, keys: list[str], order: str, value: str, dx: float) -> DataFrame:
    """(keys, ik, k, psd): two-sided density at positive wavenumbers of a whole series without gaps:
    linear detrending, symmetric Hann taper, no correction for it."""
    g = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("s"), F.count(value).alias("_n"), F.count("*").alias("n"))
    p = g.where((F.col("n") > 1) & (F.col("_n") == F.col("n"))).select(*keys, "n", F.posexplode(dsp.periodogram_udf(dx, periodic=False, raw=True)(F.col("s.v"))).alias("ik", "p"))
    return p.where("ik > 0").select(*keys, "ik", (F.col("ik") / (F.col("n") * dx)).alias("k"), (F.col("p") * dx / F.col("n")).alias("psd"))


def paired_segments(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of two products that share their keys, side by side; never paired by position."""
    return a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns]).join(b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns]), keys)
