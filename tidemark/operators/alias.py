"""Alias spectra of segments of a swath, their pass means, counters and checks against a second product.

A segment is gathered for its transform: a fixed number of rows of one swath, a parameter.  All else,
segments, means, counters and matching, is relational.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dsp
from tidemark.operators import tracks

_RESULT = (
    "reason string, valid_fraction double, gap_fraction double, gap_filled boolean, n_pixels int, "
    "k array<double>, direct array<double>, aliased array<double>, total array<double>"
)


def filled_patch(p: np.ndarray) -> np.ndarray | None:
    """Rows first, then columns, linearly and held at the ends; None where something stays missing."""
    p = p.copy()
    for lines in (p, p.T):
        for x in lines:
            bad = np.isnan(x)
            if bad.any() and not bad.all():
                i = np.arange(len(x))
                x[bad] = np.interp(i[bad], i[~bad], x[~bad])
    return None if np.isnan(p).any() else p


def without_plane(p: np.ndarray) -> np.ndarray:
    """Residual of the least-squares plane; on a whole grid its two slopes are independent."""
    p = p - p.mean()
    for axis in (0, 1):
        t = np.arange(p.shape[axis]) - (p.shape[axis] - 1) / 2
        t = t[:, None] if axis == 0 else t[None, :]
        denominator = (t * t).sum() * p.shape[1 - axis]
        p = p - t * ((p * t).sum() / denominator if denominator else 0.0)
    return p


def longest_gap(p: np.ndarray, bad_share: float = 0.5) -> float:
    """Longest run of rows with more than ``bad_share`` missing, as a share of all rows."""
    bad = np.isnan(p).mean(axis=1) > bad_share
    edges = np.flatnonzero(np.diff(np.r_[False, bad, False].astype(int)))
    return float((edges[1::2] - edges[::2]).max(initial=0)) / len(p)


def decomposed(p: np.ndarray, dx: tuple[float, float], every: tuple[int, int], taps: int) -> tuple[np.ndarray, ...] | None:
    """(k, direct, aliased, total) of a patch trimmed to whole multiples of the decimation; None if it
    is under four target samples long or wide."""
    n1, n2 = (n // m * m for n, m in zip(p.shape, every))
    if n1 < 4 * every[0] or n2 < 4 * every[1]:
        return None
    w = np.multiply.outer(dsp.hann(n1, False), dsp.hann(n2, False))
    power = np.abs(np.fft.fft2(p[:n1, :n2] * w)) ** 2 * dx[0] * dx[1] / (n1 * n2) / np.mean(w**2)
    for axis, n in ((0, n1), (1, n2)):
        h = dsp.transfer_power(np.fft.fftfreq(n, dx[axis]), taps, dx[axis])
        power = power * (h[:, None] if axis == 0 else h)
    t1, t2 = n1 // every[0], n2 // every[1]
    dk = 1 / (n2 * dx[1])
    total = power.reshape(every[0], t1, n2).sum(axis=(0, 2)) * dk
    direct = power[:t1, :t2].sum(axis=1) * dk
    k = np.fft.fftfreq(t1, dx[0] * every[0])
    one = k >= 0
    double = np.where((k > 0) & (k < np.abs(k).max()), 2.0, 1.0)[one]
    total, direct = total[one] * double, direct[one] * double
    return k[one], direct, np.maximum(total - direct, 0.0), total


def _segment_udf(rows: int, dx: tuple[float, float], every: tuple[int, int], max_nan: float, max_gap: float, taps: int, plane: bool):
    def judge(pixels, row, pixel, value) -> tuple:
        p = np.full((rows, len(pixels)), np.nan)
        if value is not None and len(value):
            p[np.asarray(row), np.searchsorted(pixels, pixel)] = value
        valid = float(np.isfinite(p).mean())
        gap = longest_gap(p)
        head = (valid, gap, bool(np.isnan(p).any()), len(pixels))
        if valid < 1 - max_nan:
            return ("nan_fraction", *head, None, None, None, None)
        if gap > max_gap:
            return ("gap", *head, None, None, None, None)
        whole = filled_patch(p)
        if whole is None:
            return ("fill_failed", *head, None, None, None, None)
        parts = decomposed(without_plane(whole) if plane else whole, dx, every, taps)
        return ("decompose_failed", *head, None, None, None, None) if parts is None else ("used", *head, *parts)

    def run(pixels: pd.Series, row: pd.Series, pixel: pd.Series, value: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(*x) for x in zip(pixels, row, pixel, value)], columns=[c.split()[0] for c in _RESULT.split(", ")])

    return F.pandas_udf(run, _RESULT)


def fixed_segments(axis: DataFrame, group: list[str], rows: int, overlap: float = 0.0, targets: dict[str, list[float]] | list[float] | None = None) -> DataFrame:
    """(group, segment_index, i0, idx and the other columns of ``axis``): every line of a track with each
    segment of ``rows`` lines that holds it.

    Segments lie at regular starts with the tail covered or, with ``targets``, centred where the track
    comes closest to these latitudes; a dictionary has targets for each swath.
    """
    if targets is None:
        m = tracks.segment_members(axis, group, "idx", rows, overlap)
        return m.withColumn("segment_index", (F.dense_rank().over(Window.partitionBy(*group).orderBy("i0")) - 1).cast("int"))
    parts = [(axis, targets)] if not isinstance(targets, dict) else [(axis.where(F.col("swath") == s), v) for s, v in targets.items()]
    at = None
    for part, wanted in parts:
        c = tracks.segments_at(part, group, "idx", "lat", wanted, rows)
        c = c.withColumn("_no", F.array_position(F.array(*[F.lit(float(v)) for v in wanted]), F.col("target")))
        at = c if at is None else at.unionByName(c)
    at = at.withColumn("segment_index", (F.row_number().over(Window.partitionBy(*group).orderBy("_no")) - 1).cast("int"))
    lines = at.select(*group, "segment_index", "i0", F.explode(F.sequence(F.col("i0"), F.col("i1") - 1)).alias("idx"))
    return lines.join(axis, [*group, "idx"])


def alias_segments(
    lines: DataFrame, group: list[str], pixel: str, order: str, value: str, length: float, native: tuple[float, float], target: tuple[float, float],
    overlap: float = 0.0, max_nan: float = 0.15, max_gap: float = 0.1, taps: int = 9, remove_plane: bool = True, targets: dict[str, list[float]] | list[float] | None = None,
) -> DataFrame:
    """(group, segment_index, reason, first_km, last_km, n_lines, n_pixels, lat_mean, lat_min, lat_max,
    lon_mean, valid_fraction, gap_fraction, gap_filled, k, direct, aliased, total), one row for every
    segment of a swath.

    ``native`` and ``target`` are spacings in km along and across the track.  reason is 'used' or why
    the segment drops out, cheap gates first: nan_fraction, gap, fill_failed, decompose_failed; only
    used ones have spectra.  Lines and columns that are absent count as missing.
    """
    lines = lines.select(*group, pixel, order, "lat", "lon", value)
    every = tuple(max(1, round(b / a)) for a, b in zip(native, target))
    rows = max(4, round(length / target[0])) * every[0]
    axis = tracks.swath_axis(lines, group, pixel, order, "lat", "lon")
    axis = axis.withColumn("idx", (F.col(order) - F.min(order).over(Window.partitionBy(*group))).cast("int"))
    m = fixed_segments(axis, group, rows, overlap, targets)
    segment = [*group, "segment_index"]
    bounds = m.groupBy(*segment).agg(F.min("km").alias("first_km"), F.max("km").alias("last_km"), F.count("*").cast("int").alias("n_lines"))
    pixels = lines.groupBy(*group).agg(F.sort_array(F.collect_set(pixel)).alias("_pixels"))
    ok = F.col(value).isNotNull()
    held = lines.join(m.select(*segment, order, (F.col("idx") - F.col("i0")).alias("_row")), [*group, order]).groupBy(*segment).agg(
        F.collect_list(F.when(ok, F.col("_row"))).alias("_r"), F.collect_list(F.when(ok, F.col(pixel))).alias("_p"), F.collect_list(value).alias("_v"),
        F.avg("lat").alias("lat_mean"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.avg("lon").alias("lon_mean"),
    )
    udf = _segment_udf(rows, native, every, max_nan, max_gap, taps, remove_plane)
    x = bounds.join(held, segment, "left").join(pixels, group).withColumn("_z", udf("_pixels", "_r", "_p", "_v"))
    return x.select("*", "_z.*").drop("_pixels", "_r", "_p", "_v", "_z")


def alias_long(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ik, k, direct, aliased, total) of the used segments."""
    z = F.arrays_zip("k", "direct", "aliased", "total")
    return segments.where("reason = 'used'").select(*keys, F.posexplode(z).alias("ik", "z")).select(*keys, "ik", "z.*")


def alias_pass_means(segments: DataFrame, group: list[str]) -> DataFrame:
    """(group, ik, k, direct, aliased, total, n_segments): means over the used segments; total is the sum
    of the two means."""
    d = alias_long(segments, group).groupBy(*group, "ik").agg(F.min("k").alias("k"), F.avg("direct").alias("direct"), F.avg("aliased").alias("aliased"), F.count("*").alias("n_segments"))
    return d.withColumn("total", F.col("direct") + F.col("aliased"))


def drop_counters(segments: DataFrame, group: list[str]) -> DataFrame:
    """(group, total, used, nan_fraction, gap, fill_failed, decompose_failed)."""
    reasons = ("used", "nan_fraction", "gap", "fill_failed", "decompose_failed")
    return segments.groupBy(*group).agg(F.count("*").alias("total"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons])


def alias_only(long: DataFrame, keys: list[str], k: str, psd: str, k_max: float, fs: float, folds: int, taps: int, dx: float) -> DataFrame:
    """(keys, k, aliased): what folds onto k <= ``k_max`` from the replicas k + m fs with 0 < abs(m) <=
    ``folds``: abs(H)**2 times the spectrum at abs(k + m fs), nothing beyond its axis."""
    m = F.explode(F.array(*[F.lit(float(i)) for i in range(-folds, folds + 1) if i]))
    f = long.where(F.col(k) <= k_max).select(*keys, F.col(k).alias("_k"), m.alias("_m")).withColumn(k, F.abs(F.col("_k") + F.col("_m") * fs))
    there = tracks.resample(long.select(*keys, k, psd), f.select(*keys, k).distinct(), keys, k, psd, "zero")
    s = f.join(there, [*keys, k]).groupBy(*keys, "_k").agg(F.sum(F.col(psd) * dsp.transfer_column(F.col(k), taps, dx)).alias("aliased"))
    return s.withColumnRenamed("_k", k)


def observed_ratio(observed: DataFrame, native: DataFrame, keys: list[str], k: str, psd: str, k_max: float, taps: int, dx: float) -> DataFrame:
    """(keys, k, ratio): the observed spectrum, interpolated, over abs(H)**2 times the native one."""
    base = native.where(F.col(k) <= k_max).select(*keys, k, (F.col(psd) * dsp.transfer_column(F.col(k), taps, dx)).alias("_predicted"))
    seen = tracks.resample(observed.select(*keys, k, psd), base.select(*keys, k).distinct(), keys, k, psd, "clamp")
    return base.join(seen, [*keys, k]).select(*keys, k, F.try_divide(F.col(psd), F.col("_predicted")).alias("ratio"))


def matched_rows(patches: DataFrame, lines: DataFrame, keys: list[str], patch: str, idx: str) -> DataFrame:
    """(keys, patch, j0, j1): rows of another product on the footprint of each patch: those nearest to
    its first and last point, in order, the end one further. ``patches`` has lat0, lon0, lat1, lon1."""
    ends = patches.select(*keys, patch, F.explode(F.array(*[F.struct(F.lit(i).alias("end"), F.col(f"lat{i}").alias("la"), F.col(f"lon{i}").alias("lo")) for i in (0, 1)])).alias("e")).select(*keys, patch, "e.*")
    near = tracks.nearest_line(ends, lines, keys, [patch, "end"], ("la", "lat"), ("lo", "lon"), idx)
    both = near.groupBy(*keys, patch).agg(F.max(F.when(F.col("end") == 0, F.col(idx))).alias("a"), F.max(F.when(F.col("end") == 1, F.col(idx) + 1)).alias("b")).where("a is not null and b is not null")
    return both.select(*keys, patch, F.least("a", "b").alias("j0"), F.greatest("a", "b").alias("j1"))


def _column_spectra_udf(dx: float, max_nan: float):
    """Arrow UDF: a patch (rows, pixels, values) to the mean spectrum of its columns, filled before."""

    def run(n: pd.Series, pixels: pd.Series, row: pd.Series, pixel: pd.Series, value: pd.Series) -> pd.Series:
        out = np.empty(len(n), dtype=object)
        for i, (m, ps, r, c, v) in enumerate(zip(n, pixels, row, pixel, value)):
            p = np.full((m, len(ps)), np.nan)
            p[np.asarray(r, dtype=int), np.searchsorted(ps, c)] = v
            whole = filled_patch(p) if np.isnan(p).mean() <= max_nan else None
            if whole is not None:
                out[i] = dsp.periodograms(whole.T, dx, "linear").mean(axis=0)
        return pd.Series(out, index=n.index)

    return F.pandas_udf(run, "array<double>")


def matched_validation(segments: DataFrame, rows: DataFrame, other: DataFrame, keys: list[str], pixel: str, idx: str, value: str, dx: float, min_rows: int = 16, max_nan: float = 0.15) -> DataFrame:
    """(keys, segment_index, ik, k, predicted, measured): total alias spectrum of each used segment beside
    the mean column spectrum of the other product on its rows (``matched_rows``), interpolated to k.

    The other product's lines meet their patches by ranges of ``min_rows`` lines, not by all pairs.
    """
    patch = [*keys, "segment_index"]
    bins = F.explode(F.sequence(F.floor(F.col("j0") / min_rows), F.floor((F.col("j1") - 1) / min_rows))).alias("_bin")
    r = rows.where(F.col("j1") - F.col("j0") >= min_rows).select(*patch, "j0", "j1", bins)
    x = other.select(*keys, pixel, idx, value).withColumn("_bin", F.floor(F.col(idx) / min_rows)).join(r, [*keys, "_bin"]).where((F.col(idx) >= F.col("j0")) & (F.col(idx) < F.col("j1")))
    ok = F.col(value).isNotNull()
    g = x.groupBy(*patch, "j0", "j1").agg(
        F.sort_array(F.collect_set(pixel)).alias("_pixels"), F.collect_list(F.when(ok, F.col(idx) - F.col("j0"))).alias("_r"), F.collect_list(F.when(ok, F.col(pixel))).alias("_p"), F.collect_list(value).alias("_v")
    )
    g = g.withColumn("psd", _column_spectra_udf(dx, max_nan)((F.col("j1") - F.col("j0")).cast("int"), "_pixels", "_r", "_p", "_v")).where("psd is not null")
    measured = g.select(*patch, F.posexplode("psd").alias("i", "measured"), (F.col("j1") - F.col("j0")).alias("n")).select(*patch, (F.col("i") / (F.col("n") * dx)).alias("k"), "measured")
    predicted = alias_long(segments, patch)
    there = tracks.resample(measured, predicted.select(*patch, "k"), patch, "k", "measured", "null")
    return predicted.select(*patch, "ik", "k", F.col("total").alias("predicted")).join(there, [*patch, "k"])
