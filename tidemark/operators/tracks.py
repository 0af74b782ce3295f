"""Ordered operators on series: distance, gaps, runs, segmentation, detrending, resampling.

A series is the rows of ``keys`` in the order of one column.  Everything here is a window or a
groupBy on the series' keys: one shuffle, sorted, spilling, inside whole-stage code.  Operators
that segment a track explode each line to the few segments it belongs to by arithmetic, never by a
theta join of lines and segments.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import haversine_km

_UP, _DOWN = Window.unboundedPreceding, Window.unboundedFollowing


def indexed(df: DataFrame, keys: list[str], order: str, name: str = "idx") -> DataFrame:
    """Position of each row in its series, from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("int"))


def along_track_km(df: DataFrame, keys: list[str], order: str, lat: str, lon: str, name: str = "km") -> DataFrame:
    """Running great-circle distance along each series; rows without a position have none."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    before = w.rowsBetween(_UP, -1)
    plat, plon = (F.last(F.when(known, F.col(c)), ignorenulls=True).over(before) for c in (lat, lon))
    x = df.withColumn("_step", F.when(known, F.coalesce(haversine_km(plat, plon, F.col(lat), F.col(lon)), F.lit(0.0))))
    return x.withColumn(name, F.when(F.col("_step").isNotNull(), F.sum("_step").over(w.rowsBetween(_UP, 0)))).drop("_step")


def interpolate(df: DataFrame, keys: list[str], order: str, value: str, x: str | None = None, name: str | None = None, clamp: bool = True, max_run: int | None = None) -> DataFrame:
    """Linear interpolation of NULLs in ``value`` over ``x`` (the order column by default).

    ``clamp`` carries the first and last value outward; ``max_run`` fills only runs of at most so
    many rows.
    """
    x, name = x or order, name or value
    w = Window.partitionBy(*keys).orderBy(order)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(value).alias("y"), F.col("_i").alias("i")))
    d = df.withColumn("_i", F.row_number().over(w)).withColumn("_p", F.last(here, ignorenulls=True).over(w.rowsBetween(_UP, 0))).withColumn(
        "_n", F.first(here, ignorenulls=True).over(w.rowsBetween(0, _DOWN))
    )
    t = F.try_divide(F.col(x) - F.col("_p.x"), F.col("_n.x") - F.col("_p.x"))
    filled = F.col("_p.y") + (F.col("_n.y") - F.col("_p.y")) * t
    if max_run is not None:
        filled = F.when(F.col("_n.i") - F.col("_p.i") - 1 <= max_run, filled)
    out = F.coalesce(F.col(value), filled)
    if clamp:
        out = F.coalesce(out, F.when(F.col("_p").isNull(), F.col("_n.y")).when(F.col("_n").isNull(), F.col("_p.y")))
    return d.withColumn(name, out).drop("_i", "_p", "_n")


def fill_plane(df: DataFrame, group: list[str], row: str, col: str, value: str, max_missing: float = 0.15) -> DataFrame:
    """Two-dimensional fill: across each row first, then along each column, on what the rows gave.

    Groups with a larger missing share drop out, and so do groups where something stays missing.
    """
    share = Window.partitionBy(*group)
    kept = df.withColumn("_m", F.avg(F.col(value).isNull().cast("double")).over(share)).where(F.col("_m") <= max_missing).drop("_m")
    # a row without any value is left to the columns
    rows = interpolate(kept, [*group, row], col, value)
    both = interpolate(rows, [*group, col], row, value)
    return both.withColumn("_left", F.count_if(F.col(value).isNull()).over(share)).where("_left = 0").drop("_left")


def runs(df: DataFrame, keys: list[str], order: str, mark: Column, step: str | None = None) -> DataFrame:
    """Rows where ``mark`` holds with the number of their run; a jump in ``step`` breaks a run."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_mark", F.coalesce(mark, F.lit(False)))
    new = F.col("_mark") & ~F.coalesce(F.lag("_mark").over(w), F.lit(False))
    if step:
        new = new | (F.col("_mark") & (F.col(step) - F.lag(step).over(w) > 1))
    return d.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(_UP, 0))).where("_mark").drop("_mark", "_new")


def longest_bad_run(df: DataFrame, group: list[str], row: str, value: str, bad_share: float = 0.5) -> DataFrame:
    """(group, n, gap_fraction): longest run of rows with more than ``bad_share`` missing, as a share."""
    rows = df.groupBy(*group, row).agg(F.avg(F.col(value).isNull().cast("double")).alias("m"))
    rows = indexed(rows, group, row)
    bad = runs(rows, group, row, F.col("m") > bad_share).groupBy(*group, "run").agg(F.count("*").alias("len"))
    longest = bad.groupBy(*group).agg(F.max("len").alias("len"))
    return rows.groupBy(*group).agg(F.count("*").alias("n")).join(longest, group, "left").select(*group, "n", (F.coalesce("len", F.lit(0)) / F.col("n")).alias("gap_fraction"))


# --- segmentation ------------------------------------------------------------------------------


def _starts(km: str, length: float, step: float) -> Column:
    """Starts of all segments that hold a line, from its ``km`` and the track's ``_d0`` and ``_total``."""
    slack = F.col("_total") - length + 1e-9 - F.col("_d0")
    n = F.greatest(F.ceil(slack / step), F.lit(1))  # starts strictly before the limit
    last = F.col("_d0") + (n - 1) * step
    tail = F.col("_total") - length
    first_in = F.greatest(F.ceil((F.col(km) - length - F.col("_d0")) / step), F.lit(0))
    last_in = F.least(F.floor((F.col(km) - F.col("_d0")) / step), n - 1)
    regular = F.when(first_in <= last_in, F.sequence(first_in, last_in)).otherwise(F.array().cast("array<bigint>"))
    starts = F.transform(regular, lambda i: F.col("_d0") + i * step)
    return F.when((tail > last + 1e-9) & (F.col(km) >= tail), F.concat(starts, F.array(tail))).otherwise(starts)


def distance_members(df: DataFrame, keys: list[str], km: str, idx: str, length: float, overlap: float = 0.0, min_rows: int = 8) -> DataFrame:
    """Every line with each distance segment that holds it: start_km, i0, i1.

    All windows have the keys of the track in front, so one shuffle on the keys serves them all.
    """
    w = Window.partitionBy(*keys)
    d = df.where(F.col(km).isNotNull()).withColumn("_total", F.max(km).over(w)).withColumn("_d0", F.min(km).over(w))
    m = d.withColumn("start_km", F.explode(_starts(km, length, length * (1 - overlap)))).drop("_total", "_d0")
    seg = Window.partitionBy(*keys, "start_km")
    m = m.withColumn("i0", F.min(idx).over(seg)).withColumn("i1", F.max(idx).over(seg) + 1).where(F.col("i1") - F.col("i0") >= min_rows)
    first = F.min("start_km").over(Window.partitionBy(*keys, "i1"))
    return m.withColumn("_first", first).where(F.col("start_km") == F.col("_first")).drop("_first")


def distance_segments(df: DataFrame, keys: list[str], km: str, idx: str, length: float, overlap: float = 0.0, min_rows: int = 8) -> DataFrame:
    """(keys, start_km, i0, i1): segments of ``length`` km, the tail of the track always covered.

    Starts lie every length * (1 - overlap) km while a whole segment fits, a shorter track is one
    segment; of segments that end at the same row the first stays, short ones drop out.
    """
    w = Window.partitionBy(*keys)
    d = df.where(F.col(km).isNotNull()).withColumn("_total", F.max(km).over(w)).withColumn("_d0", F.min(km).over(w))
    member = d.select(*keys, idx, F.explode(_starts(km, length, length * (1 - overlap))).alias("start_km"))
    seg = member.groupBy(*keys, "start_km").agg(F.min(idx).alias("i0"), (F.max(idx) + 1).alias("i1")).where(F.col("i1") - F.col("i0") >= min_rows)
    return seg.groupBy(*keys, "i1").agg(F.min(F.struct("start_km", "i0")).alias("s")).select(*keys, "s.start_km", "s.i0", "i1")


def swath_axis(lines: DataFrame, group: list[str], pixel: str, order: str, lat: str, lon: str) -> DataFrame:
    """(group, order, lat, lon, km, n_columns): one row for every line of a swath, whether it is in
    the table or not, on the track of its middle column (of the middle one of those with any position,
    if that has none).

    Missing positions are interpolated by line, longitudes the short way round, and held at the ends.
    Everything is one row per line of one column, a small part of the swath.
    """
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    cols = lines.groupBy(*group, pixel).agg(F.count_if(known).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    c, v = F.col("_c"), F.filter("_c", lambda x: x["n"] > 0)
    mid, other = F.get(c, F.floor(F.size(c) / 2).cast("int")), F.get(v, F.floor(F.size(v) / 2).cast("int"))
    ref = cols.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(pixel).alias("p"), F.col("_n").alias("n")))).alias("_c"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    ref = ref.select(*group, F.when(mid["n"] > 0, mid["p"]).otherwise(other["p"]).alias(pixel), "_lo", "_hi", F.size(c).alias("n_columns"))
    track = lines.where(known).select(*group, pixel, order, F.col(lat).alias("lat"), F.col(lon).alias("lon")).join(ref, [*group, pixel])
    w = Window.partitionBy(*group).orderBy(order)
    d = track.withColumn("_next", F.lead(order).over(w)).withColumn("_lat", F.lead("lat").over(w)).withColumn("_lon", F.lead("lon").over(w))
    begin = F.when(F.lag(order).over(w).isNull(), F.col("_lo")).otherwise(F.col(order))
    d = d.withColumn("_from", begin).withColumn("_to", F.when(F.col("_next").isNull(), F.col("_hi")).otherwise(F.col("_next") - 1)).where("_from <= _to")
    d = d.withColumn("_line", F.explode(F.sequence("_from", "_to")))
    t = F.when(F.col("_next").isNotNull() & (F.col("_line") > F.col(order)), (F.col("_line") - F.col(order)) / (F.col("_next") - F.col(order))).otherwise(0.0)
    short = F.pmod(F.col("_lon") - F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    d = d.select(
        *group, F.col("_line").alias(order), (F.col("lat") + F.coalesce(F.col("_lat") - F.col("lat"), F.lit(0.0)) * t).alias("lat"), (F.col("lon") + F.coalesce(short, F.lit(0.0)) * t).alias("lon"), "n_columns"
    )
    return along_track_km(d, group, order, "lat", "lon")


def segment_axis(lines: DataFrame, group: list[str], pixel: str, order: str, lat: str, lon: str, length: float, overlap: float = 0.0, dx: float | None = None, default_dx: float = 2.0) -> DataFrame:
    """(group, order, km, dx, n_columns, segments): every line of a swath with the distance segments that
    hold it: structs of segment_index, i0, i1 (lines, half-open), first_km, last_km, n_total.

    dx is the median of the positive steps of the track unless it is given.
    """
    axis = swath_axis(lines, group, pixel, order, lat, lon)
    g, w = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(order)
    step = F.col("km") - F.lag("km").over(w)
    axis = axis.withColumn("_step", F.when(step > 0, step))
    axis = axis.withColumn("dx", F.lit(float(dx)) if dx else F.coalesce(F.percentile("_step", 0.5).over(g), F.lit(default_dx)))
    m = distance_members(axis.drop("_step", "lat", "lon"), group, "km", order, length, overlap)
    seg = Window.partitionBy(*group, "start_km")
    number = F.dense_rank().over(Window.partitionBy(*group).orderBy("start_km")) - 1
    m = m.withColumn("first_km", F.min("km").over(seg)).withColumn("last_km", F.max("km").over(seg)).withColumn("segment_index", number.cast("int"))
    m = m.withColumn("n_total", F.max("segment_index").over(g) + 1)
    return m.groupBy(*group, order, "km", "dx", "n_columns").agg(F.collect_list(F.struct("segment_index", "i0", "i1", "first_km", "last_km", "n_total")).alias("segments"))


def row_segment_starts(n: Column, rows: int, overlap: float = 0.0) -> Column:
    """Starts of segments of a fixed number of rows in a series of ``n``, the tail included."""
    step = max(1, round(rows * (1 - overlap)))
    regular = F.sequence(F.lit(0), n - rows, F.lit(step))
    return F.when(n >= rows, F.array_union(regular, F.array(n - rows))).otherwise(F.array().cast("array<int>"))


def even_starts(n: Column, rows: int, count: int) -> Column:
    """At most ``count`` starts spread evenly over the series."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (n - rows) / F.lit(max(1, count - 1)) + 1e-9).cast("int"))
    return F.when(n >= rows, F.array_distinct(grid)).otherwise(F.array().cast("array<int>"))


def segment_members(df: DataFrame, keys: list[str], idx: str, rows: int, overlap: float = 0.0) -> DataFrame:
    """Every line with each fixed-row segment (``i0``) that holds it, by arithmetic."""
    step = max(1, round(rows * (1 - overlap)))
    n = F.max(idx).over(Window.partitionBy(*keys)) + 1
    d = df.withColumn("_n", n).where(F.col("_n") >= rows)
    lo = F.greatest(F.ceil((F.col(idx) - rows + 1) / step), F.lit(0))
    hi = F.least(F.floor(F.col(idx) / step), F.floor((F.col("_n") - rows) / step))
    regular = F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda i: (i * step).cast("int"))).otherwise(F.array().cast("array<int>"))
    tail = (F.col("_n") - rows).cast("int")
    starts = F.when(F.col(idx) >= tail, F.array_union(regular, F.array(tail))).otherwise(regular)
    return d.withColumn("i0", F.explode(starts)).drop("_n")


def segments_at(df: DataFrame, keys: list[str], idx: str, lat: str, targets: list[float], rows: int) -> DataFrame:
    """(keys, target, center, i0, i1): fixed-row segments centred where the track comes closest to
    each target latitude (the first of equals); those that run off the track drop out."""
    d = df.where(F.col(lat).isNotNull()).withColumn("_n", F.max(idx).over(Window.partitionBy(*keys)) + 1)
    t = d.withColumn("target", F.explode(F.array(*[F.lit(float(v)) for v in targets])))
    c = t.groupBy(*keys, "target", "_n").agg(F.min(F.struct(F.abs(F.col(lat) - F.col("target")).alias("d"), F.col(idx).alias("i"))).getField("i").alias("center"))
    return c.withColumn("i0", F.col("center") - rows // 2).withColumn("i1", F.col("i0") + rows).where((F.col("i0") >= 0) & (F.col("i1") <= F.col("_n"))).drop("_n")


def segments_around(df: DataFrame, keys: list[str], idx: str, km: str, lat: str, targets: list[float], length: float, min_rows: int = 8) -> DataFrame:
    """(keys, target, center, i0, i1): segments of ``length`` km centred where the track comes closest to
    each target latitude (the first of equals); those that run off the track or hold too few lines
    drop out. One window and one aggregate on the track's keys; the targets are a literal."""
    g = Window.partitionBy(*keys)
    d = df.where(F.col(lat).isNotNull() & F.col(km).isNotNull()).withColumn("_a", F.min(km).over(g)).withColumn("_b", F.max(km).over(g))
    t = d.withColumn("target", F.explode(F.array(*[F.lit(float(v)) for v in targets])))
    w = Window.partitionBy(*keys, "target")
    best = F.min(F.struct(F.abs(F.col(lat) - F.col("target")).alias("d"), F.col(idx).alias("i"), F.col(km).alias("k"))).over(w)
    t = t.withColumn("_c", best)
    lo, hi = F.col("_c.k") - length / 2, F.col("_c.k") + length / 2
    t = t.where((lo >= F.col("_a")) & (hi <= F.col("_b")) & (F.col(km) >= lo) & (F.col(km) <= hi))
    out = t.groupBy(*keys, "target").agg(F.max("_c.i").alias("center"), F.min(idx).alias("i0"), (F.max(idx) + 1).alias("i1"))
    return out.where(F.col("i1") - F.col("i0") >= min_rows)


def spread_targets(targets: list[float], count: int | None) -> list[float]:
    """At most ``count`` of the targets, evenly by position."""
    if count is None or len(targets) <= count:
        return list(targets)
    return [targets[i] for i in np.linspace(0, len(targets) - 1, count).round().astype(int)]


# --- detrending and filters --------------------------------------------------------------------


def detrend(df: DataFrame, keys: list[str], x: str, value: str, kind: str = "linear", name: str | None = None) -> DataFrame:
    """The value without its least-squares line, or without its mean, per series."""
    w = Window.partitionBy(*keys)
    if kind == "constant":
        return df.withColumn(name or value, F.col(value) - F.avg(value).over(w))
    if kind != "linear":
        raise ValueError("kind is linear or constant")
    y, t = F.col(value), F.when(F.col(value).isNotNull(), F.col(x).cast("double"))
    d = df.withColumn("_my", F.avg(y).over(w)).withColumn("_mt", F.avg(t).over(w))
    d = d.withColumn("_b", F.try_divide(F.sum((t - F.col("_mt")) * (y - F.col("_my"))).over(w), F.sum((t - F.col("_mt")) * (t - F.col("_mt"))).over(w)))
    return d.withColumn(name or value, y - F.col("_my") - F.coalesce("_b", F.lit(0.0)) * (t - F.col("_mt"))).drop("_my", "_mt", "_b")


def detrend_plane(df: DataFrame, group: list[str], row: str, col: str, value: str) -> DataFrame:
    """The value without its least-squares plane. On a complete grid rows and columns are
    orthogonal, so the plane is two independent regressions."""
    w = Window.partitionBy(*group)
    d = df
    for c in (row, col, value):
        d = d.withColumn(f"_m_{c}", F.avg(F.col(c).cast("double")).over(w))
    y = F.col(value) - F.col(f"_m_{value}")
    parts = []
    for c in (row, col):
        t = F.col(c) - F.col(f"_m_{c}")
        d = d.withColumn(f"_b_{c}", F.coalesce(F.try_divide(F.sum(t * y).over(w), F.sum(t * t).over(w)), F.lit(0.0)))
        parts.append(F.col(f"_b_{c}") * t)
    d = d.withColumn(value, y - parts[0] - parts[1])
    return d.drop(*[f"_m_{c}" for c in (row, col, value)], *[f"_b_{c}" for c in (row, col)])


def _dot(values: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def fir_decimate(df: DataFrame, keys: list[str], order: str, value: str, taps: list[float], every: int) -> DataFrame:
    """(keys, idx, value): the filtered series without a rim of as many rows as taps, each
    ``every``-th row of the rest."""
    n, half = len(taps), len(taps) // 2
    w = Window.partitionBy(*keys).orderBy(order)
    d = indexed(df, keys, order).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    d = d.withColumn("_x", F.collect_list(value).over(w.rowsBetween(-half, half)))
    d = d.where((F.col("idx") >= n) & (F.col("idx") < F.col("_n") - n) & ((F.col("idx") - n) % every == 0) & (F.size("_x") == n))
    return d.select(*keys, "idx", _dot(F.col("_x"), F.array(*[F.lit(float(t)) for t in taps])).alias(value))


def fir_decimate_2d(df: DataFrame, group: list[str], row: str, col: str, value: str, taps: list[float], every: int) -> DataFrame:
    """(group, row, col, value): filtered along the track and across it, without a rim of as many rows
    and columns as taps, each ``every``-th of both kept.

    The rim is wider than the reach of the filter, so what lies beyond the edges never matters.
    """
    along = fir_decimate(df, [*group, col], row, value, taps, every).withColumnRenamed("idx", row)
    return fir_decimate(along, [*group, row], col, value, taps, every).withColumnRenamed("idx", col)


def hamming_taps(n: int) -> list[float]:
    """Hamming taps of unit sum."""
    t = np.hamming(n)
    return [float(v) for v in t / t.sum()]


def savgol_trend(df: DataFrame, keys: list[str], order: str, value: str, window: int = 101, degree: int = 3, name: str = "trend") -> DataFrame:
    """Savitzky-Golay trend; at the ends the polynomial of the outermost whole window.

    The weights of every position in a window are the rows of one small hat matrix, a literal.
    Series shorter than the window have no trend.
    """
    t = np.arange(window) - window // 2
    v = np.vander(t / max(1, window // 2), degree + 1)
    hat = v @ np.linalg.pinv(v)
    weights = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in hat])
    half = window // 2
    w = Window.partitionBy(*keys).orderBy(order)
    d = indexed(df, keys, order, "_i").withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    d = d.withColumn("_x", F.collect_list(value).over(w.rowsBetween(-(window - 1), window - 1)))
    begin = F.least(F.greatest(F.col("_i") - half, F.lit(0)), F.col("_n") - window)  # first row of the window
    behind = F.col("_i") - F.least(F.col("_i"), F.lit(window - 1))  # row at the head of _x
    inside = F.slice("_x", (begin - behind + 1).cast("int"), window)
    pos = (F.col("_i") - begin + 1).cast("int")
    return d.withColumn(name, F.when(F.col("_n") >= window, _dot(inside, F.element_at(weights, pos)))).drop("_i", "_n", "_x")


# --- differences -------------------------------------------------------------------------------


def centred_slope(df: DataFrame, keys: list[str], order: str, km: str, value: str, name: str = "slope") -> DataFrame:
    """Slope from the neighbours on both sides, metres per metre; the value itself is not needed."""
    w = Window.partitionBy(*keys).orderBy(order)
    dx = F.lead(km).over(w) - F.lag(km).over(w)
    dz = F.lead(value).over(w) - F.lag(value).over(w)
    return df.withColumn(name, F.when(dx > 0, dz / dx * 1e-3))


def gradient(df: DataFrame, keys: list[str], x: str, y: Column | str | None = None, name: str = "gradient") -> DataFrame:
    """numpy's gradient: second-order inside, one-sided at the ends. Without ``y`` the gradient of
    ``x`` by position."""
    w = Window.partitionBy(*keys).orderBy(x)
    if y is None:
        up, down = F.lead(x).over(w), F.lag(x).over(w)
        g = F.when(up.isNull(), F.col(x) - down).when(down.isNull(), up - F.col(x)).otherwise((up - down) / 2)
        return df.withColumn(name, g)
    y = F.col(y) if isinstance(y, str) else y
    d = df.withColumn("_y", y)
    hs, hd = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    yl, yr = F.lag("_y").over(w), F.lead("_y").over(w)
    inner = (hs * hs * yr + (hd * hd - hs * hs) * F.col("_y") - hd * hd * yl) / (hs * hd * (hd + hs))
    g = F.when(hs.isNull(), F.try_divide(yr - F.col("_y"), hd)).when(hd.isNull(), F.try_divide(F.col("_y") - yl, hs)).otherwise(inner)
    return d.withColumn(name, g).drop("_y")


def median_spacing(df: DataFrame, keys: list[str], order: str, km: str, default: float = 2.0) -> DataFrame:
    """(keys, spacing): median of the positive steps."""
    step = F.col(km) - F.lag(km).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_s", step).groupBy(*keys).agg(F.coalesce(F.percentile(F.when(F.col("_s") > 0, F.col("_s")), 0.5), F.lit(default)).alias("spacing"))


# --- matching ----------------------------------------------------------------------------------


def resample(points: DataFrame, targets: DataFrame, keys: list[str], x: str, y: str, outside: str = "null") -> DataFrame:
    """(keys, x, y): ``points`` interpolated at the x of ``targets`` (same keys).

    Points and targets are sorted together, an as-of join in both directions.  Outside the points
    the result is null, zero, or with 'clamp' the nearest end's value.
    """
    p = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(0).alias("_t")).where("_y is not null")
    t = targets.select(*keys, F.col(x).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_t"))
    w = Window.partitionBy(*keys).orderBy("_x", "_t")
    here = F.when(F.col("_t") == 0, F.struct("_x", "_y"))
    d = p.unionByName(t).withColumn("_p", F.last(here, ignorenulls=True).over(w.rowsBetween(_UP, 0))).withColumn("_n", F.first(here, ignorenulls=True).over(w.rowsBetween(0, _DOWN)))
    exact = F.col("_p._x") == F.col("_x")
    blend = F.col("_p._y") + (F.col("_n._y") - F.col("_p._y")) * (F.col("_x") - F.col("_p._x")) / (F.col("_n._x") - F.col("_p._x"))
    out = F.when(exact, F.col("_p._y")).when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), blend)
    if outside == "zero":
        out = F.coalesce(out, F.lit(0.0))
    elif outside == "clamp":
        out = F.coalesce(out, F.col("_p._y"), F.col("_n._y"))
    elif outside != "null":
        raise ValueError("outside is null, zero or clamp")
    return d.where("_t = 1").select(*keys, F.col("_x").alias(x), out.alias(y))


def nearest_line(points: DataFrame, lines: DataFrame, keys: list[str], point_cols: list[str], lat: tuple[str, str], lon: tuple[str, str], idx: str, block: int = 64) -> DataFrame:
    """The line nearest to each point within the same keys, the first of equals.

    Points meet blocks of ``block`` neighbouring lines, each with a centre and the radius that holds its
    lines; only blocks that can hold the nearest line are opened. Exact whatever the track does.
    """
    p = points.select(*keys, *point_cols, F.col(lat[0]).alias("_a"), F.col(lon[0]).alias("_o")).where("_a is not null and _o is not null")
    q = lines.select(*keys, F.col(idx).alias("_i"), F.col(lat[1]).alias("_b"), F.col(lon[1]).alias("_u"), F.floor(F.col(idx) / block).alias("_k")).where("_b is not null and _u is not null")
    w = Window.partitionBy(*keys, "_k")
    centre = F.min(F.struct("_i", "_b", "_u")).over(w)
    q = q.withColumn("_m", centre).withColumn("_r", haversine_km(F.col("_m._b"), F.col("_m._u"), F.col("_b"), F.col("_u")))
    blocks = q.groupBy(*keys, "_k").agg(F.max("_r").alias("_r"), F.first("_m").alias("_m"))
    far = haversine_km(F.col("_a"), F.col("_o"), F.col("_m._b"), F.col("_m._u"))
    near = p.join(blocks, keys).withColumn("_lo", far - F.col("_r") - 1e-6).withColumn("_hi", far + F.col("_r") + 1e-6)
    near = near.withColumn("_best", F.min("_hi").over(Window.partitionBy(*keys, *point_cols))).where("_lo <= _best").select(*keys, *point_cols, "_a", "_o", "_k")
    pairs = near.join(q.select(*keys, "_k", "_i", "_b", "_u"), [*keys, "_k"]).withColumn("_km", haversine_km(F.col("_a"), F.col("_o"), F.col("_b"), F.col("_u")))
    return pairs.groupBy(*keys, *point_cols).agg(F.min(F.struct("_km", "_i")).alias("m")).select(*keys, *point_cols, F.col("m._i").alias(idx), F.col("m._km").alias("km"))


def rounded_semi(left: DataFrame, right: DataFrame, keys: list[str], left_col: str, right_col: str, digits: int = 2) -> DataFrame:
    """Rows of ``left`` whose rounded value occurs in ``right`` under the same keys."""
    unit = 10.0**digits
    r = right.select(*keys, F.floor(F.col(right_col) * unit + 0.5).alias("_r")).distinct()
    return left.withColumn("_r", F.floor(F.col(left_col) * unit + 0.5)).join(r, [*keys, "_r"], "left_semi").drop("_r")


# --- swaths ------------------------------------------------------------------------------------


def split_swaths(df: DataFrame, group: list[str], pixel: str, xt: str) -> DataFrame:
    """swath of each pixel column from the sign of its median distance; 0 and missing are neither."""
    med = F.percentile(xt, 0.5).over(Window.partitionBy(*group, pixel))
    return df.withColumn("_m", med).withColumn("swath", F.when(F.col("_m") < 0, "left").when(F.col("_m") > 0, "right")).drop("_m")


def trim_swaths(df: DataFrame, group: list[str], xt: str, edge: float, both: bool = False) -> DataFrame:
    """Rows at least ``edge`` inside the outer edge of their swath, with ``both`` the inner one too."""
    sided = df.where("swath is not null")
    edges = sided.groupBy(*group, "swath").agg(F.max(F.abs(xt)).alias("_hi"), F.min(F.abs(xt)).alias("_lo"))
    keep = F.abs(xt) <= F.col("_hi") - edge
    if both:
        keep = keep & (F.abs(xt) >= F.col("_lo") + edge)
    return sided.join(edges, [*group, "swath"]).where(keep).drop("_hi", "_lo")


def trim_swaths_median(df: DataFrame, group: list[str], pixel: str, xt: str, edges: float) -> DataFrame:
    """Rows of the columns strictly within half the swath's width less ``edges``, floored, of the median
    of its columns' distances, on both sides of it."""
    cols = df.where("swath is not null").groupBy(*group, "swath", pixel).agg(F.percentile(xt, 0.5).alias("_x"))
    w = Window.partitionBy(*group, "swath")
    half = F.floor((F.max("_x").over(w) - F.min("_x").over(w) - edges) / 2)
    off = F.abs(F.col("_x") - F.percentile("_x", 0.5).over(w))
    keep = cols.withColumn("_in", off < half).where("_in").select(*group, "swath", pixel)
    return df.join(keep, [*group, "swath", pixel], "left_semi")


def trim_pixels(df: DataFrame, group: list[str], pixel: str, n: int) -> DataFrame:
    """Rows without the first and last ``n`` pixel columns of each group."""
    ends = df.groupBy(*group).agg(F.min(pixel).alias("_a"), F.max(pixel).alias("_b"))
    return df.join(ends, group).where((F.col(pixel) >= F.col("_a") + n) & (F.col(pixel) <= F.col("_b") - n)).drop("_a", "_b")


def across_between(df: DataFrame, xt: str, lo: float, hi: float) -> DataFrame:
    """Rows whose distance from the track is in [lo, hi)."""
    return df.where((F.abs(xt) >= lo) & (F.abs(xt) < hi))


def valid_groups(df: DataFrame, group: list[str], value: str, share: float, min_rows: int = 1) -> DataFrame:
    """(group, f, n): groups (columns or lines) with at least ``share`` of their values and enough rows."""
    g = df.groupBy(*group).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("f"), F.count("*").alias("n"))
    return g.where((F.col("f") >= share) & (F.col("n") >= min_rows))


def every_nth(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Each ``n``-th row of every series, the first among them."""
    return indexed(df, keys, order, "_i").where(F.col("_i") % n == 0).drop("_i")


def nadir_gap(df: DataFrame, group: list[str], pixel: str, value: str, min_valid: float) -> DataFrame:
    """(group, gap_start, gap_end): pixels between the two longest regions of mostly valid columns."""
    cols = df.groupBy(*group, pixel).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("v"))
    regions = runs(cols, group, pixel, F.col("v") > min_valid, step=pixel).groupBy(*group, "run").agg(F.min(pixel).alias("a"), F.max(pixel).alias("b"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy((F.col("a") - F.col("b")), "a"))
    top = regions.withColumn("r", rank).where("r <= 2").groupBy(*group).agg(F.count("*").alias("n"), F.min("b").alias("b"), F.max("a").alias("a"))
    return top.where("n = 2").select(*group, (F.col("b") + 1).alias("gap_start"), (F.col("a") - 1).alias("gap_end"))
