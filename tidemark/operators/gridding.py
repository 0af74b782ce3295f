"""Grids, boxes and latitude bins: sums and counts that merge.

Every accumulation is one groupBy on computed integer keys; Catalyst splits it into a partial and a
final aggregate, so what is shuffled has the size of the grid, not of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(x: Column, lo: float, step: float) -> Column:
    """Index of the half-open cell; outside cells are not ruled out here."""
    return F.floor((x - lo) / step).cast("int")


def grid_accumulate(df: DataFrame, lat: str, lon: str, value: str, step: float, lat_range=(-60.0, 60.0), lon_range=(-180.0, 180.0), clip: bool = False, keys: tuple[str, ...] = (), squares: bool = False) -> DataFrame:
    """(keys, ilat, ilon, total, n): sums and counts per cell; add ``total_sq`` with ``squares``.

    Values that are missing or infinite do not count.  Without ``clip`` a point on the upper edge is
    outside; with it the range is closed and such a point belongs to the last cell.
    """
    n_lat, n_lon = (round((r[1] - r[0]) / step) for r in (lat_range, lon_range))
    ilat, ilon = cell(F.col(lat), lat_range[0], step), cell(F.col(lon), lon_range[0], step)
    x = df.where(F.col(value).isNotNull() & (F.abs(F.col(value)) < float("inf")))
    if clip:
        x = x.where(F.col(lat).between(*lat_range) & F.col(lon).between(*lon_range))
        ilat, ilon = (F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)) for i, n in ((ilat, n_lat), (ilon, n_lon)))
    x = x.withColumn("ilat", ilat).withColumn("ilon", ilon)
    x = x.where(F.col("ilat").between(0, n_lat - 1) & F.col("ilon").between(0, n_lon - 1))
    more = [F.sum(F.col(value) * F.col(value)).alias("total_sq")] if squares else []
    return x.groupBy(*keys, "ilat", "ilon").agg(F.sum(value).alias("total"), F.count(value).alias("n"), *more)


def grid_merge(*grids: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of accumulators, cell by cell."""
    whole = grids[0]
    for g in grids[1:]:
        whole = whole.unionByName(g)
    more = [F.sum("total_sq").alias("total_sq")] if "total_sq" in whole.columns else []
    return whole.groupBy(*keys, "ilat", "ilon").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), *more)


def grid_finish(grid: DataFrame, step: float, lat0: float = -60.0, lon0: float = -180.0, digits: int | None = None) -> DataFrame:
    """Means, observation counts and cell centres of an accumulator."""
    mean = F.try_divide(F.col("total"), F.col("n"))
    more = [F.try_divide(F.col("total_sq"), F.col("n")).alias("mean_sq")] if "total_sq" in grid.columns else []
    return grid.select(
        *[c for c in grid.columns if c not in ("total", "n", "total_sq")],
        (lat0 + (F.col("ilat") + 0.5) * step).alias("lat_center"),
        (lon0 + (F.col("ilon") + 0.5) * step).alias("lon_center"),
        (F.round(mean, digits) if digits is not None else mean).alias("mean"),
        F.col("n").alias("nobs"),
        *more,
    )


def grid_densify(grid: DataFrame, n_lat: int, n_lon: int) -> DataFrame:
    """All cells of the grid, empty ones with a null total and no observations."""
    spark = grid.sparkSession
    axes = spark.range(n_lat * n_lon).select((F.col("id") / n_lon).cast("int").alias("ilat"), (F.col("id") % n_lon).cast("int").alias("ilon"))
    return axes.join(grid, ["ilat", "ilon"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def roi(df: DataFrame, lat: str, lon: str, lat_min: float | None = None, lat_max: float | None = None, lon_min: float | None = None, lon_max: float | None = None) -> DataFrame:
    """Rows inside a region, edges included; a bound that is not given does not bind, and rows without
    the coordinate it is about stay."""
    for c, bound, above in ((lat, lat_min, True), (lat, lat_max, False), (lon, lon_min, True), (lon, lon_max, False)):
        if bound is not None:
            df = df.where(F.col(c).isNull() | (F.col(c) >= bound if above else F.col(c) <= bound))
    return df


def zone(df: DataFrame, lat: str, lo: float, hi: float) -> DataFrame:
    """Rows of a zone of latitude, lo < lat <= hi."""
    return df.where((F.col(lat) > lo) & (F.col(lat) <= hi))


def zoom(df: DataFrame, lat: str, lon: str, value: str, lat_range: tuple[float, float], lon_range: tuple[float, float]) -> DataFrame:
    """Rows of a bounding box that have a value, so that empty lines and columns are gone."""
    return df.where(F.col(lat).between(*lat_range) & F.col(lon).between(*lon_range) & F.col(value).isNotNull())


def box_keys(df: DataFrame, lat: str, lon: str, box: float) -> DataFrame:
    """ilat, ilon of boxes that begin at 0 degrees; rows without position drop out."""
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)).withColumn("ilat", F.floor(F.col(lat) / box).cast("int")).withColumn(
        "ilon", F.floor(F.col(lon) / box).cast("int")
    )


def sampling_filter(boxes: DataFrame, fraction: float, n: str = "n_segments") -> DataFrame:
    """Rows of boxes with at least ``fraction`` of the fullest box's count, and that share.

    The fullest count comes from all boxes before any is dropped; it is one row.
    """
    top = boxes.agg(F.max(n).alias("_top"))
    return boxes.join(F.broadcast(top)).withColumn("sampling_fraction", F.col(n) / F.col("_top")).where(F.col(n) >= fraction * F.col("_top")).drop("_top")


def box_mean_spectra(segments: DataFrame, lat: str, lon: str, k: str, psds: list[str], box: float = 2.0, fraction: float | None = None, min_count: int | None = None) -> DataFrame:
    """(ilat, ilon, lat_center, lon_center, n_segments, ik, k, mean_<psd>): mean spectra of boxes.

    The count is of segments, whether or not a value is missing; the mean per wavenumber skips
    missing values.  ``fraction`` and ``min_count`` filter boxes by their count.  Counts come from
    the same aggregation as the means: a segment's first value, or its one row if it has none,
    stands for it.
    """
    zipped = F.arrays_zip(F.col(k).alias("k"), *[F.col(p).alias(p) for p in psds])
    long = box_keys(segments, lat, lon, box).select("ilat", "ilon", F.posexplode_outer(zipped).alias("ik", "z"))
    whole = F.coalesce("ik", F.lit(0))
    means = long.groupBy("ilat", "ilon", whole.alias("ik")).agg(
        F.count("*").alias("_n"), F.count("ik").alias("_values"), F.max("z.k").alias("k"), *[F.avg(F.when(~F.isnan(f"z.{p}"), F.col(f"z.{p}").cast("double"))).alias(f"mean_{p}") for p in psds]
    )
    # every segment has exactly one row of index 0
    counts = F.max(F.when(F.col("ik") == 0, F.col("_n"))).over(Window.partitionBy("ilat", "ilon"))
    boxes = means.withColumn("n_segments", counts).where("_values > 0").drop("_n", "_values")
    if fraction is not None:
        boxes = sampling_filter(boxes, fraction)
    if min_count is not None:
        boxes = boxes.where(F.col("n_segments") >= min_count)
    return boxes.withColumn("lat_center", (F.col("ilat") + 0.5) * box).withColumn("lon_center", (F.col("ilon") + 0.5) * box)


def box_mean_scalar(df: DataFrame, lat: str, lon: str, value: str, box: float = 2.0) -> DataFrame:
    """Mean and count of a scalar per box."""
    return (
        box_keys(df, lat, lon, box)
        .groupBy("ilat", "ilon")
        .agg(F.avg(value).alias("mean"), F.count(value).alias("n_segments"))
        .withColumn("lat_center", (F.col("ilat") + 0.5) * box)
        .withColumn("lon_center", (F.col("ilon") + 0.5) * box)
    )


def lat_bin(lat: Column, lo: float, width: float, n: int, closed: str = "right") -> Column:
    """Bin number; (lo, hi] with closed 'right', [lo, hi) with 'left'; NULL outside."""
    i = (F.ceil((lat - lo) / width) - 1) if closed == "right" else F.floor((lat - lo) / width)
    return F.when(i.between(0, n - 1), i.cast("int"))


def closed_lat_bins(df: DataFrame, lat: str, lo: float, width: float, n: int) -> DataFrame:
    """Bin numbers of [lo, hi] bins: a point on an inner edge belongs to both its bins."""
    x = (F.col(lat) - lo) / width
    ids = F.array_distinct(F.array(F.floor(x), F.ceil(x) - 1).cast("array<int>"))
    return df.withColumn("bin", F.explode(ids)).where(F.col("bin").between(0, n - 1))


def dilate_mask(cells: DataFrame, bad: Column, reach: int, row: str = "ilat", col: str = "ilon") -> DataFrame:
    """Cells no bad cell lies within ``reach`` four-neighbour steps of.

    Each bad cell marks the diamond around it, an explode of fixed size, instead of a range join.
    """
    offsets = F.flatten(
        F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda i: F.transform(F.sequence(F.abs(i) - reach, reach - F.abs(i)), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )
    near = cells.where(bad).select(F.col(row).alias("_r"), F.col(col).alias("_c"), F.explode(offsets).alias("o"))
    near = near.select((F.col("_r") + F.col("o.i")).cast("int").alias(row), (F.col("_c") + F.col("o.j")).cast("int").alias(col)).distinct()
    return cells.where(~bad).join(near, [row, col], "left_anti")


def global_counters(df: DataFrame, ok: Column, valid: Column) -> DataFrame:
    """One row: rows used, rows skipped, valid values."""
    return df.agg(F.count_if(ok).alias("used"), F.count_if(~ok).alias("skipped"), F.count_if(ok & valid).alias("n_valid"))

