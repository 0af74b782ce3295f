"""Problem 5: points near other points or inside regions.

Positions become points on the sphere in three dimensions, cut into cubic cells whose identifiers
interleave the bits of the three cell numbers (a Morton curve).  In three dimensions neither the
poles nor the date line nor the longitude convention needs care.  A disc is covered by the at most
eight cells that its bounding cube meets, at the level whose cells are just wider than the disc;
each covering cell is one range of codes of the finest level.  Points and ranges meet in a range
join: equal on a coarser prefix of the code (and on any grouping column), inside the range, then
refined by the exact great-circle distance.  Both sides are shuffled on that prefix; nothing is
broadcast by hand and adaptive execution splits prefixes that hold very many points.

Defined cases: null, NaN or infinite coordinates, latitudes beyond the poles and null ids or radii
are in no pair; repeated rows count once; a pair exactly at the distance counts; a negative radius
holds nothing; empty tables give no pairs; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import EARTH_KM, haversine_km

_BITS = 21  # cells per axis: 2**21, edges of about 6 m


def finite(*cols: str) -> Column:
    """All the columns are numbers: neither null nor NaN nor infinite."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e300)
    return out


def _spread(x: Column) -> Column:
    """Bits of a 21-bit number, two zero bits between each: its binary digits read as octal ones."""
    return F.conv(F.bin(x), 8, 10).cast("long")


def morton(ix: Column, iy: Column, iz: Column) -> Column:
    """Interleaved code of three cell numbers."""
    return _spread(ix).bitwiseOR(F.shiftleft(_spread(iy), 1)).bitwiseOR(F.shiftleft(_spread(iz), 2))


def _axes(lat: Column, lon: Column) -> list[Column]:
    """Position in the unit cube."""
    la, lo = F.radians(lat), F.radians(lon)
    return [(c + 1) / 2 for c in (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))]


def _cell(u: Column, level: Column | int) -> Column:
    n = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    return F.greatest(F.lit(0.0), F.least(F.floor(u * n), n - 1)).cast("long")


def cell_code(lat: Column, lon: Column) -> Column:
    """Code of the finest cell that holds the position."""
    return morton(*(_cell(u, _BITS) for u in _axes(lat, lon)))


def _half_chord(km: Column) -> Column:
    """Radius of a disc of ``km`` along the sphere, in units of the cube's edge, a little wider."""
    angle = F.least(km / EARTH_KM, F.lit(math.pi))
    return F.sin(angle / 2) + 1e-9


def cover(discs: DataFrame, lat: Column, lon: Column, km: Column) -> DataFrame:
    """One row per covering cell: level, lo, hi (codes lo <= code <= hi), at most eight a disc."""
    r = _half_chord(km)
    level = F.greatest(F.lit(1), F.least(F.lit(_BITS - 1), F.floor(-F.log2(2 * r)))).cast("int")
    x = discs.withColumn("_r", r).withColumn("_level", level)
    axes = _axes(lat, lon)
    for name, u in zip("xyz", axes):
        lo, hi = _cell(u - F.col("_r"), F.col("_level")), _cell(u + F.col("_r"), F.col("_level"))
        x = x.withColumn(f"_{name}", F.explode(F.sequence(lo, hi)))
    code = morton(F.col("_x"), F.col("_y"), F.col("_z"))
    shift = "cast(3 * (%d - _level) as int)" % _BITS
    return (
        x.withColumn("_code", code)
        .withColumn("lo", F.expr(f"shiftleft(_code, {shift})"))
        .withColumn("hi", F.expr(f"shiftleft(_code, {shift}) | (shiftleft(1L, {shift}) - 1)"))
        .withColumnRenamed("_level", "level")
        .drop("_r", "_x", "_y", "_z", "_code")
    )


def _prefix(code: str, level: Column | int) -> Column:
    lv = level if isinstance(level, int) else None
    if lv is not None:
        return F.shiftright(F.col(code), 3 * (_BITS - lv))
    return F.expr(f"shiftright({code}, cast(3 * ({_BITS} - level) as int))")


def near_pairs(points: DataFrame, km: float, id_col: str, lat_col: str, lon_col: str, group_col: str) -> DataFrame:
    """(group, id, other_id, km): pairs of different ids of a group at most ``km`` apart, each once,
    the smaller id first."""
    p = (
        points.select(
            F.col(id_col).alias("id"), F.col(group_col).alias("g"), F.col(lat_col).cast("double").alias("lat"), F.col(lon_col).cast("double").alias("lon")
        )
        .where(F.col("id").isNotNull() & F.col("g").isNotNull() & finite("lat", "lon") & (F.abs("lat") <= 90))
        .dropDuplicates(["id", "g", "lat", "lon"])
    )
    level = max(1, min(_BITS - 1, math.floor(-math.log2(2 * (math.sin(min(km / EARTH_KM, math.pi) / 2) + 1e-9)))))
    left = cover(p, F.col("lat"), F.col("lon"), F.lit(float(km))).select(
        "g", F.col("id").alias("id1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "lo", "hi", _prefix("lo", level).alias("cell")
    )
    right = p.withColumn("code", cell_code(F.col("lat"), F.col("lon"))).withColumn("cell", _prefix("code", level))
    return (
        left.join(right, ["g", "cell"])
        .where("id1 < id and code >= lo and code <= hi")
        .withColumn("km", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")))
        .where(F.col("km") <= km)
        .select(F.col("g").alias("group"), F.col("id1").alias("id"), F.col("id").alias("other_id"), "km")
        .dropDuplicates(["group", "id", "other_id"])
    )


def within_regions(
    points: DataFrame,
    regions: DataFrame,
    id_col: str,
    lat_col: str,
    lon_col: str,
    region_id: str,
    region_lat: str,
    region_lon: str,
    region_km: str,
) -> DataFrame:
    """(id, region_id, km): points at most a region's own radius from its centre.

    Regions are covered at the level that fits each; a point takes part once per level in use, and
    those levels come from the data by one aggregate.
    """
    r = (
        regions.select(
            F.col(region_id).alias("rid"), F.col(region_lat).cast("double").alias("rlat"), F.col(region_lon).cast("double").alias("rlon"), F.col(region_km).cast("double").alias("rkm")
        )
        .where(F.col("rid").isNotNull() & finite("rlat", "rlon", "rkm") & (F.abs("rlat") <= 90) & (F.col("rkm") >= 0))
        .dropDuplicates()
    )
    ranges = cover(r, F.col("rlat"), F.col("rlon"), F.col("rkm")).withColumn("cell", _prefix("lo", F.col("level")))
    p = (
        points.select(F.col(id_col).alias("id"), F.col(lat_col).cast("double").alias("lat"), F.col(lon_col).cast("double").alias("lon"))
        .where(F.col("id").isNotNull() & finite("lat", "lon") & (F.abs("lat") <= 90))
        .dropDuplicates(["id", "lat", "lon"])
        .withColumn("code", cell_code(F.col("lat"), F.col("lon")))
    )
    used = F.broadcast(ranges.agg(F.collect_set("level").alias("levels")))  # one row, at most _BITS levels
    placed = p.join(used).withColumn("level", F.explode("levels")).withColumn("cell", _prefix("code", F.col("level"))).drop("levels")
    return (
        placed.join(ranges, ["level", "cell"])
        .where("code >= lo and code <= hi")
        .withColumn("km", haversine_km(F.col("rlat"), F.col("rlon"), F.col("lat"), F.col("lon")))
        .where("km <= rkm")
        .select("id", F.col("rid").alias("region_id"), "km")
        .dropDuplicates(["id", "region_id"])
    )


def segments_near(segments: DataFrame, sites: DataFrame, km: float = 10.0) -> DataFrame:
    """(pair_kind, segment_id, other_id): close segments of a run and sites that hold a segment."""
    pairs = near_pairs(segments, km, "segment_id", "lat_mean", "lon_mean", "run_id")
    held = within_regions(segments, sites, "segment_id", "lat_mean", "lon_mean", "site_id", "latitude", "longitude", "radius_km")

    def named(df: DataFrame, kind: str, other: str) -> DataFrame:
        return df.select(F.lit(kind).alias("pair_kind"), F.col("id").cast("long").alias("segment_id"), F.col(other).cast("long").alias("other_id"))

    return named(pairs, "segment", "other_id").unionByName(named(held, "site", "region_id"))
