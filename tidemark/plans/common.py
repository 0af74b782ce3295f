"""Tables and SQL fragments shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geo import lon_180
from tidemark.operators import repeats
from tidemark.schema import null_nan, nulls_for_nans
from tidemark.sources import granules

PIXEL_COLUMNS = [
    "obs_id", "granule", "run_id", "pass_no", "line_no", "pixel_no", "latitude", "longitude", "cross_track_distance",
    "ssha_karin_2", "ssha_karin_2_qual", "height_cor_xover", "internal_tide_hret",
    "ancillary_surface_classification_flag", "surface_type", "swh_karin", "swh_karin_qual",
]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pixels(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    return granules.read_pixels(spark, f"{d}/swot_pixels.parquet", columns or PIXEL_COLUMNS)


def _screened(df: DataFrame) -> DataFrame:
    return df.withColumn("ssh", F.when(F.abs("ssh") < 2.5, F.col("ssh")))


def heights(spark: SparkSession, d: str, other: list[str] | None = None) -> DataFrame:
    """Expert scan of the pixel table with implausible heights screened out, rows brought together by
    series."""
    raw = nulls_for_nans(table(spark, d, "swot_pixels").select(*PIXEL_COLUMNS))
    return granules.by_series(_screened(granules.expert_scan(raw, other=other)))


def points(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """(obs_id, latitude, longitude, lon, ssh, columns): heights for operators that need no series; rows stay
    where they are read, only repeats move."""
    raw = nulls_for_nans(table(spark, d, "swot_pixels").select(*PIXEL_COLUMNS))
    x = _screened(granules.expert_scan(raw)).select("obs_id", "latitude", "longitude", lon_180(F.col("longitude")).alias("lon"), "ssh", *columns)
    return repeats.distinct_rows(x, "obs_id", table(spark, d, "swot_pixels"))


def segments(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Segments once each, positions with NaN as NULL, longitudes in [-180, 180)."""
    keep = ["segment_id", "granule", "run_id", "swath", "lat_mean", "lon_mean", "month", "data_year", *columns]
    once = repeats.latest(table(spark, d, "segment_spectra").select(*dict.fromkeys(keep), "processed_at"), "segment_id", "processed_at")
    lon = F.pmod(F.col("lon_mean") + 180.0, F.lit(360.0)) - 180.0
    return once.withColumn("swath", F.lower(F.trim("swath"))).withColumn("lat_mean", null_nan("lat_mean")).withColumn("lon_mean", null_nan(lon))


def measured(c) -> Column:
    """Whether a spectral value enters statistics: null, NaN, infinite and negative ones do not; no size is too large."""
    c = F.col(c) if isinstance(c, str) else c
    return (c >= 0) & (c < float("inf"))


# --- the same in SQL ---------------------------------------------------------------------------

def nn(c: str) -> str:
    """NaN as NULL."""
    return f"case when not isnan({c}) then {c} end"


PX = f"""px as (select distinct obs_id, granule, run_id, pass_no, line_no, pixel_no, {nn('latitude')} latitude, {nn('longitude')} longitude,
  {nn('cross_track_distance')} cross_track_distance, {nn('ssha_karin_2')} ssha_karin_2, ssha_karin_2_qual, {nn('height_cor_xover')} height_cor_xover,
  {nn('internal_tide_hret')} internal_tide_hret, ancillary_surface_classification_flag, surface_type, {nn('swh_karin')} swh_karin, swh_karin_qual from swot_pixels)"""

EXP = f"""{PX}, ex as (select *, case when ssha_karin_2_qual = 0 and ancillary_surface_classification_flag = 0 and coalesce(surface_type, 0) = 0
  then ssha_karin_2 + height_cor_xover + internal_tide_hret end raw_ssh from px),
hh as (select * exclude (raw_ssh), case when abs(raw_ssh) < 25e-1 then raw_ssh end ssh from ex)"""

LON180 = "({x} + 180e0) - 360e0 * floor(({x} + 180e0) / 360e0) - 180e0"

SEG = f"""seg as (select * exclude (lat_mean, lon_mean, swath), {nn('lat_mean')} lat_mean, case when not isnan(lon_mean) then {LON180.format(x='lon_mean')} end lon_mean,
  lower(trim(swath)) swath from (select *, row_number() over (partition by segment_id order by processed_at desc) rn from segment_spectra) where rn = 1)"""

LONG = "long as (select seg.*, u.ik - 1 ik, wavenumber[u.ik] k, psd[u.ik] p from seg, unnest(range(1, 64)) u(ik) where psd is not null and psd[u.ik] is not null and not isnan(psd[u.ik]))"


def hav_sql(a1: str, a2: str, b1: str, b2: str) -> str:
    """Great-circle km; NULL where a coordinate is, which ``least(1, a)`` would lose."""
    a = f"pow(sin(radians({b1} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({b1})) * pow(sin(radians({b2} - {a2}) / 2), 2)"
    return f"2e0 * 6371.0088e0 * asin(sqrt(list_transform([{a}], lambda h: case when h > 1e0 then 1e0 else h end)[1]))"


def significant(c, digits: int = 8) -> Column:
    """Rounded to so many significant digits, for values that range over many powers of ten; halves
    are moved off the tie first, as in ``clean0``, and only whole powers of ten are used."""
    c = F.col(c) if isinstance(c, str) else c
    e = F.floor(F.log10(F.abs(c)))
    q = F.pow(F.lit(10.0), F.abs(e).cast("double"))
    m = F.round(F.when(e < 0, c * q).otherwise(c / q) + 3.3 * 10.0 ** (-digits - 1), digits - 1)
    return F.when(c == 0, F.lit(0.0)).when(e < 0, m / q).otherwise(m * q)


def significant_sql(sql: str, digits: int = 8) -> str:
    """The same in place of every ``round(x, 6) + 0e0`` of a text."""
    end = ", 6) + 0e0"
    e, q = "floor(log10(abs(v)))", "pow(1e1, abs(floor(log10(abs(v)))))"
    half = f"+ 33e-{digits + 2}, {digits - 1})"
    value = f"case when v = 0 then 0e0 when {e} < 0 then round(v * {q} {half} / {q} else round(v / {q} {half} * {q} end"
    while (at := sql.find(end)) >= 0:
        depth, i = 1, at
        while depth:
            i -= 1
            depth += {")": 1, "(": -1}.get(sql[i], 0)
        sql = f"{sql[: i - 5]}list_transform([{sql[i + 1 : at]}], lambda v: {value})[1]{sql[at + len(end) :]}"
    return sql


def clean0(c, digits: int = 6):
    """Rounded for comparison: exact halves moved off the tie first, minus zero made zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 3.3 * 10.0 ** (-digits - 2), digits) + F.lit(0.0)


def tie_free(oracle: dict[str, str]) -> dict[str, str]:
    """SQL whose ``round(x, d) + 0e0`` moves halves off the tie as ``clean0`` does."""
    for digits in (4, 6):
        oracle = {k: v.replace(f", {digits}) + 0e0", f" + 33e-{digits + 3}, {digits}) + 0e0") for k, v in oracle.items()}
    return oracle
