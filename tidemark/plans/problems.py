"""Registered queries of the general training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import schema_drift, spatial, spike_hmm
from tidemark.plans.common import hav_sql


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _all_variables(table: DataFrame) -> DataFrame:
    """The table with every variable of the product, null where no file has it, so that its schema does not
    hang on which files are there."""
    kinds = {v: "bigint" if v in _WHOLE else "string" if v == "time" else "double" for v in _NAMES.values()}
    product = [(F.col(v) if v in table.columns else F.lit(None)).cast(k).alias(v) for v, k in kinds.items()]
    return table.select("record_id", "granule", "run_id", *product, *[c for c in table.columns if c not in kinds and c not in ("record_id", "granule", "run_id")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: schema_drift.drift_log(_t(s, d, "raw_records"), _t(s, d, "granule_manifest")),
        "p1_union_table": lambda s, d: _all_variables(schema_drift.to_union_table(_t(s, d, "raw_records"))),
        "p1_rescaled": lambda s, d: schema_drift.rescale_log(_t(s, d, "raw_records"), _t(s, d, "granule_manifest")),
        "p2_found": lambda s, d: spike_hmm.implausible(_t(s, d, "swot_pixels"), _t(s, d, "qual_flags")),
        "p5_found": lambda s, d: spatial.segments_near(_t(s, d, "segment_spectra"), _t(s, d, "reference_sites")),
    }


_NUM = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\s*(mm|cm|km|m|deg)?\s*$"
_NAMES = {
    "classification_flag_surface": "ancillary_surface_classification_flag", "cor_height_xover": "height_cor_xover", "hret_internal_tide": "internal_tide_hret", "karin_swh": "swh_karin",
    "2_karin_ssha": "ssha_karin_2", "2_karin_qual_ssha": "ssha_karin_2_qual", "karin_speed_wind": "wind_speed_karin", "cross_distance_track": "cross_track_distance", "surface_type": "surface_type",
    "flag_rain": "rain_flag", "dac": "dac", "latitude": "latitude", "longitude": "longitude", "time": "time",
}
_WORDS = """list_sort(list_distinct(list_filter(list_transform(string_split(lower(regexp_replace(replace(replace(regexp_replace(k, '([a-z])([A-Z])', '\\1_\\2', 'g'), '-', '_'), '.', '_'), '_(m)$', '')), '_'),
     lambda x: case x when 'anc' then 'ancillary' when 'surf' then 'surface' when 'int' then 'internal' when 'correction' then 'cor' else x end), lambda x: x not in ('ancillary', 'm'))))"""
_WHOLE = ("rain_flag", "surface_type", "ssha_karin_2_qual")
# Every value of every whole record with its number, the metres in its own unit, and the scale of its file.
_VALUES = rf"""recs as (select granule, run_id, record_id, cast(any_value(payload) as json) j from raw_records where json_valid(payload) and json_type(payload) = 'OBJECT' group by 1, 2, 3),
kv as (select record_id, granule, run_id, k, json_extract(j, '$."' || k || '"') x from (select *, unnest(json_keys(j)) k from recs)),
tx as (select record_id, granule, run_id, case array_to_string({_WORDS}, '_') {' '.join(f"when '{a}' then '{b}'" for a, b in _NAMES.items())} end v, json_type(x) = 'OBJECT' o,
  case json_type(x) when 'OBJECT' then json_extract_string(x, '$.value') when 'ARRAY' then json_extract_string(x, '$[0]') else json_extract_string(x, '$') end t, case when json_type(x) = 'OBJECT' then json_extract_string(x, '$.units') end u from kv),
nu as materialized (select record_id, granule, run_id, v, t, case lower(t) when 'true' then 1e0 when 'false' then 0e0 {' '.join(f"when '{m}' then {i}e0" for i, m in enumerate(schema_drift.FLAG_MEANINGS))} else try_cast(regexp_extract(t, '{_NUM}', 1) as double) end n,
  case coalesce(u, regexp_extract(t, '{_NUM}', 2)) when 'mm' then 1000e0 when 'cm' then 100e0 when 'm' then 1e0 when 'km' then 1e-3 end d from tx),
fi as (select granule, v, median(abs(n)) filter (where n <> 0 and d is null) size, count(*) filter (where n is not null and d is null and regexp_matches(t, '^\s*[-+]?[0-9]+\s*$')) ints, count(*) filter (where n is not null and d is null) plain from nu group by 1, 2),
us as (select v, median(size) usual from fi where not 2 * ints > plain group by 1),
sc as (select granule, v, case when 2 * ints > plain and v in ('height_cor_xover', 'internal_tide_hret', 'swh_karin', 'dac', 'ssha_karin_2') then coalesce(pow(1e1, least(greatest(round(log10(size / usual)), 0), 3)), 1e0) else 1e0 end d from fi join us using (v))"""

ORACLE = {
    "p1_rescaled": f"""with {_VALUES}, files as (select granule, min((run_id, file_no)) f from granule_manifest group by 1)
select f[1] run_id, f[2] file_no, v variable, 1 / d factor from sc join files using (granule) where d <> 1
""",
    "p1_union_table": f"""with {_VALUES}, x as (select record_id, granule, run_id, v, t, n / coalesce(nu.d, sc.d, 1e0) n from nu left join sc using (granule, v))
select record_id, granule, run_id, max(t) filter (where v = 'time') "time", {', '.join(f"cast(max(n) filter (where v = '{v}') as {'bigint' if v in _WHOLE else 'double'}) {v}" for v in _NAMES.values() if v != 'time')} from x group by 1, 2, 3
""",
    "p1_found": """
with files as (select distinct granule, file_no from granule_manifest),
recs as (select distinct record_id, r.granule, r.run_id, f.file_no, cast(payload as json) j
         from raw_records r join files f using (granule) where json_valid(payload) and json_type(payload) = 'OBJECT'),
once as (select record_id, run_id, file_no, any_value(j) j from recs group by all),
kv as (select run_id, file_no, k, json_type(json_extract(j, '$."' || k || '"')) t from (select *, unnest(json_keys(j)) k from once)),
typed as (select run_id, file_no, k, case t when 'NULL' then null when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer'
   when 'DOUBLE' then 'decimal' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'list' else 'object' end t,
   list_sort(list_distinct(list_filter(list_transform(string_split(lower(regexp_replace(replace(replace(regexp_replace(k, '([a-z])([A-Z])', '\\1_\\2', 'g'), '-', '_'), '.', '_'), '_(m)$', '')), '_'),
     lambda x: case x when 'anc' then 'ancillary' when 'surf' then 'surface' when 'int' then 'internal' when 'correction' then 'cor' else x end), lambda x: x not in ('ancillary', 'm')))) v
   from kv),
n as (select run_id, file_no, v, k, t, count(*) n from typed group by all),
var as (select run_id, file_no, v, min(k) k, arg_max(t, (n, t)) filter (where t is not null) t from n group by all),
seq as (select *, dense_rank() over (partition by run_id order by file_no) s from var),
last as (select run_id, file_no, s from seq group by all),
w as (select *, lag(s) over p ps, lead(s) over p ns, lag(k) over p pk from seq window p as (partition by run_id, v order by s)),
isl as (select *, sum(case when ps = s - 1 then 0 else 1 end) over (partition by run_id, v order by s) isle from w),
ty as (select *, last_value(t ignore nulls) over (partition by run_id, v, isle order by s rows between unbounded preceding and 1 preceding) pt from isl)
select run_id, file_no, 'added' change_kind, '' old_name, k new_name from ty where s > 1 and (ps is null or ps < s - 1)
union all select run_id, file_no, 'renamed', pk, k from ty where ps = s - 1 and pk <> k
union all select run_id, file_no, 'retyped', pk, k from ty where t <> pt
union all select ty.run_id, last.file_no, 'removed', k, '' from ty join last on last.run_id = ty.run_id and last.s = ty.s + 1 where ns is null or ns > ty.s + 1
""",
    "p5_found": f"""
with seg as (select distinct segment_id, run_id, lat_mean lat, lon_mean lon from segment_spectra
             where isfinite(lat_mean) and isfinite(lon_mean)),
site as (select site_id, latitude lat, longitude lon, radius_km from reference_sites)
select 'segment' pair_kind, a.segment_id, b.segment_id other_id from seg a join seg b on a.run_id = b.run_id and a.segment_id < b.segment_id
where abs(a.lat - b.lat) < 0.1 and {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 10
union all
select 'site', seg.segment_id, cast(site.site_id as bigint) from seg join site on abs(seg.lat - site.lat) <= radius_km / 111e0 + 0.01
where {hav_sql('site.lat', 'site.lon', 'seg.lat', 'seg.lon')} <= radius_km
""",
}
