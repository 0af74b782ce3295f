"""Registered queries of this subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mojibake, packing, quantiles, splitting, tokenize


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p3_percentiles": lambda s, d: quantiles.spectrum_percentiles(_t(s, d, "segment_spectra")),
        "p4_found": lambda s, d: splitting.cut_kinds(_t(s, d, "segment_spectra"), _t(s, d, "track_breaks")),
        "p4_pieces": lambda s, d: splitting.split_stretches(_t(s, d, "segment_spectra"), _t(s, d, "track_breaks")),
        "p6_ids": lambda s, d: tokenize.encode_corpus(_t(s, d, "documents")),
        "p7_containers": lambda s, d: packing.pack_documents(_t(s, d, "documents")),
        "p8_found": lambda s, d: mojibake.garbled_documents(_t(s, d, "documents")),
        "p8_restored": lambda s, d: mojibake.repair_documents(_t(s, d, "documents")),
    }


_LONG = """
ends as (
  select segment_id, granule, lower(trim(swath)) swath,
         case when greatest(abs(a), abs(b)) > 20100 then 1e0 else 1e3 end k, a, b
  from (select distinct segment_id, granule, swath, along_track_distance_start_km a, along_track_distance_end_km b from segment_spectra)
  where a is not null and b is not null and isfinite(a) and isfinite(b)),
long as (
  select segment_id, granule, swath, cast(round(least(a, b) * k) as bigint) s, cast(round(greatest(a, b) * k) as bigint) e from ends
  where cast(round(greatest(a, b) * k) as bigint) - cast(round(least(a, b) * k) as bigint) > 500000),
brk as (
  select distinct granule, swath, cast(round(break_km * 1e3) as bigint) pos from track_breaks where break_km is not null),
pts as (
  select l.segment_id, l.s, l.e, b.pos from long l join brk b on b.granule = l.granule and (b.swath is null or lower(trim(b.swath)) = l.swath) and b.pos > l.s and b.pos < l.e
  union select segment_id, s, e, s from long union select segment_id, s, e, e from long)
"""

ORACLE = {
    "p4_found": f"""with {_LONG},
        gaps as (select segment_id, pos - lag(pos) over (partition by segment_id order by pos) gap from pts)
        select segment_id, case when max(gap) > 450000 then 'forced' else 'boundary' end cut_kind from gaps group by segment_id""",
    "p4_pieces": f"""with recursive {_LONG},
        widest as (select segment_id, max(gap) / 1e3 widest_gap_km from (select segment_id, pos - lag(pos) over (partition by segment_id order by pos) gap from pts) group by 1),
        walk as (
          select segment_id, s, e, -1 piece_no, cast(null as bigint) prev, s + 50000 pos, false at_break from long
          union all
          select w.segment_id, w.s, w.e, w.piece_no + 1, w.pos,
            case when w.e <= w.pos + 450000 then w.e
                 else coalesce((select max(p.pos) from pts p where p.segment_id = w.segment_id and p.pos > w.pos and p.pos <= w.pos + 450000), w.pos + 450000) end,
            w.e <= w.pos + 450000 or exists (select 1 from pts p where p.segment_id = w.segment_id and p.pos > w.pos and p.pos <= w.pos + 450000)
          from walk w where w.pos < w.e)
        select segment_id, cast(piece_no as integer) piece_no, (prev - 50000) / 1e3 start_km, pos / 1e3 end_km,
          case when pos = e then 'end' when at_break then 'boundary' else 'forced' end cut_kind, widest_gap_km
        from walk join widest using (segment_id) where prev is not null""",
}
