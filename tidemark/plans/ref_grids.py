"""Registered queries: scans, masks, scalar functions, grids and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import gridding as g
from tidemark.plans.common import EXP, LON180, LONG, PX, SEG, clean0, hav_sql, measured, pixels, points, segments, significant, significant_sql, table, tie_free
from tidemark.sources import granules as src

_KEYS = ["obs_id", "granule", "line_no", "pixel_no"]
_FINITE = "abs(ssh) < 'inf'::double"


def _long(s, d, *cols):
    from tidemark.schema import unnest_vectors

    return unnest_vectors(segments(s, d, "wavenumber", "psd"), ["segment_id", "granule", "swath", "lat_mean", "lon_mean", "month", *cols], "wavenumber", "psd")


def _good(long):
    """Values that enter means: finite and positive-definite spectra only."""
    return long.where(measured("psd"))


GOOD = f"{LONG}, good as (select * from long where p >= 0 and p < 'inf'::double)"


def queries():
    def grid(s, d, **kw):
        return g.grid_accumulate(points(s, d), "latitude", "lon", "ssh", 1.0, **kw)

    def finish(df, *keep):
        return df.select(*keep, "ilat", "ilon", "lat_center", "lon_center", clean0("mean").alias("mean"), "nobs")

    def partials(s, d):
        """Accumulators of the runs, kept apart as files or days would be, and merged."""
        by_run = g.grid_accumulate(points(s, d, "run_id"), "latitude", "lon", "ssh", 1.0, keys=("run_id",))
        return finish(g.grid_finish(g.grid_merge(by_run.drop("run_id")), 1.0))

    def mean_square(s, d):
        return g.grid_finish(grid(s, d, squares=True), 1.0).select("ilat", "ilon", clean0("mean_sq").alias("mean_sq"), "nobs")

    def densified(s, d):
        x = g.grid_densify(g.grid_accumulate(points(s, d), "latitude", "lon", "ssh", 5.0), 24, 72)
        return g.grid_finish(x, 5.0).select("ilat", "ilon", "lat_center", "lon_center", clean0("mean").alias("mean"), "nobs")

    def anomaly(s, d):
        h = points(s, d).where("ssh is not null")
        acc = g.grid_accumulate(h, "latitude", "lon", "ssh", 1.0)
        x = h.withColumn("ilat", g.cell(F.col("latitude"), -60.0, 1.0)).withColumn("ilon", g.cell(F.col("lon"), -180.0, 1.0))
        return x.join(acc, ["ilat", "ilon"]).select("obs_id", clean0(F.col("ssh") - F.col("total") / F.col("n")).alias("anomaly"))

    def all_vars(s, d):
        names = ["ssha_karin_2", "swh_karin"]
        v = src.variables_long(pixels(s, d), names, ["latitude", "longitude"]).withColumn("lon", geo.lon_180(F.col("longitude"))).where("abs(value) < 100")
        return finish(g.grid_finish(g.grid_accumulate(v, "latitude", "lon", "value", 5.0, keys=("var",)), 5.0), "var")

    def box_psd(s, d):
        x = segments(s, d, "wavenumber", "psd").withColumn("psd", F.transform("psd", lambda v: F.when(measured(v), v)))
        b = g.box_mean_spectra(x, "lat_mean", "lon_mean", "wavenumber", ["psd"], box=2.0)
        return b.where("mean_psd is not null").select("ilat", "ilon", "lat_center", "lon_center", "n_segments", "ik", "k", significant(F.col("mean_psd") * 1e4, 10).alias("mean_psd_cm2"))

    def box_filtered(s, d):
        x = segments(s, d, "wavenumber", "psd").withColumn("psd", F.transform("psd", lambda v: F.when(measured(v), v)))
        b = g.box_mean_spectra(x, "lat_mean", "lon_mean", "wavenumber", ["psd"], box=10.0, fraction=0.15)
        return b.where("mean_psd is not null").select("ilat", "ilon", "n_segments", "sampling_fraction", "ik", significant(F.col("mean_psd") * 1e4, 10).alias("mean_psd_cm2"))

    def box_scalar(s, d):
        b = g.box_mean_scalar(segments(s, d, "valid_fraction"), "lat_mean", "lon_mean", "valid_fraction", 2.0)
        return b.select("ilat", "ilon", "lat_center", "lon_center", clean0("mean").alias("mean"), "n_segments")

    def box_counts(s, d):
        b = g.box_mean_scalar(segments(s, d, "valid_fraction"), "lat_mean", "lon_mean", "valid_fraction", 5.0)
        return b.groupBy("ilat").agg(F.max("n_segments").alias("max_n"), F.count_if(F.col("n_segments") >= 5).alias("n5"), F.count_if(F.col("n_segments") >= 10).alias("n10"))

    def bins(closed):
        def run(s, d):
            x = segments(s, d, "valid_fraction").withColumn("bin", g.lat_bin(F.col("lat_mean"), -80.0, 10.0, 16, closed)).where("bin is not null")
            return x.groupBy("bin").agg(clean0(F.avg("valid_fraction")).alias("mean"), F.count("*").alias("n"))

        return run

    def bins_closed(s, d):
        x = g.closed_lat_bins(segments(s, d, "valid_fraction").where("lat_mean is not null"), "lat_mean", -80.0, 10.0, 16)
        return x.groupBy("bin").agg(clean0(F.avg("valid_fraction")).alias("mean"), F.count("*").alias("n"))

    def zonal(axis):
        def run(s, d):
            b = g.box_keys(_good(_long(s, d)), "lat_mean", "lon_mean", 10.0)
            per_box = b.groupBy("ilat", "ilon", "ik").agg(F.avg("psd").alias("m"))
            return per_box.groupBy(axis, "ik").agg(significant(F.avg("m") * 1e4, 10).alias("mean_cm2"), F.count("*").alias("n_boxes"))

        return run

    def coast(s, d):
        h = src.expert_scan(pixels(s, d), other=["ancillary_surface_classification_flag"]).withColumn("lon", geo.lon_180(F.col("longitude")))
        c = h.withColumn("ilat", g.cell(F.col("latitude"), -90.0, 1.0)).withColumn("ilon", g.cell(F.col("lon"), -180.0, 1.0))
        c = c.where("ilat is not null and ilon is not null").groupBy("ilat", "ilon").agg(F.max("ancillary_surface_classification_flag").alias("f"))
        return g.dilate_mask(c.withColumn("f", F.coalesce("f", F.lit(0))), F.col("f") > 0, 2).select("ilat", "ilon")

    def masks(s, d):
        p = pixels(s, d)
        x = F.col("ssha_karin_2")
        q = src.quality_mask(p, x, "ssha_karin_2")
        return p.select("obs_id", *[clean0(F.when(F.abs(c) < 1e4, c)).alias(n) for n, c in (("by_quality", q), ("by_surface", src.surface_mask(p, x)), ("by_waves", src.wave_screen(x)), ("by_size", F.when(F.abs(x) < 2.5, x)))])

    def unsmoothed(s, d):
        p = pixels(s, d, _KEYS + ["cross_track_distance"]).where("cross_track_distance is not null")
        return src.unsmoothed_scan(p.where("cross_track_distance < 0"), p.where("cross_track_distance > 0")).select("obs_id", "pixel_no", "cross_track_distance")

    def months(s, d):
        m = table(s, d, "granule_manifest").select("granule", "subdir").distinct()
        y, mo = src.month_of_folder(F.concat(F.lit("/data/"), F.col("subdir"), F.lit("/")))
        return m.select("granule", "subdir", y.alias("year"), mo.alias("month"), src.stem(F.concat(F.lit("/data/"), F.col("subdir"), F.lit("/"), F.col("granule"), F.lit(".nc"))).alias("stem"))

    def scalars(s, d):
        p = pixels(s, d)
        lat, lon = F.col("latitude"), F.col("longitude")
        return p.select("obs_id", clean0(geo.lon_180(lon)).alias("lon_180"), clean0(geo.lon_360(lon)).alias("lon_360"), clean0(geo.coriolis(lat) * 1e4).alias("f_1e4"), clean0(geo.haversine_km(lat, lon, F.lit(0.0), F.lit(0.0))).alias("km"), clean0(geo.geostrophic_velocity(F.lit(1e-6), lat)).alias("v"), clean0(geo.signed_cross_track(F.col("cross_track_distance"), F.when(F.col("pixel_no") < 34, "left").otherwise("right"))).alias("xt"), clean0(F.log10(F.when(F.col("swh_karin") > 0, F.col("swh_karin")))).alias("log_swh"), clean0(geo.white_noise(F.col("swh_karin"))).alias("white_noise"))

    def local_xy(s, d):
        p = pixels(s, d, _KEYS + ["latitude", "longitude"]).withColumn("lon", geo.lon_360(F.col("longitude")))
        ref = p.groupBy("granule").agg(F.avg("latitude").alias("lat0"), F.avg("lon").alias("lon0"))
        x, y = geo.local_xy_km(F.col("latitude"), F.col("lon"), F.col("lat0"), F.col("lon0"))
        return p.join(ref, "granule").select("obs_id", clean0(x, 4).alias("x_km"), clean0(y, 4).alias("y_km"))

    def roi(s, d):
        x = segments(s, d)
        return g.roi(x.where("lat_mean is not null and lon_mean is not null"), "lat_mean", "lon_mean", -40, 40, -60, 120).select("segment_id", "swath", "month")

    def zoom(s, d):
        h = g.zoom(points(s, d), "latitude", "lon", "ssh", (-30, 30), (-90, 90))
        return h.select("obs_id", clean0("lon").alias("lon"), clean0("ssh").alias("ssh"))

    def manifest(s, d):
        out = src.combine_by_manifest(table(s, d, "granule_manifest"), segments(s, d))
        return out.groupBy("granule", "swath").agg(F.count("*").alias("n"))

    def no_output(s, d):
        return src.missing_outputs(table(s, d, "granule_manifest"), segments(s, d))

    def counts(s, d):
        return segments(s, d).rollup("data_year", "month", "swath").agg(F.count("*").alias("n"), F.countDistinct("granule").alias("granules"))

    def counters(s, d):
        m = table(s, d, "granule_manifest").groupBy("granule").agg(F.max(F.when(F.trim("error") != "", F.col("error"))).alias("error"), F.max("n_lines").alias("n"))
        ok = F.col("error").isNull()
        return g.global_counters(m, ok, F.col("n") > 9860)

    def differences(s, d):
        return pixels(s, d).select("obs_id", clean0(F.when(F.abs("ssha_karin_2") < 1e4, F.col("ssha_karin_2")) - F.col("height_cor_xover")).alias("diff"))

    return {
        "basic_scan": lambda s, d: src.basic_scan(pixels(s, d)).where("abs(ssh) < 1e4").select("obs_id", clean0("ssh").alias("ssh")),
        "expert_scan": lambda s, d: src.expert_scan(pixels(s, d), waves=True, other=["swh_karin"]).where("abs(ssh) < 1e4").select("obs_id", "swh_karin", clean0("ssh").alias("ssh")),
        "unsmoothed_scan": unsmoothed,
        "mask_flags": masks,
        "scalar_functions": scalars,
        "local_xy": local_xy,
        "year_month_from_path": months,
        "product_difference": differences,
        "roi_filter": roi,
        "zoom_bbox": zoom,
        "roi_optional": lambda s, d: g.roi(segments(s, d), "lat_mean", "lon_mean", lat_min=-40, lon_max=120).select("segment_id", "swath"),
        "latitude_zone": lambda s, d: g.zone(segments(s, d), "lat_mean", 30, 60).select("segment_id", "lat_mean"),
        "months_selected": lambda s, d: src.of_months(segments(s, d), [3]).select("segment_id", "granule", "month"),
        "ocean_flag": lambda s, d: pixels(s, d).select("obs_id", src.ocean(pixels(s, d)).alias("ocean")),
        "coast_dilation": coast,
        "manifest_combine": manifest,
        "manifest_missing": no_output,
        "month_swath_counts": counts,
        "global_counters": counters,
        "grid_mean": lambda s, d: finish(g.grid_finish(grid(s, d), 1.0)),
        "grid_mean_clip": lambda s, d: finish(g.grid_finish(grid(s, d, clip=True), 1.0)),
        "grid_partials_merge": partials,
        "grid_mean_square": mean_square,
        "grid_dense": densified,
        "grid_anomaly": anomaly,
        "grid_variables": all_vars,
        "box_mean_psd": box_psd,
        "box_sampling_filter": box_filtered,
        "box_mean_scalar": box_scalar,
        "box_count_thresholds": box_counts,
        "lat_bins_right_closed": bins("right"),
        "lat_bins_half_open": bins("left"),
        "lat_bins_closed": bins_closed,
        "zonal_mean": zonal("ilat"),
        "meridional_mean": zonal("ilon"),
    }


_H = hav_sql("latitude", "longitude", "0e0", "0e0")
_L = LON180.format(x="longitude")
_CELL = "cast(floor((latitude + 60e0) / {s}) as integer) ilat, cast(floor((lon + 180e0) / {s}) as integer) ilon"
_HG = f"{EXP}, p as (select *, {_L} lon from hh where ssh is not null)"
_FIN = "ilat, ilon, -60e0 + (ilat + 5e-1) * {s} lat_center, -180e0 + (ilon + 5e-1) * {s} lon_center, round(sum({v}) / count(*), 6) + 0e0 mean, count(*) nobs"
_BOX = "cast(floor(lat_mean / {b}) as integer) ilat, cast(floor(lon_mean / {b}) as integer) ilon"


def _grid(step, drop=True, clip=False):
    n1, n2 = int(120 / float(step)), int(360 / float(step))
    ilat, ilon = f"cast(floor((latitude + 60e0) / {step}) as integer)", f"cast(floor((lon + 180e0) / {step}) as integer)"
    where = f"where ilat between 0 and {n1 - 1} and ilon between 0 and {n2 - 1}"
    if clip:
        ilat, ilon = f"least(greatest({ilat}, 0), {n1 - 1})", f"least(greatest({ilon}, 0), {n2 - 1})"
        where = "where latitude between -60 and 60 and lon between -180 and 180"
    return f"{_HG}, c as (select *, {ilat} ilat, {ilon} ilon from p), gr as (select * from c {where})"


def _boxes(b, where=""):
    return f"""{SEG}, bx as (select *, {_BOX.format(b=b)} from seg where lat_mean is not null and lon_mean is not null),
      cnt as (select ilat, ilon, count(*) n_segments from bx group by 1, 2 {where}),
      lg as (select ilat, ilon, u.ik - 1 ik, wavenumber[u.ik] k, case when psd[u.ik] >= 0 and psd[u.ik] < 'inf'::double then psd[u.ik] end p from bx, unnest(range(1, 64)) u(ik) where psd is not null)"""


_SQL = {
    "basic_scan": f"with {PX} select obs_id, round(ssh, 6) + 0e0 ssh from (select obs_id, case when ssha_karin_2_qual = 0 then ssha_karin_2 + height_cor_xover + internal_tide_hret end ssh from px) where abs(ssh) < 1e4",
    "expert_scan": f"with {EXP} select obs_id, swh_karin, round(raw_ssh, 6) + 0e0 ssh from ex where swh_karin_qual = 0 and swh_karin <= 5 and abs(raw_ssh) < 1e4",
    "unsmoothed_scan": f"""with {PX}, x as (select * from px where cross_track_distance <> 0), w as (select granule, max(pixel_no) filter (where cross_track_distance < 0) + 1 n from x group by 1)
        select obs_id, case when cross_track_distance < 0 then n - 1 - pixel_no else coalesce(n, 0) + pixel_no end pixel_no, cross_track_distance from x join w using (granule)""",
    "mask_flags": f"""with {PX}, q as (select *, case when abs(ssha_karin_2) < 1e4 then ssha_karin_2 end x from px)
        select obs_id, round(case when ssha_karin_2_qual = 0 then x end, 6) + 0e0 by_quality,
        round(case when ancillary_surface_classification_flag = 0 and coalesce(surface_type, 0) = 0 then x end, 6) + 0e0 by_surface,
        round(case when swh_karin_qual = 0 and swh_karin <= 5 then x end, 6) + 0e0 by_waves, round(case when abs(x) < 25e-1 then x end, 6) + 0e0 by_size from q""",
    "scalar_functions": f"""with {PX} select obs_id, round({_L}, 6) + 0e0 lon_180, round(longitude - 360e0 * floor(longitude / 360e0), 6) + 0e0 lon_360,
        round(2 * 7.2921150e-5 * sin(radians(latitude)) * 1e4, 6) + 0e0 f_1e4, round({_H}, 6) + 0e0 km,
        round(case when abs(latitude) >= 2 then 981e-2 * 1e-6 / (2 * 7.2921150e-5 * sin(radians(latitude))) end, 6) + 0e0 v,
        round(case when pixel_no < 34 then -abs(cross_track_distance) else abs(cross_track_distance) end, 6) + 0e0 xt,
        round(log10(case when swh_karin > 0 then swh_karin end), 6) + 0e0 log_swh,
        round(2 * 30e0 * pow(1 / 23e-1, 2) * pow(case when swh_karin >= 0 then swh_karin end / 2, 15e-1), 6) + 0e0 white_noise from px""",
    "local_xy": f"""with {PX}, p as (select obs_id, granule, latitude, longitude - 360e0 * floor(longitude / 360e0) lon from px), r as (select granule, avg(latitude) lat0, avg(lon) lon0 from p group by 1)
        select obs_id, round((lon - lon0) * (pi() / 180 * 6371e0) * cos(radians(lat0)), 4) + 0e0 x_km, round((latitude - lat0) * (pi() / 180 * 6371e0), 4) + 0e0 y_km from p join r using (granule)""",
    "year_month_from_path": """select distinct granule, subdir, cast(case when m between 1 and 12 then 2000 + y end as integer) "year",
        cast(case when m between 1 and 12 then m end as integer) "month", granule stem
        from (select *, try_cast(regexp_extract(subdir, '([0-9]{2})([0-9]{2})$', 1) as integer) m, try_cast(regexp_extract(subdir, '([0-9]{2})([0-9]{2})$', 2) as integer) y from granule_manifest)""",
    "product_difference": f"with {PX} select obs_id, round(case when abs(ssha_karin_2) < 1e4 then ssha_karin_2 end - height_cor_xover, 6) + 0e0 diff from px",
    "roi_filter": f"with {SEG} select segment_id, swath, month from seg where lat_mean between -40 and 40 and lon_mean between -60 and 120",
    "roi_optional": f"with {SEG} select segment_id, swath from seg where (lat_mean is null or lat_mean >= -40) and (lon_mean is null or lon_mean <= 120)",
    "latitude_zone": f"with {SEG} select segment_id, lat_mean from seg where lat_mean > 30 and lat_mean <= 60",
    "months_selected": f"with {SEG} select segment_id, granule, month from seg where month = 3",
    "ocean_flag": f"with {PX} select obs_id, coalesce(ancillary_surface_classification_flag = 0 and coalesce(surface_type, 0) = 0, false) ocean from px",
    "zoom_bbox": f"with {_HG} select obs_id, round(lon, 6) + 0e0 lon, round(ssh, 6) + 0e0 ssh from p where latitude between -30 and 30 and lon between -90 and 90",
    "coast_dilation": f"""with {PX}, c as (select cast(floor(latitude + 90e0) as integer) ilat, cast(floor({_L} + 180e0) as integer) ilon, coalesce(max(ancillary_surface_classification_flag), 0) f
        from px where latitude is not null and longitude is not null group by 1, 2)
        select ilat, ilon from c where f <= 0 and not exists (select 1 from c b where b.f > 0 and abs(b.ilat - c.ilat) + abs(b.ilon - c.ilon) <= 2)""",
    "manifest_combine": f"with {SEG} select granule, swath, count(*) n from seg where granule in (select granule from granule_manifest where error is null or trim(error) = '') group by 1, 2",
    "manifest_missing": f"with {SEG} select distinct granule from granule_manifest where (error is null or trim(error) = '') and granule not in (select granule from seg where granule is not null)",
    "month_swath_counts": f"with {SEG} select data_year, month, swath, count(*) n, count(distinct granule) granules from seg group by rollup (data_year, month, swath)",
    "global_counters": """with m as (select granule, max(case when trim(error) <> '' then error end) error, max(n_lines) n from granule_manifest group by 1)
        select count(*) filter (where error is null) used, count(*) filter (where error is not null) skipped, count(*) filter (where error is null and n > 9860) n_valid from m""",
    "grid_mean": f"with {_grid('1e0')} select {_FIN.format(s='1e0', v='ssh')} from gr group by ilat, ilon",
    "grid_mean_clip": f"with {_grid('1e0', clip=True)} select {_FIN.format(s='1e0', v='ssh')} from gr group by ilat, ilon",
    "grid_partials_merge": f"""with {_grid('1e0')}, by_run as (select run_id, ilat, ilon, sum(ssh) t, count(*) n from gr group by all)
        select ilat, ilon, -60e0 + (ilat + 5e-1) lat_center, -180e0 + (ilon + 5e-1) lon_center, round(sum(t) / sum(n), 6) + 0e0 mean, cast(sum(n) as bigint) nobs from by_run group by ilat, ilon""",
    "grid_mean_square": f"with {_grid('1e0')} select ilat, ilon, round(sum(ssh * ssh) / count(*), 6) + 0e0 mean_sq, count(*) nobs from gr group by 1, 2",
    "grid_dense": f"""with {_grid('5e0')}, a as (select ilat, ilon, sum(ssh) t, count(*) n from gr group by 1, 2),
        ax as (select cast(i as integer) ilat, cast(j as integer) ilon from range(0, 24) x(i), range(0, 72) y(j))
        select ilat, ilon, -60e0 + (ilat + 5e-1) * 5e0 lat_center, -180e0 + (ilon + 5e-1) * 5e0 lon_center, round(t / n, 6) + 0e0 mean, coalesce(n, 0) nobs from ax left join a using (ilat, ilon)""",
    "grid_anomaly": f"with {_grid('1e0')} select obs_id, round(ssh - avg(ssh) over (partition by ilat, ilon), 6) + 0e0 anomaly from gr",
    "grid_variables": f"""with {PX}, v as (select 'ssha_karin_2' var, latitude, longitude, case when ssha_karin_2_qual = 0 then ssha_karin_2 + height_cor_xover + internal_tide_hret end x from px
          union all select 'swh_karin', latitude, longitude, case when swh_karin_qual = 0 then swh_karin end from px),
        c as (select var, x, cast(floor((latitude + 60e0) / 5e0) as integer) ilat, cast(floor(({_L} + 180e0) / 5e0) as integer) ilon from v where abs(x) < 100)
        select var, {_FIN.format(s='5e0', v='x')} from c where ilat between 0 and 23 and ilon between 0 and 71 group by var, ilat, ilon""",
    "box_mean_psd": f"""with {_boxes('2e0')} select ilat, ilon, (ilat + 5e-1) * 2e0 lat_center, (ilon + 5e-1) * 2e0 lon_center, n_segments, cast(ik as integer) ik, max(k) k, round(avg(p) * 1e4, 6) + 0e0 mean_psd_cm2
        from lg join cnt using (ilat, ilon) group by ilat, ilon, n_segments, ik having count(p) > 0""",
    "box_sampling_filter": f"""with {_boxes('1e1')}, m as (select max(n_segments) mx from cnt) select ilat, ilon, n_segments, n_segments / cast(mx as double) sampling_fraction, cast(ik as integer) ik,
        round(avg(p) * 1e4, 6) + 0e0 mean_psd_cm2 from lg join cnt using (ilat, ilon), m where n_segments >= 15e-2 * mx group by ilat, ilon, n_segments, mx, ik having count(p) > 0""",
    "box_mean_scalar": f"with {SEG} select {_BOX.format(b='2e0')}, (floor(lat_mean / 2e0) + 5e-1) * 2e0 lat_center, (floor(lon_mean / 2e0) + 5e-1) * 2e0 lon_center, round(avg(valid_fraction), 6) + 0e0 mean, count(valid_fraction) n_segments from seg where lat_mean is not null and lon_mean is not null group by all",
    "box_count_thresholds": f"""with {SEG}, b as (select {_BOX.format(b='5e0')}, count(valid_fraction) n from seg where lat_mean is not null and lon_mean is not null group by 1, 2)
        select ilat, max(n) max_n, count(*) filter (where n >= 5) n5, count(*) filter (where n >= 10) n10 from b group by 1""",
    "lat_bins_right_closed": f"with {SEG}, b as (select *, cast(ceil((lat_mean + 80e0) / 1e1) as integer) - 1 bin from seg) select bin, round(avg(valid_fraction), 6) + 0e0 mean, count(*) n from b where bin between 0 and 15 group by 1",
    "lat_bins_half_open": f"with {SEG}, b as (select *, cast(floor((lat_mean + 80e0) / 1e1) as integer) bin from seg) select bin, round(avg(valid_fraction), 6) + 0e0 mean, count(*) n from b where bin between 0 and 15 group by 1",
    "lat_bins_closed": f"with {SEG}, e as (select cast(i as integer) bin, -80e0 + i * 1e1 lo, -70e0 + i * 1e1 hi from range(0, 16) r(i)) select bin, round(avg(valid_fraction), 6) + 0e0 mean, count(*) n from seg join e on lat_mean between lo and hi group by 1",
    "zonal_mean": f"with {SEG}, {GOOD}, b as (select {_BOX.format(b='1e1')}, cast(ik as integer) ik, avg(p) m from good where lat_mean is not null and lon_mean is not null group by 1, 2, 3) select ilat, ik, round(avg(m) * 1e4, 6) + 0e0 mean_cm2, count(*) n_boxes from b group by 1, 2",
    "meridional_mean": f"with {SEG}, {GOOD}, b as (select {_BOX.format(b='1e1')}, cast(ik as integer) ik, avg(p) m from good where lat_mean is not null and lon_mean is not null group by 1, 2, 3) select ilon, ik, round(avg(m) * 1e4, 6) + 0e0 mean_cm2, count(*) n_boxes from b group by 1, 2",
}
_WIDE = ("box_mean_psd", "box_sampling_filter", "zonal_mean", "meridional_mean")  # values over many powers of ten
ORACLE = tie_free({name: significant_sql(sql, 10) if name in _WIDE else sql for name, sql in _SQL.items()})
