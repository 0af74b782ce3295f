"""Registered queries: ordered operators on series, segmentation, gaps, detrending, matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import tracks as t
from tidemark.plans.common import EXP, SEG, clean0, hav_sql, heights, segments, table, tie_free

K = ["granule", "pixel_no"]
LENGTH, ROWS, TARGETS = 100.0, 64, [-60.0, -30.0, 0.0, 30.0, 60.0]


def series(s, d):
    """Height series of every pixel column, with row numbers."""
    h = heights(s, d).where("latitude is not null and longitude is not null")
    h = h.select("obs_id", "granule", "pass_no", "pixel_no", "line_no", F.col("latitude").alias("lat"), geo.lon_360(F.col("longitude")).alias("lon"), F.col("cross_track_distance").alias("xt"), "ssh")
    return t.indexed(h, K, "line_no")


def with_km(s, d):
    return t.along_track_km(series(s, d), K, "line_no", "lat", "lon")


def patches(s, d):
    """Embeddings as patches: one per label, a row per vector, a column per element."""
    e = table(s, d, "embeddings").withColumn("row", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int"))
    return e.select(F.col("label"), "row", F.posexplode("embedding").alias("col", "v")).withColumn("v", F.col("v").cast("double"))


def queries():
    def interp(clamp, run=None, x="line_no"):
        def q(s, d):
            src = with_km(s, d) if x == "km" else series(s, d)
            return t.interpolate(src, K, "line_no", "ssh", x=x, clamp=clamp, max_run=run).select("obs_id", clean0("ssh").alias("ssh"))

        return q

    def fill2d(s, d):
        p = patches(s, d).withColumn("v", F.when((F.col("row") * 7 + F.col("col") * 13) % 10 != 0, F.col("v")))
        return t.fill_plane(p, ["label"], "row", "col", "v").select("label", "row", "col", clean0("v").alias("v"))

    def ocean_runs(s, d):
        r = t.runs(series(s, d), K, "line_no", F.col("ssh").isNotNull(), step="line_no")
        return r.groupBy(*K, "run").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines"), clean0(F.avg("lat")).alias("mean_latitude")).where("n_lines >= 8").drop("run")

    def fixed_segments(s, d):
        n = series(s, d).groupBy(*K).agg(F.count("*").cast("int").alias("n"))
        return n.withColumn("i0", F.explode(t.row_segment_starts(F.col("n"), ROWS, 0.5))).withColumn("i1", F.col("i0") + ROWS)

    def even(s, d):
        n = series(s, d).groupBy(*K).agg(F.count("*").cast("int").alias("n"))
        return n.withColumn("i0", F.explode(t.even_starts(F.col("n"), ROWS, 5)))

    def metadata(s, d):
        m = t.segment_members(series(s, d), K, "idx", ROWS, 0.5)
        return m.groupBy(*K, "i0").agg(clean0(F.avg("lat")).alias("lat_mean"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), clean0(F.avg("lon"), 4).alias("lon_mean"), clean0(F.avg(F.col("ssh").isNotNull().cast("double"))).alias("valid_fraction"), F.count("*").alias("n"))

    def drop_reasons(s, d):
        m = t.segment_members(series(s, d), K, "idx", ROWS, 0.5)
        q = m.groupBy(*K, "i0").agg(F.avg(F.col("ssh").isNull().cast("double")).alias("missing"))
        gap = t.longest_bad_run(m, [*K, "i0"], "idx", "ssh")
        r = q.join(gap, [*K, "i0"]).select(F.when(F.col("missing") > 0.15, "nan_fraction").when(F.col("gap_fraction") > 0.05, "gap").otherwise("used").alias("reason"))
        return r.groupBy("reason").agg(F.count("*").alias("n"))

    def bounds(s, d):
        b = t.distance_segments(with_km(s, d), K, "km", "idx", LENGTH, 0.5)
        return b.select(*K, clean0("start_km", 4).alias("start_km"), "i0", "i1")

    def detrended(kind):
        return lambda s, d: t.detrend(series(s, d), K, "idx", "ssh", kind).where("ssh is not null").select("obs_id", clean0("ssh").alias("ssh"))

    def slope(s, d):
        x = t.centred_slope(t.interpolate(with_km(s, d), K, "line_no", "ssh", x="km", clamp=False, max_run=5), K, "line_no", "km", "ssh")
        return x.where("slope is not null")

    def slope_field(s, d):
        return slope(s, d).select("obs_id", clean0(F.col("slope") * 1e6, 4).alias("slope_e6"), clean0(geo.geostrophic_velocity(F.col("slope"), F.col("lat")), 4).alias("v"))

    def slope_stats(s, d):
        x = slope(s, d).withColumn("u", F.col("slope") * 1e6).withColumn("v", geo.geostrophic_velocity(F.col("slope"), F.col("lat")))
        return x.groupBy("granule").agg(F.count("*").alias("n"), clean0(F.avg("u"), 4).alias("mean"), clean0(F.var_pop("u"), 4).alias("variance"), clean0(F.sqrt(F.avg(F.col("u") * F.col("u"))), 4).alias("rms"), clean0(F.sqrt(F.avg(F.col("v") * F.col("v"))), 4).alias("v_rms"))

    def filtered(s, d):
        x = t.interpolate(series(s, d), K, "line_no", "ssh").where("ssh is not null")
        return t.fir_decimate(x, K, "line_no", "ssh", t.hamming_taps(17), 8).select(*K, "idx", clean0("ssh").alias("ssh"))

    def savgol(s, d):
        x = t.interpolate(series(s, d), K, "line_no", "ssh").where("ssh is not null")
        return t.savgol_trend(x, K, "line_no", "ssh", 21, 3).where("trend is not null").select("obs_id", clean0(F.col("ssh") - F.col("trend")).alias("ssh"))

    def spacing(s, d):
        return t.median_spacing(with_km(s, d), K, "line_no", "km").select(*K, clean0("spacing", 4).alias("spacing"))

    def uniform(outside):
        def q(s, d):
            x = with_km(s, d).where("ssh is not null").groupBy(*K, "km").agg(F.avg("ssh").alias("ssh"))
            top = x.groupBy(*K).agg(F.max("km").alias("m"))
            grid = top.select(*K, F.explode(F.sequence(F.lit(0), F.ceil("m").cast("int") + 100, F.lit(100)).cast("array<double>")).alias("km"))
            return t.resample(x, grid, K, "km", "ssh", outside).select(*K, "km", clean0("ssh").alias("ssh"))

        return q

    def nearest(s, d):
        lines = series(s, d).where("pixel_no >= 0").groupBy("granule", "line_no").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
        return t.nearest_line(segments(s, d), lines, ["granule"], ["segment_id"], ("lat_mean", "lat"), ("lon_mean", "lon"), "line_no").select("segment_id", "line_no", clean0("km", 4).alias("km"))

    def semi(s, d):
        return t.rounded_semi(segments(s, d).where("lat_mean is not null"), series(s, d), ["granule"], "lat_mean", "lat", 1).select("segment_id", "lat_mean")

    def swaths(s, d):
        x = t.split_swaths(series(s, d), ["granule"], "pixel_no", "xt")
        return x.groupBy("granule", "pixel_no", "swath").agg(F.count("*").alias("n"))

    def trims(both):
        def q(s, d):
            x = t.split_swaths(series(s, d), ["granule"], "pixel_no", "xt")
            return t.trim_swaths(x, ["pass_no"], "xt", 4000.0, both).groupBy("pass_no", "swath", "pixel_no").agg(F.count("*").alias("n"))

        return q

    def gap(s, d):
        p = patches(s, d).withColumn("v", F.when(~F.col("col").between(28, 28 + F.col("label") % 4), F.col("v")))
        return t.nadir_gap(p, ["label"], "col", "v", 0.5)

    def xtrack_bin(s, d):
        x = t.across_between(series(s, d), "xt", 10_000, 40_000)
        return x.groupBy("granule").agg(F.count("*").alias("n"), F.count("ssh").alias("valid"))

    def min_valid(s, d):
        x = t.valid_groups(series(s, d), K, "ssh", 0.9, 100)
        return x.select(*K, clean0("f").alias("f"), "n")

    def trimmed(s, d):
        x = t.trim_swaths_median(t.split_swaths(series(s, d), ["granule"], "pixel_no", "xt"), ["pass_no"], "pixel_no", "xt", 4000.0)
        return x.groupBy("pass_no", "swath", "pixel_no").agg(F.count("*").alias("n"))

    def around(s, d):
        return t.segments_around(with_km(s, d), K, "idx", "km", "lat", t.spread_targets([-60.0, -45.0, -30.0, -15.0, 0.0, 15.0, 30.0, 45.0, 60.0], 5), LENGTH)

    def decimated(s, d):
        x = t.fir_decimate_2d(patches(s, d), ["label"], "row", "col", "v", t.hamming_taps(9), 4)
        return x.select("label", "row", "col", clean0("v").alias("v"))

    return {
        "swath_trim_median": trimmed,
        "pixel_trim": lambda s, d: t.trim_pixels(series(s, d), ["pass_no"], "pixel_no", 2).groupBy("pass_no", "pixel_no").agg(F.count("*").alias("n")),
        "segments_around_targets": around,
        "every_tenth": lambda s, d: t.every_nth(series(s, d), K, "line_no", 10).select("obs_id", *K, "line_no"),
        "fir_decimate_2d": decimated,
        "track_distance": lambda s, d: with_km(s, d).select("obs_id", clean0("km", 4).alias("km")),
        "nan_interp": interp(True),
        "nan_interp_unclamped": interp(False),
        "gap_bridge_limited": interp(False, 5, "km"),
        "fill2d": fill2d,
        "longest_gap": lambda s, d: t.longest_bad_run(series(s, d), ["granule"], "line_no", "ssh").select("granule", "n", clean0("gap_fraction").alias("gap_fraction")),
        "ocean_runs": ocean_runs,
        "segment_bounds_distance": bounds,
        "segment_bounds_rows": fixed_segments,
        "even_patches": even,
        "segment_metadata": metadata,
        "segments_at_targets": lambda s, d: t.segments_at(series(s, d), K, "idx", "lat", TARGETS, ROWS),
        "drop_reasons": drop_reasons,
        "detrend_linear": detrended("linear"),
        "detrend_constant": detrended("constant"),
        "detrend_plane": lambda s, d: t.detrend_plane(patches(s, d), ["label"], "row", "col", "v").select("label", "row", "col", clean0("v").alias("v")),
        "slope_field": slope_field,
        "slope_stats": slope_stats,
        "fir_filter_decimate": filtered,
        "savgol_detrend": savgol,
        "median_spacing": spacing,
        "resample_null": uniform("null"),
        "resample_zero": uniform("zero"),
        "resample_clamp": uniform("clamp"),
        "nearest_line": nearest,
        "rounded_latitude_semi": semi,
        "swath_split": swaths,
        "swath_trim": trims(False),
        "swath_trim_both": trims(True),
        "nadir_gap": gap,
        "xtrack_bin": xtrack_bin,
        "min_valid_columns": min_valid,
    }


SER = f"""{EXP}, ser as (select obs_id, granule, pass_no, pixel_no, line_no, latitude lat, longitude - 360e0 * floor(longitude / 360e0) lon, cross_track_distance xt, ssh,
  cast(row_number() over (partition by granule, pixel_no order by line_no) - 1 as integer) idx from hh where latitude is not null and longitude is not null)"""
KM = f"""{SER}, stp as (select *, coalesce({hav_sql(a1='lag(lat) over w', a2='lag(lon) over w', b1='lat', b2='lon')}, 0) step from ser window w as (partition by granule, pixel_no order by line_no)),
km as (select * exclude (step), sum(step) over (partition by granule, pixel_no order by line_no) km from stp)"""
PATCH = "pat as (select label, cast(row_number() over (partition by label order by vec_id) - 1 as integer) \"row\", embedding from embeddings), cells as (select label, \"row\", cast(i - 1 as integer) col, cast(embedding[i] as double) v from pat, range(1, 65) r(i))"


def _ends(rel, x, part="granule, pixel_no", order="line_no", y="ssh"):
    """Bracket values of every row."""
    return f"""br as (select *, last_value(case when {y} is not null then {y} end ignore nulls) over b py, last_value(case when {y} is not null then {x} end ignore nulls) over b px,
      last_value(case when {y} is not null then rn end ignore nulls) over b pr, first_value(case when {y} is not null then {y} end ignore nulls) over a ny,
      first_value(case when {y} is not null then {x} end ignore nulls) over a nx, first_value(case when {y} is not null then rn end ignore nulls) over a nr
      from (select *, row_number() over (partition by {part} order by {order}) rn from {rel})
      window b as (partition by {part} order by {order} rows between unbounded preceding and current row), a as (partition by {part} order by {order} rows between current row and unbounded following))"""


_BLEND = "coalesce({y}, py + (ny - py) * ({x} - px) / nullif(nx - px, 0))"
_SEGROWS = f"""{SER}, nn as (select granule, pixel_no, max(idx) + 1 n from ser group by 1, 2), st as (select distinct granule, pixel_no, n, cast(i0 as integer) i0 from
  (select *, unnest(range(0, n - {ROWS} + 1, {ROWS // 2})) i0 from nn where n >= {ROWS} union all select *, n - {ROWS} from nn where n >= {ROWS})),
mem as (select st.i0, ser.* from st join ser on ser.granule = st.granule and ser.pixel_no = st.pixel_no and ser.idx >= st.i0 and ser.idx < st.i0 + {ROWS})"""
_SLOPE = f"""{KM}, {_ends('km', 'km')}, fl as (select *, case when ssh is not null then ssh when nr - pr - 1 <= 5 then {_BLEND.format(y='ssh', x='km')} end z from br),
sl as (select *, case when lead(km) over w - lag(km) over w > 0 then (lead(z) over w - lag(z) over w) / (lead(km) over w - lag(km) over w) * 1e-3 end slope from fl window w as (partition by granule, pixel_no order by line_no)),
sv as (select *, case when abs(lat) >= 2 then 981e-2 * slope / (2 * 7.2921150e-5 * sin(radians(lat))) end v from sl where slope is not null)"""
_FULL = f"{SER}, {_ends('ser', 'line_no')}, full_ as (select * exclude (ssh), coalesce({_BLEND.format(y='ssh', x='line_no')}, py, ny) ssh from br), ok as (select *, count(*) over (partition by granule, pixel_no) n from full_ where ssh is not null)"


def _resample(outside):
    y = "py + (ny - py) * (km - px) / nullif(nx - px, 0)"
    out = {"null": f"coalesce(case when px = km then py end, {y})", "zero": f"coalesce(case when px = km then py end, {y}, 0)", "clamp": f"coalesce(case when px = km then py end, {y}, py, ny)"}[outside]
    return f"""with {KM}, pt as (select granule, pixel_no, km, avg(ssh) ssh from km where ssh is not null group by 1, 2, 3),
      tg as (select granule, pixel_no, cast(unnest(range(0, cast(ceil(m) as integer) + 101, 100)) as double) km from (select granule, pixel_no, max(km) m from pt group by 1, 2)),
      al as (select *, 0 tg from pt union all select granule, pixel_no, km, null, 1 from tg), {_ends('al', 'km', order='km, tg')}
      select granule, pixel_no, km, round({out}, 6) + 0e0 ssh from br where tg = 1"""


def _savgol_sql(window=21, degree=3):
    import numpy as np

    u = np.arange(window) - window // 2
    v = np.vander(u / max(1, window // 2), degree + 1)
    hat = v @ np.linalg.pinv(v)
    rows = ", ".join("(" + f"{i}, {j}, {hat[i, j]!r}".replace("np.float64(", "").replace(")", "") + ")" for i in range(window) for j in range(window))
    return f"""with {_FULL}, oi as (select *, row_number() over (partition by granule, pixel_no order by line_no) - 1 i from ok), hat(a, b, w) as (values {rows}),
      bg as (select *, least(greatest(i - {window // 2}, 0), n - {window}) g from oi where n >= {window})
      select x.obs_id, round(x.ssh - sum(hat.w * y.ssh), 6) + 0e0 ssh from bg x join oi y on y.granule = x.granule and y.pixel_no = x.pixel_no and y.i >= x.g and y.i < x.g + {window}
      join hat on hat.a = x.i - x.g and hat.b = y.i - x.g group by x.obs_id, x.ssh"""


def _taps_sql(n=17):
    return ", ".join(f"({i - n // 2}, {w!r})" for i, w in enumerate(t.hamming_taps(n)))


ORACLE = tie_free({
    "swath_trim_median": f"""with {SER}, m as (select granule, pixel_no, median(xt) m from ser group by 1, 2), x as (select ser.*, case when m < 0 then 'left' when m > 0 then 'right' end swath from ser join m using (granule, pixel_no)),
      c as (select pass_no, swath, pixel_no, median(xt) x from x where swath is not null group by all), b as (select pass_no, swath, median(x) mid, floor((max(x) - min(x) - 4000) / 2) half from c group by all)
      select pass_no, swath, pixel_no, count(*) n from x join c using (pass_no, swath, pixel_no) join b using (pass_no, swath) where c.x > mid - half and c.x < mid + half group by all""",
    "pixel_trim": f"with {SER}, b as (select pass_no, min(pixel_no) lo, max(pixel_no) hi from ser group by 1) select pass_no, pixel_no, count(*) n from ser join b using (pass_no) where pixel_no between lo + 2 and hi - 2 group by 1, 2",
    "segments_around_targets": f"""with {KM}, tg(target) as (values (-60e0), (-30e0), (0e0), (30e0), (60e0)), c as (select granule, pixel_no, target, arg_min(idx, (abs(lat - target), idx)) center, arg_min(km, (abs(lat - target), idx)) mid, min(km) a, max(km) b from km, tg group by 1, 2, 3)
      select c.granule, c.pixel_no, target, center, min(idx) i0, max(idx) + 1 i1 from c join km on km.granule = c.granule and km.pixel_no = c.pixel_no and km.km between mid - {LENGTH / 2}e0 and mid + {LENGTH / 2}e0
      where mid - {LENGTH / 2}e0 >= a and mid + {LENGTH / 2}e0 <= b group by all having count(*) >= 8""",
    "every_tenth": f"with {SER} select obs_id, granule, pixel_no, line_no from ser where idx % 10 = 0",
    "fir_decimate_2d": f"""with {PATCH}, tp(o, w) as (values {_taps_sql(9)}), nn as (select label, max("row") + 1 n from cells group by 1)
      select x.label, x."row", x.col, round(sum(a.w * b.w * y.v), 6) + 0e0 v from cells x join nn on nn.label = x.label join tp a on true join tp b on true join cells y on y.label = x.label and y."row" = x."row" + a.o and y.col = x.col + b.o
      where x."row" >= 9 and x."row" < n - 9 and (x."row" - 9) % 4 = 0 and x.col >= 9 and x.col < 55 and (x.col - 9) % 4 = 0 group by 1, 2, 3""",
    "track_distance": f"with {KM} select obs_id, round(km, 4) + 0e0 km from km",
    "nan_interp": f"with {SER}, {_ends('ser', 'line_no')} select obs_id, round(coalesce({_BLEND.format(y='ssh', x='line_no')}, py, ny), 6) + 0e0 ssh from br",
    "nan_interp_unclamped": f"with {SER}, {_ends('ser', 'line_no')} select obs_id, round({_BLEND.format(y='ssh', x='line_no')}, 6) + 0e0 ssh from br",
    "gap_bridge_limited": f"with {KM}, {_ends('km', 'km')} select obs_id, round(case when ssh is not null then ssh when nr - pr - 1 <= 5 then {_BLEND.format(y='ssh', x='km')} end, 6) + 0e0 ssh from br",
    "fill2d": f"""with {PATCH}, c0 as (select label, "row", col, case when ("row" * 7 + col * 13) % 10 <> 0 then v end v from cells), keep as (select * from c0 where label in (select label from c0 group by 1 having avg(case when v is null then 1e0 else 0e0 end) <= 0.15)),
      {_ends('keep', 'col', 'label, "row"', 'col', 'v')}, r1 as (select label, "row", col, coalesce({_BLEND.format(y='v', x='col')}, py, ny) v from br),
      {_ends('r1', '"row"', 'label, col', '"row"', 'v').replace('br as', 'br2 as')}
      select label, "row", col, round(coalesce({_BLEND.format(y='v', x='"row"')}, py, ny), 6) + 0e0 v from br2""",
    "longest_gap": f"""with {SER}, rw as (select granule, line_no, avg(case when ssh is null then 1e0 else 0e0 end) > 5e-1 bad, row_number() over (partition by granule order by line_no) i from ser group by granule, line_no),
      rn as (select granule, i - row_number() over (partition by granule, bad order by line_no) g, bad from rw), ln as (select granule, g, count(*) len from rn where bad group by 1, 2)
      select rw.granule, count(*) n, round(coalesce((select max(len) from ln where ln.granule = rw.granule), 0) / cast(count(*) as double), 6) + 0e0 gap_fraction from rw group by rw.granule""",
    "ocean_runs": f"""with {SER}, v as (select *, line_no - row_number() over (partition by granule, pixel_no order by line_no) g from ser where ssh is not null)
      select granule, pixel_no, min(line_no) start_line, max(line_no) end_line, count(*) n_lines, round(avg(lat), 6) + 0e0 mean_latitude from v group by granule, pixel_no, g having count(*) >= 8""",
    "segment_bounds_distance": f"""with {KM}, tot as (select granule, pixel_no, min(km) d0, max(km) total from km group by 1, 2),
      reg as (select *, d0 + i * {LENGTH / 2}e0 s from (select *, unnest(range(0, greatest(cast(ceil((total - {LENGTH}e0 + 1e-9 - d0) / {LENGTH / 2}e0) as bigint), 1))) i from tot)),
      st as (select granule, pixel_no, s from reg union all select granule, pixel_no, total - {LENGTH}e0 from reg group by granule, pixel_no, total having total - {LENGTH}e0 > max(s) + 1e-9),
      bd as (select st.granule, st.pixel_no, s, count(*) filter (where km < s) i0, count(*) filter (where km <= s + {LENGTH}e0) i1 from st join km on km.granule = st.granule and km.pixel_no = st.pixel_no group by 1, 2, 3),
      rk as (select *, row_number() over (partition by granule, pixel_no, i1 order by s) k from bd where i1 - i0 >= 8)
      select granule, pixel_no, round(s, 4) + 0e0 start_km, cast(i0 as integer) i0, cast(i1 as integer) i1 from rk where k = 1""",
    "segment_bounds_rows": f"with {_SEGROWS} select granule, pixel_no, n, i0, i0 + {ROWS} i1 from st",
    "even_patches": f"with {SER}, n as (select granule, pixel_no, cast(count(*) as integer) n from ser group by 1, 2) select distinct granule, pixel_no, n, cast(floor(i * (n - {ROWS}) / 4e0 + 1e-9) as integer) i0 from n, range(0, 5) r(i) where n >= {ROWS}",
    "segment_metadata": f"""with {_SEGROWS} select granule, pixel_no, i0, round(avg(lat), 6) + 0e0 lat_mean, min(lat) lat_min, max(lat) lat_max, round(avg(lon), 4) + 0e0 lon_mean,
      round(avg(case when ssh is not null then 1e0 else 0e0 end), 6) + 0e0 valid_fraction, count(*) n from mem group by 1, 2, 3""",
    "segments_at_targets": f"""with {SER}, tg(target) as (values {', '.join(f'({v}e0)' for v in TARGETS)}), c as (select granule, pixel_no, target, cast(arg_min(idx, (abs(lat - target), idx)) as integer) center, max(idx) + 1 n from ser, tg group by 1, 2, 3)
      select granule, pixel_no, target, center, center - {ROWS // 2} i0, center + {ROWS // 2} i1 from c where center - {ROWS // 2} >= 0 and center + {ROWS // 2} <= n""",
    "drop_reasons": f"""with {_SEGROWS}, q as (select granule, pixel_no, i0, avg(case when ssh is null then 1e0 else 0e0 end) missing from mem group by 1, 2, 3),
      isl as (select granule, pixel_no, i0, count(*) len from (select *, idx - row_number() over (partition by granule, pixel_no, i0 order by idx) g from mem where ssh is null) group by granule, pixel_no, i0, g),
      g as (select granule, pixel_no, i0, max(len) / {ROWS}e0 f from isl group by 1, 2, 3)
      select case when missing > 0.15 then 'nan_fraction' when f > 0.05 then 'gap' else 'used' end reason, count(*) n from q left join g using (granule, pixel_no, i0) group by 1""",
    "detrend_linear": f"""with {SER}, v as (select * from ser where ssh is not null) select obs_id, round(ssh - avg(ssh) over w - coalesce(case when count(*) over w > 1 then regr_slope(ssh, idx) over w end, 0) * (idx - avg(idx) over w), 6) + 0e0 ssh from v window w as (partition by granule, pixel_no)""",
    "detrend_constant": f"with {SER} select obs_id, round(ssh - avg(ssh) over (partition by granule, pixel_no), 6) + 0e0 ssh from ser where ssh is not null",
    "detrend_plane": f"""with {PATCH} select label, "row", col, round(v - avg(v) over w - regr_slope(v, "row") over w * ("row" - avg("row") over w) - regr_slope(v, col) over w * (col - avg(col) over w), 6) + 0e0 v from cells window w as (partition by label)""",
    "slope_field": f"with {_SLOPE} select obs_id, round(slope * 1e6, 4) + 0e0 slope_e6, round(v, 4) + 0e0 v from sv",
    "slope_stats": f"with {_SLOPE} select granule, count(*) n, round(avg(slope * 1e6), 4) + 0e0 mean, round(var_pop(slope * 1e6), 4) + 0e0 variance, round(sqrt(avg(slope * slope * 1e12)), 4) + 0e0 rms, round(sqrt(avg(v * v)), 4) + 0e0 v_rms from sv group by 1",
    "fir_filter_decimate": f"""with {_FULL}, oi as (select *, cast(row_number() over (partition by granule, pixel_no order by line_no) - 1 as integer) i from ok), tp(o, w) as (values {_taps_sql()})
      select x.granule, x.pixel_no, x.i idx, round(sum(w * y.ssh), 6) + 0e0 ssh from oi x join tp on true join oi y on y.granule = x.granule and y.pixel_no = x.pixel_no and y.i = x.i + o
      where x.i >= 17 and x.i < x.n - 17 and (x.i - 17) % 8 = 0 group by 1, 2, 3""",
    "savgol_detrend": _savgol_sql(),
    "median_spacing": f"with {KM}, st2 as (select *, km - lag(km) over (partition by granule, pixel_no order by line_no) s from km) select granule, pixel_no, round(coalesce(quantile_cont(s, 0.5) filter (where s > 0), 2e0), 4) + 0e0 spacing from st2 group by 1, 2",
    "resample_null": _resample("null"),
    "resample_zero": _resample("zero"),
    "resample_clamp": _resample("clamp"),
    "nearest_line": f"""with {SER}, {SEG.replace('seg as', 'seg as')}, ln as (select granule, line_no, min(lat) lat, min(lon) lon from ser group by 1, 2),
      x as (select segment_id, line_no, {hav_sql(a1='lat_mean', a2='lon_mean', b1='lat', b2='lon')} km from seg join ln using (granule) where lat_mean is not null and lon_mean is not null)
      select segment_id, arg_min(line_no, (km, line_no)) line_no, round(min(km), 4) + 0e0 km from x group by 1""",
    "rounded_latitude_semi": f"with {SER}, {SEG} select segment_id, lat_mean from seg where lat_mean is not null and exists (select 1 from ser where ser.granule = seg.granule and floor(ser.lat * 1e1 + 5e-1) = floor(lat_mean * 1e1 + 5e-1))",
    "swath_split": f"with {SER} select granule, pixel_no, case when median(xt) < 0 then 'left' when median(xt) > 0 then 'right' end swath, count(*) n from ser group by 1, 2",
    "swath_trim": f"""with {SER}, m as (select granule, pixel_no, median(xt) m from ser group by 1, 2), x as (select ser.*, case when m < 0 then 'left' when m > 0 then 'right' end swath from ser join m using (granule, pixel_no)),
      y as (select *, max(abs(xt)) over (partition by pass_no, swath) hi from x where swath is not null) select pass_no, swath, pixel_no, count(*) n from y where abs(xt) <= hi - 4000 group by 1, 2, 3""",
    "swath_trim_both": f"""with {SER}, m as (select granule, pixel_no, median(xt) m from ser group by 1, 2), x as (select ser.*, case when m < 0 then 'left' when m > 0 then 'right' end swath from ser join m using (granule, pixel_no)),
      y as (select *, max(abs(xt)) over p hi, min(abs(xt)) over p lo from x where swath is not null window p as (partition by pass_no, swath)) select pass_no, swath, pixel_no, count(*) n from y where abs(xt) <= hi - 4000 and abs(xt) >= lo + 4000 group by 1, 2, 3""",
    "nadir_gap": f"""with {PATCH}, v as (select label, col from cells where not (col between 28 and 28 + label % 4) group by 1, 2), r as (select label, col - row_number() over (partition by label order by col) g, col from v),
      reg as (select label, min(col) a, max(col) b from r group by label, g), rk as (select *, row_number() over (partition by label order by b - a desc, a) k from reg)
      select label, cast(min(b) + 1 as integer) gap_start, cast(max(a) - 1 as integer) gap_end from rk where k <= 2 group by 1 having count(*) = 2""",
    "xtrack_bin": f"with {SER} select granule, count(*) n, count(ssh) valid from ser where abs(xt) >= 10000 and abs(xt) < 40000 group by 1",
    "min_valid_columns": f"with {SER} select granule, pixel_no, round(avg(case when ssh is not null then 1e0 else 0e0 end), 6) + 0e0 f, count(*) n from ser group by 1, 2 having avg(case when ssh is not null then 1e0 else 0e0 end) >= 0.9 and count(*) >= 100",
})
