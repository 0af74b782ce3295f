"""Registered queries: statistics of the segments' spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dsp
from tidemark.operators import spectral_stats as st
from tidemark.operators.tracks import resample
from tidemark.plans.common import LONG, SEG, clean0, measured, segments, significant, significant_sql, table, tie_free
from tidemark.schema import unnest_vectors

BANDS = [(a, b) for a in (0.01, 0.02, 0.05) for b in (0.1, 0.2)]


def long(s, d):
    x = unnest_vectors(segments(s, d, "wavenumber", "psd"), ["segment_id", "granule", "swath", "lat_mean", "lon_mean", "month"], "wavenumber", "psd")
    return x.where(measured("psd")).withColumn("psd", F.col("psd") * 1e4)


def queries():
    seg = ["segment_id"]

    def ready(f, *cols, digits=8, rounded=significant):
        def q(s, d):
            x = f(long(s, d))
            return x.select(*[c for c in x.columns if c not in cols], *[rounded(c, digits).alias(c) for c in cols])

        return q

    def pooled(s, d):
        return st.pooled_sides(st.standard_error(long(s, d), ["month", "swath", "ik"]), ["month", "ik"]).select("month", "ik", significant("mean").alias("mean"), significant("error").alias("error"))

    def pass_mean(s, d):
        return long(s, d).groupBy("granule", "swath", "ik").agg(F.max("k").alias("k"), significant(F.avg("psd"), 10).alias("mean"), F.count("*").alias("n"))

    def mean_of_means(s, d):
        per = long(s, d).groupBy("granule", "swath", "ik").agg(F.avg("psd").alias("m"))
        return per.groupBy("ik").agg(significant(F.avg("m")).alias("mean"))

    def lon_slices(s, d):
        x = long(s, d).where("lon_mean is not null").withColumn("slice", F.when(F.col("lon_mean").between(-60, 0), "west").when(F.col("lon_mean").between(60, 120), "east")).where("slice is not null")
        m = x.groupBy("slice", "ik").agg(F.max("k").alias("k"), F.avg("psd").alias("psd"))
        return st.spectral_slope(m, ["slice"], 0.01, 0.1).select("slice", clean0("slope").alias("slope"))

    def colour_limits(s, d):
        e = st.percentile_row(st.band_energy_gradient(long(s, d), seg, 0.01, 0.1), [], {"low": 0.05, "high": 0.95}, "energy")
        return e.select(*[significant(c).alias(c) for c in ("low", "high")])

    def probe(s, d):
        x = st.at_wavelength(long(s, d), ["segment_id", "swath"], 30.0)
        q = st.percentile_row(x, ["swath"], {"q25": 0.25, "q50": 0.5, "q75": 0.75}, "psd")
        return q.join(x.groupBy("swath").agg(F.count("*").alias("n")), "swath").select("swath", "n", *[significant(c).alias(c) for c in ("q25", "q50", "q75")])

    def cycles(s, d):
        """Spectra of the same pass in different cycles beside each other, on the wavenumbers they share."""
        m = table(s, d, "granule_manifest").groupBy("granule").agg(F.min("pass_no").alias("pass_no"), F.min("cycle_no").alias("cycle_no"))
        c = long(s, d).join(m, "granule").groupBy("pass_no", "swath", "cycle_no", "ik").agg(F.avg("psd").alias("psd"))
        return c.groupBy("pass_no", "swath", "ik").agg(F.count("*").alias("n_cycles"), significant(F.avg("psd")).alias("mean"), significant(F.max("psd")).alias("largest"))

    def majority(s, d):
        x = segments(s, d, "psd").where("psd is not null").withColumn("v", F.filter("psd", lambda v: v.isNotNull()))
        return st.majority_length(x, ["swath"], "v").select("segment_id", F.size("v").alias("n"))

    def predicted(s, d):
        x = long(s, d)
        f = st.replicas(x.where("k <= 0.124").select("segment_id", "k"), 0.124, 2)
        r = resample(x.select("segment_id", "k", "psd"), f.select("segment_id", F.col("k_fold").alias("k")).distinct(), seg, "k", "psd", "zero")
        j = f.join(r.withColumnRenamed("k", "k_fold"), ["segment_id", "k_fold"])
        return j.groupBy("segment_id", "k").agg(significant(F.sum("psd")).alias("predicted"))

    return {
        "band_energy_gradient": ready(lambda x: st.band_energy_gradient(x, seg, 0.01, 0.1), "energy"),
        "band_energy_trapz": ready(lambda x: st.band_energy(x, seg, 0.01, 0.1), "energy"),
        "band_matrix": ready(lambda x: st.band_matrix(x, seg, BANDS), "energy"),
        "energy_ratio": ready(lambda x: st.energy_ratio(x, seg, 0.01, 0.1), "ratio"),
        "energy_beyond": ready(lambda x: st.energy_beyond(x, seg, 0.125), "fraction"),
        "spectral_slope": ready(lambda x: st.spectral_slope(x, seg, 0.01, 0.1), "slope", digits=6, rounded=clean0),
        "local_slope": ready(lambda x: st.local_slope(x, seg).select("segment_id", "ik", "local_slope"), "local_slope", digits=6, rounded=clean0),
        "psd_percentiles": ready(lambda x: st.percentiles(x, ["swath", "ik"], [0.05, 0.25, 0.5, 0.75, 0.95]), "value", digits=10),
        "stderr_tracks": ready(lambda x: st.standard_error(x, ["month", "swath", "ik"]), "mean", "error"),
        "pooled_lr": pooled,
        "power_law": ready(lambda x: st.power_law(x, seg, [-2.0, -11.0 / 3.0, -5.0]).select("segment_id", F.round("exponent", 6).alias("exponent"), "ik", "k", "reference"), "reference"),
        "normalised_spectrum": ready(lambda x: st.normalised(x, seg).select("segment_id", "ik", "normalised"), "normalised"),
        "probe_wavelength": probe,
        "pass_mean": pass_mean,
        "mean_of_passes": mean_of_means,
        "lon_slice_slope": lon_slices,
        "colour_limits": colour_limits,
        "nyquist_spacing": lambda s, d: long(s, d).groupBy("segment_id").agg(significant(dsp.spacing_of(F.max("k"))).alias("spacing")),
        "cycle_alignment": cycles,
        "majority_length": majority,
        "fold_prediction": predicted,
        "one_sided": ready(lambda x: st.one_sided(x, seg, double_top=False).select("segment_id", "ik", "psd"), "psd"),
    }


G = f"{SEG}, {LONG}, g as (select segment_id, granule, swath, lat_mean, lon_mean, month, cast(ik as integer) ik, k, p * 1e4 psd from long where p >= 0 and p < 'inf'::double)"
_DK = f"{G}, dk as (select *, case when lead(k) over w is null then k - lag(k) over w when lag(k) over w is null then lead(k) over w - k else (lead(k) over w - lag(k) over w) / 2 end dk from g window w as (partition by segment_id order by k))"


def _trap(where, psd="psd"):
    return f"select segment_id, sum(a) energy from (select segment_id, ({psd} + lag({psd}) over w) / 2 * (k - lag(k) over w) a from g where {where} window w as (partition by segment_id order by k)) group by 1"


_SQL = {
    "band_energy_gradient": f"with {_DK} select segment_id, round(sum(psd * dk), 6) + 0e0 energy from dk where k between 0.01 and 0.1 group by 1",
    "band_energy_trapz": f"with {G} select segment_id, round(energy, 6) + 0e0 energy from ({_trap('k between 0.01 and 0.1')})",
    "band_matrix": f"""with {G}, b(lo, hi) as (values {', '.join(f'({a}e0, {b}e0)' for a, b in BANDS)}), x as (select segment_id, lo, hi, (psd + lag(psd) over w) / 2 * (k - lag(k) over w) a from g join b on k between lo and hi
        window w as (partition by segment_id, lo, hi order by k)) select segment_id, lo, hi, round(sum(a), 6) + 0e0 energy from x group by 1, 2, 3""",
    "energy_ratio": f"with {_DK} select segment_id, round(sum(case when k between 0.01 and 0.1 then psd * dk end) / nullif(sum(psd * dk), 0), 6) + 0e0 ratio from dk group by 1",
    "energy_beyond": f"with {G} select segment_id, round(sum(case when k > 0.125 then psd else 0 end) / nullif(sum(psd), 0), 6) + 0e0 fraction from g group by 1",
    "spectral_slope": f"""with {G}, x as (select segment_id, (log10(psd) - lag(log10(psd)) over w) / (log10(k) - lag(log10(k)) over w) s from g where k between 0.01 and 0.1 and psd > 0 window w as (partition by segment_id order by k))
        select segment_id, round(avg(s), 6) + 0e0 slope from x group by 1""",
    "local_slope": f"""with {G}, x as (select segment_id, ik, ln(k) x, ln(psd) y from g where k > 0 and psd > 0), h as (select *, x - lag(x) over w hs, lead(x) over w - x hd, lag(y) over w yl, lead(y) over w yr from x window w as (partition by segment_id order by x))
        select segment_id, ik, round(case when hs is null then (yr - y) / hd when hd is null then (y - yl) / hs else (hs * hs * yr + (hd * hd - hs * hs) * y - hd * hd * yl) / (hs * hd * (hd + hs)) end, 6) + 0e0 local_slope from h""",
    "psd_percentiles": f"with {G}, q(q) as (values (0.05e0), (0.25e0), (0.5e0), (0.75e0), (0.95e0)), l as (select swath, ik, list(psd order by psd) v from g group by 1, 2) select swath, ik, q, round(list_aggregate(v, 'quantile_cont', 0.05) * (q = 0.05e0)::int + list_aggregate(v, 'quantile_cont', 0.25) * (q = 0.25e0)::int + list_aggregate(v, 'quantile_cont', 0.5) * (q = 0.5e0)::int + list_aggregate(v, 'quantile_cont', 0.75) * (q = 0.75e0)::int + list_aggregate(v, 'quantile_cont', 0.95) * (q = 0.95e0)::int, 6) + 0e0 \"value\" from l, q",
    "stderr_tracks": f"with {G} select month, swath, ik, round(avg(psd), 6) + 0e0 mean, round(stddev_pop(psd) / sqrt(count(psd)), 6) + 0e0 error from g group by 1, 2, 3",
    "pooled_lr": f"""with {G}, e as (select month, swath, ik, avg(psd) m, stddev_pop(psd) / sqrt(count(psd)) e from g group by 1, 2, 3)
        select a.month, a.ik, round((a.m + b.m) / 2, 6) + 0e0 mean, round(sqrt(a.e * a.e + b.e * b.e) / 2, 6) + 0e0 error from e a join e b on a.swath = 'left' and b.swath = 'right' and a.ik = b.ik and a.month is not distinct from b.month""",
    "power_law": f"""with {G}, a as (select *, max(case when ik = 2 then k end) over w ak, max(case when ik = 2 then psd end) over w ap from g window w as (partition by segment_id)),
        x as (select *, unnest([-2e0, -11e0 / 3e0, -5e0]) e from a where k > 0 and ak is not null)
        select segment_id, round(e, 6) exponent, ik, k, round(ap * pow(k / ak, e), 6) + 0e0 reference from x""",
    "normalised_spectrum": f"with {G} select segment_id, ik, round(psd / nullif(last_value(psd) over (partition by segment_id order by k rows between unbounded preceding and unbounded following), 0), 6) + 0e0 normalised from g",
    "probe_wavelength": f"""with {G}, b as (select segment_id, swath, arg_min(psd, (abs(k - 1e0 / 3e1), ik)) psd from g group by 1, 2)
        select swath, count(*) n, round(quantile_cont(psd, 0.25), 6) + 0e0 q25, round(quantile_cont(psd, 0.5), 6) + 0e0 q50, round(quantile_cont(psd, 0.75), 6) + 0e0 q75 from b group by 1""",
    "pass_mean": f"with {G} select granule, swath, ik, max(k) k, round(avg(psd), 6) + 0e0 mean, count(*) n from g group by 1, 2, 3",
    "mean_of_passes": f"with {G}, m as (select granule, swath, ik, avg(psd) m from g group by 1, 2, 3) select ik, round(avg(m), 6) + 0e0 mean from m group by 1",
    "lon_slice_slope": f"""with {G}, m as (select case when lon_mean between -60 and 0 then 'west' when lon_mean between 60 and 120 then 'east' end slice, ik, max(k) k, avg(psd) psd from g where lon_mean between -60 and 0 or lon_mean between 60 and 120 group by 1, 2),
        x as (select slice, (log10(psd) - lag(log10(psd)) over w) / (log10(k) - lag(log10(k)) over w) s from m where k between 0.01 and 0.1 and psd > 0 window w as (partition by slice order by k)) select slice, round(avg(s), 6) + 0e0 slope from x group by 1""",
    "colour_limits": f"with {_DK}, e as (select segment_id, sum(psd * dk) e from dk where k between 0.01 and 0.1 group by 1) select round(quantile_cont(e, 0.05), 6) + 0e0 low, round(quantile_cont(e, 0.95), 6) + 0e0 high from e",
    "nyquist_spacing": f"with {G} select segment_id, round(1 / (2 * max(k)), 6) + 0e0 spacing from g group by 1",
    "cycle_alignment": f"""with {G}, m as (select granule, min(pass_no) pass_no, min(cycle_no) cycle_no from granule_manifest group by 1), c as (select pass_no, swath, cycle_no, ik, avg(psd) psd from g join m using (granule) group by all)
        select pass_no, swath, ik, count(*) n_cycles, round(avg(psd), 6) + 0e0 mean, round(max(psd), 6) + 0e0 largest from c group by 1, 2, 3""",
    "majority_length": f"""with {SEG}, v as (select segment_id, swath, len(list_filter(psd, lambda x: x is not null)) n from seg where psd is not null), c as (select swath, n, count(*) c from v group by 1, 2), m as (select swath, arg_min(n, (-c, n)) n from c group by 1)
        select segment_id, cast(n as integer) n from v join m using (swath, n)""",
    "fold_prediction": f"""with {G}, f as (select segment_id, k, k + n * 0.124e0 kf from g, range(0, 2) r(n) where k <= 0.124), br as (select f.segment_id, f.k, f.kf, max(case when g.k <= f.kf then (g.k, g.psd) end) lo, min(case when g.k >= f.kf then (g.k, g.psd) end) hi
        from f join g using (segment_id) group by 1, 2, 3)
        select segment_id, k, round(sum(case when lo is null or hi is null then 0 when lo[1] = kf then lo[2] else lo[2] + (hi[2] - lo[2]) * (kf - lo[1]) / (hi[1] - lo[1]) end), 6) + 0e0 predicted from br group by 1, 2""",
    "one_sided": f"with {G} select segment_id, ik, round(case when k > 0 and k < max(abs(k)) over (partition by segment_id) then 2 * psd else psd end, 6) + 0e0 psd from g where k >= 0",
}
_DIGITS = {"pass_mean": 10, "psd_percentiles": 10, "spectral_slope": 0, "local_slope": 0, "lon_slice_slope": 0}  # 0: slopes are near one
ORACLE = tie_free({name: significant_sql(sql, d) if (d := _DIGITS.get(name, 8)) else sql for name, sql in _SQL.items()})
