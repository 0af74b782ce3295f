"""Statistics of spectra in long form (keys, ik, k, psd): bands, slopes, ratios, percentiles.

All are groupBys or windows on the spectrum's keys; bands and replicas are literals of the plan and
become an explode, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tracks import gradient


def band_energy_gradient(long: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """(keys, energy): sum of psd times the gradient of k over the band, k's gradient over the whole axis."""
    g = gradient(long, keys, "k", name="_dk").where(F.col("k").between(lo, hi))
    return g.groupBy(*keys).agg(F.sum(F.col("psd") * F.col("_dk")).alias("energy"))


def trapezoids(long: DataFrame, keys: list[str], where: Column) -> DataFrame:
    """Rows of the band with the area of the trapezoid that ends there."""
    w = Window.partitionBy(*keys).orderBy("k")
    d = long.where(where)
    return d.withColumn("area", (F.col("psd") + F.lag("psd").over(w)) / 2 * (F.col("k") - F.lag("k").over(w)))


def band_energy(long: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """(keys, energy): trapezoid rule over the band; fewer than two points give NULL."""
    return trapezoids(long, keys, F.col("k").between(lo, hi)).groupBy(*keys).agg(F.sum("area").alias("energy"))


def band_matrix(long: DataFrame, keys: list[str], edges: list[tuple[float, float]]) -> DataFrame:
    """(keys, lo, hi, energy) for several bands at once."""
    bands = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in edges])
    d = long.withColumn("_b", F.explode(F.filter(bands, lambda b: F.col("k").between(b["lo"], b["hi"]))))
    d = d.select(*keys, F.col("_b.lo").alias("lo"), F.col("_b.hi").alias("hi"), "k", "psd")
    return band_energy(d, [*keys, "lo", "hi"], float("-inf"), float("inf"))


def energy_ratio(long: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """(keys, ratio): gradient-rule energy of the band over that of the whole axis."""
    g = gradient(long, keys, "k", name="_dk").withColumn("_e", F.col("psd") * F.col("_dk"))
    return g.groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col("k").between(lo, hi), F.col("_e"))), F.sum("_e")).alias("ratio"))


def energy_beyond(long: DataFrame, keys: list[str], k_n: float) -> DataFrame:
    """(keys, fraction): share of the summed power at wavenumbers above ``k_n``."""
    return long.groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col("k") > k_n, F.col("psd")).otherwise(0.0)), F.sum("psd")).alias("fraction"))


def spectral_slope(long: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """(keys, slope): mean of the log-log difference quotients in the band."""
    w = Window.partitionBy(*keys).orderBy("k")
    d = long.where(F.col("k").between(lo, hi) & (F.col("k") > 0) & (F.col("psd") > 0))
    dk, dp = F.log10("k") - F.lag(F.log10("k")).over(w), F.log10("psd") - F.lag(F.log10("psd")).over(w)
    return d.withColumn("_s", F.try_divide(dp, dk)).groupBy(*keys).agg(F.avg("_s").alias("slope"))


def local_slope(long: DataFrame, keys: list[str]) -> DataFrame:
    """The log-log gradient at every wavenumber, second order on the uneven axis."""
    d = long.where((F.col("k") > 0) & (F.col("psd") > 0)).withColumn("lk", F.log("k"))
    return gradient(d, keys, "lk", F.log("psd"), "local_slope").drop("lk")


def percentiles(df: DataFrame, keys: list[str], qs: list[float], value: str = "psd") -> DataFrame:
    """(keys, q, value): exact percentiles with linear interpolation, missing values left out.

    No group is gathered: values are counted in buckets of about one per cent of their size, whose
    running counts name the few buckets that hold the wanted ranks; only values of these are sorted.
    """
    v = F.col(value)
    x = df.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(c).alias(f"_{c}") for c in keys], v.cast("double").alias("_v"))
    ks = [f"_{c}" for c in keys] or ["_all"]
    x = x if keys else x.withColumn("_all", F.lit(0))
    # buckets ascend with the value: negative numbers mirrored, zeros in one of their own
    size = F.floor(F.log2(F.abs("_v")) * 64) + (1 << 20)
    x = x.withColumn("_b", F.when(F.col("_v") > 0, size).when(F.col("_v") < 0, -size).otherwise(F.lit(0).cast("long")))
    counts = x.groupBy(*ks, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("_to", F.sum("_n").over(w)).withColumn("_all_n", F.sum("_n").over(Window.partitionBy(*ks)))
    at = F.col("q") * (F.col("_all_n") - 1)
    wanted = c.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_at", at)
    wanted = wanted.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).where("_rank < _to and _rank >= _to - _n")
    wanted = wanted.select(*[F.col(k).alias(f"{k}_") for k in ks], F.col("_b").alias("_b_"), "q", "_at", "_rank", (F.col("_to") - F.col("_n")).alias("_before"))
    same = F.col("_b") == F.col("_b_")
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    held = x.join(wanted.select(*[f"{k}_" for k in ks], "_b_", "_before").distinct(), same).groupBy(*ks, "_b", "_before", "_v").agg(F.count("*").alias("_n"))
    held = held.withColumn("_end", F.col("_before") + F.sum("_n").over(Window.partitionBy(*ks, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    found = held.join(wanted.drop("_before"), same).where("_rank < _end and _rank >= _end - _n")
    lo, hi = F.min("_v"), F.max("_v")
    out = found.groupBy(*ks, "q", "_at").agg((lo + (hi - lo) * (F.col("_at") - F.floor("_at"))).alias("value"))
    return out.select(*[F.col(f"_{c}").alias(c) for c in keys], "q", "value")


def percentile_row(df: DataFrame, keys: list[str], qs: dict[str, float], value: str) -> DataFrame:
    """(keys, one column per name of ``qs``): the percentiles side by side."""
    p = percentiles(df, keys, sorted(set(qs.values())), value)
    return p.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for n, q in qs.items()])


def standard_error(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, error): mean over tracks and its standard error, population form."""
    return long.groupBy(*keys).agg(F.avg("psd").alias("mean"), (F.stddev_pop("psd") / F.sqrt(F.count("psd"))).alias("error"))


def pooled_sides(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of left and right with the pooled error; both sides must be there."""
    side = {s: [F.max(F.when(F.col("swath") == s, F.col(c))) for c in ("mean", "error")] for s in ("left", "right")}
    return errors.groupBy(*keys).agg(
        ((side["left"][0] + side["right"][0]) / 2).alias("mean"), (F.sqrt(side["left"][1] * side["left"][1] + side["right"][1] * side["right"][1]) / 2).alias("error")
    ).where("mean is not null")


def power_law(long: DataFrame, keys: list[str], exponents: list[float], anchor: int = 2) -> DataFrame:
    """(keys, exponent, ik, k, reference): power laws through the ``anchor``-th bin of each spectrum."""
    at = F.max(F.when(F.col("ik") == anchor, F.struct("k", "psd"))).over(Window.partitionBy(*keys))
    d = long.withColumn("_a", at).where("k > 0 and _a is not null").withColumn("exponent", F.explode(F.array(*[F.lit(float(e)) for e in exponents])))
    return d.select(*keys, "exponent", "ik", "k", (F.col("_a.psd") * F.pow(F.col("k") / F.col("_a.k"), F.col("exponent"))).alias("reference"))


def normalised(long: DataFrame, keys: list[str]) -> DataFrame:
    """Each spectrum over its value at the last wavenumber."""
    last = F.max(F.struct("k", "psd")).over(Window.partitionBy(*keys)).getField("psd")
    return long.withColumn("normalised", F.try_divide(F.col("psd"), last))


def at_wavelength(long: DataFrame, keys: list[str], wavelength: float) -> DataFrame:
    """(keys, k, psd) at the wavenumber nearest to 1 / wavelength, the first of equals."""
    best = F.min(F.struct(F.abs(F.col("k") - 1.0 / wavelength).alias("d"), "ik", "k", "psd"))
    return long.groupBy(*keys).agg(best.alias("m")).select(*keys, F.col("m.k").alias("k"), F.col("m.psd").alias("psd"))


def majority_length(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """Rows whose vector has the commonest length of their group (ties: the shorter)."""
    sizes = df.groupBy(*group, F.size(vector).alias("_n")).agg(F.count("*").alias("_c"))
    mode = sizes.groupBy(*group).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col("_n").alias("n"))).getField("n").alias("_mode"))
    return df.join(mode, group).where(F.size(vector) == F.col("_mode")).drop("_mode")


def replicas(long: DataFrame, fs: float, count: int) -> DataFrame:
    """Every row with each replica number n and the wavenumber k + n * fs."""
    return long.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("k_fold", F.col("k") + F.col("n") * fs)


def one_sided(long: DataFrame, keys: list[str], double_top: bool = True) -> DataFrame:
    """Non-negative wavenumbers; interior ones doubled, the largest only with ``double_top``."""
    top = F.max(F.abs("k")).over(Window.partitionBy(*keys))
    d = long.withColumn("_top", top).where("k >= 0")
    inner = (F.col("k") > 0) if double_top else (F.col("k") > 0) & (F.col("k") < F.col("_top"))
    return d.withColumn("psd", F.when(inner, 2 * F.col("psd")).otherwise(F.col("psd"))).drop("_top")
