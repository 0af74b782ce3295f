"""Scans of pixel tables, manifests and persisted results, and the sinks for them.

The tested storage is Parquet, one row per pixel.  The products differ in which optional variables
exist; that is decided from the schema when the plan is built, never per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import nulls_for_nans

QUALITY_FLAGS = ("{var}_qual", "ssha_karin_2_qual", "ssha_karin_qual")
SURFACE_FLAGS = ("ancillary_surface_classification_flag", "surface_classification_flag")
SSH_FAMILY = ("ssha_karin", "ssha_karin_2", "ssh_karin", "ssh_karin_2")


def first_existing(df: DataFrame, candidates: tuple[str, ...] | list[str]) -> str | None:
    """First of the names that is a column of ``df``."""
    return next((c for c in candidates if c in df.columns), None)


def read_pixels(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Pixels with NaN as NULL and repeated rows (equal but for the time of receipt) once.

    Rows are first brought together by series (granule and pixel column), which is also the
    clustering that removing repeats and every window on the series need: one shuffle serves all.
    """
    df = spark.read.parquet(path)
    keep = columns or [c for c in df.columns if c != "received_at"]
    rows = nulls_for_nans(df.select(*keep))
    return by_series(rows)


def by_series(rows: DataFrame) -> DataFrame:
    """Distinct rows, brought together by series (granule and pixel column)."""
    series = [c for c in ("granule", "pixel_no") if c in rows.columns]
    return (rows.repartition(*series) if series else rows).distinct()


def corrected_ssh(df: DataFrame, var: str = "ssha_karin_2", tide: bool = True) -> Column:
    """Sea-surface height with the crossover correction and, for ``ssha_karin_2``, the tide term."""
    x = F.col(var) + F.col("height_cor_xover")
    return x + F.col("internal_tide_hret") if tide and var == "ssha_karin_2" and "internal_tide_hret" in df.columns else x


def quality_mask(df: DataFrame, value: Column, var: str, candidates: tuple[str, ...] = QUALITY_FLAGS) -> Column:
    """The value where the first quality flag that exists is 0, else NULL."""
    flag = first_existing(df, [c.format(var=var) for c in candidates])
    return F.when(F.col(flag) == 0, value) if flag else value


def surface_mask(df: DataFrame, value: Column) -> Column:
    """The value over ocean: surface class 0 and surface type 0. A granule written without surface
    type has it null throughout, which masks nothing."""
    flag = first_existing(df, SURFACE_FLAGS)
    if flag:
        value = F.when(F.col(flag) == 0, value)
    if "surface_type" in df.columns:
        value = F.when(F.coalesce(F.col("surface_type"), F.lit(0)) == 0, value)
    return value


def wave_screen(value: Column, swh: str = "swh_karin", qual: str = "swh_karin_qual", limit: float = 5.0) -> Column:
    """The value where the flag-screened wave height is at most ``limit``; missing heights screen out."""
    return F.when((F.col(qual) == 0) & (F.col(swh) <= limit), value)


def basic_scan(df: DataFrame, var: str = "ssha_karin_2", tide: bool = True) -> DataFrame:
    """Basic product: corrected height where the quality flag is 0."""
    if "cross_track_distance" not in df.columns:
        raise ValueError("the table has no cross_track_distance")
    return df.withColumn("ssh", quality_mask(df, corrected_ssh(df, var, tide), var))


def expert_scan(df: DataFrame, var: str = "ssha_karin_2", tide: bool = True, waves: bool = False, other: list[str] | None = None) -> DataFrame:
    """Expert product: Basic plus surface masks and, if asked, the wave screen; ``other`` variables
    come along raw."""
    value = surface_mask(df, quality_mask(df, corrected_ssh(df, var, tide), var))
    value = wave_screen(value) if waves else value
    keys = ["obs_id", "granule", "run_id", "pass_no", "line_no", "pixel_no", "latitude", "longitude", "cross_track_distance"]
    return df.select(*[k for k in keys if k in df.columns], value.alias("ssh"), *(other or []))


def variables_long(df: DataFrame, variables: list[str], keys: list[str]) -> DataFrame:
    """(keys, var, value): several variables at once; heights corrected, each masked by its own flag."""
    pairs = []
    for v in variables:
        value = corrected_ssh(df, v) if v in SSH_FAMILY else F.col(v)
        own = (f"{v}_qual",)
        pairs.append(F.struct(F.lit(v).alias("var"), quality_mask(df, value, v, own).cast("double").alias("value")))
    return df.select(*keys, F.explode(F.array(*pairs)).alias("z")).select(*keys, "z.var", "z.value")


def unsmoothed_scan(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two swath groups as one: left pixels reversed, left distances negative, right pixels after."""
    width = left.groupBy("granule").agg((F.max("pixel_no") + 1).alias("n_left"))
    size = width.join(right.groupBy("granule").agg(F.max("pixel_no").alias("r")), "granule", "left").select("granule", "n_left")
    flipped = left.join(size, "granule").withColumn("pixel_no", F.col("n_left") - 1 - F.col("pixel_no")).withColumn(
        "cross_track_distance", -F.abs("cross_track_distance")
    )
    moved = right.join(size, "granule", "left").withColumn("pixel_no", F.coalesce("n_left", F.lit(0)) + F.col("pixel_no")).withColumn(
        "cross_track_distance", F.abs("cross_track_distance")
    )
    return flipped.unionByName(moved).drop("n_left")


def ocean(df: DataFrame) -> Column:
    """Whether the surface flags that exist all say ocean."""
    return surface_mask(df, F.lit(1)).isNotNull()


def of_months(df: DataFrame, months: list[int], month: str = "month") -> DataFrame:
    """Rows of some months; on a table partitioned by month only these folders are read."""
    return df.where(F.col(month).isin(months))


def concatenated(spark: SparkSession, paths: dict[str, str], name: str = "cycle") -> DataFrame:
    """Several files or folders as one table with the label of each in the column ``name``."""
    parts = [spark.read.parquet(p).withColumn(name, F.lit(label)) for label, p in paths.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def discover(spark: SparkSession, folder: str, pattern: str = "*.parquet", schema=None) -> DataFrame:
    """All files below the monthly folders that match, with their names."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    df = (reader.schema(schema) if schema else reader).parquet(folder)
    return df.withColumn("path", F.col("_metadata.file_path"))


def stem(path: Column) -> Column:
    """File name without folders and without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def month_of_folder(path: Column, overrides: dict[str, tuple[int, int]] | None = None, strict: bool = False) -> tuple[Column, Column]:
    """(year, month) from a folder name ending in MMYY; overrides first; where there is none NULL, or
    with ``strict`` an error."""
    digits = F.regexp_extract(F.rtrim(path, F.lit("/")), r"([0-9]{2})([0-9]{2})$", 1), F.regexp_extract(F.rtrim(path, F.lit("/")), r"([0-9]{2})([0-9]{2})$", 2)
    month, year = digits[0].try_cast("int"), 2000 + digits[1].try_cast("int")
    ok = month.between(1, 12)
    year, month = F.when(ok, year), F.when(ok, month)
    for folder, (y, m) in (overrides or {}).items():
        hit = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1) == folder
        year, month = F.when(hit, F.lit(y)).otherwise(year), F.when(hit, F.lit(m)).otherwise(month)
    if strict:
        year, month = (F.when(c.isNotNull(), c).otherwise(F.raise_error(F.concat(F.lit("no month in "), path))) for c in (year, month))
    return year.cast("int"), month.cast("int")


def combine_by_manifest(manifest: DataFrame, outputs: DataFrame, key: str = "granule") -> DataFrame:
    """Outputs of the granules that the manifest calls successful, each manifest row once."""
    good = manifest.where(F.col("error").isNull() | (F.trim("error") == "")).select(key).distinct()
    return outputs.join(good, key, "left_semi")


def missing_outputs(manifest: DataFrame, outputs: DataFrame, key: str = "granule") -> DataFrame:
    """Successful granules of the manifest without any output."""
    good = manifest.where(F.col("error").isNull() | (F.trim("error") == "")).select(key).distinct()
    return good.join(outputs.select(key).distinct(), key, "left_anti")


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """Manifest as CSV; the columns that are used are output and error."""
    return spark.read.csv(path, header=True, schema="granule string, output string, error string")


def write_table(df: DataFrame, path: str, partitions: tuple[str, ...] = ("data_year", "month")) -> None:
    """Parquet partitioned by the columns that exist, replaced as a whole."""
    cols = [c for c in partitions if c in df.columns]
    df.write.mode("overwrite").partitionBy(*cols).parquet(path)


def write_payload(segments: DataFrame, means: DataFrame, metadata: dict[str, str], path: str) -> None:
    """A run's result as two tables and one row of metadata."""
    write_table(segments, f"{path}/segments")
    means.write.mode("overwrite").parquet(f"{path}/means")
    spark = segments.sparkSession
    spark.createDataFrame([tuple(metadata.values())], ", ".join(f"`{k}` string" for k in metadata)).write.mode("overwrite").parquet(f"{path}/metadata")


def reload_or_build(spark: SparkSession, path: str, setting: str, value: str, build) -> DataFrame:
    """A persisted table whose metadata column ``setting`` still has ``value``, else a new one."""
    try:
        df = spark.read.parquet(path)
        if setting in df.columns and not df.where(F.col(setting) != value).limit(1).count():
            return df
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    return build()
