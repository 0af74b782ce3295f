import pytest
from pyspark.sql import functions as F

from tidemark.operators import gridding as g
from tidemark.sources import granules as src
from tidemark.streaming import grids


def test_month_of_folder(spark):
    df = spark.createDataFrame([("/d/SSH_0424/",), ("/d/SSH_1323",), ("/d/none",), ("/d/special",), (None,)], "p string")
    y, m = src.month_of_folder(F.col("p"), {"special": (2025, 7)})
    assert [tuple(r) for r in df.select(y, m).collect()] == [(2024, 4), (None, None), (None, None), (2025, 7), (None, None)]


def test_manifest_and_sinks(spark, tmp_path):
    m = spark.createDataFrame([("a", "o", None), ("a", "o", None), ("b", "o", ""), ("c", "o", "boom")], "granule string, output string, error string")
    m.coalesce(1).write.csv(str(tmp_path / "m"), header=True)
    again = src.read_manifest_csv(spark, str(tmp_path / "m"))
    out = spark.createDataFrame([("a", 1, 2024), ("c", 2, 2024)], "granule string, month int, data_year int")
    assert [r["granule"] for r in src.combine_by_manifest(again, out).collect()] == ["a"]
    assert [r["granule"] for r in src.missing_outputs(again, out).collect()] == ["b"]
    src.write_payload(out, out, {"run": "1"}, str(tmp_path / "p"))
    found = src.discover(spark, str(tmp_path / "p" / "segments"))
    assert found.count() == 2 and "path" in found.columns
    assert spark.read.parquet(str(tmp_path / "p" / "segments")).where("month = 1").count() == 1


def test_reload_or_build(spark, tmp_path):
    df = spark.createDataFrame([("a", "2")], "x string, box string")
    assert src.reload_or_build(spark, str(tmp_path / "none"), "box", "2", lambda: df).count() == 1
    df.write.parquet(str(tmp_path / "t"))
    assert src.reload_or_build(spark, str(tmp_path / "t"), "box", "2", lambda: df.limit(0)).count() == 1
    assert src.reload_or_build(spark, str(tmp_path / "t"), "box", "3", lambda: df.limit(0)).count() == 0


def test_scan_needs_cross_track(spark):
    with pytest.raises(ValueError):
        src.basic_scan(spark.createDataFrame([(1.0,)], "ssha_karin_2 double"))


def test_upper_edges(spark):
    df = spark.createDataFrame([(60.0, 180.0, 1.0), (-60.0, -180.0, 3.0), (59.9, 0.0, float("inf")), (0.0, 0.0, None)], "lat double, lon double, v double")
    drop = g.grid_accumulate(df, "lat", "lon", "v", 1.0).collect()
    clip = g.grid_accumulate(df, "lat", "lon", "v", 1.0, clip=True).collect()
    assert [(r["ilat"], r["ilon"]) for r in drop] == [(0, 0)]
    assert sorted((r["ilat"], r["ilon"]) for r in clip) == [(0, 0), (119, 359)]


def test_streaming_grid_equals_batch(spark, small, tmp_path):
    pixels = spark.read.parquet(f"{small}/swot_pixels.parquet")
    parts = tmp_path / "in"
    pixels.repartition(3).write.parquet(str(parts))
    stream = grids.read_pixel_stream(spark, str(parts), pixels.schema, 1)
    q = grids.write_grid(grids.streaming_grid(stream, late="3650 days"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    got = {(r["ilat"], r["ilon"]): (round(r["total"], 6), r["n"]) for r in grids.read_grid(spark, str(tmp_path / "out")).collect()}
    h = src.expert_scan(pixels.dropDuplicates(["obs_id"])).where("abs(ssh) < 2.5 and latitude is not null and longitude is not null")
    lon = F.pmod(F.col("longitude") + 180.0, F.lit(360.0)) - 180.0
    want = h.groupBy(F.floor("latitude").cast("int").alias("i"), F.floor(lon).cast("int").alias("j")).agg(F.sum("ssh").alias("t"), F.count("*").alias("n")).collect()
    assert got == {(r["i"], r["j"]): (round(r["t"], 6), r["n"]) for r in want}
