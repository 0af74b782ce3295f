"""Distances and what hangs on them, against numbers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.geo import EARTH_KM, haversine_km
from tidemark.operators import tracks as t

DEGREE = math.pi / 180 * EARTH_KM  # 111.19508 km along a meridian


def km(spark, *p):
    return spark.range(1).select(haversine_km(*[F.lit(v).cast("double") for v in p])).first()[0]


def test_known_distances(spark):
    assert km(spark, 0, 0, 1, 0) == pytest.approx(111.19508, abs=1e-5)
    assert km(spark, 0, 0, 0, 90) == pytest.approx(math.pi / 2 * EARTH_KM)
    assert km(spark, 0, 0, 0, 180) == pytest.approx(math.pi * EARTH_KM)
    assert km(spark, 90, 0, -90, 77) == pytest.approx(math.pi * EARTH_KM)
    assert km(spark, 12.5, 359.5, 12.5, -0.5) == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("missing", range(4))
def test_a_missing_coordinate_has_no_distance(spark, missing):
    assert km(spark, *[None if i == missing else 1.0 for i in range(4)]) is None


def track(spark, rows):
    return spark.createDataFrame([("g", i, la, lo) for i, (la, lo) in enumerate(rows)], "g string, line int, lat double, lon double")


def test_track_begins_at_zero(spark):
    d = track(spark, [(10.0, 5.0), (11.0, 5.0), (None, None), (11.5, 5.0), (11.5, 5.0)])
    got = [r.km for r in t.along_track_km(d, ["g"], "line", "lat", "lon").orderBy("line").collect()]
    assert got[2] is None
    assert [got[i] for i in (0, 1, 3, 4)] == pytest.approx([0.0, DEGREE, 1.5 * DEGREE, 1.5 * DEGREE])


def test_segments_begin_at_the_first_line(spark):
    d = t.along_track_km(track(spark, [(i * 0.1, 0.0) for i in range(40)]), ["g"], "line", "lat", "lon")
    s = t.distance_segments(d.withColumn("idx", F.col("line")), ["g"], "km", "idx", 1.03 * DEGREE).orderBy("i0").collect()
    # 39 steps of a tenth of a degree: three segments of 1.03 degrees, and the last one up to the end
    assert [(r.i0, r.i1) for r in s] == [(0, 11), (11, 21), (21, 31), (29, 40)]
    assert [r.start_km for r in s] == pytest.approx([0, 1.03 * DEGREE, 2.06 * DEGREE, 2.87 * DEGREE])


def test_resampled_values_lie_on_the_track(spark, small):
    from tidemark.plans import ref_series

    x = ref_series.queries()["resample_null"](spark, small)
    span = ref_series.with_km(spark, small).where("ssh is not null").groupBy("granule", "pixel_no").agg(F.min("km").alias("lo"), F.max("km").alias("hi"))
    inside = F.col("km").between(F.col("lo"), F.col("hi"))
    filled, n = x.join(span, ["granule", "pixel_no"]).agg(F.count_if(F.col("ssh").isNotNull() == inside), F.count("*")).first()
    assert filled == n and x.where("ssh is not null").count() > n / 2
    ends = ref_series.queries()["track_distance"](spark, small).agg(F.min("km"), F.max("km")).first()
    assert ends[0] == 0 and ends[1] < 20_100
