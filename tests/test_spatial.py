import numpy as np
import pytest

from tidemark.operators import spatial as sp

POINT = "id long, run int, lat double, lon double, cell long, code string, lo int, g int"


def km(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * sp.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h)))


def cloud(seed=3):
    r = np.random.default_rng(seed)
    lat = np.concatenate([r.uniform(-90, 90, 80), 89.9 + r.uniform(0, 0.1, 30), r.uniform(-0.3, 0.3, 60), [90.0, -90.0, 0.0, 0.0]])
    lon = np.concatenate([r.uniform(-180, 360, 80), r.uniform(0, 360, 30), 180 + r.uniform(-0.3, 0.3, 60), [0.0, 10.0, 180.0, -180.0]])
    return [(i, int(i % 2), float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "", 0, 9) for r in rows], POINT)


@pytest.mark.parametrize("limit", [0.5, 10.0, 400.0])
def test_pairs(spark, limit):
    rows = cloud()
    dirt = [(900, 0, None, 1.0), (901, 0, float("nan"), 1.0), (902, 0, 1.0, None), (None, 0, 1.0, 1.0), (903, None, 0.0, 0.0), (904, 0, 95.0, 0.0)]
    df = frame(spark, rows + rows[:40] + dirt)
    got = {(r["id"], r["other_id"]) for r in sp.near_pairs(df, limit, "id", "lat", "lon", "run").collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and km(a[2], a[3], b[2], b[3]) <= limit}
    assert got == want and want


def test_regions(spark):
    rows = cloud(4)
    sites = [(i, float(la), float(lo), float(r)) for i, (la, lo, r) in enumerate([(90, 0, 50), (0, 179.9, 60), (0, -179.9, 5), (10, 20, 3000), (0, 0, 25000), (5, 5, -1), (5, 5, 0)])]
    s = spark.createDataFrame(sites + sites[:2] + [(99, None, 1.0, 1.0)], "sid int, slat double, slon double, r double")
    got = {(x["id"], x["region_id"]) for x in sp.within_regions(frame(spark, rows), s, "id", "lat", "lon", "sid", "slat", "slon", "r").collect()}
    assert got == {(a[0], b[0]) for a in rows for b in sites if km(a[2], a[3], b[1], b[2]) <= b[3]}


def test_empty(spark):
    e = frame(spark, cloud()).limit(0)
    assert sp.near_pairs(e, 10, "id", "lat", "lon", "run").count() == 0
    s = spark.createDataFrame([], "sid int, slat double, slon double, r double")
    assert sp.within_regions(frame(spark, cloud()), s, "id", "lat", "lon", "sid", "slat", "slon", "r").count() == 0


def test_codes_sort_like_their_cells(spark):
    df = spark.createDataFrame([(1, 2, 3), (2**21 - 1, 0, 5)], "x long, y long, z long")
    got = [r[0] for r in df.select(sp.morton(df.x, df.y, df.z)).collect()]

    def brute(*c):
        return sum(((v >> i) & 1) << (3 * i + a) for a, v in enumerate(c) for i in range(21))

    assert got == [brute(1, 2, 3), brute(2**21 - 1, 0, 5)]
