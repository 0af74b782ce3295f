import numpy as np
import pytest

from tidemark.llm import splitting as sp

SEG = "segment_id long, granule string, swath string, along_track_distance_start_km double, along_track_distance_end_km double, pos long, id int"
BRK = "break_id long, granule string, swath string, break_km double, break_kind string, id int"


def walk(s, e, breaks):
    """Greedy cuts, one after the other."""
    c, out = s + 50_000, []
    inner = sorted({b for b in breaks if s < b < e})
    while c < e:
        near = [b for b in inner if c < b <= c + 450_000]
        c = e if e <= c + 450_000 else near[-1] if near else c + 450_000
        out.append(c)
    return out


def frames(spark, segs, breaks):
    return (
        spark.createDataFrame([(i, g, w, a, b, 1, 1) for i, g, w, a, b in segs], SEG),
        spark.createDataFrame([(i, g, w, k, "land", 1) for i, (g, w, k) in enumerate(breaks)], BRK),
    )


def test_against_a_walk(spark):
    r = np.random.default_rng(2)
    segs, breaks = [], []
    for i in range(25):
        s = round(float(r.uniform(0, 3000)), 3)
        segs.append((i, f"g{i % 5}", ["left", "Right "][i % 2], s, round(s + float(r.uniform(400, 12_000)), 3)))
    for g in range(5):
        for _ in range(60):
            breaks.append((f"g{g}", [None, "left", "RIGHT"][int(r.integers(3))], round(float(r.uniform(0, 15_000)), 3)))
    got = {}
    for p in sp.split_stretches(*frames(spark, segs + segs[:3], breaks + breaks[:9])).orderBy("segment_id", "piece_no").collect():
        got.setdefault(p["segment_id"], []).append((round(p["start_km"] * 1000), round(p["end_km"] * 1000)))
    want = {}
    for i, g, w, a, b in segs:
        s, e = round(a * 1000), round(b * 1000)
        if e - s > 500_000:
            cuts = walk(s, e, [round(k * 1000) for h, v, k in breaks if h == g and (v is None or v.strip().lower() == w.strip().lower())])
            want[i] = list(zip([s, *[c - 50_000 for c in cuts[:-1]]], cuts))
    assert got == want


def test_pieces_obey_the_limit(spark):
    pieces = sp.split_stretches(*frames(spark, [(1, "g", "left", 0.0, 20_000.0)], [("g", None, float(k)) for k in range(0, 20_000, 333)])).collect()
    assert max(p["end_km"] - p["start_km"] for p in pieces) <= 500


@pytest.mark.parametrize(
    "a,b,breaks,kind",
    [
        (0.0, 500.0, [], None),
        (0.0, 500.001, [], "forced"),
        (500.001, 0.0, [300.0], "boundary"),
        (100_000.0, 700_000.0, [400.0], "boundary"),
        (0.0, 600.0, [450.0], "boundary"),
        (0.0, 600.0, [450.001], "forced"),
        (0.0, 600.0, [0.0, 600.0, -5.0, 700.0, None, float("nan")], "forced"),
        (None, 900.0, [], None),
        (float("nan"), 900.0, [], None),
        (0.0, float("inf"), [], None),
    ],
)
def test_kinds(spark, a, b, breaks, kind):
    got = [r["cut_kind"] for r in sp.cut_kinds(*frames(spark, [(1, "g", "left", a, b)], [("g", "left", k) for k in breaks] or [("h", None, 1.0)])).collect()]
    assert got == ([kind] if kind else [])


def test_empty(spark):
    s, b = frames(spark, [(1, "g", "left", 0.0, 900.0)], [("g", None, 5.0)])
    assert sp.split_stretches(s.limit(0), b).count() == 0
    assert sp.cut_kinds(s, b.limit(0)).count() == 1


def test_kinds_against_the_definition(spark):
    """Random breaks, many in the first 50 km and between 450 and 500 km, where the walk needs no forced cut."""
    r = np.random.default_rng(5)
    segs = [(i, f"g{i}", "left", 0.0, float(r.choice([501.0, 700.0, 905.0, 1400.0]))) for i in range(150)]
    places = [0.5, 20.0, 49.0, 50.0, 51.0, 300.0, 449.0, 451.0, 470.0, 490.0, 500.0, 502.0, 900.0, 949.0, 955.0]
    breaks = [(f"g{i}", None, float(k)) for i in range(150) for k in r.choice(places, int(r.integers(0, 5)), replace=False)]
    got = {x["segment_id"]: x["cut_kind"] for x in sp.cut_kinds(*frames(spark, segs, breaks)).collect()}
    for i, g, _, a, b in segs:
        pts = sorted({a, b, *[k for h, _, k in breaks if h == g and a < k < b]})
        assert got[i] == ("forced" if max(np.diff(pts)) > 450 else "boundary"), pts


def test_limits_are_parameters_and_counted(spark):
    s, b = frames(spark, [(1, "g", "left", 0.0, 900.0), (2, "g", "left", 0.0, 30_000.0), (3, "g", "left", -30.0, 21_000.0)], [])
    report = {(r.in_metres, r.too_long): r.n for r in sp.stretch_report(s).collect()}
    assert report == {(False, False): 1, (True, False): 2}
    assert {r.segment_id for r in sp.cut_kinds(s, b, metres_above=1e9).collect()} == {1}
    assert {r.segment_id for r in sp.cut_kinds(s, b, metres_above=1e9, longest_km=40_000.0).collect()} == {1, 2, 3}
    assert {(r.in_metres, r.too_long): r.n for r in sp.stretch_report(s, metres_above=1e9).collect()} == {(False, False): 1, (False, True): 2}
