import numpy as np
import pytest

from tidemark.operators import spike_hmm as sh

SCHEMA = "obs_id long, granule string, pixel_no int, line_no int, ssha_karin_2 double, ssha_karin_2_qual int, state string, block int"


def judge(v):
    s = np.zeros(len(v), dtype=int)
    return [int(x) for x in sh.classify(s, np.asarray(v, dtype=float))[0]]


def noise(n=200, seed=0):
    return np.random.default_rng(seed).normal(0, 0.02, n)


def test_spikes_of_one_to_three_lines():
    v = noise()
    v[50] += 0.5
    v[100:103] -= 0.4
    got = judge(v)
    assert [i for i, s in enumerate(got) if s] == [50, 100, 101, 102]
    assert set(got) == {sh.NORMAL, sh.SPIKE}


def test_steps_and_broad_features_are_real():
    v = noise()
    v[120:] += 0.8
    v[30:60] += 0.6 * np.hanning(30)
    assert not any(judge(v))


def test_spike_at_either_end():
    v = noise()
    v[1:4] += 1.0
    v[-1] += 1.0
    assert [i for i, s in enumerate(judge(v)) if s] == [1, 2, 3, len(v) - 1]


def test_stuck_and_out_of_range():
    v = noise()
    v[20:28] = 0.1234
    v[60:67] = 0.2
    v[150] = 99.0
    v[151] = np.inf
    got = judge(v)
    assert got[20:28] == [sh.STUCK] * 8 and not any(got[60:67])
    assert got[150] == got[151] == sh.OUT
    assert sum(map(bool, got)) == 10


def test_short_series_are_judged_like_long_ones():
    assert judge([0.1, 0.11, 9.0, 0.1]) == [0, 0, sh.SPIKE, 0]
    assert judge([0.1, 9.0]) == judge([0.1]) + [0] == [0, 0]
    assert judge([25.0]) == [sh.OUT]
    assert judge([]) == []


def frame(spark, values, qual=0):
    return spark.createDataFrame([(i, "g", 1, i, v, qual, "x", 1) for i, v in enumerate(values)], SCHEMA)


def test_dirt(spark):
    v = [float(x) for x in noise()]
    v[10], v[11], v[40] = None, float("nan"), 3.0
    v[70:82] = [0.5] * 5 + [None, None] + [0.5] * 5
    df = frame(spark, v)
    df = df.unionByName(df).unionByName(spark.createDataFrame([(None, None, None, None, 50.0, None, "", 0)], SCHEMA))
    got = {r["obs_id"]: r["state"] for r in sh.flag_readings(df).collect()}
    assert got == {40: "spike", **{i: "stuck" for i in [*range(70, 75), *range(77, 82)]}}
    assert sh.flag_readings(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 64, 500])
def test_blocks_give_the_same_result(spark, block):
    """Spikes, stuck runs and gaps at the edges of blocks, beside a series that is short."""
    v = [float(x) for x in noise(1200, 5)]
    for i in (0, 63, 64, 127, 128, 499, 500, 501, 640, 641, 642, 643, 1199):
        v[i] += 2.0
    v[186:202] = [0.25] * 16
    v[440:512] = v[440:499] + [float("nan")] * 13
    v[700:900] = [None] * 100 + [-0.5] * 100
    v[950] = 77.0
    df = frame(spark, v).unionByName(spark.createDataFrame([(5000 + i, "h", 2, i, x, 0, "x", 1) for i, x in enumerate([0.1, 0.12, 3.0, 0.11, 0.1] + [0.2] * 8)], SCHEMA))
    df = df.unionByName(df.where("obs_id % 10 = 3"))
    whole = {r.obs_id: (r.state, r.probability) for r in sh.flag_readings(df).collect()}
    got = {r.obs_id: (r.state, r.probability) for r in sh.flag_readings(df, block=block).collect()}
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in whole.items()}
    assert all(x[1] == pytest.approx(whole[k][1], abs=1e-6) for k, x in got.items())
    assert {x[0] for x in whole.values()} == {"spike", "stuck", "out_of_range"} and len(whole) > 120 and 640 not in whole


@pytest.mark.parametrize("word,bad", [(0, False), (3, False), (33, False), (16, True), (-2, True), (2**31 - 1, True), (None, False)])
def test_flag_words(spark, word, bad):
    flags = spark.createDataFrame([(b, "") for b in (1, 2, 4, 8, 32)], "bit_value int, flag_name string")
    df = spark.createDataFrame([(1, word)], "obs_id long, ssha_karin_2_qual int")
    assert sh.invalid_flags(df, flags).count() == int(bad)


def test_no_known_bits(spark):
    flags = spark.createDataFrame([], "bit_value int, flag_name string")
    df = spark.createDataFrame([(1, 1), (2, 0)], "obs_id long, ssha_karin_2_qual int")
    assert [r["obs_id"] for r in sh.invalid_flags(df, flags).collect()] == [1]
