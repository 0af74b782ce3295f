import json

import pytest

from tidemark.operators import schema_drift as sd

RECORD = "record_id long, granule string, run_id int, received_at timestamp_ntz, payload string, variable string, v string"
MANIFEST = "granule string, run_id int, file_no int, key string"


def frames(spark, files, extra=()):
    rows, n = [], 0
    for g, payloads in files.items():
        for p in payloads:
            n += 1
            rows.append((n, g, 1, None, p if isinstance(p, str) or p is None else json.dumps(p), "x", "y"))
    rows += list(extra)
    manifest = [(g, 1, i + 1, "z") for i, g in enumerate(files)] * 2
    return spark.createDataFrame(rows, RECORD), spark.createDataFrame(manifest, MANIFEST)


@pytest.mark.parametrize(
    "key,name",
    [
        ("internalTideHret", "internal_tide_hret"),
        ("HEIGHT_COR_XOVER", "height_cor_xover"),
        ("height.cor.xover", "height_cor_xover"),
        ("xover_height_cor", "height_cor_xover"),
        ("height_correction_xover", "height_cor_xover"),
        ("internal_tide_hret_m", "internal_tide_hret"),
        ("int_tide_hret", "internal_tide_hret"),
        ("surface_classification_flag", "ancillary_surface_classification_flag"),
        ("anc_surf_classification_flag", "ancillary_surface_classification_flag"),
        ("karin_swh", "swh_karin"),
        ("swh_karin_qual", "swh_karin_qual"),
        ("ssha_karin_2", "ssha_karin_2"),
        ("ssha_karin", "ssha_karin"),
        ("surface_type", "surface_type"),
        ("brand_new_thing", "brand_new_thing"),
        ("", ""),
    ],
)
def test_variable_of(key, name):
    assert sd.variable_of(key) == (name if name != "brand_new_thing" else "brand_new_thing")


def test_promotion_is_a_lattice():
    kinds = ["null", "boolean", "integer", "decimal", "string"]
    for a in kinds:
        assert sd.promote(a, a) == a
        for b in kinds:
            assert sd.promote(a, b) == sd.promote(b, a)
            for c in kinds:
                assert sd.promote(a, sd.promote(b, c)) == sd.promote(sd.promote(a, b), c)


def test_log(spark):
    files = {
        "a": [{"dac": 1.5, "swh_karin": 1}] * 3,
        "b": [{"dac": "x", "swhKarin": 2}, {"dac": "y", "swhKarin": 3}, '{"dac": 1.0, "swhK', None, ""],
        "c": [{"swhKarin": None}],
        "d": [{"swhKarin": 2.5, "dac": 1}, {"swhKarin": 2.5, "dac": 1}],
        "e": ['{"cut'],
        "f": [{"swhKarin": 1.5, "dac": [1]}],
    }
    got = {tuple(r) for r in sd.drift_log(*frames(spark, files)).collect()}
    assert got == {
        (1, 2, "retyped", "dac", "dac"),
        (1, 2, "renamed", "swh_karin", "swhKarin"),
        (1, 3, "removed", "dac", ""),
        (1, 4, "added", "", "dac"),
        (1, 4, "retyped", "swhKarin", "swhKarin"),
        (1, 6, "retyped", "dac", "dac"),
    }


def test_repeats_count_once(spark):
    files = {"a": [{"dac": 1}], "b": [{"dac": 1}, {"dac": 1}, {"dac": "s"}]}
    again = [(4, "b", 1, None, '{"dac": "s"}', "", "")] * 9
    assert sd.drift_log(*frames(spark, files, again)).count() == 0


def test_empty(spark):
    r, m = frames(spark, {"a": [{"dac": 1}]})
    assert sd.drift_log(r.limit(0), m).count() == 0
    assert sd.drift_log(r, m.limit(0)).count() == 0
    assert sd.to_union_table(r.limit(0)).count() == 0


def test_union_table(spark):
    files = {
        "a": [{"height_cor_xover": {"value": 0.25, "units": "m"}, "surface_classification_flag": "land"}],
        "b": [{"heightCorXover": [0.5], "ancillary_surface_classification_flag": True}, {"heightCorXover": "0.75 m"}, {"heightCorXover": "NaN"}],
    }
    r, _ = frames(spark, files)
    t = sd.to_union_table(r).orderBy("record_id").collect()
    assert [x["height_cor_xover"] for x in t] == [0.25, 0.5, 0.75, None]
    assert [x["ancillary_surface_classification_flag"] for x in t] == [1, 1, None, None]


def test_units(spark):
    """A file that writes integers in millimetres, one with units of its own, and true integers."""
    metres = [{"height_cor_xover": v, "count": n} for v, n in [(0.021, 3), (-0.034, 5), (0.018, 900), (0.0, 1)]]
    files = {
        "a": metres,
        "b": metres,
        "c": [{"height_cor_xover_m": v, "count": 7} for v in (21, -34, 18, 0)],
        "d": [{"height_cor_xover": "25 mm", "count": 1}, {"height_cor_xover": {"value": 3, "units": "cm"}, "count": 1}, {"height_cor_xover": "0.5 m", "count": 1}],
    }
    r, m = frames(spark, files)
    got = {}
    for x in sd.to_union_table(r).orderBy("record_id").collect():
        got.setdefault(x["granule"], []).append(x["height_cor_xover"])
    assert got["a"] == got["c"] == pytest.approx([0.021, -0.034, 0.018, 0.0])
    assert got["d"] == pytest.approx([0.025, 0.03, 0.5])
    assert [tuple(x) for x in sd.rescale_log(r, m).collect()] == [(1, 3, "height_cor_xover", 0.001)]
    assert [x["count"] for x in sd.to_union_table(r).where("granule = 'c'").collect()] == [7] * 4


def test_names_are_a_parameter(spark):
    files = {"a": [{"currentHeading": 1.5}], "b": [{"current_hdg": 2.5}]}
    r, m = frames(spark, files)
    assert {x["change_kind"] for x in sd.drift_log(r, m).collect()} == {"added", "removed"}
    assert [tuple(x)[2:] for x in sd.drift_log(r, m, known=("current_heading",)).collect()] == [("renamed", "currentHeading", "current_hdg")]
    assert [x["current_heading"] for x in sd.to_union_table(r, known=("current_heading",)).orderBy("record_id").collect()] == [1.5, 2.5]


def test_lists_and_objects_stay_whole(spark):
    r, _ = frames(spark, {"a": [{"dac": [1.5, 2.5]}, {"dac": {"lo": 1}}, {"dac": [3.5]}, {"dac": {"value": None, "units": "m"}}]})
    assert [x["dac"] for x in sd.to_union_table(r).orderBy("record_id").collect()] == ["[1.5,2.5]", '{"lo":1}', "3.5", None]


def test_records_without_id_are_kept_apart(spark):
    r, m = frames(spark, {"a": [{"dac": 1}], "b": []})
    extra = [(None, "b", 1, None, '{"dac": "s"}', "", "")] * 2 + [(None, "b", 1, None, f'{{"dac": {i}}}', "", "") for i in (7, 8)]
    r = r.unionByName(spark.createDataFrame(extra, RECORD))
    assert sd.whole_records(r).where("granule = 'b'").count() == 3
    assert sd.drift_log(r, m).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 20])
def test_blocks_of_files_give_the_same_log(spark, bits):
    import random

    rnd, runs, rows = random.Random(4), {}, []
    for n in range(90):
        run = n // 40
        doc = {k: rnd.choice([1, 2.5, "x", None, None, None]) for k in ("dac", rnd.choice(["swh_karin", "swhKarin"])) if rnd.random() < 0.8}
        runs.setdefault(run, []).append((n, doc))
        rows.append((n, f"g{n}", run, None, json.dumps(doc), "", ""))
    kind = {int: "integer", float: "decimal", str: "string"}
    want = set()
    for run, files in runs.items():
        state, last = {}, None
        for n, doc in files:
            if not doc:
                continue
            now = {sd.variable_of(k): (k, kind.get(type(v))) for k, v in doc.items()}
            for name, (key, t) in now.items():
                if name not in state:
                    if last is not None:
                        want.add((run, n, "added", "", key))
                    state[name] = [key, t]
                    continue
                if state[name][0] != key:
                    want.add((run, n, "renamed", state[name][0], key))
                if t and state[name][1] and t != state[name][1]:
                    want.add((run, n, "retyped", state[name][0], key))
                state[name] = [key, t or state[name][1]]
            for name in set(state) - set(now):
                want.add((run, n, "removed", state.pop(name)[0], ""))
            last = n
    manifest = spark.createDataFrame([(f"g{n}", n // 40, n, "") for n in range(90)], MANIFEST)
    got = [tuple(x) for x in sd.drift_log(spark.createDataFrame(rows, RECORD), manifest, block_bits=bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
