import os

import pytest

from tidemark.llm import mojibake as mj

FIT = os.path.join(os.path.dirname(os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")), "sf0.01", "documents.parquet")


@pytest.fixture(scope="module")
def models(spark):
    return mj.fit_models(spark.read.parquet(FIT))


def found(spark, models, texts):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, restored string, chains string")
    return {r["doc_id"]: r["restored"] for r in mj.judge(df, models).collect()}


def test_round_trips():
    text = "Größe fällt – très déçu, “não”"
    for chain in mj.CHAINS:
        g = mj.garble(text, chain)
        if g is not None and g != text:
            assert mj.restore(g, chain) == text


def test_known_damage(spark, models):
    clean = [
        "Die Größe fällt üblich aus, würde ich wieder kaufen.",
        "Livré là où je l’avais demandé.",
        "Посылка лежала 25 дней, очень доволен покупкой.",
        "とても良く、満足しています。",
        "Sent it back, still waiting for my £20.",
    ]
    bad = [(t, c) for t in clean for c in [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp1251", "cp1252"), ("cp1252", "cp1251"), ("cp850", "cp1252"), ("koi8_r", "cp1251")] if mj.garble(t, c) not in (None, t)]
    got = found(spark, models, [mj.garble(t, c) for t, c in bad])
    assert len(got) >= len(bad) - 1
    assert sum(got.get(i) == t for i, (t, _) in enumerate(bad)) >= 0.9 * len(bad)


def test_twice_and_in_part(spark, models):
    twice = mj.garble(mj.garble("señor está muy bien", ("cp1252", "utf-8")), ("cp1252", "utf-8"))
    got = found(spark, models, [twice, "Die GrÃ¶ße fällt üblich aus.", "from ŠalskeÃ§a, it’s lighter", "O� que j�aille", "ok \x99"])
    assert got == {0: "señor está muy bien", 1: "Die Größe fällt üblich aus.", 2: "from Šalskeça, it’s lighter", 3: None, 4: None}


def test_what_was_written_so(spark, models):
    fine = ["", None, "plain", "Â  and À are on my keyboard", "x² + ½ ≈ π", "──┤ 21 ├──", "&eacute;t&eacute; &amp; co", "ATENÇÃO: NÃO FUNCIONA.", "¯\\_(ツ)_/¯", "１２３ｋｍ", "Ñorske, Øst, Šal", "Þetta er mjög gott", "👨‍👩‍👧 ⚓"]
    assert found(spark, models, fine) == {}


def test_held_out_accuracy(spark, models, small):
    """Sentences of other documents: intact ones stay, garbled ones are found."""
    rows = spark.read.parquet(f"{small}/documents.parquet").where("text is not null").collect()
    clean = [r["text"] for r in rows if not r["text"].isascii() and len(r["text"]) < 1000]
    before = set(found(spark, models, clean))
    clean = [t for i, t in enumerate(clean) if i not in before]
    chains = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "utf-8")]
    bad = [(t, g) for i, t in enumerate(clean) if (g := mj.garble(t, chains[i % 4])) not in (None, t)]
    got = found(spark, models, [g for _, g in bad])
    assert len(got) >= 0.99 * len(bad)
    assert sum(got.get(i) == t for i, (t, _) in enumerate(bad)) >= 0.9 * len(bad)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert mj.garbled_documents(df).count() == 0
