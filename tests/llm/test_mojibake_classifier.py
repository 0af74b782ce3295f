"""The classifier's posterior decides on whole texts and sentences."""

import os

import numpy as np
import pytest

from tidemark.llm import mojibake as mj

FIT = os.path.join(os.path.dirname(os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")), "sf0.01", "documents.parquet")


@pytest.fixture(scope="module")
def models(spark):
    return mj.fit_models(spark.read.parquet(FIT))


@pytest.fixture(scope="module")
def intact(spark, models, small):
    """Texts of other rows than the models were fitted on, in which nothing is found."""
    rows = spark.read.parquet(f"{small}/documents.parquet").where("text is not null and length(text) between 60 and 800").collect()
    r = mj.Repairer(models)
    return [x.text for x in rows if not x.text.isascii() and r.repair(x.text) == (x.text, [])]


def test_intact_text_is_mostly_the_likeliest_class(models, intact):
    """Chains that change few letters leave text that looks intact, so their classes come close."""
    behind = models.behind(intact)
    assert behind.shape == (len(intact), len(mj.CHAINS) + 1)
    assert np.mean(behind.argmin(axis=1) == len(mj.CHAINS)) >= 0.8


@pytest.mark.parametrize("written", sorted({c[1] for c in mj.CHAINS}))
def test_whole_texts_are_restored(models, intact, written):
    r = mj.Repairer(models)
    bad = [(t, g) for c in mj.CHAINS if c[1] == written for t in intact if (g := mj.garble(t, c)) not in (None, t) and mj.restore(g, c) == t]
    bad = bad[:: max(1, len(bad) // 150)]
    done = [(t, *r.repair(g)) for t, g in bad]
    assert np.mean([bool(c) for _, _, c in done]) >= 0.9
    assert np.mean([fixed == t for t, fixed, _ in done]) >= 0.85


def test_words_judged_together_or_alone_are_judged_alike(models):
    words = ["wÃ¼rde", "très", "cafÈ", "ni¤o", "отвечает", "重さは", "canít", "Ñornara", "¯\\_(ツ)_/¯"]
    together = mj._inversions_of(models, words)
    for w, (odd, options) in zip(words, together):
        alone_odd, alone = mj._inversions_of(models, [w])[0]
        assert odd == alone_odd and options.keys() == alone.keys()
        assert all(options[c][0] == pytest.approx(alone[c][0], abs=1e-3) and options[c][1] == alone[c][1] for c in options)


def test_batches_learn_what_single_texts_do(models):
    texts = ["Die GrÃ¶ÃŸe fÃ¤llt Ã¼blich aus. wÃ¼rde", "niÃƒÂ±o", "plain", "Посылка лежалÐ° 12 дней."]
    batch, single = mj.Repairer(models), mj.Repairer(models)
    batch.learn(texts)
    assert [batch.repair(t) for t in texts] == [single.repair(t) for t in texts]
    assert batch.repair(texts[1])[0] == "niño"
