"""Every chain that decodes strictly is tried, not only the classifier's first ones."""

import os

import pytest

from tidemark.llm import mojibake as mj

FIT = os.path.join(os.path.dirname(os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")), "sf0.01", "documents.parquet")


@pytest.fixture(scope="module")
def models(spark):
    return mj.fit_models(spark.read.parquet(FIT))


@pytest.mark.parametrize("damaged, written", [("cafÈ", "café"), ("ni¤o", "niño")])
def test_every_chain_is_tried(models, damaged, written):
    want = {c for c in mj.CHAINS if mj.restore(damaged, c) == written}
    assert want and want <= set(mj._inversions(models, damaged))


def test_a_chain_beyond_the_likeliest_is_found(models):
    assert mj.Repairer(models).repair("Посылка лежалÐ° 12 дней в Sanna.")[0] == "Посылка лежала 12 дней в Sanna."
