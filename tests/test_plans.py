"""Plans stay as they are meant: pruned scans, few exchanges, no cross joins, no Python where built-ins do."""

import re

import pytest

from ampliscope.operators import amplify, pairs, regress
from ampliscope.plans import catalog
from ampliscope.sources.banks import documents_bank, events_bank, lineitem_bank


@pytest.fixture(autouse=True)
def uncached(spark):
    spark.catalog.clearCache()  # another test's persisted table would stand in the plan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_needed_columns_only(spark, sf_dir):
    text = plan(amplify.amplification(amplify.scored(documents_bank(spark, sf_dir))))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("text:" not in s for s in schemas)
    assert "IsNotNull(quality)" in plan(documents_bank(spark, sf_dir).where("attr = 'quality'")) or "PushedFilters" in text


def test_amplification_has_three_exchanges(spark, sf_dir):
    """Rewards to prompts, labels by (attr, prompt), attributes; the last two carry partial sums."""
    text = plan(amplify.amplification(amplify.scored(lineitem_bank(spark, sf_dir))))
    assert len(re.findall(r"\bExchange ", text)) <= 3 and text.count("partial_avg") >= 2


def test_grams_need_one_exchange_beyond_the_quantile(spark, sf_dir):
    text = plan(regress.grams(regress.with_u(events_bank(spark, sf_dir).images), 5))
    assert len(re.findall(r"\bExchange ", text)) == 1  # the quantile's window already groups by prompt


def test_pairs_are_equi_joined(spark, sf_dir):
    b = events_bank(spark, sf_dir)
    text = plan(pairs.closest(b.images, b.attrs, 3))
    assert "Cartesian" not in text and "NestedLoop" not in text and "WindowGroupLimit" in text


@pytest.mark.parametrize("name", ["amp_bon_n2", "amp_kl", "bon_curve", "ols_k1", "ols_k2", "hamming_topk", "gap_cap", "partial_ahat", "cache_merge", "tukey_mean", "medoid"])
def test_built_ins_only(name, spark, sf_dir):
    assert not re.search("Python|Pandas|Arrow", plan(catalog.QUERIES[name](spark, sf_dir)))
