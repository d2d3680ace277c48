"""Each registered query of the record-linkage operators against its SQL twin."""

import pytest
from conftest import same_rows

from tessera.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_approximate_search_has_recall(spark, sf_dir):
    exact = {(r[0], r[1]) for r in QUERIES["embedding_topk_all"](spark, sf_dir).select("q_id", "t_id").collect()}
    found = {(r[0], r[1]) for r in QUERIES["ann_ivf_topk"](spark, sf_dir).select("q_id", "t_id").collect()}
    assert len(exact & found) >= 0.9 * len(exact)
