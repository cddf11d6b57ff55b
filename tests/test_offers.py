"""Books offered to libraries: what a library lacks is taken from lists, so no pair of library and book is dealt out before."""

import pytest

from lectern import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["exclude_owned", "recommend_author", "recommend_explore", "recommend_genre", "recommend_mix", "recommend_similar"])
def test_no_pairs_are_shuffled(spark, key):
    plan = registry.queries()[key](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_what_is_bought_is_read_and_dealt_out_once(spark):
    """Lines were read twice, and went by library with titles and ratings, then once more for the books of the same kind."""
    plan = registry.queries()["exclude_owned"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1
