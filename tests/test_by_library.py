"""Jobs by library deal their rows in parts by the size of the tables, not in a fixed number."""

import duckdb
import pytest

from lectern import adapters, registry
from lectern.plans import joins

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["feature_similarity_join", "missing_genres", "profile_agg", "quick_diversity", "shannon_diversity", "udaf_entropy"])
def test_parts_grow_with_the_lines(spark, monkeypatch, key):
    monkeypatch.setattr(registry, "LINES", 500)
    plan = registry.queries()[key](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [library_id" in plan and "RepartitionByExpression [o_orderkey" in plan
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert f", {-(-rows // 500)}" in plan


@pytest.mark.parametrize("block", [7, 1024])
def test_all_pairs_of_a_library_are_compared(spark, monkeypatch, block):
    """Also of libraries of many books, whose blocks meet in different tasks."""
    monkeypatch.setattr(joins, "BLOCK", block)
    found = registry.queries()["feature_similarity_join"](spark, SF)
    owned = duckdb.connect()
    for name in ("part", "orders", "lineitem"):
        owned.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    wanted = owned.sql(registry.oracles()["feature_similarity_join"]).fetchall()
    books = owned.sql(adapters.with_views(["owned"], "select sum(n * (n - 1) / 2) from (select count(*) as n from owned group by library_id) q")).fetchall()[0][0]
    assert len(wanted) == books
    assert sorted((a, b, c, float(s)) for a, b, c, s in found.collect()) == sorted((a, b, c, float(s)) for a, b, c, s in wanted)
