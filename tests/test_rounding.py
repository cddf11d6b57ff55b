"""Scores that end in a five at the seventh place are rounded as DuckDB rounds them."""

import duckdb
import pytest

from lectern import registry



def squares(total, parts, wanted):
    """Numbers in falling order, `parts` of them, with this sum and this sum of squares."""

    def search(total, parts, wanted, most):
        if parts == 0:
            return [] if total == wanted == 0 else None
        for n in range(min(most, total - parts + 1), 0, -1):
            if n * parts < total or n * n + parts - 1 > wanted:
                continue
            rest = search(total - n, parts - 1, wanted - n * n, n)
            if rest is not None:
                return [n, *rest]
        return None

    return search(total, parts, wanted, total)


@pytest.mark.parametrize("key", ["author_diversity", "diversity_report"])
def test_ties(spark, tmp_path, key):
    duck = duckdb.connect()
    counts = squares(64, 21, 640)
    authors = [k for k, n in enumerate(counts) for _ in range(n)]
    books = [17 * k + 1 for k in range(64)]  # none of them is deleted
    rows = ", ".join(f"({b}, 'a b', 'Brand#{a}', 'X Y', {1 + a})" for b, a in zip(books, authors, strict=True))
    duck.execute(f"create table part as select p_partkey::bigint as p_partkey, p_name, p_brand, p_type, p_size::int as p_size from (values {rows}) v(p_partkey, p_name, p_brand, p_type, p_size)")
    duck.execute("create table orders as select 1::bigint as o_orderkey, 1::bigint as o_custkey, timestamp '1998-01-01' as o_orderdate")
    duck.execute("create table lineitem as select 1::bigint as l_orderkey, p_partkey as l_partkey, timestamp '1998-01-02' as l_shipdate from part")
    for name in ("part", "orders", "lineitem"):
        duck.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    made = registry.queries()[key](spark, str(tmp_path))
    wanted = duck.execute(f"select {', '.join(made.columns)} from ({registry.oracles()[key]})").fetchall()
    assert [tuple(r) for r in made.collect()] == wanted
