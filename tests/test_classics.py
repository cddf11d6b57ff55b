"""Offers beyond the catalog: classics where a genre has too few books left, and genres that lead on from the favourite one."""

import duckdb
import pytest

from lectern import registry

WANTED = {
    "recommend_genre": {
        (1, 4, None, "ring", 0.7, 1), (1, None, "Dune by Frank Herbert", "ring", 0.85, 2), (1, None, "1984 by George Orwell", "ring", 0.85, 3), (1, None, "Foundation by Isaac Asimov", "ring", 0.85, 4),
        (2, None, "The Lord of the Rings by J.R.R. Tolkien", "bolt", 0.85, 1), (2, None, "A Wizard of Earthsea by Ursula K. Le Guin", "bolt", 0.85, 2),
    },
    "recommend_explore": {
        (1, 5, None, "bolt", 0.5, 1), (1, None, "Murder on the Orient Express by Agatha Christie", "gear", 0.6, 2), (1, None, "The Great Gatsby by F. Scott Fitzgerald", "plate", 0.6, 3), (1, None, "A Wizard of Earthsea by Ursula K. Le Guin", "bolt", 0.55, 4),
        (2, 4, None, "ring", 0.5, 1), (2, None, "The Maltese Falcon by Dashiell Hammett", "gear", 0.6, 2), (2, None, "To Kill a Mockingbird by Harper Lee", "plate", 0.6, 3), (2, None, "Foundation by Isaac Asimov", "ring", 0.55, 4),
    },
}


@pytest.mark.parametrize("key", sorted(WANTED))
def test_classics_and_bridges(spark, tmp_path, key):
    duck = duckdb.connect()
    duck.execute("create table part as select k::bigint as p_partkey, case when k = 5 then 'bolt' else 'ring' end as p_name, 'Brand#1' as p_brand, case when k = 5 then 'BOLT' else 'RING' end as p_type, 10 as p_size from range(1, 6) r(k)")
    duck.execute("create table orders as select k::bigint as o_orderkey, k::bigint as o_custkey, timestamp '1998-01-01' as o_orderdate from range(1, 3) r(k)")
    duck.execute("create table lineitem as select o::bigint as l_orderkey, b::bigint as l_partkey, timestamp '1998-01-02' as l_shipdate from (values (1, 1), (1, 2), (1, 3), (2, 5)) v(o, b)")
    for name in ("part", "orders", "lineitem"):
        duck.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    names = "library_id, book_id, classic, genre, confidence, place"
    assert {tuple(r) for r in registry.queries()[key](spark, str(tmp_path)).selectExpr(*names.split(", ")).collect()} == WANTED[key]
    assert set(duck.execute(f"select {names} from ({registry.oracles()[key]})").fetchall()) == WANTED[key]
