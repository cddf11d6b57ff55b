"""Profiles of libraries against plain Python: shares of genres, favourite authors, what is rare, the era."""

from collections import Counter

import duckdb
import pytest

from lectern import registry
from lectern.plans.books import MAJOR


@pytest.fixture
def folder(tmp_path):
    """Library 1 is large, 2 has one book of 1998, 3 has a book of 2000 twice and one of 1902."""
    books = [(k, f"{'ring' if k % 3 else 'rod'} Steel", f"Brand#{min(k % 11, 6)}", "PROMO" if k % 7 else "ANVIL Bolt", 1 + k % 50) for k in range(1, 60) if k % 17]
    held = [(1, b[0]) for b in books[:40]] + [(2, books[47][0]), (3, books[48][0]), (3, books[48][0]), (3, books[49][0])]
    duck = duckdb.connect()
    duck.execute(f"create table part as select p_partkey::bigint as p_partkey, p_name, p_brand, p_type, p_size::int as p_size from (values {', '.join(map(str, books))}) v(p_partkey, p_name, p_brand, p_type, p_size)")
    duck.execute("create table orders as select k::bigint as o_orderkey, k::bigint as o_custkey, timestamp '1998-01-01' as o_orderdate from range(1, 4) r(k)")
    duck.execute(f"create table lineitem as select o::bigint as l_orderkey, b::bigint as l_partkey, timestamp '1998-01-02' as l_shipdate from (values {', '.join(map(str, held))}) v(o, b)")
    for name in ("part", "orders", "lineitem"):
        duck.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    return str(tmp_path), {b[0]: b for b in books}, held, duck


def profile(books):
    genres = Counter(g.lower() for b in books for g in [*b[1].split(), *b[3].lower().split()])
    total = sum(genres.values())
    order = sorted(genres, key=lambda g: (-genres[g], g))
    authors = Counter(b[2] for b in books)
    years = [1900 + 2 * b[4] for b in books]
    mean = sum(years) / len(years)
    liked = [a for a in sorted(authors, key=lambda a: (-authors[a], a))[:5] if authors[a] >= 2]
    return {
        "books": len(books), "top_genres": ",".join(order[:5]), "genres": len(order), "favorite_authors": ",".join(liked) or None,
        "under_represented": ",".join(g for g in MAJOR if genres[g] / total < 0.05), "mean_year": round(mean, 4), "era": "contemporary" if mean >= 2010 else "modern" if mean >= 1990 else "mid-century" if mean >= 1950 else "classic",
    }, {g: genres[g] / total for g in order}


def test_profiles(spark, folder):
    place, books, held, duck = folder
    made = registry.queries()["profile_agg"](spark, place)
    rows = {r.library_id: r.asDict() for r in made.collect()}
    assert sorted(rows) == [1, 2, 3]
    for library, row in rows.items():
        told, shares = profile([books[b] for b in sorted({b for k, b in held if k == library})])
        found = dict(x.split(":") for x in row["distribution"].split(","))
        assert {k: row[k] for k in told} == pytest.approx(told)
        assert list(found) == list(shares) and {g: float(x) for g, x in found.items()} == pytest.approx(shares, abs=1e-6)
    assert rows[1]["favorite_authors"].count(",") == 4 and rows[2]["favorite_authors"] is None
    wanted = duck.execute(f"select {', '.join(made.columns)} from ({registry.oracles()['profile_agg']})").fetchall()
    assert sorted(tuple(r.values()) for r in rows.values()) == sorted(wanted)
