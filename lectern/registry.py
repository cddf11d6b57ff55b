"""Registered queries of the library: key -> builder, and oracle SQL where SQL can express the query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern import adapters

Builder = Callable[[SparkSession, str], DataFrame]
_BUILDERS: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def register(key: str, builder: Builder, views: list[str] | None = None, oracle: str | None = None) -> None:
    """A query built by a function; oracle is DuckDB SQL over the named views."""
    if key in _BUILDERS:
        raise ValueError(f"{key} is registered twice")
    _BUILDERS[key] = builder
    if oracle is not None:
        _ORACLES[key] = adapters.with_views(views or [], oracle)


def register_sql(key: str, views: list[str], body: str, duckdb: str | None = None) -> None:
    """A query that is one Spark SQL statement over the named views; duckdb where its dialect differs."""
    register(key, lambda spark, sf_dir: adapters.query(spark, sf_dir, views, body), views, duckdb or body)


#: Spellings that differ between the dialects: (Spark, DuckDB), for register_dialects.
DIALECTS = {
    "$EXPLODE(": ("explode(", "unnest("),
    "$SIZE(": ("size(", "len("),
    "$ARRAY(": ("array(", "list_value("),
    "$HAS(": ("array_contains(", "list_contains("),
    "$OVERLAP(": ("arrays_overlap(", "list_has_any("),
    "$SECONDS(": ("unix_seconds(timestamp ", "epoch("),
    "$DISTINCT(": ("array_distinct(", "list_distinct("),
    "$MATCHES(": ("regexp_like(", "regexp_matches("),
    # DuckDB rounds the scaled double, Spark's round(x, 6) the shortest decimal: they differ where a score ends in a five at the seventh place
    "$ROUND(": ("round((", "round("),
    ", $SIX)": (") * 1e6) / 1e6", ", 6)"),
}


def dialect(text: str, engine: int, **words: tuple[str, str]) -> str:
    """text with each $WORD spelled as Spark (0) or DuckDB (1) has it; words adds further ones."""
    for name, pair in ({f"${k}": v for k, v in words.items()} | DIALECTS).items():
        text = text.replace(name, pair[engine])
    return text


def register_dialects(key: str, views: list[str], body: str, **words: tuple[str, str]) -> None:
    """register_sql for a text in which $WORDs stand for what the dialects spell differently; words adds further ones."""
    register_sql(key, views, dialect(body, 0, **words), dialect(body, 1, **words))


#: Lines of orders for which a task of a job by library is made: genres multiply them before they are counted.
LINES = 250_000

#: `owned` for Spark, each of its steps dealt in PARTS parts.
_BOUGHT = """select /*+ REPARTITION(PARTS, DEALT_BY) */ o.o_custkey as library_id, l.l_partkey as book_id, o.o_orderdate as at
                from (select /*+ REPARTITION(PARTS, o_orderkey) */ o_orderkey, o_custkey, o_orderdate from orders) o
                join (select /*+ REPARTITION(PARTS, l_orderkey) */ l_orderkey, l_partkey from lineitem) l on l.l_orderkey = o.o_orderkey"""
_DEALT = f"""select /*+ REPARTITION(PARTS, library_id) */ l.library_id, l.acquired_at, b.*
    from (select /*+ REPARTITION(PARTS, book_id) */ library_id, book_id, min(at) as acquired_at
          from ({_BOUGHT.replace("DEALT_BY", "library_id")}) bought
          group by library_id, book_id) l
    join (select /*+ REPARTITION(PARTS, book_id) */ * from books) b on b.book_id = l.book_id where not b.is_deleted"""


def _parts(session: SparkSession, sf_dir: str) -> int:
    rows = session.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # from the files' footers
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-rows // LINES))


def dealt_libraries(session: SparkSession, sf_dir: str) -> DataFrame:
    """(library_id, book_id) of `libraries`, dealt out by book in as many parts as its size asks for: they meet books where they are."""
    bought = _BOUGHT.replace("PARTS", str(_parts(session, sf_dir))).replace("DEALT_BY", "book_id")
    return adapters.query(session, sf_dir, [], f"select library_id, book_id from ({bought}) bought group by library_id, book_id")


def over_bought(session: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """A statement over `books` and over `bought` (library_id, book_id), dealt out by book; PARTS in it is as many parts as its size asks for."""
    text = f"with bought as ({_BOUGHT.replace('DEALT_BY', 'book_id')}), {body.removeprefix('with ')}"
    return adapters.query(session, sf_dir, ["books"], text.replace("PARTS", str(_parts(session, sf_dir))))


def by_library(session: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """A statement over `owned`, dealt out by library in as many parts as its size asks for.

    Libraries then stay where they are: what is counted in one is counted in one task, and the rows of a task do not grow with the
    table, as they do with a fixed number of shuffle partitions. PARTS in the statement is that number of parts.
    """
    dealt = f"with dealt as ({_DEALT}), {body.removeprefix('with ').replace('from owned', 'from dealt')}"
    return adapters.query(session, sf_dir, ["books"], dealt.replace("PARTS", str(_parts(session, sf_dir))))


def register_by_library(key: str, body: str, duckdb: str | None = None, **words: tuple[str, str]) -> None:
    """register_dialects, or register_sql with duckdb, for a statement over `owned` that starts with "with"."""
    register(key, lambda session, sf_dir: by_library(session, sf_dir, body if duckdb else dialect(body, 0, **words)), ["owned"], duckdb or dialect(body, 1, **words))


def _load() -> None:
    from lectern import catalog  # noqa: F401  registers on import


def queries() -> dict[str, Builder]:
    _load()
    return dict(_BUILDERS)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
