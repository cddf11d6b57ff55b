"""Views that give every query a realistic input from the base tables: one text for Spark and DuckDB, or a text for each."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_PAIR = "line as truth, translate(line, 'oil', '011') as prediction, cast((doc_id + pos) % 10 as double) / 10 as confidence"

#: By name: one text for both engines, or (Spark, DuckDB).
VIEWS: dict[str, str | tuple[str, str]] = {
    "books": """
        select p.p_partkey as book_id, p.p_name as title, p.p_brand as author,
               split(concat(p.p_name, ' ', lower(p.p_type)), ' ') as genres,
               1900 + p.p_size * 2 as publication_year, cast(100 + p.p_partkey % 400 as int) as page_count,
               case p.p_partkey % 5 when 0 then 'unread' when 1 then 'reading' when 2 then 'read'
                                    when 3 then 'completed' else 'dnf' end as read_status,
               cast(1 + p.p_partkey % 5 as int) as rating, p.p_partkey % 17 = 0 as is_deleted, a.added_at
        from part p left join (select l_partkey, min(l_shipdate) as added_at from lineitem group by l_partkey) a
          on a.l_partkey = p.p_partkey""",
    "isbn_books": """
        select b.*, case when book_id % 3 <> 0 then concat('978', lpad(cast(book_id as varchar(12)), 10, '0')) end as isbn_13,
               case when book_id % 4 = 0 then lpad(cast(book_id as varchar(12)), 10, '0') end as isbn_10
        from books b""",
    "libraries": """
        select o.o_custkey as library_id, l.l_partkey as book_id, min(o.o_orderdate) as acquired_at
        from orders o join lineitem l on l.l_orderkey = o.o_orderkey group by o.o_custkey, l.l_partkey""",
    "owned": """
        select l.library_id, l.acquired_at, b.* from libraries l join books b on b.book_id = l.book_id where not b.is_deleted""",
    "search_queries": "select item_id as query_id, text as query from benchmark where item_id % 20 = 0",
    "ocr_pairs": (
        f"""select doc_id * 100000 + pos as sample_id, lang as category, {_PAIR}
            from (select doc_id, lang, posexplode(split(text, chr(10))) as (pos, line) from documents)""",
        f"""select doc_id * 100000 + pos as sample_id, lang as category, {_PAIR}
            from (select doc_id, lang, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)""",
    ),
    "boxes": """
        select l_orderkey as image_id, l_linenumber as box_no, l_returnflag as class_name, cast(1.0 - l_tax as double) as confidence,
               cast(l_linenumber * 60 as double) as gx1, cast(100 as double) as gy1, cast(l_linenumber * 60.0 + l_quantity + 10 as double) as gx2, cast(400 as double) as gy2,
               cast(l_linenumber * 60.0 + l_discount * 200 as double) as px1, cast(100.0 + l_discount * 100 as double) as py1,
               cast(l_linenumber * 60.0 + l_quantity + 10 + l_discount * 200 as double) as px2, cast(400.0 + l_discount * 100 as double) as py2
        from lineitem""",
    "latency": "select event_id, event_type as stage, ts, value as ms, user_id from events",
    "visual_vectors": "select (vec_id + cast(floor(n / 2) as bigint)) % n as vec_id, embedding from embeddings cross join (select count(*) as n from embeddings) c",
    "turns": """
        select conv_id, turn, role, text, (conv_id * 7 + turn) % n as book_id, cast(length(text) as int) as token_count
        from conversations cross join (select count(*) as n from documents) c""",
    "rag_cases": """
        select q.conv_id * 1000 + q.turn as query_id, q.text as question, a.text as answer, d.doc_id, d.text as content,
               d.doc_id % 4 as relevance, cast(q.conv_id % 5 as int) as category
        from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
        cross join (select count(*) as n from documents) c cross join (select * from (values (0), (1), (2), (3), (4)) v(k)) k
        join documents d on d.doc_id = ((q.conv_id * 7 + q.turn) * 5 + k.k) % c.n
        where q.role = 'user' and a.role = 'assistant'""",
}

NEEDS = {"isbn_books": ["books"], "owned": ["libraries", "books"]}


def closure(names: list[str]) -> list[str]:
    """names and the views they stand on, in the order of definition."""
    wanted = set(names)
    for n in names:
        wanted |= set(closure(NEEDS.get(n, [])))
    return [n for n in VIEWS if n in wanted]


def with_views(names: list[str], body: str, duckdb: bool = True) -> str:
    """body as one statement, with the views it reads in front."""
    parts = [f"{n} as ({v if isinstance(v := VIEWS[n], str) else v[duckdb]})" for n in closure(names)]
    text = body.strip()
    for start in ("with recursive ", "with "):
        if text.lower().startswith(start):
            return start + ", ".join([*parts, text[len(start) :]])
    return ("with " + ", ".join(parts) + " " if parts else "") + text


def tables(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Register those base tables of a folder that the text names as temporary views."""
    for name in TABLES:
        if not re.search(rf"\b{name}\b", text):
            continue
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def query(spark: SparkSession, sf_dir: str, names: list[str], body: str) -> DataFrame:
    text = with_views(names, body, duckdb=False)
    tables(spark, sf_dir, text)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter view, or a base table, as a DataFrame."""
    return query(spark, sf_dir, [name] if name in VIEWS else [], f"select * from {name}")
