"""Retrieval as one plan: expand, search both ways, enrich, filter, rerank; for whole tables of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import adapters
from lectern.plans.retrieval import _KNN_ORACLE, _TOKENS, knn, rrf
from lectern.plans.sparse import bm25, bm25_repeated
from lectern.plans.text import expanded_query
from lectern.registry import register

#: Candidates for each wanted result, at the reranker and again at each of the two searches.
OVERFETCH = 3
BOOST, DIVERSITY = 0.1, 0.2


def alike(a: Column, b: Column) -> Column:
    """Likeness of two books (author, genres, year): same author, shared genres, and at most five years apart."""
    shared = F.size(F.array_intersect(a["genres"], b["genres"]))
    genres = F.when(shared > 0, 0.3 * shared / F.greatest(F.size(a["genres"]), F.size(b["genres"]))).otherwise(0.0)
    author = F.when(F.lower(a["author"]) == F.lower(b["author"]), 0.5).otherwise(0.0)
    year = F.when(F.abs(a["year"] - b["year"]) <= 5, 0.2).otherwise(0.0)
    return F.round(F.coalesce(author, F.lit(0.0)) + F.coalesce(genres, F.lit(0.0)) + F.coalesce(year, F.lit(0.0)), 9)


def diversified(ranked: Column, k: int) -> Column:
    """Places in ranked (structs in falling order of score) of k items: each step takes the best of score less likeness to those taken."""

    def step(state: Column, _: Column) -> Column:
        value = F.transform(ranked, lambda x, i: F.when(F.array_contains(state["taken"], i), F.lit(-1e9)).otherwise(F.round((1 - DIVERSITY) * x["score"] - DIVERSITY * F.get(state["near"], i), 9)))
        pick = F.transform(F.array(value), lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))

        def taken(p: Column) -> Column:
            near = F.transform(ranked, lambda x, i: F.greatest(F.get(state["near"], i), alike(x, F.get(ranked, p))))
            return F.struct(F.concat(state["taken"], F.array(p)).alias("taken"), near.alias("near"))

        return F.get(F.transform(pick, taken), F.lit(0))

    start = F.struct(F.expr("cast(array() as array<int>)").alias("taken"), F.transform(ranked, lambda _: F.lit(0.0)).alias("near"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda s: s["taken"])


def rerank(found: DataFrame, context: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, place) of found (query_id, doc_id, score, place, author, genres, publication_year).

    Books of the query's conversation gain `BOOST`; then books are taken one by one, unlike those before. Where there are k
    or fewer the order stays. A query has a few times k candidates, so they fit one row.
    """
    named = context.select("query_id", "doc_id").distinct().withColumn("seen", F.lit(True))
    lifted = found.join(named, ["query_id", "doc_id"], "left").withColumn("lifted", F.round(F.col("score") + F.when(F.col("seen"), BOOST).otherwise(0.0), 8))
    item = F.struct((-F.col("lifted")).alias("down"), "place", F.col("lifted").alias("score"), "doc_id", "author", "genres", F.col("publication_year").alias("year"), F.col("score").alias("plain"))
    lists = lifted.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("ranked"))
    picked = F.when(F.size("ranked") > k, F.transform(diversified(F.col("ranked"), k), lambda p: F.get(F.col("ranked"), p)))
    plain = F.transform(F.array_sort(F.transform("ranked", lambda x: F.struct(x["place"].alias("place"), x["plain"].alias("score"), x["doc_id"].alias("doc_id")))), lambda x: F.struct(x["score"].alias("score"), x["doc_id"].alias("doc_id")))
    chosen = F.coalesce(F.transform(picked, lambda x: F.struct(x["score"].alias("score"), x["doc_id"].alias("doc_id"))), plain)
    each = lists.select("query_id", F.posexplode(chosen).alias("pos", "x"))
    return each.select("query_id", "x.doc_id", "x.score", (F.col("pos") + 1).alias("place"))


def filtered(found: DataFrame, genres: list[str] | None = None, authors: list[str] | None = None, min_year: int | None = None, max_year: int | None = None) -> DataFrame:
    """Candidates with one of the genres and authors (any case), and a year between; books without a year fail a year bound."""
    if genres:
        found = found.where(F.exists("genres", lambda g: F.lower(g).isin([x.lower() for x in genres])))
    if min_year is not None:
        found = found.where(F.col("publication_year") >= min_year)
    if max_year is not None:
        found = found.where(F.col("publication_year") <= max_year)
    if authors:
        found = found.where(F.lower("author").isin([x.lower() for x in authors]))
    return found


def retrieve(asked: DataFrame, docs: DataFrame, vectors: DataFrame, catalog: DataFrame, context: DataFrame, k: int = 10, sparse_search: Callable[[DataFrame, DataFrame, int], DataFrame] = bm25, **filters) -> DataFrame:
    """(query_id, expanded, doc_id, title, score, place): the whole chain for asked (query_id, query, embedding).

    docs is (doc_id, text), vectors (vec_id, embedding) with ids of documents, catalog (doc_id, title, author, genres,
    publication_year), context (query_id, doc_id). Hits that the catalog lacks are dropped; a null embedding or query
    leaves the other search alone.
    """
    wide = OVERFETCH * k
    widened = asked.withColumn("query", F.expr(expanded_query("query")))
    dense = knn(widened.select("query_id", "embedding"), vectors, OVERFETCH * wide)
    sparse = sparse_search(widened.select("query_id", "query"), docs, OVERFETCH * wide)
    found = rrf(dense, sparse, wide).join(catalog, "doc_id")
    best = rerank(filtered(found, **filters), context, k)
    return best.join(catalog.select("doc_id", "title"), "doc_id").join(widened.select("query_id", F.col("query").alias("expanded")), "query_id").select("query_id", "expanded", "doc_id", "title", F.round("score", 8).alias("score"), "place")


_ASKED = "select q.query_id, case when query_id % 40 = 0 then concat('Something sci-fi: ', query) when query_id % 60 = 0 then concat('Books like ', query) else query end as query, e.embedding from search_queries q left join embeddings e on e.vec_id = q.query_id"
_CATALOG = "select book_id as doc_id, title, author, genres, publication_year from books where not is_deleted"
_CONTEXT = "select distinct conv_id as query_id, book_id as doc_id from turns"
_SHELF = "select book_id as doc_id, concat(title, ' ', author, ' ', array_join(genres, ' ')) as text from books where not is_deleted"
_LIKE = "select b.book_id as query_id, concat(title, ' ', author, ' ', array_join(slice(genres, 1, 3), ' ')) as query, e.embedding from books b left join embeddings e on e.vec_id = b.book_id where b.book_id % 20 = 0 and not is_deleted"
YEARS = (1910, 1990)


def _pipeline(s: SparkSession, d: str) -> DataFrame:
    asked = adapters.query(s, d, ["search_queries"], _ASKED)
    docs, vectors = adapters.view(s, d, "documents").select("doc_id", "text"), adapters.view(s, d, "embeddings").select("vec_id", "embedding")
    return retrieve(asked, docs, vectors, adapters.query(s, d, ["books"], _CATALOG), adapters.query(s, d, ["turns"], _CONTEXT), min_year=YEARS[0], max_year=YEARS[1])


def similar(asked: DataFrame, docs: DataFrame, vectors: DataFrame, catalog: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, title, score, place): books like the book that a query is made of, itself left out."""
    none = asked.select("query_id", F.lit(None).cast("long").alias("doc_id"))
    found = retrieve(asked, docs, vectors, catalog, none, k + 1, bm25_repeated).where(F.col("query_id") != F.col("doc_id"))
    order = Window.partitionBy("query_id").orderBy("place")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "doc_id", "title", "score", "place")


def _similar(s: SparkSession, d: str) -> DataFrame:
    books = [adapters.query(s, d, ["books"], text) for text in (_LIKE, _SHELF, _CATALOG)]
    return similar(books[0], books[1], adapters.view(s, d, "embeddings").select("vec_id", "embedding"), books[2])


def oracle(asked: str, docs: str, context: str, k: int, last: str, where: str = "true") -> str:
    """DuckDB SQL of the chain; asked, docs and context are its tables, last selects from picked (query_id, step, doc_id, score)."""
    wide, many = OVERFETCH * k, OVERFETCH * OVERFETCH * k
    knn_sql = _KNN_ORACLE[: _KNN_ORACLE.index("dense_all as")]
    return f"""with recursive raw as ({asked}), asked as (select query_id, {expanded_query('query')} as query, embedding from raw), shelf as ({docs}), talk as ({context}), catalog as ({_CATALOG}),
      tok as (select doc_id, unnest({_TOKENS.format('text')}) as term from shelf), tfs as (select doc_id, term, count(*) as tf from tok group by doc_id, term),
      lens as (select doc_id, coalesce(len({_TOKENS.format('text')}), 0) as dl from shelf), tot as (select count(*) as n, avg(dl) as avgdl from lens), dfs as (select term, count(*) as df from tfs group by term),
      wants as (select query_id, term, count(*) as times from (select query_id, unnest({_TOKENS.format('query')}) as term from asked) group by query_id, term),
      sparse_all as (select query_id, t.doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 8) as score
        from wants a join dfs d on d.term = a.term join tfs t on t.term = a.term join lens l on l.doc_id = t.doc_id cross join tot group by query_id, t.doc_id),
      s3 as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from sparse_all where score > 0) where place <= {many}),
      {knn_sql} eq as (select query_id, vec_id, e, norm from asked join m on m.vec_id = asked.query_id),
      d3 as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from (select q.query_id, b.vec_id as doc_id, round(list_dot_product(q.e, b.e) / (q.norm * b.norm), 8) as score from eq q cross join m b)) where place <= {many}),
      fused as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.doc_id, b.doc_id) as doc_id, round(coalesce(1.0::double / (60 + a.place), 0) + coalesce(1.0::double / (60 + b.place), 0), 8) as score from d3 a full outer join s3 b on a.query_id = b.query_id and a.doc_id = b.doc_id),
      found as (select f.*, c.title, c.author, c.genres, c.publication_year as year from (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from fused) f join catalog c on c.doc_id = f.doc_id where f.place <= {wide} and {where}),
      lifted as (select f.*, round(f.score + case when t.doc_id is not null then {BOOST} else 0 end, 8) as lifted, count(*) over (partition by f.query_id) as n from found f left join talk t on t.query_id = f.query_id and t.doc_id = f.doc_id),
      sims as (select a.query_id, a.doc_id as x, b.doc_id as y, round(case when lower(a.author) = lower(b.author) then 0.5::double else 0 end
               + case when len(list_intersect(a.genres, b.genres)) > 0 then 0.3::double * len(list_intersect(a.genres, b.genres)) / greatest(len(a.genres), len(b.genres)) else 0 end + case when abs(a.year - b.year) <= 5 then 0.2::double else 0 end, 9) as s
               from lifted a join lifted b on a.query_id = b.query_id where a.n > {k}),
      steps as (
        select query_id, 0 as step, []::bigint[] as taken from (select distinct query_id from lifted where n > {k})
        union all
        select query_id, step + 1, list_append(taken, doc_id) from (
          select *, row_number() over (partition by query_id order by v desc, lifted desc, place) as o from (
            select p.query_id, p.step, p.taken, l.doc_id, l.lifted, l.place, round(0.8::double * l.lifted - 0.2::double * coalesce(max(z.s), 0), 9) as v
            from steps p join lifted l on l.query_id = p.query_id and not list_contains(p.taken, l.doc_id) left join sims z on z.query_id = p.query_id and z.x = l.doc_id and list_contains(p.taken, z.y)
            where p.step < {k} group by p.query_id, p.step, p.taken, l.doc_id, l.lifted, l.place)) where o = 1),
      picked as (
        select s.query_id, l.doc_id, l.title, l.lifted as score, list_position(s.taken, l.doc_id) as place from steps s join lifted l on l.query_id = s.query_id and list_contains(s.taken, l.doc_id) where s.step = {k}
        union all select query_id, doc_id, title, score, row_number() over (partition by query_id order by place) as place from lifted where n <= {k})
      {last}"""


register("retrieve_pipeline", _pipeline, ["search_queries", "books", "turns"], oracle(_ASKED, "select doc_id, text from documents", _CONTEXT, 10, "select p.query_id, a.query as expanded, p.doc_id, p.title, round(p.score, 8) as score, p.place from picked p join asked a on a.query_id = p.query_id", f"c.publication_year >= {YEARS[0]} and c.publication_year <= {YEARS[1]}"))
register(
    "similar_books", _similar, ["books"],
    oracle(_LIKE.replace("array_join", "array_to_string").replace("slice(genres, 1, 3)", "genres[1:3]"), _SHELF.replace("array_join", "array_to_string"), "select null::bigint as query_id, null::bigint as doc_id", 6,
           "select query_id, doc_id, title, round(score, 8) as score, place from (select query_id, doc_id, title, score, row_number() over (partition by query_id order by place) as place from picked where doc_id <> query_id) where place <= 5"),
)
