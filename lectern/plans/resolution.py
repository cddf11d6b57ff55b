"""Noisy text to known books: blocking, scoring, fused vector matches, embeddings with a cache."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import adapters
from lectern.plans.retrieval import _KNN_ORACLE, _RANKED, _VISUAL, knn, postings, top
from lectern.plans.sparse import bm25_repeated, rounded
from lectern.plans.text import sequence_ratio, token_sort
from lectern.registry import register

DIMENSION = 64


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashed_embedding(text: pd.Series) -> pd.Series:
    """Unit vectors of hashed words: a stand-in for a model in the same slot. Text without words gives zeros."""

    def one(t: str | None) -> np.ndarray:
        v = np.zeros(DIMENSION, dtype=np.float32)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % DIMENSION] += 1 if h >> 31 else -1
        return v / max(float(np.linalg.norm(v)), 1e-8)

    return text.map(one)


def embed_with_cache(texts: DataFrame, cache: DataFrame, model: str = "hashed-64", max_chars: int = 2048) -> DataFrame:
    """(key, embedding, truncated, cached) of distinct texts; only keys that the cache lacks reach the model."""
    keyed = texts.select(F.substring(F.sha2(F.concat(F.lit(f"text:{model}:"), F.col("text")), 256), 1, 32).alias("key"), "text").dropDuplicates(["key"])
    new = keyed.join(cache.select("key"), "key", "left_anti").select("key", hashed_embedding(F.substring("text", 1, max_chars)).alias("embedding"), (F.length("text") > max_chars).alias("truncated"), F.lit(False).alias("cached"))
    old = keyed.join(cache, "key").select("key", "embedding", F.lit(False).alias("truncated"), F.lit(True).alias("cached"))
    return new.union(old)


GRAM = 3


def grams(text: Column) -> Column:
    """A text as runs of GRAM characters of its words, ends marked: words with a misread letter still share most of them."""
    marked = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("_"), w, F.lit("_")))
    cut = F.transform(marked, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - GRAM + 1)), lambda i: F.substring(w, i, F.lit(GRAM))))
    return F.array_join(F.flatten(cut), " ")


def candidates(queries: DataFrame, catalog: DataFrame, k: int = 3) -> DataFrame:
    """The k best catalog rows for each query: the block that costly scores are worked out on.

    Rows are ranked by BM25 over character runs instead of words, so letters misread in every word do not hide a book; common runs
    give no candidates by themselves (see sparse.bm25).
    """
    return bm25_repeated(queries.select("query_id", grams(F.col("query")).alias("query")), catalog.select("doc_id", grams(F.col("text")).alias("text")), k)


def partial_ratio(a: Column, b: Column) -> Column:
    """Length of the shorter over the longer where one holds the other, else the ratio of matching characters; 0 where one is empty."""
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(inside, F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(sequence_ratio(a, b))


def last_name(author: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(author, r"\s+"), lambda w: w != ""), F.lit(-1)), F.lit(""))


def score_candidates(pairs: DataFrame) -> DataFrame:
    """Weighted score of (query_title, query_author, title, author, embedding_score): 0.5, 0.3 and 0.2, less 0.1 where lengths differ.

    Titles count by the better of ratio and 0.9 of the partial ratio, authors by the best of ratio, ratio of sorted words and ratio of
    last names; 0.5 where an author is missing. Nulls count as empty.
    """
    low = {c: F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("query_title", "title", "query_author", "author")}
    pairs = pairs.withColumns({f"_{c}": v for c, v in low.items()})
    t, u, a, b = (F.col(f"_{c}") for c in ("query_title", "title", "query_author", "author"))
    ratio = F.when((F.length(t) == 0) | (F.length(u) == 0), 0.0).otherwise(sequence_ratio(t, u))
    title = F.greatest(ratio, 0.9 * partial_ratio(t, u))
    author = F.when((a == "") | (b == ""), 0.5).otherwise(F.greatest(sequence_ratio(a, b), sequence_ratio(token_sort(a), token_sort(b)), sequence_ratio(last_name(a), last_name(b))))
    off = F.length(t) / F.greatest(F.length(u), F.lit(1))
    score = 0.5 * F.col("embedding_score") + 0.3 * title + 0.2 * author - F.when((off < 0.5) | (off > 2), 0.1).otherwise(0.0)
    return pairs.withColumn("score", F.round(score, 6)).drop(*[f"_{c}" for c in low])


def identified(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    """(query_id, book_id, similarity): the most similar candidate by title, or by title and author; no book below least. Ties go to the least id."""
    q = F.lower("query_title")
    rows = pairs.withColumn("similarity", F.greatest(sequence_ratio(q, F.lower("title")), sequence_ratio(q, F.lower(F.concat_ws(" ", "title", "author")))))
    best = rows.groupBy("query_id").agg(F.max_by(F.struct("doc_id", "similarity"), F.struct("similarity", -F.col("doc_id"))).alias("b"))
    return best.select("query_id", F.when(F.col("b.similarity") >= least, F.col("b.doc_id")).alias("book_id"), F.round("b.similarity", 6).alias("similarity"))


def _catalog(s: SparkSession, d: str) -> DataFrame:
    return adapters.query(s, d, ["books"], "select book_id as doc_id, title, author, concat(title, ' ', author) as text from books where not is_deleted")


def _noisy(s: SparkSession, d: str) -> DataFrame:
    return adapters.query(s, d, ["books"], "select book_id as query_id, translate(title, 'lo', '10') as query_title, author as query_author, concat(title, ' ', translate(author, 'B', '8')) as query from books")


def _scored(s: SparkSession, d: str) -> DataFrame:
    asked, catalog = _noisy(s, d), _catalog(s, d)
    found = candidates(asked.select("query_id", "query"), catalog, 5)
    best = F.max("score").over(Window.partitionBy("query_id"))
    pairs = found.withColumn("embedding_score", F.col("score") / best).drop("score", "place").join(asked, "query_id").join(catalog, "doc_id")
    return score_candidates(pairs).select("query_id", "doc_id", "query_title", "title", "author", "embedding_score", "score")


def _identified(s: SparkSession, d: str) -> DataFrame:
    return identified(_scored(s, d))


def _explained(s: SparkSession, d: str) -> DataFrame:
    best = top(_scored(s, d), "query_id", "doc_id", 5)
    line = F.format_string("%d. %s (score %.3f, embedding %.3f)", F.col("place"), F.col("title"), F.col("score"), F.col("embedding_score"))
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("explanation"))


def _fused(s: SparkSession, d: str) -> DataFrame:
    vectors = adapters.view(s, d, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    text, visual = (knn(asked, v, 9).select("query_id", "vec_id", F.col("score").alias(n)) for v, n in ((vectors, "text"), (adapters.view(s, d, "visual_vectors"), "visual")))
    both = text.join(visual, ["query_id", "vec_id"], "full_outer")
    agree = F.when(F.col("text").isNotNull() & F.col("visual").isNotNull(), 1 - F.abs(F.col("text") - F.col("visual")))
    fused = 0.6 * F.coalesce("text", F.lit(0.0)) + 0.4 * F.coalesce("visual", F.lit(0.0))
    score = F.when(agree.isNull(), F.least(F.greatest("text", "visual"), F.lit(0.7))).otherwise(fused * (0.8 + 0.2 * agree))
    return top(both.select("query_id", "vec_id", rounded(score, 6).alias("score"), F.when(agree.isNotNull(), "fused").when(F.col("text").isNotNull(), "text").otherwise("visual").alias("method")), "query_id", "vec_id", 5)


def _embedded(s: SparkSession, d: str) -> DataFrame:
    texts = adapters.view(s, d, "documents").select("text")
    cache = embed_with_cache(adapters.view(s, d, "documents").where("doc_id % 3 = 0").select("text"), s.createDataFrame([], "key string, embedding array<float>"))
    return embed_with_cache(texts, cache.select("key", "embedding")).select("key", "truncated", "cached")


def _indexed(s: SparkSession, d: str) -> DataFrame:
    docs = adapters.view(s, d, "documents").select("doc_id", "text")
    counts = postings(docs).groupBy("doc_id").agg(F.sum("tf").alias("tokens"), F.count("*").alias("terms"))
    return docs.select("doc_id", F.size(hashed_embedding("text")).alias("dimension")).join(counts, "doc_id", "left")


register("candidate_scoring", _scored)
register("identify_batch", _identified)
register("explain_ranking", _explained)
register(
    "fused_match", _fused, [],
    f"""with {_KNN_ORACLE}, {_VISUAL}, v9 as (select query_id, vec_id, score from (select *, {_RANKED} from vis_all) where place <= 9), t9 as (select query_id, vec_id, score from dense where place <= 9),
        both_sides as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.vec_id, b.vec_id) as vec_id, a.score as t, b.score as v from t9 a full outer join v9 b on a.query_id = b.query_id and a.vec_id = b.vec_id),
        scored as (select query_id, vec_id, round(case when t is null or v is null then least(coalesce(t, v), 0.7::double) else (0.6::double * t + 0.4::double * v) * (0.8::double + 0.2::double * (1 - abs(t - v))) end, 6) as score,
                          case when t is not null and v is not null then 'fused' when t is not null then 'text' else 'visual' end as method from both_sides)
        select * from (select *, {_RANKED} from scored) where place <= 5""",
)
register("embed_with_cache", _embedded)
register("udf_embedder", lambda s, d: adapters.view(s, d, "documents").select("doc_id", F.size(F.filter(hashed_embedding("text"), lambda x: x != 0)).alias("used")))
register("index_documents", _indexed)


class CitationRows:
    """Table function: a row (title, author, position) for each `[title by author]` in a text."""

    def eval(self, text: str):
        import re

        for k, m in enumerate(re.finditer(r"\[([^\[\]]+?) by ([^\[\]]+)\]", text or ""), 1):
            yield m[1], m[2], k


def _udtf(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.functions import udtf

    s.udtf.register("citation_rows", udtf(CitationRows, returnType="title string, author string, position int"))
    adapters.query(s, d, ["owned"], "select library_id, concat('As in [', title, ' by ', author, '] and more.') as answer from owned").createOrReplaceTempView("lectern_answers")
    return s.sql("select a.library_id, c.title, c.author, c.position from lectern_answers a, lateral citation_rows(a.answer) c")


register("udtf_citations", _udtf, ["owned"], "select library_id, title, author, cast(1 as int) as position from owned")
