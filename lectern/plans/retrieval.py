"""Sparse, dense and fused retrieval for whole tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import adapters
from lectern.plans.sparse import bm25, postings, rounded, top
from lectern.registry import register, register_sql
from lectern.storage import written

RRF = 60

# -- sparse

_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: length(t) > 1)"
_BM25_ORACLE = f"""tok as (select doc_id, unnest({_TOKENS.format('text')}) as term from documents), tfs as (select doc_id, term, count(*) as tf from tok group by doc_id, term),
    lens as (select doc_id, coalesce(len({_TOKENS.format('text')}), 0) as dl from documents), tot as (select count(*) as n, avg(dl) as avgdl from lens), dfs as (select term, count(*) as df from tfs group by term),
    asked as (select query_id, term, count(*) as times from (select query_id, unnest({_TOKENS.format('query')}) as term from search_queries) group by query_id, term),
    sparse_all as (select query_id, t.doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 8) as score
      from asked a join dfs d on d.term = a.term join tfs t on t.term = a.term join lens l on l.doc_id = t.doc_id cross join tot group by query_id, t.doc_id),
    sparse as (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from sparse_all where score > 0)"""


def _queries(s: SparkSession, d: str) -> DataFrame:
    return adapters.view(s, d, "search_queries")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return adapters.view(s, d, "documents").select("doc_id", "text")


register("bm25_index", lambda s, d: postings(_docs(s, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), [], f"select term, count(*) as df, cast(sum(tf) as bigint) as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TOKENS.format('text')}) as term from documents) group by doc_id, term) group by term")
register("bm25_search", lambda s, d: bm25(_queries(s, d), _docs(s, d)), ["search_queries"], f"with {_BM25_ORACLE} select query_id, doc_id, score, place from sparse where place <= 10")

# -- dense


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-8))))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Vectors and queries of a block at most.
VECTORS, QUERIES = 16_384, 4_096
#: Queries of a block that are scored at once: a task holds so many rows of scores.
SLICE = 128


def unit_rows(rows: pd.Series) -> np.ndarray:
    m = np.stack(rows.to_numpy())
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)


def _best(asked: np.ndarray, found: np.ndarray, k: int, meet: Callable[[slice], np.ndarray] | None = None, score: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries and vectors (unit rows, vectors by rising id) and rounded scores: the best k of each query.

    Of equal scores the least id; meet gives which vectors the queries of a slice may find, score their scores with -inf for the others.
    """
    rows, columns, values = [], [], []
    for first in range(0, len(asked), SLICE):
        part = slice(first, min(first + SLICE, len(asked)))
        scores = np.round(score(part) if score else asked[part] @ found.T, 8)
        if meet is not None:
            scores[~meet(part)] = -np.inf
        if k < scores.shape[1]:
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        else:
            least = np.full((len(scores), 1), -np.inf)
        row, column = np.nonzero((scores >= least) & (scores > -np.inf))  # by query, then by id
        value = scores[row, column]
        order = np.lexsort((column, -value, row))
        row, column, value = row[order], column[order], value[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        rows.append(row[kept] + first)
        columns.append(column[kept])
        values.append(value[kept])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, planes: np.ndarray | None = None, bits: int = 1) -> DataFrame:
    """(query_id, vec_id, score, place): exact best k by cosine. Both tables have (id, embedding).

    Both are dealt into blocks by hash, and each block of queries meets each block of vectors in one matrix product; k
    rows a query and block of vectors are left for the final ranking. Null vectors match nothing. With planes, a query finds
    only vectors that lie on its side of each of some `bits` planes that follow each other.
    """
    v = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    q = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("e"))
    parts, blocks = v.count() // VECTORS + 1, q.count() // QUERIES + 1
    # the numbers have one type on both sides: an int and a long of one value have different hashes, so their rows would not meet
    left = v.withColumns({"part": F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = q.withColumns({"block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})

    def run(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        found = found.sort_values("vec_id")
        left, right = unit_rows(asked["e"]), unit_rows(found["e"])
        meet = None
        if planes is not None:
            powers = 1 << np.arange(bits)
            one, other = ((((m @ planes.T) > 0).reshape(len(m), -1, bits) @ powers).astype(np.uint32) for m in (left, right))

            def meet(part: slice) -> np.ndarray:
                same = np.zeros((part.stop - part.start, len(other)), dtype=bool)
                for band in range(one.shape[1]):
                    same |= one[part, band, None] == other[None, :, band]
                return same

        row, column, value = _best(left, right, k, meet)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[row], "vec_id": found["vec_id"].to_numpy()[column], "score": value})

    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
    return top(met, "query_id", "vec_id", k)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return adapters.view(s, d, "embeddings").select("vec_id", "embedding")


def _vector_queries(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


_KNN_ORACLE = """n as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), m as (select vec_id, e, greatest(sqrt(list_dot_product(e, e)), 1e-8) as norm from n),
    dense_all as (select a.vec_id as query_id, b.vec_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 8) as score from m a cross join m b where a.vec_id % 20 = 0),
    dense as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from dense_all)"""
register("vector_normalize", lambda s, d: _vectors(s, d).select("vec_id", F.round(dot(unit(F.col("embedding").cast("array<double>")), F.transform(F.col("embedding"), lambda x, i: (i + 1).cast("double"))), 6).alias("projection")), [], "with n as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings) select vec_id, round(list_dot_product(e, list_transform(e, lambda x, i: cast(i as double))) / greatest(sqrt(list_dot_product(e, e)), 1e-8), 6) as projection from n")
register("knn_exact", lambda s, d: knn(_vector_queries(s, d), _vectors(s, d)), [], f"with {_KNN_ORACLE} select query_id, vec_id, score, place from dense where place <= 10")
register("cross_modal_match", lambda s, d: knn(_vector_queries(s, d), adapters.view(s, d, "visual_vectors"), 5), ["visual_vectors"], f"with {_KNN_ORACLE.replace('cross join m b', 'cross join (select (m.vec_id + cast(floor(n / 2) as bigint)) % n as vec_id, m.e, m.norm from m cross join (select count(*) as n from embeddings) c) b')} select query_id, vec_id, score, place from dense where place <= 5")
register("pairwise_similarity", lambda s, d: _vectors(s, d).alias("a").join(_vectors(s, d).alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select(F.col("a.vec_id").alias("vec_id"), F.round(dot(unit(F.col("a.embedding").cast("array<double>")), unit(F.col("b.embedding").cast("array<double>"))), 6).alias("similarity")), [], "with n as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings) select a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) as similarity from n a join n b on b.vec_id = a.vec_id + 1")


#: Vectors of which k-means learns its clusters, about: those with the least hashes of their ids.
FITTED = 20_000


def knn_ivf(queries: DataFrame, vectors: DataFrame, k: int = 10, clusters: int = 20, probe: int = 5) -> DataFrame:
    """Approximate search: vectors are dealt to k-means clusters, and a query meets those of its nearest clusters only.

    The clusters are learned from FITTED vectors, and every vector is dealt to one. Clusters one after the other fill blocks of VECTORS
    rows (a large one several), a query is sent to the blocks of its clusters, and a task scores it against their rows there, in matrix
    products: no pairs are written, and a task holds a block of vectors and one of queries. Null vectors match nothing.
    """
    v = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    q = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("e"))
    total, blocks, far = v.count(), q.count() // QUERIES + 1, 1 << 40
    if not total:
        return v.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, place int")
    learned = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(far)) < int(min(1.0, FITTED / total) * far))
    if learned.isEmpty():  # few ids, repeated
        learned = v.limit(FITTED)
    centers = np.array(KMeans(k=clusters, seed=7, featuresCol="f").fit(learned.select(array_to_vector(unit(F.col("e"))).alias("f"))).clusterCenters())
    squares = (centers**2).sum(axis=1) / 2

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            if len(rows):
                yield rows.assign(cluster=(unit_rows(rows["e"]) @ centers.T - squares).argmax(axis=1).astype("int32"))

    dealt = written(v.mapInPandas(deal, "vec_id long, e array<double>, cluster int"), "dealt")
    sizes = np.zeros(len(centers), dtype=np.int64)
    for cluster, n in dealt.groupBy("cluster").count().collect():  # one row a cluster
        sizes[cluster] = n
    starts = np.concatenate([[0], np.cumsum(sizes)])
    first, last = starts[:-1] // VECTORS, np.maximum(starts[1:] - 1, starts[:-1]) // VECTORS

    def probed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            if not len(rows):
                continue
            near = np.argsort(-(unit_rows(rows["e"]) @ centers.T), axis=1, kind="stable")[:, :probe]
            near.sort(axis=1)
            sent = [np.unique(np.concatenate([np.arange(first[c], last[c] + 1) for c in row if sizes[c]] or [[]])).astype("int32") for row in near]
            yield rows.assign(near=list(near.astype("int32")), parts=sent)

    start, size = (F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("cluster")) for values in (starts[:-1], sizes))
    part = F.floor((start + F.pmod(F.xxhash64("vec_id"), size)) / VECTORS).cast("int")
    left = dealt.withColumns({"part": part, "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    asked = q.mapInPandas(probed, "query_id long, e array<double>, near array<int>, parts array<int>")
    right = asked.select("query_id", "e", "near", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode("parts").alias("part"))

    def run(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        found = found.sort_values("vec_id")
        one, other = unit_rows(asked["e"]), unit_rows(found["e"])
        cluster = found["cluster"].to_numpy()
        columns = [(c, np.flatnonzero(cluster == c)) for c in np.unique(cluster)]
        meets = np.zeros((len(one), len(centers)), dtype=bool)
        np.put_along_axis(meets, np.stack(asked["near"].to_numpy()).astype(np.int64), True, axis=1)
        by_cluster = [other[at].T for _, at in columns]

        def score(part: slice) -> np.ndarray:
            scores = np.full((part.stop - part.start, len(other)), -np.inf)
            for (c, at), these in zip(columns, by_cluster, strict=True):
                rows = np.flatnonzero(meets[part, c])
                scores[rows[:, None], at] = one[part][rows] @ these
            return scores

        row, column, value = _best(one, other, k, score=score)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[row], "vec_id": found["vec_id"].to_numpy()[column], "score": value})

    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
    return top(met, "query_id", "vec_id", k)


def knn_lsh(queries: DataFrame, vectors: DataFrame, k: int = 10, bands: int = 24, bits: int = 6) -> DataFrame:
    """Approximate search by sign random projections: candidates share a band of signs, then are scored exactly.

    Bands of few signs make candidates of most pairs, so pairs are not written: vectors are dealt into blocks as in the exact
    search, and a task compares the signs of its two blocks.
    """
    width = vectors.where("embedding is not null").select(F.size("embedding")).first()
    planes = np.random.default_rng(11).normal(size=(bands * bits, width[0] if width else 1))
    return knn(queries, vectors, k, planes, bits)


def _ivf(s: SparkSession, d: str) -> DataFrame:
    """The clusters grow with the square root of the table; seven tenths of them are probed for a recall of 0.9."""
    vectors = _vectors(s, d)
    clusters = max(20, round(vectors.count() ** 0.5))
    return knn_ivf(_vector_queries(s, d), vectors, clusters=clusters, probe=-(-7 * clusters // 10))


register("knn_ivf", _ivf)
register("knn_lsh", lambda s, d: knn_lsh(_vector_queries(s, d), _vectors(s, d), bands=32, bits=4))

# -- fusion


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 10, constant: int = RRF) -> DataFrame:
    """(query_id, doc_id, score, source, place): reciprocal ranks of two ranked lists added up."""
    a = dense.select("query_id", F.col("vec_id").alias("doc_id"), F.col("place").alias("d"))
    b = sparse.select("query_id", "doc_id", F.col("place").alias("s"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    score = F.coalesce(1 / (constant + F.col("d")), F.lit(0.0)) + F.coalesce(1 / (constant + F.col("s")), F.lit(0.0))
    source = F.when(F.col("d").isNotNull() & F.col("s").isNotNull(), "hybrid").when(F.col("d").isNotNull(), "dense").otherwise("sparse")
    return top(both.select("query_id", "doc_id", F.round(score, 8).alias("score"), source.alias("source")), "query_id", "doc_id", k)


def weighted(dense: DataFrame, sparse: DataFrame, k: int = 10, share: float = 0.6) -> DataFrame:
    """Two lists, each brought to 0..1 by its own range, in a weighted sum."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("query_id")
        low, high = F.min("score").over(w), F.max("score").over(w)
        return df.withColumn(name, F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0)).select("query_id", "doc_id", name)

    both = scaled(dense.withColumnRenamed("vec_id", "doc_id"), "d").join(scaled(sparse, "s"), ["query_id", "doc_id"], "full_outer")
    return top(both.select("query_id", "doc_id", rounded(share * F.coalesce("d", F.lit(0.0)) + (1 - share) * F.coalesce("s", F.lit(0.0)), 6).alias("score")), "query_id", "doc_id", k)


_LISTS = f"{_BM25_ORACLE}, {_KNN_ORACLE}, d3 as (select query_id, vec_id as doc_id, score, place from dense where place <= 30), s3 as (select query_id, doc_id, score, place from sparse where place <= 30)"


def _lists(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return knn(_vector_queries(s, d), _vectors(s, d), 30), bm25(_queries(s, d), _docs(s, d), 30)


register(
    "hybrid_rrf", lambda s, d: rrf(*_lists(s, d)), ["search_queries"],
    f"""with {_LISTS}, fused as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.doc_id, b.doc_id) as doc_id, round(coalesce(1.0::double / (60 + a.place), 0) + coalesce(1.0::double / (60 + b.place), 0), 8) as score,
          case when a.doc_id is not null and b.doc_id is not null then 'hybrid' when a.doc_id is not null then 'dense' else 'sparse' end as source from d3 a full outer join s3 b on a.query_id = b.query_id and a.doc_id = b.doc_id),
        placed as (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from fused) select * from placed where place <= 10""",
)
register(
    "hybrid_weighted", lambda s, d: weighted(*_lists(s, d)), ["search_queries"],
    f"""with {_LISTS}, dn as (select query_id, doc_id, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0 end as v from d3 window w as (partition by query_id)),
        sn as (select query_id, doc_id, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0 end as v from s3 window w as (partition by query_id)),
        fused as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.doc_id, b.doc_id) as doc_id, round(0.6 * coalesce(a.v, 0) + 0.4 * coalesce(b.v, 0), 6) as score from dn a full outer join sn b on a.query_id = b.query_id and a.doc_id = b.doc_id),
        placed as (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from fused) select * from placed where place <= 10""",
)
_VISUAL = "vis_all as (select query_id, (vec_id + cast(floor(n / 2) as bigint)) % n as vec_id, score from dense_all cross join (select count(*) as n from embeddings) c)"
_RANKED = "row_number() over (partition by query_id order by score desc, vec_id) as place"
register(
    "multimodal_search",
    lambda s, d: top(
        knn(_vector_queries(s, d), _vectors(s, d), 30).select("query_id", "vec_id", F.col("score").alias("t")).join(knn(_vector_queries(s, d), adapters.view(s, d, "visual_vectors"), 30).select("query_id", "vec_id", F.col("score").alias("v")), ["query_id", "vec_id"], "full_outer").select("query_id", "vec_id", rounded(0.6 * F.coalesce("t", F.lit(0.0)) + 0.4 * F.coalesce("v", F.lit(0.0)), 6).alias("score")), "query_id", "vec_id", 10),
    [],
    f"""with {_KNN_ORACLE}, {_VISUAL}, v3 as (select * from (select *, {_RANKED} from vis_all) where place <= 30), t3 as (select * from dense where place <= 30),
        fused as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.vec_id, b.vec_id) as vec_id, round(0.6 * coalesce(a.score, 0) + 0.4 * coalesce(b.score, 0), 6) as score from t3 a full outer join v3 b on a.query_id = b.query_id and a.vec_id = b.vec_id)
        select * from (select *, {_RANKED} from fused) where place <= 10""",
)


def boosted(s: SparkSession, d: str) -> DataFrame:
    """Each query belongs to a conversation of the same number; books named there gain a tenth."""
    named = adapters.view(s, d, "turns").select(F.col("conv_id").alias("query_id"), F.col("book_id").alias("doc_id")).distinct().withColumn("seen", F.lit(True))
    found = bm25(_queries(s, d), _docs(s, d), 30).join(named, ["query_id", "doc_id"], "left")
    return top(found.select("query_id", "doc_id", F.round(F.col("score") + F.when(F.col("seen"), 0.1).otherwise(0.0), 6).alias("score")), "query_id", "doc_id", 10)


register(
    "rerank_boost", boosted, ["search_queries", "turns"],
    f"""with {_BM25_ORACLE}, named as (select distinct conv_id as query_id, book_id as doc_id from turns),
        lifted as (select s.query_id, s.doc_id, round(score + case when n.doc_id is not null then 0.1 else 0 end, 6) as score from sparse s left join named n on n.query_id = s.query_id and n.doc_id = s.doc_id where s.place <= 30)
        select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from lifted) where place <= 10""",
)


def mmr(candidates: DataFrame, k: int = 5, relevance: float = 0.8) -> DataFrame:
    """Greedy diversification per query: candidates (query_id, vec_id, score, embedding), a few times k a query."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        m = np.stack(part["embedding"].to_numpy()).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
        alike, left, taken, out = m @ m.T, list(range(len(part))), [], []
        while left and len(taken) < k:
            value = [relevance * part["score"][i] - (1 - relevance) * (alike[i, taken].max() if taken else 0.0) for i in left]
            pick = left.pop(int(np.argmax(value)))
            out.append((part["query_id"][pick], part["vec_id"][pick], float(max(value)), len(taken) + 1))
            taken.append(pick)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "place"])

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, vec_id long, score double, place int")


register("mmr_rerank", lambda s, d: mmr(knn(_vector_queries(s, d), _vectors(s, d), 15).drop("place").join(_vectors(s, d), "vec_id")))
register("grouped_map_greedy", lambda s, d: mmr(knn(_vector_queries(s, d), _vectors(s, d), 9).drop("place").join(_vectors(s, d), "vec_id"), 3))
register_sql("retrieve_by_genre", ["books"], "select book_id, title from books where array_contains(genres, 'anvil') and not is_deleted order by rating desc, book_id limit 10", "select book_id, title from books where list_contains(genres, 'anvil') and not is_deleted order by rating desc, book_id limit 10")


def search(s: SparkSession, d: str, mode: str, offset: int, limit: int) -> DataFrame:
    """(query_id, doc_id, score, place, mode): a page of hits in one mode, among documents in English (the filter)."""
    k = offset + limit
    kept = adapters.view(s, d, "documents").where("lang = 'en'")
    dense = knn(_vector_queries(s, d), _vectors(s, d).join(kept.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), 3 * k if mode == "hybrid" else k) if mode != "sparse" else None
    sparse = bm25(_queries(s, d), kept.select("doc_id", "text"), 3 * k if mode == "hybrid" else k) if mode != "dense" else None
    found = rrf(dense, sparse, k).drop("source") if mode == "hybrid" else sparse if mode == "sparse" else dense.withColumnRenamed("vec_id", "doc_id")
    return found.where(F.col("place").between(offset + 1, k)).select("query_id", "doc_id", "score", "place", F.lit(mode).alias("mode"))


_ENGLISH = _BM25_ORACLE.replace("from documents", "from (select * from documents where lang = 'en')") + ", " + _KNN_ORACLE.replace("from m a cross join m b", "from m a cross join (select * from m where vec_id in (select doc_id from documents where lang = 'en')) b")
register(
    "search_modes", lambda s, d: search(s, d, "dense", 5, 10).union(search(s, d, "sparse", 5, 10)).union(search(s, d, "hybrid", 5, 10)), ["search_queries"],
    f"""with {_ENGLISH}, d3 as (select query_id, vec_id as doc_id, score, place from dense where place <= 45), s3 as (select query_id, doc_id, score, place from sparse where place <= 45),
        fused as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.doc_id, b.doc_id) as doc_id, round(coalesce(1.0::double / (60 + a.place), 0) + coalesce(1.0::double / (60 + b.place), 0), 8) as score from d3 a full outer join s3 b on a.query_id = b.query_id and a.doc_id = b.doc_id),
        hybrid as (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from fused)
        select *, 'dense' as mode from d3 where place between 6 and 15 union all select *, 'sparse' from s3 where place between 6 and 15 union all select *, 'hybrid' from hybrid where place between 6 and 15""",
)
