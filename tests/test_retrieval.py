"""Pruned BM25 and the retrieval chain against plain Python on small tables."""

import math
import random
import re
import tracemalloc

import numpy as np
import pytest

from lectern.plans import rag, retrieval, sparse


def tokens(text):
    return [t for t in re.sub(r"[^\w\s]", " ", (text or "").lower()).split() if len(t) > 1]


def brute_bm25(queries, docs, k):
    bags = [(i, tokens(t)) for i, t in docs]
    n, avgdl = len(bags), sum(len(b) for _, b in bags) / max(1, len(bags))
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text in queries:
        scored = []
        for i, b in bags:
            s = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * b.count(t) * 2.5 / (b.count(t) + 1.5 * (0.25 + 0.75 * len(b) / avgdl)) for t in tokens(text) if t in df and t in b)
            if round(s, 8) > 0:
                scored.append((-round(s, 8), i))
        out += [(q, i, -s, place) for place, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(seed, n):
    draw = random.Random(seed)
    spoken = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]  # the first words stand nearly everywhere
    docs = [(k, " ".join(draw.choices(spoken, weights, k=draw.randint(0, 80)))) for k in range(n)]
    queries = [(k, " ".join(draw.choices(spoken, weights, k=draw.randint(1, 12)))) for k in range(20)]
    return [*queries, (90, "w0"), (91, "w0 w1 w2"), (92, "none of these"), (93, ""), (94, None), (95, "w299 w298 w0 w0")], [*docs, (n, None), (n + 1, "w0 " * 3000), (n + 2, docs[3][1])]


@pytest.mark.parametrize(("seed", "k"), [(1, 10), (2, 3)])
def test_pruned_bm25(spark, seed, k):
    queries, docs = corpus(seed, 250)
    made = sparse.bm25(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3), k)
    found = sorted((r.query_id, r.doc_id, round(r.score, 6), r.place) for r in made.collect())
    assert found == [(q, i, round(s, 6), p) for q, i, s, p in brute_bm25(queries, docs, k)]


def test_common_terms_give_no_candidates(spark):
    """A word of every document, beside a rare one of enough documents, is only looked up."""
    docs = spark.createDataFrame([(k, "every word here" + (" rare find" if k % 20 == 0 else "")) for k in range(400)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "every rare find")], "query_id long, query string")
    found, terms = sparse.weighed(queries, docs)
    head = terms.where("term <> 'every'")
    parted = {r.term: r.common for r in sparse.essential(terms, sparse._kth(sparse._summed(head, found), 10)).collect()}
    assert parted["every"] and not all(parted.values())
    assert [r.doc_id for r in sparse.bm25(queries, docs, 10).orderBy("place").collect()] == [k * 20 for k in range(10)]


def test_empty_tables(spark):
    queries, docs = spark.createDataFrame([(1, "a word")], "query_id long, query string"), spark.createDataFrame([], "doc_id long, text string")
    assert sparse.bm25(queries, docs).count() == 0
    assert sparse.bm25(queries.limit(0), docs.union(spark.createDataFrame([(1, "a word")], docs.schema))).count() == 0


# -- reranking


def brute_rerank(books, seen, k):
    """books: (id, score, author, genres, year) in retrieval order."""
    if len(books) <= k:
        return [b[0] for b in books]
    pool = sorted(((b, round(b[1] + (0.1 if b[0] in seen else 0), 8)) for b in books), key=lambda x: -x[1])

    def alike(a, b):
        s = 0.5 if a[2].lower() == b[2].lower() else 0
        shared = set(a[3]) & set(b[3])
        s += 0.3 * len(shared) / max(len(a[3]), len(b[3])) if shared else 0
        return round(s + (0.2 if a[4] and b[4] and abs(a[4] - b[4]) <= 5 else 0), 9)

    taken = []
    while len(taken) < k:
        best = max(pool, key=lambda x: round(0.8 * x[1] - 0.2 * max([alike(x[0], t) for t in taken], default=0), 9))
        taken.append(best[0])
        pool.remove(best)
    return [b[0] for b in taken]


def test_rerank(spark):
    draw = random.Random(4)
    rows, want, talk = [], {}, [(1, 3), (1, 7), (2, 11), (2, 11)]
    for q, n in [(1, 12), (2, 30), (3, 5), (4, 4)]:
        books = [(100 * q + k if k % 3 else k, round(1 / (60 + k), 8), draw.choice(["Ann", "ANN", "Bo"]), draw.sample(["a", "b", "c", "d"], draw.randint(0, 3)), draw.choice([None, 1900, 1904, 1990])) for k in range(n)]
        rows += [(q, b[0], b[1], k + 1, b[2], b[3], b[4]) for k, b in enumerate(books)]
        want[q] = brute_rerank(books, {d for i, d in talk if i == q}, 4)
    found = spark.createDataFrame(rows, "query_id long, doc_id long, score double, place int, author string, genres array<string>, publication_year int")
    made = rag.rerank(found, spark.createDataFrame(talk, "query_id long, doc_id long"), 4).orderBy("query_id", "place").collect()
    assert {q: [r.doc_id for r in made if r.query_id == q] for q in want} == want


def test_filters(spark):
    rows = spark.createDataFrame([(1, "Ann", ["Sci", "x"], 1950), (2, "bo", ["y"], None), (3, "BO", [], 1990)], "doc_id long, author string, genres array<string>, publication_year int")

    def kept(**by):
        return [r.doc_id for r in rag.filtered(rows, **by).orderBy("doc_id").collect()]

    assert kept() == [1, 2, 3] and kept(genres=["SCI", "q"]) == [1] and kept(authors=["Bo"]) == [2, 3]
    assert kept(min_year=1950, max_year=1960) == [1] and kept(max_year=1990) == [1, 3]


# -- ranking metrics and redaction


def test_ranking_metrics(spark):
    from lectern.plans.evaluation import ranking_metrics

    hits = {1: [0, 1, 0, 1, 1], 2: [0] * 10, 3: [1] * 10, 4: []}
    totals = {1: 4, 2: 2, 3: 30, 4: 3, 5: 0}
    ranked = spark.createDataFrame([(q, k, bool(r)) for q, row in hits.items() for k, r in enumerate(row, 1)], "query_id int, place int, relevant boolean")
    made = {r.query_id: r for r in ranking_metrics(ranked, spark.createDataFrame(list(totals.items()), "query_id int, total long")).collect()}
    for q, total in totals.items():
        row = hits.get(q, [])
        assert made[q].rr == round(next((1 / (k + 1) for k, r in enumerate(row) if r), 0.0), 6)
        for k in (1, 3, 5, 10):
            ideal = sum(1 / math.log2(i + 2) for i in range(min(total, k)))
            dcg = sum(r / math.log2(i + 2) for i, r in enumerate(row[:k]))
            want = (sum(row[:k]) > 0, round(sum(row[:k]) / k, 6), round(sum(row[:k]) / total, 6) if total else 0.0, round(dcg / ideal, 6) if ideal else 0.0)
            assert tuple(made[q][f"{name}_{k}"] for name in ("hit", "precision", "recall", "ndcg")) == want


def test_redaction_at_any_depth(spark):
    from lectern.plans.text import redact

    texts = ['{"Password": {"a": 1}, "x": [{"TOKEN": null, "y": "é \\" z"}, [{"k": [1]}]]}', "[]", '"token"', "no json", "", None, "[" * 100_000]
    made = [r.o for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, t string").select("i", redact("t").alias("o")).orderBy("i").collect()]
    assert made == ['{"Password": "[REDACTED]", "x": [{"TOKEN": "[REDACTED]", "y": "é \\" z"}, [{"k": "[REDACTED]"}]]}', "[]", '"token"', "[REDACTED]", "[REDACTED]", None, "[REDACTED]"]


def test_blocks_of_vectors_and_queries_all_meet(spark, monkeypatch):
    """Several blocks on both sides: each query finds itself, and the best of all blocks."""
    monkeypatch.setattr(retrieval, "VECTORS", 40)
    monkeypatch.setattr(retrieval, "QUERIES", 7)
    monkeypatch.setattr(retrieval, "SLICE", 3)
    m = np.random.default_rng(5).normal(size=(300, 8))
    m[200:] = m[100:200]  # equal vectors go by id
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    found = retrieval.knn(rows.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), rows, 5).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 8)
    wanted = {(q, int(v), p) for q in range(0, 300, 10) for p, v in enumerate(np.argsort(-scores[q], kind="stable")[:5], 1)}
    assert {(r.query_id, r.vec_id, r.place) for r in found} == wanted


def test_best_in_slices_holds_few_scores():
    draw = np.random.default_rng(3)
    a, b = draw.normal(size=(600, 4)), draw.normal(size=(20_000, 4))
    tracemalloc.start()
    row, column, value = retrieval._best(a, b, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = np.round(a @ b.T, 8)
    best = np.argsort(-whole, axis=1, kind="stable")[:, :6]
    assert (row.tolist(), column.tolist()) == (np.repeat(np.arange(600), 6).tolist(), best.ravel().tolist())
    assert value.tolist() == np.take_along_axis(whole, best, axis=1).ravel().tolist()
    assert peak < whole.nbytes


def test_equal_texts_are_scored_once(spark, monkeypatch):
    """The rows of the plain search, ties by id included, from as many documents as there are texts."""
    draw = random.Random(9)
    texts = [" ".join(draw.choices(["red", "blue", "gear", "rod", "ring", "bolt"], k=draw.randint(1, 4))) for _ in range(12)] + [None]
    docs = spark.createDataFrame([(i, draw.choice(texts)) for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, draw.choice(texts)) for i in range(30)], "query_id long, query string")
    plain = sorted(map(tuple, sparse.bm25(queries, docs, 7).collect()))
    sizes, search = [], sparse.bm25
    monkeypatch.setattr(sparse, "bm25", lambda q, d, k: sizes.extend([q.count(), d.count()]) or search(q, d, k))
    assert sorted(map(tuple, sparse.bm25_repeated(queries, docs, 7).select("query_id", "doc_id", "score", "place").collect())) == plain
    assert max(sizes) <= len(texts)


def test_ivf_in_blocks_of_few_rows(spark, monkeypatch):
    """Clusters learned from some vectors, dealt over many blocks: with all clusters probed the search is exact, and nulls match nothing."""
    monkeypatch.setattr(retrieval, "FITTED", 100)
    monkeypatch.setattr(retrieval, "VECTORS", 64)
    monkeypatch.setattr(retrieval, "QUERIES", 16)
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(300)] + [(300 + k, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for k in range(200)] + [(500, None), (501, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    found = retrieval.knn_ivf(queries, vectors, clusters=7, probe=7)
    assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.knn(queries, vectors).collect()))
    part = retrieval.knn_ivf(queries, vectors, clusters=7, probe=2).groupBy("query_id").count().collect()
    assert len(part) == 50 and retrieval.knn_ivf(queries, vectors.limit(0)).count() == 0
