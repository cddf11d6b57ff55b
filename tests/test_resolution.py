"""Blocking, scoring and identification of misread titles against plain Python."""

import random
from difflib import SequenceMatcher

from lectern.plans import resolution


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def brute_score(qt, qa, t, a, e):
    qt, qa, t, a = ((x or "").strip().lower() for x in (qt, qa, t, a))
    partial = 0.0
    if qt and t:
        partial = min(len(qt), len(t)) / max(len(qt), len(t)) if qt in t or t in qt else ratio(qt, t)
    title = max(ratio(qt, t) if qt and t else 0.0, 0.9 * partial)
    author = max(ratio(qa, a), ratio(" ".join(sorted(qa.split())), " ".join(sorted(a.split()))), ratio(qa.split()[-1], a.split()[-1])) if qa and a else 0.5
    off = len(qt) / max(len(t), 1)
    return round(0.5 * e + 0.3 * title + 0.2 * author - (0.1 if off < 0.5 or off > 2 else 0), 6)


def test_scores(spark):
    rows = [("The Hobbit", "Tolkien J R R", "the hobbit", "J R R Tolkien", 0.9), ("Dune", None, "Dune Messiah", "Frank Herbert", 0.4), ("", "x", "Emma", "", 0.1), (None, None, None, None, 0.0), ("Emma", "Jane Austen", "Emma", "J. Austen", 1.0), ("a very long title of a book", "A B", "short", "C B", 0.3)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, query_title string, query_author string, title string, author string, embedding_score double")
    made = resolution.score_candidates(frame).orderBy("k").collect()
    assert [r.score for r in made] == [brute_score(*r) for r in rows]


def test_block_survives_misread_letters(spark):
    draw = random.Random(12)
    parts = ["river", "stone", "golden", "silent", "harbor", "winter", "letter", "garden", "mirror", "shadow", "copper", "meadow", "lantern", "orchard", "violin", "compass"]
    books = [(k, " ".join(draw.sample(parts, 3)) + f" {draw.choice(parts)}{k % 97}") for k in range(400)]
    queries = []
    for k, text in books[:150]:
        letters = list(text)
        for word_start in [0] + [i + 1 for i, c in enumerate(text) if c == " "]:  # one letter of every word is misread
            letters[word_start + draw.randint(0, 3)] = draw.choice("0185")
        queries.append((k, "".join(letters)))
    found = resolution.candidates(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(books, "doc_id long, text string"), 5)
    hits = {r.query_id for r in found.collect() if r.query_id == r.doc_id}
    assert len(hits) >= 0.95 * len(queries)


def test_the_least_similarity(spark):
    pairs = spark.createDataFrame([(1, 7, "Emma", "Emma", "Austen"), (1, 5, "Emma", "emma", "Austen"), (2, 9, "Xyzzy", "Emma", "Austen"), (3, 4, "abcde", "abcxy", "")], "query_id long, doc_id long, query_title string, title string, author string")
    made = {r.query_id: (r.book_id, r.similarity) for r in resolution.identified(pairs).collect()}
    assert made[1] == (5, 1.0) and made[2][0] is None and made[3] == (4, 0.6)
