"""Genre classification, reports and suggestions against plain Python."""

import re
from collections import Counter

from lectern.plans import genres as G

BOOKS = [
    (1, "The Wizard of the Dark Galaxy", "a story of love and war", ["Space travel", None], ["sci-fi", "Fantasy", "odd magic"]),
    (2, "Nothing here", None, None, None),
    (3, "YA", "", [], ["YA", "ya", "Ya book", "fantasy"]),
    (4, None, "An ancient biography: the history of a civil war", ["medieval realm"], []),
    (5, "Plain", "x" * 100_000 + " robot", None, ["novel"]),
    (6, "Children's verse", "comic manga comic", ["Historical novel"], ["Graphic Novel", "kids"]),
]


def brute(title, description, subjects, given):
    words = {}
    for name, _, aliases, keywords in G.GENRES:
        for w in [*keywords, *aliases]:
            words.setdefault(w.lower(), []).append(name)

    def match(text):
        found = Counter()
        for w, names in words.items():
            if w in text.lower():
                for n in names:
                    found[n] += 1.0
        return found

    def normal(name):
        if name in [g[0] for g in G.GENRES]:
            return name
        return next((g[0] for g in G.GENRES if name.lower() in [a.lower() for a in g[2]]), None)

    score = Counter()
    for g in given or []:
        if normal(g):
            score[normal(g)] += 2.0
        else:
            for n, s in match(g).items():
                score[n] += 1.5 * s
    for texts, weight in ((subjects or [], 1.0), ([title], 0.5), ([description], 0.3)):
        for t in texts:
            if t is not None:
                for n, s in match(t).items():
                    score[n] += weight * s
    if not score:
        return [("Fiction", 0.5, 1)]
    ranked = sorted(score.items(), key=lambda x: -round(x[1], 6))
    return [(n, round(s / max(score.values()), 6), k) for k, (n, s) in enumerate(ranked, 1) if k == 1 or (k <= 5 and s / max(score.values()) > 0.3)]


def classified(spark):
    rows = spark.createDataFrame([(*b, "clash") for b in BOOKS], "book_id long, title string, description string, subjects array<string>, genres array<string>, score string").repartition(3)
    return G.classify(rows)


def test_classification(spark):
    made = G.labels(classified(spark)).orderBy("book_id", "place").collect()
    for key, *book in BOOKS:
        assert [(r.genre, round(r.share, 6), r.place) for r in made if r.book_id == key] == brute(*book), key


def test_normal_names(spark):
    raw = ["Fantasy", "fantasy", "SF", "sf", "Love Story", "YA", "ya", "unknown", "", None]
    made = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string").select("k", G.DEFAULT.normal(G.F.col("raw")).alias("g"), G.DEFAULT.parent(G.DEFAULT.normal(G.F.col("raw"))).alias("p")).orderBy("k").collect()
    assert [r.g for r in made] == ["Fantasy", None, "Science Fiction", "Science Fiction", "Romance", "Young Adult", "Young Adult", None, None, None]
    assert [r.p for r in made][:5] == ["Fiction", None, "Fiction", "Fiction", "Fiction"] and made[5].p is None


def test_reports_and_suggestions(spark):
    primary = {1: "Fiction", 2: "Fiction", 3: "Fantasy", 4: "Poetry", 5: "Fiction", 6: "Science", 7: "Fiction", 8: "Fiction", 9: "Fiction"}
    found = spark.createDataFrame([(k, g, 1) for k, g in primary.items()], "book_id long, genre string, place int")
    owned = spark.createDataFrame([(1, k) for k in (9, 1, 2, 3, 4, 5, 7, 8)] + [(2, 6), (2, 3), (3, 4)], "library_id long, book_id long")
    report = {(r.library_id, r.genre): r for r in G.collection(owned, found).collect()}
    first = report[1, "Fiction"]
    assert (first.n, first.share_pct, first.r, first.dominant, first.samples) == (6, 75.0, 1, True, "1,2,5,7,8")
    assert not report[1, "Fantasy"].dominant and report[1, "Poetry"].r == 3 and first.fiction_pct == 100.0
    assert [report[2, g].r for g in ("Fantasy", "Science")] == [1, 2] and report[2, "Science"].nonfiction_pct == 50.0 and report[3, "Poetry"].fiction_pct == 0.0
    liked = spark.createDataFrame([(1, "Fantasy"), (3, "Poetry")], "library_id long, genre string")
    made = {}
    for r in G.suggest(G.collection(owned, found), liked).orderBy("library_id", "place").collect():
        made.setdefault(r.library_id, []).append(r.genre)
    # missing majors of the same parent as a liked genre, then children of dominant genres that are not liked yet
    assert made[1] == ["Science Fiction", "Mystery", "Science Fiction", "Mystery", "Thriller"]
    assert made[3] == ["Fiction", "Non-Fiction"] and 2 not in made


def test_empty(spark):
    none = spark.createDataFrame([], "book_id long, title string, description string, subjects array<string>, genres array<string>")
    assert G.classify(none).count() == 0


def test_texts_are_read_once_and_no_lists_are_gathered(spark):
    words = sorted({w for w, *_ in G.DEFAULT.words()}) + ["a", "ab", "abc", "b c", "b.c"]
    pattern = re.compile(f"(?=({G.longest(words)}))")
    for text in ["abcd b c bxc b.c", "awarriors", "civil wars of the scifi science fiction", "eras", "", *words]:
        assert {v for w in pattern.findall(text) for v in words if w.startswith(v)} == {w for w in words if w in text}, text
    books = spark.createDataFrame([(*b, "clash") for b in BOOKS], "book_id long, title string, description string, subjects array<string>, genres array<string>, score string")
    found = G.classify(books)
    owned = spark.createDataFrame([(1, 2)], "library_id long, book_id long")
    plan = G.collection(owned, found)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "contains(" not in plan.lower()
