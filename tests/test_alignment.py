"""Bit-parallel distances and alignments against the full table, and the queries that use them."""

import random
import time
from collections import Counter

import pytest

from lectern import registry
from lectern.plans import alignment, text
from lectern.plans.alignment import distance, replaced


def brute(a, b):
    m, n = len(a), len(b)
    d = [[i + j if not i * j else 0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    found, i, j = Counter(), m, n
    while i and j:
        if d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            if a[i - 1] != b[j - 1]:
                found[a[i - 1], b[j - 1]] += 1
            i, j = i - 1, j - 1
        elif d[i][j] == d[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return d[m][n], found


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefgh漢"])
def test_random_strings(letters):
    draw = random.Random(len(letters))
    for _ in range(600):
        a = "".join(draw.choices(letters, k=draw.randint(0, 60)))
        b = "".join(x if draw.random() < 0.8 else draw.choice(letters) for x in a) if draw.random() < 0.5 else "".join(draw.choices(letters, k=draw.randint(0, 60)))
        assert (distance(a, b), replaced(a, b)) == brute(a, b)


def test_words_in_few_and_many_places():
    draw = random.Random(1)
    a, b = ([draw.choice("xyz") if draw.random() < 0.5 else f"w{draw.randint(0, 40)}" for _ in range(150)] for _ in range(2))
    assert (distance(a, b), replaced(a, b)) == brute(a, b)


def test_long_lines_are_aligned_whole():
    draw = random.Random(2)
    a = "".join(draw.choices("the quick brown fox lio", k=30_000))
    began = time.time()
    found = replaced(a, a.translate(str.maketrans("oil", "011")))
    assert set(found) <= {("o", "0"), ("i", "1"), ("l", "1")} and sum(found.values()) > 7000 and time.time() - began < 20


def test_confusions(spark):
    rows = [("solo", "s0l0"), ("solo", "s0l0"), ("été", "ete"), ("same", "same"), (None, "x"), ("x", None), ("", "abc"), ("abc", ""), ("ab" * 300, "ac" * 300)]
    made = text.confusions(spark.createDataFrame([(t, p, "clash") for t, p in rows], "truth string, prediction string, n string").repartition(3))
    assert sorted(tuple(r) for r in made.collect()) == [("b", "c", 300), ("o", "0", 4), ("é", "e", 2)]
    assert text.confusions(spark.createDataFrame([], "truth string, prediction string")).count() == 0


def test_ratios_and_word_errors(spark):
    from difflib import SequenceMatcher

    draw = random.Random(3)
    rows = [("".join(draw.choices("abc ", k=draw.randint(0, 30))), "".join(draw.choices("abc ", k=draw.randint(0, 30)))) for _ in range(200)] + [(None, None), ("a b", None), (None, "a")]
    made = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string").select("k", text.sequence_ratio("a", "b").alias("r"), text.word_error_rate("a", "b").alias("w")).orderBy("k").collect()
    for (a, b), r in zip(rows, made, strict=True):
        x, y = (a or "").split(), (b or "").split()
        assert r.r == SequenceMatcher(None, a or "", b or "").ratio()
        assert r.w == (brute(x, y)[0] / len(x) if x else float(bool(y)))


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefgh漢"])
def test_many_pairs_at_once(letters):
    draw = random.Random(len(letters) + 7)
    a = ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(500)]
    b = ["".join({"a": "x", "b": "y"}.get(c, c) if draw.random() < 0.7 else c for c in x) if draw.random() < 0.6 else "".join(draw.choices(letters, k=len(x))) for x in a]
    whole = [brute(x, y) for x, y in zip(a, b, strict=True)]
    assert alignment.distances(a, b).tolist() == [w[0] for w in whole]
    times = [draw.randint(1, 3) for _ in a]
    total = Counter()
    for (_, found), n in zip(whole, times, strict=True):
        for pair, k in found.items():
            total[pair] += n * k
    assert alignment.confused(a, b, times) == total
    assert (len(alignment.distances([], [])), alignment.confused([], [], [])) == (0, Counter())


def test_long_lines_take_linear_time():
    """A table of these lines has 4e10 cells; levenshtein() took minutes for each."""
    a = "oil and water, " * 14_000
    began = time.time()
    assert alignment.distances([a] * 20, [a.translate(str.maketrans("oil", "011"))] * 20).tolist() == [42_000] * 20
    assert time.time() - began < 30


def test_edit_distance_of_nulls(spark):
    rows = spark.createDataFrame([(1, "oil", "011"), (2, None, "a"), (3, "a", None), (4, "", "ab"), (5, "漢字", "字漢字")], "k int, a string, b string")
    assert [r[0] for r in rows.orderBy("k").select(text.edit_distance("a", "b")).collect()] == [3, None, None, 2, 1]


def test_ratios_are_those_of_difflib():
    from difflib import SequenceMatcher

    draw = random.Random(5)
    for letters in ("ab", "etaoinshrdlu zqxjkv01", "abcdefghijklmnopqrstuvwxyz eeeeaaa01漢"):
        for size in [3, 30, 150, 250, 700] * 12:
            a = "".join(draw.choices(letters, k=draw.randint(0, size)))
            words = a.split(" ")
            draw.shuffle(words)
            for b in (a.translate(str.maketrans("oil", "011")), a.translate(str.maketrans("oil", "#@@")), "".join(draw.choices(letters, k=size)), " ".join(words), "".join(c if draw.random() < 0.9 else "a" for c in a)):
                assert alignment.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_ratios_of_long_lines():
    """SequenceMatcher reads the rest of the text anew for each block: minutes for these."""
    draw = random.Random(6)
    a = " ".join("".join(draw.choices("etaoinshrdlucmfwypvbgkqjxz", [12.7, 9.1, 8.2, 7.5, 7, 6.7, 6.3, 6.1, 6, 4.3, 4, 2.8, 2.8, 2.4, 2.2, 2.4, 2, 1.9, 1, 1.5, 2, 0.8, 0.2, 0.2, 0.1, 0.1], k=draw.randint(1, 9))) for _ in range(20_000))
    b = a.translate(str.maketrans("oil", "011"))
    began = time.time()
    assert 0 < alignment.ratio(a, b) < 1 and 0 < alignment.ratio(*(" ".join(sorted(x.split())) for x in (a, b))) < 1
    assert time.time() - began < 30


def test_ratios_of_blank_lines(spark, tmp_path):
    """A blank line made a division of 0 by 0."""
    spark.createDataFrame([(0, "a word\n\nlion"), (1, ""), (2, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.sample_id: (r.ratio, r.token_sort_ratio, r.partial_ratio) for r in registry.queries()["fuzzy_ratio_cols"](spark, str(tmp_path)).collect()}
    assert set(found) == {0, 1, 2, 100_000}
    assert found[1] == found[100_000] == (1.0, 1.0, 0.0) and found[0][2] == 0.0
