"""Scanned text against hand-worked cases and a plain-Python twin."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.plans import scanned
from lectern.plans.text import expanded_query, intent

CASES = ["The Great Gatsby^&*", "a vv big wave", "F. SC0TT", "THE B0OK", "The\n Great\t Gatsby", "Les Misérables", "the great gatsby", "rn 2nd ed. V01. 3", "well - known", "ﬁne print", "PENGU1N RAND0M H0USE", "", None, "il se1l"]


def slow_normalized(text):
    t = "".join(c for c in unicodedata.normalize("NFKC", text or "") if unicodedata.category(c) != "Mn")
    t = "".join(c if re.match(r"""[a-zA-Z0-9 .,;:!?'"()\[\]&-]""", c) else " " for c in t)
    changed = 0
    for pattern, new in scanned.CORRECTIONS:
        after = re.sub(pattern, new.replace("$1", r"\g<1>"), t, flags=re.IGNORECASE)
        changed += after != t
        t = after
    return re.sub(r"\s*-\s*", "-", re.sub(r"\s+", " ", t)).strip(), changed


def test_normalized_like_plain_python(spark):
    frame = spark.createDataFrame(list(enumerate(CASES)), "k int, t string")
    rows = {r.k: r for r in scanned.normalized(frame, "t").collect()}
    for k, text in enumerate(CASES):
        assert (rows[k].normalized, rows[k].corrections) == slow_normalized(text)
        assert rows[k].adjustment == pytest.approx(max(-0.3, -0.02 * rows[k].corrections))
    assert "a w big wave" in rows[1].normalized and "SCOTT" in rows[2].normalized and "BOOK" in rows[3].normalized and rows[4].normalized == "The Great Gatsby"
    titles = {r.k: r.normalized for r in scanned.normalized(frame, "t", title=True, least=2).collect()}
    assert titles[6] == "The Great Gatsby" and titles[1] == "Big Wave"


def test_confidence_orders_readings(spark):
    texts = ["The Great Gatsby", "AB", "ThGxrzPlmknnq", "Xqz Plmk Rtyu", "", "   ", None, "1234567890123", "A Novel by Penguin 9780306406157", "aaaaaaa"]
    rows = scanned.scored(spark.createDataFrame([(k, t, 0.9) for k, t in enumerate(texts)], "k int, t string, c double"), "t", "c").collect()
    by = {r.k: r for r in rows}
    assert "very_short" in by[1].flags and by[1].final_confidence < by[0].final_confidence
    assert by[2].final_confidence < by[0].final_confidence and by[3].language_score < by[0].language_score
    assert all(by[k].flags == ["empty_text"] and by[k].final_confidence == 0 for k in (4, 5, 6))
    assert {"numeric_only", "no_letters", "suspicious_pattern"} <= set(by[7].flags) and by[7].language_score == pytest.approx(0.3)
    assert {"isbn_present", "publisher_name"} <= set(by[8].flags) and "suspicious_pattern" in by[9].flags
    low = "thegreatgatsby"
    fit = sum(max(0, 1 - 5 * abs(low.count(c) / len(low) - share)) for c, share in scanned.LETTERS.items()) / 26
    assert by[0].language_score == pytest.approx(fit)
    assert by[0].final_confidence == pytest.approx(0.35 * 0.9 + 0.25 * 1 + 0.25 * fit + 0.15 * 0.7)


def test_queries_are_widened_and_sorted_by_intent(spark):
    cases = [
        ("A mystery about fog", "A mystery about fog detective crime thriller", "default"), ("Books like this", "Books like this similar to", "recommendation"),
        ("books like, written by, about", "books like, written by, about similar to author on the topic of", "default"), ("plain words", "plain words", "default"), ("How many?", "How many?", "analysis"),
    ]
    frame = spark.createDataFrame([(q,) for q, _, _ in cases], "q string")
    found = [tuple(r) for r in frame.selectExpr("q", f"{expanded_query('q')} as e", f"{intent('q')} as i").collect()]
    assert found == cases


def test_author_names(spark):
    import re

    from pyspark.sql import functions as F

    from lectern.plans.scanned import author_name

    def plain(name):
        if "," in name:
            parts = [p.strip() for p in name.split(",", 1)]
            name = f"{parts[1]} {parts[0]}"
        name = name.title()
        for pattern, new in [(r"\bJr\b", "Jr."), (r"\bSr\b", "Sr."), (r"\bDr\b", "Dr."), (r"\bMc ([A-Z])", r"Mc\1"), (r"\bO ([A-Z])", r"O'\1")]:
            name = re.sub(pattern, new, name)
        return name.strip()

    names = ["SMITH, JOHN", "ann brown jr", "mc donald, ronald", "o brien", "o'neill, EUGENE, sr", "dr. seuss", "émile zola", "j.r.r. tolkien", "", ",", "3rd man", "a-b c"]
    made = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", author_name(F.col("n")).alias("a")).orderBy("k").collect()
    assert [r.a for r in made] == [plain(n) for n in names]


def test_titles_of_long_lines_take_linear_time(spark):
    """The words of the whole line were split anew for each word."""
    import time

    rows = spark.createDataFrame([(" ".join(["of", "Mice", "and", "men"] * 15_000),)], "t string")
    began = time.time()
    made = rows.select(scanned.title_case(F.col("t"))).first()[0]
    assert made.split()[:5] == ["Of", "Mice", "and", "Men", "of"] and made.endswith(" Men") and time.time() - began < 30


def test_counts_are_worked_out_once(spark):
    """Each score and flag that used the number of letters listed all letters of the text anew."""
    plan = scanned.scored(spark.createDataFrame([("The Hobbit", 0.5)], "t string, c double"), "t", "c")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
