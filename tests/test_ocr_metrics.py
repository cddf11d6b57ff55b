"""Error rates of characters and words over normal texts, against plain Python."""

import random

import duckdb
import numpy as np
import pytest

from lectern import adapters, registry
from lectern.plans import evaluation
from lectern.plans.alignment import item_edits


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def wanted(pairs):
    normal = [tuple(" ".join(x.split()).lower() for x in pair) for pair in pairs]
    rates = [[brute(a, b) / len(a) if a else float(bool(b)) for a, b in side] for side in (normal, [(a.split(), b.split()) for a, b in normal])]
    found = {f"{name}_{x}": f(r) for x, r in zip(("cer", "wer"), rates) for name, f in (("mean", np.mean), ("median", np.median), ("sd", np.std))}
    found |= {"samples": len(pairs), "exact_rate": np.mean([a == b for a, b in normal]), "mean_distance": np.mean([brute(a, b) for a, b in normal])}
    return found | {"chars": sum(len(a) for a, _ in pairs), "words": sum(len(a.split()) for a, _ in pairs)}


LINES = ["Oil  in\tthe  well", "", "  ", "i l i 1 o 0 l", "Oo oO o0 O0 0O", "no change here", "Café ÉTÉ oil", "o0 Oo x o0 00", "ten hills"]


def test_words_and_exact_matches(spark, tmp_path):
    spark.createDataFrame([(0, "\n".join(LINES), "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = [(x, x.translate(str.maketrans("oil", "011"))) for x in LINES]
    row = registry.queries()["ocr_metrics"](spark, str(tmp_path)).collect()[0].asDict()
    assert row == pytest.approx(wanted(pairs), abs=1e-6)
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = duck.execute(registry.oracles()["ocr_metrics"])
    names = [c[0] for c in found.description]
    assert dict(zip(names, found.fetchall()[0])) == pytest.approx(row, abs=1e-6)


def test_words_that_move(spark, monkeypatch):
    """Predictions of other lengths and orders; the SQL goes through its table of distances for these."""
    draw = random.Random(2)
    pairs = [(" ".join(draw.choices("ab cd ef g".split(), k=draw.randint(0, 6))), " ".join(draw.choices("ab cd ef G".split(), k=draw.randint(0, 6)))) for _ in range(80)]
    assert all(item_edits(a.split(), b.split()) == brute(a.split(), b.split()) for a, b in pairs)
    errors = evaluation.ocr_errors(spark.createDataFrame(pairs, "truth string, prediction string")).agg({"wer": "avg", "cer": "avg", "words": "sum"}).collect()[0]
    rows = wanted(pairs)
    assert errors["avg(wer)"] == pytest.approx(rows["mean_wer"]) and errors["avg(cer)"] == pytest.approx(rows["mean_cer"]) and errors["sum(words)"] == rows["words"]
    values = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(pairs))
    monkeypatch.setitem(adapters.VIEWS, "ocr_pairs", f"select * from (values {values}) v(sample_id, truth, prediction)")
    found = duckdb.connect().execute(adapters.with_views(["ocr_pairs"], evaluation._oracle([], evaluation._OCR_ORACLE)["oracle"]))
    names = [c[0] for c in found.description]
    assert dict(zip(names, found.fetchall()[0])) == pytest.approx(rows, abs=1e-6)
