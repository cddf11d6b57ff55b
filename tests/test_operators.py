"""Hand-computed cases of operators that SQL does not express."""

import pytest

from lectern.plans import retrieval, text, vision


def test_suppression_keeps_two_of_three(spark):
    rows = [(1, 0, 0.95, 50.0, 100.0, 90.0, 400.0), (1, 1, 0.90, 200.0, 100.0, 240.0, 400.0), (1, 2, 0.80, 55.0, 105.0, 95.0, 405.0)]
    frame = spark.createDataFrame(rows, "image_id long, box_no long, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.confidence for r in vision.nms(frame).collect()) == [0.90, 0.95]


def overlap(a, b):
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def area(a):
    return (a[2] - a[0]) * (a[3] - a[1])


def slow_iou(a, b):
    return overlap(a, b) / (area(a) + area(b) - overlap(a, b))


@pytest.fixture(scope="module")
def box_rows():
    import random

    pick = random.Random(4)
    rows = []
    for image in range(40):
        for no in range(pick.randint(1, 8)):
            x, y, w, h = pick.randint(0, 60), pick.randint(0, 60), pick.randint(20, 60), pick.randint(20, 60)
            dx, dy = pick.randint(-8, 8), pick.randint(-8, 8)
            rows.append((image, no, pick.choice("AB"), pick.randint(1, 20) / 20, *map(float, (x, y, x + w, y + h, x + dx, y + dy, x + w + dx, y + h + dy))))
    return rows


BOX = "image_id long, box_no long, class_name string, confidence double, gx1 double, gy1 double, gx2 double, gy2 double, px1 double, py1 double, px2 double, py2 double"


def slow_matches(rows, threshold):
    out = {}
    for image in {r[0] for r in rows}:
        mine, taken = [r for r in rows if r[0] == image], set()
        for r in sorted(mine, key=lambda r: (-r[3], r[1])):
            free = [(-slow_iou(r[8:], t[4:8]), t[1]) for t in mine if t[2] == r[2] and t[1] not in taken and overlap(r[8:], t[4:8]) > 0]
            best = min(free) if free else (0.0, None)
            out[image, r[1]] = (bool(free) and -best[0] >= threshold, -best[0])
            if out[image, r[1]][0]:
                taken.add(best[1])
    return out


def test_matches_and_precision_like_plain_python(spark, box_rows):
    frame = spark.createDataFrame(box_rows, BOX)
    found = {(r.image_id, r.box_no, r.threshold): r for r in vision.match_detections(frame, [0.5, 0.7]).collect()}
    for threshold in (0.5, 0.7):
        wanted = slow_matches(box_rows, threshold)
        assert len(wanted) == len(box_rows)
        for (image, no), (hit, best) in wanted.items():
            r = found[image, no, threshold]
            assert r.matched == hit and r.iou == pytest.approx(best)
    hits = slow_matches(box_rows, 0.5)
    for row in vision.average_precision(vision.match_detections(frame), ["class_name"]).collect():
        mine = [r for r in box_rows if r[2] == row.class_name]
        curve = []
        for c in {r[3] for r in mine}:
            above = [r for r in mine if r[3] >= c]
            tp = sum(hits[r[0], r[1]][0] for r in above)
            curve.append((tp / len(mine), tp / len(above)))
        levels = [max([p for recall, p in curve if recall >= k / 100 - 1e-9], default=0) for k in range(101)]
        assert row.ap == pytest.approx(sum(levels) / 101, abs=1e-6)


def test_suppression_like_plain_python(spark, box_rows):
    boxes = [(r[0], r[1], r[3], *r[4:8]) for r in box_rows]
    wanted = set()
    for image in {b[0] for b in boxes}:
        kept = []
        for b in sorted([b for b in boxes if b[0] == image], key=lambda b: (-b[2], b[1])):
            if not any(slow_iou(b[3:], k[3:]) > 0.5 or overlap(b[3:], k[3:]) > 0.8 * min(area(b[3:]), area(k[3:])) for k in kept):
                kept.append(b)
        wanted |= {b[:2] for b in kept}
    frame = spark.createDataFrame(boxes, "image_id long, box_no long, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert {(r.image_id, r.box_no) for r in vision.nms(frame).collect()} == wanted


def test_counts_of_all_classes_add_up(spark, box_rows):
    rows = {r.class_name: r for r in vision.detection_prf(spark.createDataFrame(box_rows, BOX)).collect()}
    assert set(rows) == {"A", "B", None}
    for r in rows.values():
        assert r.tp + r.fp == r.tp + r.fn and r.f1 == pytest.approx(2 * r.precision * r.recall / (r.precision + r.recall))
    assert rows[None].tp == rows["A"].tp + rows["B"].tp


def test_search_in_blocks_is_exact(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "VECTORS", 30)
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    m = np.random.default_rng(2).normal(size=(100, 5))
    frame = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(100, None)], "vec_id long, embedding array<double>")
    rows = retrieval.knn(frame.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), frame, 4).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 100, 10):
        best = np.argsort(-(unit @ unit[q]), kind="stable")[:4].tolist()
        assert [r.vec_id for r in sorted(rows, key=lambda r: r.place) if r.query_id == q] == best


def test_bucket_decisions_like_plain_python(spark):
    from lectern import registry

    place = "/root/testdata/sf0.001"
    wanted, last, tokens = {}, {}, {}
    for r in sorted(spark.read.parquet(f"{place}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        at = r.ts.timestamp()
        left = min(3.0, tokens.get(r.user_id, 3.0) + (at - last.get(r.user_id, at)) * 0.02 / 60)
        wanted[r.event_id] = left >= 1
        tokens[r.user_id], last[r.user_id] = left - wanted[r.event_id], at
    found = {r.event_id: r.allowed for r in registry.queries()["stream_token_bucket"](spark, place).collect()}
    assert found == wanted


def test_isbn_is_found_and_checked(spark):
    frame = spark.createDataFrame([("x 978-0-306-40615-7 y",), ("ISBN 0306406152",), ("0306406153",)], "t string")
    assert [r[0] for r in frame.select(text.extract_isbn(frame.t)).collect()] == ["9780306406157", "0306406152", None]


def test_similarity_and_word_errors(spark):
    frame = spark.createDataFrame([("abcd", "abcd", 1.0), ("abcd", "bcde", 0.75), ("", "", 1.0)], "a string, b string, want double")
    for row in frame.select(text.sequence_ratio("a", "b").alias("got"), "want").collect():
        assert row.got == pytest.approx(row.want)
    words = spark.createDataFrame([("a b c", "a x c d", 2 / 3), ("", "a", 1.0), ("", "", 0.0)], "a string, b string, want double")
    for row in words.select(text.word_error_rate("a", "b").alias("got"), "want").collect():
        assert row.got == pytest.approx(row.want)


def test_mmr_starts_with_the_best(spark):
    rows = [(1, 10, 0.9, [1.0, 0.0]), (1, 11, 0.89, [1.0, 0.0]), (1, 12, 0.8, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "query_id long, vec_id long, score double, embedding array<double>")
    assert [r.vec_id for r in retrieval.mmr(frame, 2).orderBy("place").collect()] == [10, 12]


@pytest.mark.parametrize("name", ["knn_lsh", "knn_ivf"])
def test_registered_approximate_search_recalls_nine_tenths(spark, name):
    from lectern import registry

    place = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{place}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in retrieval.knn(asked, vectors).collect()}
    near = {(r.query_id, r.vec_id) for r in registry.queries()[name](spark, place).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_images_are_matched_as_whole_batches(spark):
    """No pairs of boxes are shuffled, and nulls and repeated boxes keep their rows."""
    rows = [(1, 1, "a", 0.9, 0.0, 0.0, 10.0, 10.0, 1.0, 0.0, 11.0, 10.0)] * 2 + [(1, 2, None, None, 0.0, 0.0, 10.0, 10.0, 0.0, 0.0, 10.0, 10.0), (None, 1, "a", 0.5, 0.0, 0.0, 10.0, 10.0, 0.0, 0.0, 10.0, 10.0)]
    frame = spark.createDataFrame(rows, "image_id long, box_no long, class_name string, confidence double, " + ", ".join(f"{k}{c} double" for k in "gp" for c in ("x1", "y1", "x2", "y2")))
    made = vision.match_detections(frame)
    assert sorted((r.box_no, r.class_name or "", r.matched, round(r.iou, 6)) for r in made.collect()) == [(1, "a", False, 0.0), (1, "a", True, 0.818182), (1, "a", True, 0.818182), (2, "", False, 0.0)]
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert vision.match_detections(frame.limit(0)).count() == 0
