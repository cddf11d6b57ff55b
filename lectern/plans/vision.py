"""Box tables: filters, overlap joins, suppression and detection metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import adapters
from lectern.registry import register, register_dialects, register_sql

IOU = """(greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"""

register_sql(
    "spine_box_filter", ["boxes"],
    """select image_id, box_no, confidence, row_number() over (partition by image_id order by gx1, box_no, class_name, gx2, px1, py1, confidence) as position from boxes
       where (gy2 - gy1) / (gx2 - gx1) between 0.1 and 20 and (gx2 - gx1) * (gy2 - gy1) >= 0.001 * 1000 * 1000""",
)
register_sql(
    "cover_box_filter", ["boxes"],
    """with shaped as (select *, greatest((gy2 - gy1) / (gx2 - gx1), (gx2 - gx1) / (gy2 - gy1)) as ratio, (gx2 - gx1) * (gy2 - gy1) / 1000000.0 as share from boxes)
       select image_id, box_no, round(ratio, 6) as ratio, round(0.5 * confidence + 0.5 * (1 - least(1.0, abs(ratio - 1.5) / 1.5)), 6) as likeness,
              row_number() over (partition by image_id order by round(0.5 * confidence + 0.5 * (1 - least(1.0, abs(ratio - 1.5) / 1.5)), 6) desc, box_no, gx2, px1, py1, class_name) as place
       from shaped where ratio between 0.5 and 8 and share between 0.005 and 0.9""",
)
register_sql("confidence_filter", ["boxes"], "select image_id, box_no, class_name, confidence from boxes where confidence >= 0.97")
register_dialects(
    "ocr_tokens_combine", ["boxes"],
    """select image_id, round(avg(confidence), 6) as confidence, $JOINED as text, min(gx1) as x1, max(gx2) as x2, min(gy1) as y1, max(gy2) as y2
       from boxes where confidence >= 0.95 group by image_id""",
    JOINED=("array_join(transform(sort_array(collect_list(struct(box_no, class_name))), t -> t.class_name), ' ')", "string_agg(class_name, ' ' order by box_no, class_name)"),
)
register_sql(
    "normalize_bbox_crop", ["boxes"],
    """select image_id, box_no, round(gx1 / 1000, 6) as nx1, round(gy1 / 1000, 6) as ny1, round(gx2 / 1000, 6) as nx2, round(gy2 / 1000, 6) as ny2,
              greatest(0.0, gx1 - 10) as cx1, greatest(0.0, gy1 - 10) as cy1, least(1000.0, gx2 + 10) as cx2, least(1000.0, gy2 + 10) as cy2
       from boxes where least(1000.0, gx2 + 10) - greatest(0.0, gx1 - 10) >= 40 and least(1000.0, gy2 + 10) - greatest(0.0, gy1 - 10) >= 40""",
)
register_sql("auto_add_split", ["boxes"], "select case when confidence >= 0.96 then 'auto_add' else 'review' end as decision, class_name, count(*) as boxes from boxes group by 1, 2")
register_sql(
    "box_overlap_join", ["boxes"],
    """with pairs as (
         select g.image_id, g.box_no as truth_no, p.box_no as predicted_no, g.class_name,
                greatest(0.0, least(g.gx2, p.px2) - greatest(g.gx1, p.px1)) * greatest(0.0, least(g.gy2, p.py2) - greatest(g.gy1, p.py1)) as shared,
                (g.gx2 - g.gx1) * (g.gy2 - g.gy1) as ga, (p.px2 - p.px1) * (p.py2 - p.py1) as pa
         from boxes g join boxes p on p.image_id = g.image_id and p.class_name = g.class_name and p.px1 < g.gx2 and g.gx1 < p.px2 and p.py1 < g.gy2 and g.gy1 < p.py2)
       select image_id, truth_no, predicted_no, class_name, round(shared / (ga + pa - shared), 6) as iou from pairs""",
)
register_sql(
    "best_ocr_attempt", ["boxes"],
    """with attempts as (select image_id, box_no as attempt, max(confidence) as confidence, max(class_name) as text from boxes group by image_id, box_no),
            stops as (select *, min(case when confidence > 0.98 then attempt end) over (partition by image_id) as stop from attempts),
            seen as (select *, row_number() over (partition by image_id order by confidence desc, attempt) as place from stops where stop is null or attempt <= stop)
       select image_id, attempt, confidence, text, confidence <= 0.93 as use_second_engine from seen where place = 1""",
)


# -- greedy steps: boxes of an image in one sorted array


def _shared(a: Column, b: Column) -> Column:
    def side(low: str, high: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))

    return side("x1", "x2") * side("y1", "y2")


def _area(a: Column) -> Column:
    return (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])


def iou(a: Column, b: Column) -> Column:
    """Overlap over union of two boxes (x1, y1, x2, y2); 0 where the union is empty."""
    shared = _shared(a, b)
    union = _area(a) + _area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def nms(boxes: DataFrame, most: float = 0.5, inside: float = 0.8) -> DataFrame:
    """Greedy suppression per image: by confidence, a box goes if it overlaps a kept one by iou, or by inside of the smaller."""
    order = [(-F.col("confidence")).alias("_down"), F.col("box_no").alias("_no"), F.col("x1").alias("_x"), F.col("y1").alias("_y")]
    box = F.struct(*order, *[F.col(c) for c in boxes.columns])
    rows = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(box)).alias("all"))
    kind = rows.schema["all"].dataType.simpleString()

    def step(kept: Column, b: Column) -> Column:
        beaten = F.exists(kept, lambda k: (iou(b, k) > most) | (_shared(b, k) > inside * F.least(_area(b), _area(k))))
        return F.when(beaten, kept).otherwise(F.concat(kept, F.array(b)))

    kept = F.aggregate("all", F.expr(f"cast(array() as {kind})"), step)
    return rows.select(F.explode(kept).alias("b")).select(*[F.col(f"b.{c}").alias(c) for c in boxes.columns])


#: What is known of a box inside its image, in the order in which boxes are numbered.
_BOX = ["box_no", "class_name", "confidence", *[f"{k}{c}" for k in "pg" for c in ("x1", "y1", "x2", "y2")]]


def _fold(images: pa.Array, boxes: pa.ListArray, steps: list[float], first_fit: bool, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, matched, iou) of all predictions of whole images: matched and iou have a column for each threshold.

    All images take a step at once: the first prediction of each, then the second, and so on. A step holds the boxes of an
    image once, so memory grows with the boxes, not with their pairs.
    """
    flat = boxes.flatten()

    def number(name: str, missing: float = np.nan) -> np.ndarray:
        return flat.field(name).cast(pa.float64()).fill_null(missing).to_numpy(zero_copy_only=False)

    sizes = boxes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    total, known = len(flat), flat.field("confidence").is_valid().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    names = flat.field("class_name").to_pylist()
    code = {c: k for k, c in enumerate(sorted({c for c in names if c is not None}))}
    kind = np.array([code.get(c, -1) for c in names], dtype=np.int64)
    p, g = ([number(f"{k}{c}") for c in ("x1", "y1", "x2", "y2")] for k in "pg")
    areas = [(b[2] - b[0]) * (b[3] - b[1]) for b in (p, g)]
    down = np.where(known, -number("confidence", 0.0), -np.inf)
    # by falling confidence, then number, place and class; nulls first; at the end the order of the image
    order = np.lexsort((kind, number("py1", -np.inf), number("px1", -np.inf), number("box_no", -np.inf), down, known, owner))
    # an image whose key is null meets nothing
    keyed = images.is_valid().to_numpy(zero_copy_only=False)
    taken = np.zeros((len(steps), total), dtype=bool)
    matched, best = np.zeros((total, len(steps)), dtype=bool), np.zeros((total, len(steps)))
    for step in range(int(sizes.max(initial=0))):
        live = np.flatnonzero((sizes > step) & keyed)
        if not len(live):
            break
        n = sizes[live]
        first = np.cumsum(n) - n
        truth = np.arange(n.sum()) + np.repeat(starts[live] - first, n)  # the boxes of all live images
        asked = order[starts[live] + step]
        row = np.repeat(asked, n)
        meet = (p[0][row] < g[2][truth]) & (g[0][truth] < p[2][row]) & (p[1][row] < g[3][truth]) & (g[1][truth] < p[3][row])
        if not first_fit:
            meet &= (kind[row] == kind[truth]) & (kind[row] >= 0)
        row, truth = row[meet], truth[meet]
        if not len(row):
            continue
        shared = np.maximum(0.0, np.minimum(p[2][row], g[2][truth]) - np.maximum(p[0][row], g[0][truth])) * np.maximum(0.0, np.minimum(p[3][row], g[3][truth]) - np.maximum(p[1][row], g[1][truth]))
        union = areas[0][row] + areas[1][truth] - shared
        iou = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
        # candidates of a prediction in the order of choice: the largest overlap, then the least number; or by number
        choice = np.lexsort((truth, owner[row]) if first_fit else (truth, -iou, owner[row]))
        row, truth, iou = row[choice], truth[choice], iou[choice]
        for t, least in enumerate(steps):
            enough = iou > least if strict else iou >= least
            free = np.flatnonzero(~taken[t, truth] & enough if first_fit else ~taken[t, truth])
            who, at = np.unique(row[free], return_index=True)
            got = free[at]
            best[who, t] = iou[got]
            matched[who, t] = enough[got]
            taken[t, truth[got[enough[got]]]] = True
    return order, matched, best


def matches(boxes: DataFrame, thresholds: list[float], first_fit: bool = False, strict: bool = False) -> DataFrame:
    """(image_id, box_no, class_name, confidence, matched, ious): lists with an entry for each threshold.

    The boxes of an image come together in one shuffle; numpy matches all images of a batch at once.
    """
    types = dict(boxes.dtypes)
    images = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*_BOX))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, every = batch.columns
            if not len(key):
                continue
            order, matched, best = _fold(key, every, thresholds, first_fit, strict)
            flat, owner = every.flatten().take(pa.array(order)), np.repeat(np.arange(len(key)), every.value_lengths().to_numpy(zero_copy_only=False))
            ends = pa.array(np.arange(len(order) + 1) * len(thresholds), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].ravel())) for x in (matched, best)]
            yield pa.RecordBatch.from_arrays([key.take(pa.array(owner[order])), *[flat.field(c) for c in ("box_no", "class_name", "confidence")], *lists], names=["image_id", "box_no", "class_name", "confidence", "matched", "ious"])

    columns = ", ".join(f"{c} {types[c]}" for c in ("image_id", "box_no", "class_name", "confidence"))
    return images.mapInArrow(run, f"{columns}, matched array<boolean>, ious array<double>")


def match_detections(boxes: DataFrame, thresholds: list[float] | None = None, first_fit: bool = False, strict: bool = False) -> DataFrame:
    """Greedy matching per image and threshold: predictions by confidence take the best free truth box of their class.

    first_fit takes the first free box (by number) that reaches the threshold instead, whatever its class; strict asks
    for more than the threshold. All thresholds are worked out in one pass.
    """
    steps = thresholds or [0.5]
    found = matches(boxes, steps, first_fit, strict)
    columns = ["image_id", "box_no", "class_name", "confidence", "matched", "iou"]
    each = found.select(*columns[:4], F.inline(F.arrays_zip("matched", F.col("ious").alias("iou"), F.lit(steps).alias("threshold"))))
    return each.select(*columns, "threshold") if thresholds else each.select(*columns)


def average_precision(matches: DataFrame, by: list[str], points: int = 101, times: Column | None = None) -> DataFrame:
    """(by, ap): best precision at each recall level, averaged. One truth box stands behind each row, or as many as times says.

    Rows are first counted by confidence, so that only distinct confidences are put in order; rows of one confidence
    enter the curve together.
    """
    order = Window.partitionBy(*by).orderBy(F.col("confidence").desc()).rowsBetween(Window.unboundedPreceding, 0)
    times = F.lit(1) if times is None else times
    counted = matches.groupBy(*by, "confidence").agg(F.sum(F.when(F.col("matched"), times).otherwise(0)).alias("hits"), F.sum(times).alias("rows"))
    curve = counted.withColumns({"tp": F.sum("hits").over(order), "n": F.sum("rows").over(order), "truths": F.sum("rows").over(Window.partitionBy(*by))})
    curve = curve.select(*by, (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("truths")).alias("recall"))
    levels = curve.select(*by, "precision", F.floor(F.col("recall") * (points - 1) + 1e-9).cast("int").alias("step")).groupBy(*by, "step").agg(F.max("precision").alias("best"))
    above = Window.partitionBy(*by).orderBy(F.col("step").desc())
    steps = levels.withColumn("best", F.max("best").over(above)).withColumn("below", F.coalesce(F.lead("step").over(above), F.lit(-1)))
    return steps.groupBy(*by).agg(F.round(F.sum(F.col("best") * (F.col("step") - F.col("below"))) / points, 8).alias("ap"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.view(spark, sf_dir, "boxes").withColumn("image_id", F.col("image_id").cast("long")).withColumn("box_no", F.col("box_no").cast("long"))


def _two_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    sides = [rows.select("image_id", "box_no", F.lit(s).alias("detector"), (F.col("confidence") - d).alias("confidence"), *[F.col(f"{s}{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]) for s, d in (("g", 0.0), ("p", 0.01))]
    return sides[0].union(sides[1])


def map_thresholds(boxes: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, map) for each threshold, and one row without threshold: their mean."""
    # equal predictions are counted before they become a row for each threshold
    same = matches(boxes, thresholds).groupBy("class_name", "confidence", "matched").agg(F.count("*").alias("times"))
    rows = same.select("class_name", "confidence", "times", F.inline(F.arrays_zip("matched", F.lit(thresholds).alias("threshold"))))
    each = average_precision(rows, ["threshold", "class_name"], times=F.col("times")).groupBy("threshold").agg(F.avg("ap").alias("map"))
    return each.groupingSets([["threshold"], []], "threshold").agg(F.round(F.avg("map"), 8).alias("map"))


def detection_prf(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall and F1 per class and over all (class null); first fit, whatever the class."""
    found = match_detections(boxes, first_fit=True)
    counts = found.groupingSets([["class_name"], []], "class_name").agg(F.count_if("matched").alias("tp"), F.count_if(~F.col("matched")).alias("fp"), F.count("*").alias("truths"))
    counts = counts.withColumn("fn", F.col("truths") - F.col("tp"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("truths"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return counts.select("class_name", "tp", "fp", "fn", F.round(precision, 8).alias("precision"), F.round(recall, 8).alias("recall"), F.round(f1, 8).alias("f1"))


register("nms_dedup", lambda s, d: nms(_two_detectors(s, d)))
register("detection_match", lambda s, d: match_detections(_boxes(s, d)))
register("pr_curve_ap", lambda s, d: average_precision(match_detections(_boxes(s, d)), ["class_name"]).withColumn("variant", F.lit("101 points")).union(average_precision(match_detections(_boxes(s, d), strict=True), ["class_name"], 11).withColumn("variant", F.lit("11 points"))))
register("map_thresholds", lambda s, d: map_thresholds(_boxes(s, d), [(50 + 5 * k) / 100 for k in range(10)]))
register("detection_prf", lambda s, d: detection_prf(_boxes(s, d)))
