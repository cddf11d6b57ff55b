"""Exact percentiles of groups of any size: no task ever holds all values of a large group.

A group of more than `ROOM` values is narrowed down: a sketch of fixed size gives `GRID` edges that are known to hold the
wanted ranks between two of them, the values between those are counted by value, and what is left is cut by edges again until
it fits; the last values are ranked by running counts. Edges are broadcast, a few hundred numbers for each `ROOM` values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import written

ROOM = 1_000_000
#: Edges of a cut, and the accuracy of the sketch behind them: a rank is off by 1 / ACCURACY, far less than a cell.
GRID, ACCURACY = 256, 10_000


def _edges(value: str) -> Column:
    return F.percentile_approx(value, [j / GRID for j in range(GRID + 1)], ACCURACY)


def _cell(k: Column, n: Column, step: int) -> Column:
    """Number of the edge one cell before (or after) a rank."""
    at = GRID * k / F.greatest(n - 1, F.lit(1))
    return F.greatest(F.lit(0), F.floor(at) - 1).cast("int") if step < 0 else F.least(F.lit(GRID), F.ceil(at) + 1).cast("int")


def _cut(values: DataFrame, marks: DataFrame, room: int) -> DataFrame:
    """(g, i, low, high): the least and greatest value between which ranks k and k + 1 lie; values is (g, i, v, c)."""
    edges = values.groupBy("g", "i").agg(_edges("v").alias("edges"), F.count("*").alias("n"))
    cells = values.join(F.broadcast(edges), ["g", "i"]).withColumn("cell", F.size(F.filter("edges", lambda e: e < F.col("v"))))
    counts = cells.groupBy("g", "i", "cell").agg(F.sum("c").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
    up = Window.partitionBy("g", "i").orderBy("cell")  # a few hundred cells
    ranked = counts.withColumn("to", F.sum("c").over(up)).join(F.broadcast(marks), ["g", "i"])
    here = ranked.where((F.col("to") > F.floor("k")) & (F.col("to") - F.col("c") <= F.ceil("k")))
    return here.groupBy("g", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.col("to") - F.col("c")).alias("below"))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], room: int = ROOM) -> DataFrame:
    """keys and p, an array: linearly interpolated percentiles of each group, as percentile() gives them; null values are left out."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_"))
    rows = df.select(group.alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    sizes = written(rows.groupBy("g").agg(F.count("*").alias("n"), _edges("v").alias("edges")), "sizes")
    large = sizes.where(F.col("n") > room)
    small = rows.join(F.broadcast(large.select("g")), "g", "left_anti").groupBy("g").agg(F.percentile("v", shares).alias("p"))  # a row for each `room` rows
    out = small
    if not large.isEmpty():
        wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("share")) for i, p in enumerate(shares)])
        marks = large.select("g", "n", "edges", F.explode(wanted).alias("w")).select("g", "n", "edges", "w.i", (F.col("w.share") * (F.col("n") - 1)).alias("k"))
        marks = written(marks.select("g", "i", "k", F.get("edges", _cell(F.col("k"), F.col("n"), -1)).alias("low"), F.get("edges", _cell(F.col("k") + 1, F.col("n"), 1)).alias("high")), "marks")
        met = rows.join(F.broadcast(marks), "g")
        below = met.groupBy("g", "i").agg(F.count_if(F.col("v") < F.col("low")).alias("below"))
        values = written(met.where("v between low and high").groupBy("g", "i", "v").agg(F.count("*").alias("c")), "values")
        marks = written(marks.join(below, ["g", "i"]).select("g", "i", (F.col("k") - F.col("below")).alias("k")), "marks")
        most = None
        while (n := values.groupBy("g", "i").count().agg(F.max("count")).first()[0]) > room and n != most:
            most = n
            cut = written(_cut(values, marks, room), "cut")
            values = written(values.join(F.broadcast(cut), ["g", "i"]).where("v between low and high").select("g", "i", "v", "c"), "values")
            marks = written(marks.join(cut, ["g", "i"]).select("g", "i", (F.col("k") - F.col("below")).alias("k")), "marks")
        up = Window.partitionBy("g", "i").orderBy("v")
        ranked = values.withColumn("to", F.sum("c").over(up)).join(F.broadcast(marks), ["g", "i"])
        found = ranked.groupBy("g", "i").agg(F.min("k").alias("k"), F.min(F.when(F.col("to") > F.floor("k"), F.col("v"))).alias("low"), F.min(F.when(F.col("to") > F.ceil("k"), F.col("v"))).alias("high"))
        share = F.col("k") - F.floor("k")
        exact = found.select("g", "i", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - share) * F.col("low") + share * F.col("high")).alias("v"))
        listed = exact.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("p"))
        out = small.union(listed)
    return out.select(*[F.col("g").getField(k).alias(k) for k in keys], "p")
