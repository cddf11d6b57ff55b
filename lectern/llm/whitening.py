"""Whitening of embeddings: principal components by mixed-precision refinement.

1. Entries become whole numbers (floor of 256 times the value); equal vectors count once. Copies are merged before they
   are shuffled, so a vector that holds a third of all rows is one row a task.
2. Sums, then the covariance of centred entries, are added up in each task as matrix products, and by matrix entry over
   tasks; what reaches the driver is one matrix of dimension x dimension, whatever the number of rows.
3. Eigenvectors of the covariance are found in float32 and corrected by matrix products in higher precision
   (Ogita and Aishima 2018): residuals of orthogonality and diagonality give a correction whose error squares with each
   step. Eigenvalues too close for that are a cluster; its vectors are turned by the eigenvectors of the small
   matrix that the cluster's span makes (the 2019 sub-solve), then corrected on.
4. Every row is projected in its task; deviations are whole numbers throughout.

Defined results: a row whose vector is null, empty or holds null or non-finite entries is dropped, so is one with an entry
of `GREATEST` or more in magnitude (its whole number would not be exact) and one whose length is not the most frequent
(of equally frequent ones the greatest). Rows that share an id, or have none, are rows of their own; equal eigenvalues
keep the order of the solver; a component without variance has whitened 0 and does not count for identity_error; an
empty table gives no rows; extra columns are ignored. deviation is null if it passes 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import materialize

SCALE, COMPONENTS = 256, 4
#: Entries from here on are no exact whole numbers in double precision.
GREATEST = float(1 << 40)
#: Rows that a task multiplies at once.
BLOCK = 4096
#: Eigenvalues under this share of the greatest are rounding errors.
NOTHING = 1e-13


def whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): the rows that remain, with entries as whole numbers."""
    v = F.col(vec_col).cast("array<double>")
    usable = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < GREATEST) & ~F.isnan(c))
    rows = vectors.select(F.col(id_col).alias("_id"), v.alias("_v")).where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & usable)
    made = rows.select("_id", F.transform("_v", lambda c: F.floor(c * SCALE).cast("long") + F.lit(0).cast("long")).alias("x"))
    length = made.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return made.where(F.size("x") == (length["d"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if len(batch):
                s = _matrix(batch.column(0)).sum(axis=0)
                n, total = n + len(batch), s if total is None else total + s
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array(np.concatenate([[n], total]))], names=["i", "v"])

    rows = fit.mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
    values = rows["v"].to_numpy(dtype=np.int64)
    return (int(values[0]), values[1:]) if len(values) else (0, values)


def covariance(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance of the vectors (x) with divisor n; each entry is centred before it is multiplied."""
    mean = np.array([int(s) / n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                c = _matrix(batch.column(0).slice(at, BLOCK)) - mean
                total += c.T @ c
        i, j = np.triu_indices(len(mean))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    rows = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    v = np.zeros((len(mean), len(mean)))
    v[rows["i"], rows["j"]] = v[rows["j"], rows["i"]] = rows["v"] / n
    return v


def correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step: (eigenvalues, better eigenvectors, size of the correction) of symmetric a from vectors x (columns).

    r says how far x is from orthogonal and s how far from diagonal; both are taken in the precision of a. Pairs of
    eigenvalues closer than the threshold only have their orthogonality mended.
    """
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    norm = np.linalg.norm(a.astype(float))
    least = max(2 * (np.linalg.norm(off.astype(float)) + norm * np.linalg.norm(r.astype(float))), 4 * np.finfo(float).eps * norm)
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > least
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return values, x + x @ e, float(np.abs(e).max())


def clusters(values: np.ndarray, least: float) -> list[np.ndarray]:
    """Groups of two or more indices whose sorted eigenvalues lie within least of the next."""
    order = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.diff(values[order]) > least) + 1
    return [g for g in np.split(order, cut) if len(g) > 1]


def refined(a: np.ndarray, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of a symmetric matrix, to double precision.

    The start is float32. Corrections and the sub-solves of clusters run in double precision until a step changes next to
    nothing; two or three steps in extended precision then make the last digits of the doubles right.
    """
    scale = float(np.abs(a).max()) or 1.0
    a = (a / scale).astype(np.float64)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    close = 64 * np.finfo(np.float32).eps
    for step in range(steps):
        _, x, size = correct(a, x)
        if step and size < 1e-8:
            break
        s = x.T @ (a @ x)
        least = max(2 * float(np.linalg.norm(s - np.diag(np.diag(s)))), close * 2.0**-step)
        for group in clusters(np.diag(s), least):
            span = x[:, group]
            small = span.T @ (a @ span) - np.diag(s)[group].mean() * (span.T @ span)
            x[:, group] = span @ np.linalg.eigh((small + small.T) / 2)[1]
    a, x = a.astype(np.longdouble), x.astype(np.longdouble)
    for _ in range(4):
        values, x, size = correct(a, x)
        if size < 1e-10:  # its square is beyond the last digit
            break
    for _ in range(2):  # what rounding left between vectors of next to equal eigenvalues
        x = x + x @ (np.eye(len(a)) - x.T @ x) / 2
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float) * scale, x[:, order].astype(float)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums over dimensions of (n * x - sums) ** 2; None beyond 64 bits."""
    if not len(x):
        return []
    far = max(int(np.abs(x).max()), 1) * n + max(abs(int(s)) for s in sums)
    if far * far * x.shape[1] < 1 << 62:
        v = x * n - sums
        return (v * v).sum(axis=1).tolist()
    found = (sum((n * p - q) ** 2 for p, q in zip(row, sums.tolist(), strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in found]


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """(n, sums, shares, values, vectors, fit list) of rows with x: the leading components of the distinct vectors."""
    distinct = materialize(rows.select("x").distinct(), "vectors")
    n, sums = _sums(distinct)
    if not n:
        return 0, sums, np.zeros(0), np.zeros(0), np.zeros((0, 0)), distinct
    v = covariance(distinct, n, sums)
    values, vectors = refined(v)
    values, vectors = values[:components], vectors[:, :components]
    trace = float(np.trace(v))
    return n, sums, values / trace if trace else np.zeros(len(values)), values, vectors, distinct


def projected(rows: DataFrame, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """rows with deviation and whitened (an array over components) beside their other columns."""
    mean = np.array([int(s) / n for s in sums])
    varies = values > NOTHING * max(float(values.max()), 0.0)
    turn = np.where(varies, vectors / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column(names.index("x")))
                w = (x - mean) @ turn
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(deviations(x, n, sums), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=[*names, "deviation", "whitened"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, deviation long, whitened array<double>")


def identity_error(distinct: DataFrame, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> float:
    """Greatest entry of the whitened vectors' covariance minus the identity, measured over the fit list."""
    k = [i for i in range(len(values)) if values[i] > NOTHING * values.max()]
    if not k:
        return 0.0
    w = projected(distinct, n, sums, values, vectors).select(*[F.col("whitened")[i].alias(f"w{i}") for i in k])
    found = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"{i}_{j}") for i in k for j in k if i <= j]).first().asDict()
    return max(abs(v - (len(set(key.split("_"))) == 1)) for key, v in found.items())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    rows = whole(vectors, id_col, vec_col)
    n, sums, shares, values, turn, distinct = fit(rows, components)
    kind = rows.schema["_id"].dataType.simpleString()
    if not n:
        return vectors.sparkSession.createDataFrame(pd.DataFrame(columns=range(7)), f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(distinct, n, sums, values, turn)
    made = projected(rows, n, sums, values, turn).select("_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*[F.lit(float(s)) for s in shares])
    return made.select(F.col("_id").alias(id_col), (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"))
