"""Helpers of the training-data operators: shared storage, table access, word and shingle kernels."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words, as a regular expression and as bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"

#: Bytes of text that a kernel holds in its arrays at once (one longer document makes a chunk of its own).
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the configured one, else (tests, local mode) the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    path = f"{checkpoint_dir(df.sparkSession)}/lectern-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a table that materialize() wrote and that nothing will read again."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def hash_sample(rows: DataFrame, key: Column, size: int) -> DataFrame:
    """size rows at most, those with the least hash of key; few more than that leave the tasks."""
    share = min(1.0, (1.2 * size + 1000) / max(1, rows.count()))
    low = F.col("_hash") < int(share * (1 << 62))
    return rows.withColumn("_hash", F.pmod(F.xxhash64(key), F.lit(1 << 62))).where(low).orderBy("_hash", *rows.columns).limit(size).drop("_hash")


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files of tables that nothing refers to any more."""
    spark._jvm.System.gc()


#: Bits of a filter that is sent to every task.
FILTER_BITS = 1 << 22


def bit_filter(values: DataFrame, tested: Column) -> Column:
    """A test that all of values (h) pass and few others: FILTER_BITS bits, whatever the number of values."""
    words = values.select(F.pmod("h", F.lit(FILTER_BITS)).alias("bit")).select((F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits"))
    dense = values.sparkSession.range(FILTER_BITS // 64).join(words.groupBy("word").agg(F.bit_or("bits").alias("bits")), F.col("id") == F.col("word"), "left")
    bits = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"])).scalar()
    bit = F.pmod(tested, F.lit(FILTER_BITS))
    return F.getbit(F.get(bits, (bit / 64).cast("int")), (bit % 64).cast("int")) == 1


#: A key that holds one in so many rows is hot; there are at most so many.
HOT_KEYS = 500


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """left joined with right by key, without hot keys meeting in one task.

    right has one row a key, and in weight the number of rows of left with that key (total in all). Hot keys, HOT_KEYS
    at most, are sent to every task, so their rows stay where they are; the others are joined by hash.
    """
    hot = [r[0] for r in right.where(F.col(weight) >= max(16, total / HOT_KEYS)).select(key).collect()]
    right = right.drop(weight)
    if not hot:
        return left.join(right, key)
    here = F.col(key).isin(hot)
    rest = left.where(~here).join(right.where(~here), key)
    return left.where(here).join(F.broadcast(right.where(here)), key).select(*rest.columns).union(rest)


# -- words and shingles over Arrow batches ---------------------------------------------------------------------------

_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(ids: pa.Array, texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of some documents at a time; a null text counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset or not len(texts):
        texts = pa.concat_arrays([texts.slice(0, 0), texts])
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    ids, at = ids.to_numpy(zero_copy_only=False), 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield ids[at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def text_chunks(keys: pa.Array, texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """chunks(), with the keys as they are (of any type, null or not)."""
    at = 0
    for _, data, offsets in chunks(pa.array(np.zeros(len(keys), dtype=np.int8)), texts, size):
        n = len(offsets) - 1
        yield keys.slice(at, n), data, offsets
        at += n


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    inside = (data != 32) & (data - np.uint8(9) > 4)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LETTER = _BYTE[LOWER]
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, n at least; kept for the next call."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2)), base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z taken as a-z: a polynomial over the bytes, from running sums over all data."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers_to(len(data) + 1)
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(np.take(_LETTER, data, mode="clip") * power[: len(data)], out=running[1:])
    return mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes; fewer words than size make one shingle, none make none."""
    windows = np.zeros(0, dtype=np.uint64)
    if len(words) >= size:
        windows = words[: len(words) - size + 1] * _PLACES[0]
        for k in range(1, size):
            windows = windows + words[k : len(words) - size + 1 + k] * _PLACES[k]
        windows = mix(windows)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(windows[a : b - size + 1])
        elif b > a:
            yield mix((words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield windows[:0]
