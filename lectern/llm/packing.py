"""Packing of documents into training windows: best-fit decreasing over a segment tree of remaining capacities.

A document's ids (and an end id) are cut into full windows first; what is left over, always shorter than a window, is
packed best-fit decreasing: longest piece first, each into the open window that it leaves the least room in. Pieces
are dealt by a hash into shards of about `SHARD_PIECES`, and each shard is packed by itself in one task, so a hot
source or a huge document never meets in one place; a shard wastes about one window. Special tokens that a text names
become their ids, as the library does by default.

Defined results: a null or empty text has the end id alone; repeated rows, and rows without an id, are packed each; very
long texts are encoded whole; pieces of one length go by id (nulls last), then start, and of windows with the same
room the one opened or filled last is taken; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import encoded
from lectern.llm.shared import materialize

WINDOW = 2048
SHARD_PIECES = 1536


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree over the capacities 0 to size - 1 (a power of two)."""

    def __init__(self, size: int):
        self.size = 1 << (size - 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, window: int, left: int) -> None:
        self.windows[left].append(window)
        k = left + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity that is at least need, taken out; None if there is none."""
        count, k = self.count, need + self.size
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up until a sibling to the right has windows
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if count[2 * k] else 2 * k + 1
        left = k - self.size
        while k:
            count[k] -= 1
            k >>= 1
        return self.windows[left].pop(), left


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of pieces given by lengths of 1 to window."""
    opened, n = OpenWindows(window), 0
    into, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        found = opened.take(size) if size < window else None
        if found is None:
            into[k], left, n = n, window, n + 1
        else:
            into[k], left = found
            offset[k] = window - left
        if left > size:
            opened.add(int(into[k]), left - size)
    return into, offset


def pieces(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document's ids and end id, cut into windows and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, rows in encoded(batches, vocab, id_col, text_col, special=True):
            out: list[tuple] = []
            for key, ids in zip(keys, rows, strict=True):
                whole = np.append(ids, end_id).astype("<u4")
                out += [(key, a, len(part := whole[a : a + window]), zlib.crc32(part.tobytes()), len(whole)) for a in range(0, len(whole), window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    return docs.select(id_col, text_col).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def pack(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece."""
    cut = materialize(pieces(docs, vocab, id_col, text_col, window, end_id), "pieces")
    shards = cut.count() // SHARD_PIECES + 1
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(shards)))

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.take(pc.sort_indices(shard, sort_keys=[("length", "descending"), (id_col, "ascending"), ("start", "ascending")]))
        into, offset = best_fit(shard["length"].to_numpy(), window)
        sequence = shard["shard"].to_numpy() * (1 << 32) + into
        return shard.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("shard").applyInArrow(run, ", ".join(f"{c} long" for c in [*cut.columns, "sequence_id", "offset"]))
