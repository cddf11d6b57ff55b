"""N-gram Jaccard join of documents by signature trees.

A document's set is its distinct word shingles. The steps:

1. Documents with equal sets become one node (the least id), so exact copies never multiply.
2. Nodes are dealt into clusters: minhash bands (`BANDS` of `ROWS`; a pair at the threshold misses all of them with a
   probability of 3e-8; those that share a third of their shingles meet in one band of 240) link each node with the
   least and the greatest node of its bucket, and the components of those links are the clusters. No pair is formed inside
   a bucket.
3. Inside a cluster a signature tree holds OR-combined bitmaps of shingles, ranges of set sizes and the most shingles
   that share a bit. A dual traversal from the root drops node pairs whose greatest possible overlap is too small; leaf
   pairs that remain, and that are not in one component yet, are verified on the whole sets.
4. Clusters of more than `CHUNK` nodes are split over tasks: trees of chunks first, then of one node from each
   component found. In each band bucket that still holds several components, finally, blocks of the nodes outside the
   largest one meet blocks of all the bucket's nodes: a stranger among a million near copies costs a million comparisons.
5. Links become components by distributed star contraction.

Defined results: null and empty texts have empty sets and are linked with nothing; rows that share an id are one node;
ties take the least id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.shared import attach, bit_filter, forget, materialize, mix, shingle_sets, text_chunks, word_bounds, word_hashes

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 64, 5
CHUNK, FANOUT = 128, 8
#: Nodes on each side of a comparison in mixed buckets, in chunks: larger blocks repeat fewer sets, and the trees prune inside them.
BLOCKS = 8

_RNG = np.random.default_rng(7_071_067)
_FACTOR = (_RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_OFFSET = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]
_COLUMN = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Minhash band keys of a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    least = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    for a in range(0, x.shape[1], 4096):
        least = np.minimum(least, (x[:, a : a + 4096] * _FACTOR + _OFFSET).min(axis=1))
    rows = (least.reshape(BANDS, ROWS).astype(np.uint64) * _COLUMN).sum(axis=1, dtype=np.uint64)
    return mix(rows + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for ids, data, offsets in text_chunks(batch.column(0), batch.column(1)):
            starts, ends, first = word_bounds(data, offsets)
            yield ids, list(shingle_sets(word_hashes(data, starts, ends), first, size))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """(id, n, d1, d2, keys): set size, two digests of the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, size):
            digests = [(mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) for s in sets]
            keys = np.concatenate([band_keys(s) for s in sets if len(s)] or [np.zeros(0, dtype=np.uint64)]).view(np.int64)
            ends = np.cumsum([0, *[BANDS * (len(s) > 0) for s in sets]])
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.array([d[k] for d in digests], dtype=np.uint64).view(np.int64)) for k in (0, 1)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))],
                names=[id_col, "n", "d1", "d2", "keys"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n long, d1 long, d2 long, keys array<long>")


class SignatureTree:
    """Sets in a tree: leaves are single sets in an order that puts like sets side by side, nodes join FANOUT children."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.order = sorted(range(len(sets)), key=lambda k: (int(sets[k][0]), len(sets[k])))
        bitmaps = np.zeros((len(sets), bits // 8), dtype=np.uint8)
        for row, k in enumerate(self.order):
            at = (sets[k] & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(bitmaps[row], at >> 3, (1 << (at & 7)).astype(np.uint8))
        sizes = np.array([len(sets[k]) for k in self.order], dtype=np.int64)
        words = bitmaps.view(np.uint64)
        self.levels = [(words, sizes, sizes, sizes - np.bitwise_count(words).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            words, low, high, shared = self.levels[-1]
            heads = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(words, heads), np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads), np.maximum.reduceat(shared, heads)))

    def at(self, level: int) -> tuple:
        return self.levels[min(level, len(self.levels) - 1)]


def possible(a: SignatureTree, b: SignatureTree, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some pair below nodes i of a and j of b can reach the similarity.

    Common shingles are at most the common bits and the shingles that share a bit with others in a set.
    """
    (wa, lowa, higha, dupa), (wb, lowb, highb, dupb) = a.at(level), b.at(level)
    common = np.bitwise_count(wa[i] & wb[j]).sum(axis=1, dtype=np.int64) + np.minimum(dupa[i], dupb[j])
    most = np.minimum(common, np.minimum(higha[i], highb[j]))
    return ((100 + percent) * most >= percent * (lowa[i] + lowb[j])) & (100 * higha[i] >= percent * lowb[j]) & (100 * highb[j] >= percent * lowa[i])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def tree_links(sets: list[np.ndarray], others: list[np.ndarray] | None, groups: list[int], other_groups: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """Links (index in sets, index in others) that join components; without others, inside sets.

    groups name the components known before. A link between nodes that are in one component already is not looked for.
    """
    alone = others is None
    every = sets if alone else sets + others
    bits = 1 << int(np.clip(np.ceil(np.log2(4 * np.mean([len(s) for s in every]))), 9, 16))
    a = SignatureTree(sets, bits)
    b = a if alone else SignatureTree(others, bits)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = up
        return x

    level = max(len(a.levels), len(b.levels)) - 1
    i = j = np.zeros(1, dtype=np.int64)
    while True:
        keep = possible(a, b, level, i, j, percent)
        i, j = i[keep], j[keep]
        if not level:
            break
        level -= 1
        (na, ra), (nb, rb) = ((len(t.at(level)[1]), level < len(t.levels) - 1) for t in (a, b))
        step = np.arange(FANOUT)
        ii, jj = (np.concatenate([k[:, None] * FANOUT + step if grows else np.repeat(k[:, None], 1, axis=1)]) for k, grows in ((i, ra), (j, rb)))
        x = np.repeat(ii, jj.shape[1], axis=1).ravel()
        y = np.tile(jj, (1, ii.shape[1])).ravel()
        inside = (x < na) & (y < nb) & ((x <= y) if alone else True)
        i, j = x[inside], y[inside]
    links = []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        u, v = a.order[p], b.order[q]
        if alone and u == v:
            continue
        gu, gv = find(groups[u]), find((groups if alone else other_groups)[v])
        if gu != gv and similar(sets[u], every[v] if alone else others[v], percent):
            parent[gu] = gv
            links.append((u, v))
    return links


def _unpack(blobs: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in blobs]


def _linked(grouped: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) inside each group of (node, group, side, set): within side 0, or between sides 0 and 1."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        left = part[part["side"] == 0].sort_values("node")
        right = part[part["side"] == 1].sort_values("node")
        if not len(left):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if len(right):
            found = tree_links(_unpack(left["set"]), _unpack(right["set"]), left["group"].tolist(), right["group"].tolist(), percent)
            pairs = [(left["node"].iat[u], right["node"].iat[v]) for u, v in found]
        else:
            found = tree_links(_unpack(left["set"]), None, left["group"].tolist(), None, percent)
            pairs = [(left["node"].iat[u], left["node"].iat[v]) for u, v in found]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return grouped.groupBy(*keys).applyInPandas(run, "a long, b long")


def _sides(rows: DataFrame, side: int, *columns: str) -> DataFrame:
    return rows.select("cluster", *columns, "node", "group", F.lit(side).alias("side"), "set")


def links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of nodes (node, keys)."""
    banded = nodes.select("node", F.explode("keys").alias("key"))
    ends = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high")
    ends = materialize(ends, "ends")
    met = attach(banded, ends, "key", "n", BANDS * nodes.count())
    dealt = components(met.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")))
    dealt = materialize(dealt.withColumnRenamed("component", "cluster"), "clusters")
    forget(ends)
    sizes = dealt.groupBy("cluster").agg(F.count("*").alias("members"))
    dealt = attach(dealt, sizes.withColumn("n", F.col("members")), "cluster", "n", dealt.count())
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / CHUNK)).cast("int").alias("chunk")
    placed = materialize(dealt.select("node", "cluster", chunk, "members"), "placed")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, sets in _sets(iter([batch]), size):
                part = batch.slice(at, len(sets))
                at += len(sets)
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(0), part.column(0), part.column(4), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cluster", "chunk", "node", "group", "members", "set"])

    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).where(bit_filter(placed.select(F.xxhash64("node").alias("h")), F.xxhash64(docs[id_col])))
    sets = texts.join(placed, "node").select("node", "text", "cluster", "chunk", "members").mapInArrow(pack, "cluster long, chunk int, node long, group long, members long, set binary")
    sets = materialize(sets, "sets")
    found = materialize(_linked(_sides(sets, 0, "chunk"), ["cluster", "chunk"], percent), "links")
    large = sets.where(F.col("members") > CHUNK)
    if large.isEmpty():
        return found

    def grouped() -> DataFrame:
        """Rows of large clusters with the component that the links give them so far."""
        now = components(found).select("node", "component")
        return materialize(large.drop("group").join(now, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component"), "grouped")

    rows = grouped()
    heads = rows.where(F.col("group") == F.col("node"))
    heads = heads.join(heads.groupBy("cluster").agg(F.count("*").alias("heads")), "cluster")
    heads = heads.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("heads") / CHUNK)).cast("int"))
    found = materialize(found.union(_linked(_sides(heads, 0, "part"), ["cluster", "part"], percent)), "links")

    rows = grouped()
    keyed = rows.select("node", "group").join(nodes, "node").select("node", "group", F.explode("keys").alias("key"))
    keyed = materialize(keyed, "keyed")
    sizes = keyed.groupBy("key", "group").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.count("*").alias("groups"), F.sum("n").alias("n"), F.max("n").alias("most")).where("groups > 1")
    block = BLOCKS * CHUNK
    mixed = materialize(mixed.select("key", "main", F.ceil(F.col("n") / block).cast("int").alias("parts"), F.ceil((F.col("n") - F.col("most")) / block).cast("int").alias("turns"), "n"), "mixed")
    total = mixed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keyed = attach(keyed, mixed, "key", "n", total)
    part, turn = (F.pmod(F.xxhash64("node", F.lit(k)), F.col(n)).cast("int").alias(name) for k, n, name in ((2, "parts", "part"), (3, "turns", "turn")))
    members = keyed.select("key", part, F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "node", "group", F.lit(0).alias("side"))
    strangers = keyed.where(F.col("group") != F.col("main")).select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), turn, "node", "group", F.lit(1).alias("side"))
    both = members.union(strangers).join(rows.select("node", "set").dropDuplicates(["node"]), "node")
    return found.union(_linked(both, ["key", "part", "turn"], percent))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of each row: the least id reachable by links."""
    made = materialize(sketches(docs, id_col, text_col, size).withColumn("same", F.concat_ws(":", "n", "d1", "d2")), "sketches")
    filled = made.where("n > 0")
    nodes = materialize(filled.groupBy("same").agg(F.min(id_col).alias("node"), F.first("keys").alias("keys"), F.count("*").alias("copies")), "nodes")
    merged = materialize(components(links(docs, nodes.select("node", "keys"), id_col, text_col, size, percent)), "merged")
    known = materialize(nodes.join(merged, "node", "left").select("same", F.coalesce("component", "node").alias("component"), "copies"), "known")
    placed = attach(filled.select(id_col, "n", "same"), known, "same", "copies", filled.count())
    found = placed.select(id_col, F.col("n").alias("n_shingles"), F.coalesce("component", id_col).alias("component_id"))
    return found.union(made.where("n = 0").select(id_col, "n", id_col))  # nothing to look up: empty texts never meet
