"""Phrase collocation mining: phrases of 2 to 5 words that stand together more often than their parts would by chance.

Lengths are counted one after the other. A phrase can only be frequent if both phrases that it is made of (all but its
last word, all but its first) are, so each length looks only at places where a bit filter of `FILTER_BITS` holds both;
what the filter lets through by mistake is counted and falls at the threshold, so the filter's fixed size costs time on
very large tables, never a phrase.

In a task, phrases are counted in a HAT-trie (`HatTrie`): a shallow trie over word ids whose leaves are hash containers of
phrases; a container that grows too large bursts into a node over the next word, and when the whole trie does, its largest
subtrees are spilled as sorted runs: rows that Spark shuffles and merges. The runs are dealt by the hash of the
whole phrase rather than of its first words: a task sends a phrase once a spill, so no partition gets more than
tasks x spills rows of one phrase, though one word pair may start a third of all phrases.

A word's id is a 64-bit hash of its language and letters; the table of all words proves that no two share an id (else
another seed is taken), so phrases as lists of ids are exact.

Defined results: null texts are empty; a null language is `und`; repeated rows count each; very long texts are counted
whole; tables without a frequent phrase, and empty ones, give no rows; extra columns are ignored; of cuts with
equal scores the shortest first part counts, and of phrases with equal scores the more frequent, then the least in bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import LOWER, attach, forget, materialize, mix, text_chunks, word_hashes

LONGEST, LEAST, PERCENT, KEPT = 5, 100, 100, 2000
UNKNOWN = "und"

#: Bits of the filter that every task gets (8 MB), and the bits of a word id that choose a child.
FILTER_BITS, FAN_BITS = 1 << 26, 4
#: Phrases after which a container bursts, and phrases of a whole trie.
BURST, LIMIT = 1 << 16, 1 << 20

_PLACES = np.random.default_rng(31_415).integers(1, 2**63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPLITS = np.zeros(256, dtype=bool)
_SPLITS[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK = _SPLITS.copy()
_BLANK[list(b" \t")] = True


def phrase_keys(ids: np.ndarray) -> np.ndarray:
    """One hash a row of word ids."""
    return mix((ids * _PLACES[: ids.shape[1]]).sum(axis=1, dtype=np.uint64))


def merged(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ids with their counts added up; equal hashes of different rows are told apart."""
    codes, _ = pd.factorize(phrase_keys(ids))
    first = np.full(codes.max(initial=-1) + 1, -1, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    if not np.array_equal(ids[first][codes], ids):
        rows, codes = np.unique(ids, axis=0, return_inverse=True)
        codes = codes.ravel()
    else:
        rows = ids[first]
    total = np.zeros(len(rows), dtype=np.int64)
    np.add.at(total, codes, counts)
    return rows, total


class Container:
    """Leaf of the trie: distinct phrases and counts, behind what came in since they were last merged."""

    def __init__(self, width: int):
        self.ids, self.counts = np.zeros((0, width), dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.waits = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((ids, counts))
        self.waits += len(ids)
        if self.waits > max(len(self.ids), 4096):
            self.merge()

    def merge(self) -> None:
        if self.waits:
            self.ids, self.counts = merged(np.concatenate([self.ids, *[w[0] for w in self.waiting]]), np.concatenate([self.counts, *[w[1] for w in self.waiting]]))
            self.waiting, self.waits = [], 0

    def rows(self) -> int:
        return len(self.ids) + self.waits

    def leaves(self) -> list[Container]:
        return [self]


class Node:
    """Children by some bits of the word id at a depth; containers below burst until the last word is used."""

    def __init__(self, width: int, depth: int, burst: int):
        self.width, self.depth, self.burst = width, depth, burst
        self.children: list[Container | Node] = [Container(width) for _ in range(1 << FAN_BITS)]

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        child = (ids[:, self.depth] >> np.uint64(64 - FAN_BITS)).astype(np.uint8)
        order = np.argsort(child, kind="stable")
        ends = np.cumsum(np.bincount(child, minlength=1 << FAN_BITS))
        for c, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if a == b:
                continue
            at = self.children[c]
            at.add(ids[order[a:b]], counts[order[a:b]])
            if isinstance(at, Container) and len(at.ids) > self.burst and self.depth + 1 < self.width:
                at.merge()
                self.children[c] = Node(self.width, self.depth + 1, self.burst)
                self.children[c].add(at.ids, at.counts)

    def rows(self) -> int:
        return sum(c.rows() for c in self.children)

    def leaves(self) -> list[Container]:
        return [leaf for c in self.children for leaf in c.leaves()]


class HatTrie:
    """Counts of phrases of one length, bounded: beyond limit phrases whole subtrees leave it as sorted runs."""

    def __init__(self, width: int, burst: int = BURST, limit: int = LIMIT):
        self.root, self.limit = Node(width, 0, burst), limit

    def add(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Count the rows of ids; yields runs (ids, counts) that had to leave."""
        if len(ids):
            self.root.add(*merged(ids, np.ones(len(ids), dtype=np.int64)))
        if self.root.rows() > self.limit:
            yield from self.spill(self.limit // 2)

    def spill(self, until: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The largest subtrees as runs, until so many phrases are left."""
        left = self.root.rows()
        for c in sorted(range(1 << FAN_BITS), key=lambda c: -self.root.children[c].rows()):
            if left <= until:
                break
            subtree = self.root.children[c]
            self.root.children[c] = Container(self.root.width)
            left -= subtree.rows()
            for leaf in subtree.leaves():  # leaves follow each other by the bits of their words
                leaf.merge()
                order = np.lexsort(leaf.ids.T[::-1])
                if len(order):
                    yield leaf.ids[order], leaf.counts[order]


def _words(langs: pa.Array, texts: pa.Array, seed: int) -> Iterator[tuple]:
    """(bytes, starts, ends, word ids, piece numbers, document numbers, langs) of some documents at a time."""
    for keys, data, offsets in text_chunks(langs.fill_null(UNKNOWN), texts):
        inside = ~_BLANK[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= ~inside[:-1]
        after[:-1] |= ~inside[1:]
        starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        doc = np.searchsorted(offsets, starts, "right") - 1
        piece = np.cumsum(_SPLITS[data])[starts] + doc
        names = keys.dictionary_encode()
        spelled = [str(n).encode() for n in names.dictionary.to_pylist()]
        ends_of = np.cumsum([0, *map(len, spelled)])
        # word hashes take A-Z as a-z, the checksum does not
        tongue = word_hashes(np.frombuffer(b"".join(spelled), dtype=np.uint8), ends_of[:-1], ends_of[1:]) + np.array([zlib.crc32(s) for s in spelled], dtype=np.uint64)
        salt = mix(tongue + np.uint64(seed))[names.indices.to_numpy(zero_copy_only=False)] | np.uint64(1)
        yield data, starts, ends, mix(word_hashes(data, starts, ends) * salt[doc] + salt[doc]), piece, doc, keys


def words(docs: DataFrame, lang_col: str, text_col: str, seed: int) -> DataFrame:
    """(lang, word, id, f): each task sends a word once a chunk of texts, Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, ends, ids, _, doc, langs in _words(batch.column(0), batch.column(1), seed):
                codes, found = pd.factorize(ids)
                if not len(found):
                    continue
                at = np.full(len(found), -1, dtype=np.int64)
                at[codes[::-1]] = np.arange(len(codes))[::-1]
                size = ends[at] - starts[at]
                to = np.cumsum(size)
                spelled = LOWER[data[np.repeat(starts[at] - (to - size), size) + np.arange(to[-1])]]
                text = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], to]).astype(np.int32)), pa.py_buffer(spelled.tobytes()))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(doc[at])).cast(pa.string()), text, pa.array(found.view(np.int64)), pa.array(np.bincount(codes).astype(np.int64))], names=["lang", "word", "id", "f"])

    made = docs.select(F.col(lang_col).cast("string"), F.col(text_col)).mapInArrow(run, "lang string, word string, id long, f long")
    return made.groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


def filter_bits(phrases: DataFrame) -> np.ndarray:
    """The filter of phrases (ids): a bit for each hash. What reaches the driver is at most the filter itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy().view(np.uint64)
            if not len(ids):
                continue
            bit = phrase_keys(ids.reshape(len(batch), -1)) & np.uint64(FILTER_BITS - 1)
            word, codes = np.unique(bit >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), dtype=np.uint64)
            np.bitwise_or.at(bits, codes, np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    rows = phrases.select("ids").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return bits


def counted(docs: DataFrame, width: int, bits: np.ndarray, lang_col: str, text_col: str, seed: int) -> DataFrame:
    """(ids, f): phrases of width words, both of whose parts of one word less pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        flat = pa.array(np.ascontiguousarray(ids).view(np.int64).ravel())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), flat), pa.array(counts)], names=["ids", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trie = shared.value, HatTrie(width)
        for batch in batches:
            for _, _, _, ids, piece, _, _ in _words(batch.column(0), batch.column(1), seed):
                if len(ids) < width:
                    continue
                parts = sliding(ids, width - 1)
                key = phrase_keys(parts) & np.uint64(FILTER_BITS - 1)
                held = (known[(key >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63))) & np.uint64(1) == 1
                at = np.flatnonzero(held[:-1] & held[1:] & (piece[: len(piece) - width + 1] == piece[width - 1 :]))
                for run_ids, run_counts in trie.add(sliding(ids, width)[at]):
                    yield rows(run_ids, run_counts)
        for run_ids, run_counts in trie.spill():
            yield rows(run_ids, run_counts)

    made = docs.select(F.col(lang_col).cast("string"), F.col(text_col)).mapInArrow(run, "ids array<long>, f long")
    return made.repartition("ids").groupBy("ids").agg(F.sum("f").alias("f"))  # the trie has combined what a task can combine


def sliding(ids: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(ids, width)


def spelled(phrases: DataFrame, vocab: DataFrame) -> DataFrame:
    """(lang, words, f) of phrases (ids, f): word ids looked up, frequent words without meeting in one task."""
    each = materialize(phrases.select("ids", "f", F.posexplode("ids").alias("pos", "id")), "positions")
    uses = each.groupBy("id").agg(F.count("*").alias("uses"))
    names = vocab.select("id", "lang", "word").join(uses, "id")
    found = attach(each, names.select("id", "lang", "word", "uses"), "id", "uses", max(1, each.count()))
    one = found.groupBy("ids").agg(F.first("f").alias("f"), F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return one.select("lang", F.col("w.word").alias("words"), "f")


def _key(words: Column) -> Column:
    """Language and words as one string; words hold no line feeds, so the last one parts the two."""
    return F.concat("lang", F.lit("\n"), F.concat_ws(" ", words))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score, covered): every frequent phrase, its best-explained cut and whether a longer one covers it."""
    seed = 0
    while True:
        table = materialize(words(docs, lang_col, text_col, seed), "words")
        if table.groupBy("id").count().where("count > 1").isEmpty():
            break
        forget(table)
        seed += 1
    totals = table.groupBy("lang").agg(F.sum("f").alias("n"))
    vocab = materialize(table.where(F.col("f") >= least), "vocab")
    level = vocab.select(F.array("id").alias("ids"), "f")
    levels: list[DataFrame] = []
    for width in range(2, longest + 1):
        bits = filter_bits(level)
        if not bits.any():
            break
        level = materialize(counted(docs, width, bits, lang_col, text_col, seed).where(F.col("f") >= least), f"phrases{width}")
        levels.append(level)
    empty = docs.sparkSession.createDataFrame([], "ids array<long>, f long")
    phrases = empty
    for found in levels:
        phrases = phrases.union(found)
    named = materialize(spelled(phrases, vocab).withColumns({"key": _key(F.col("words")), "k": F.size("words")}), "named")
    parts = named.select("key", "f").union(vocab.select(F.concat("lang", F.lit("\n"), "word").alias("key"), "f"))

    def side(cuts: DataFrame, column: str, name: str) -> DataFrame:
        """cuts with the frequency of the part in column; parts of many phrases are sent to every task."""
        uses = cuts.groupBy(F.col(column).alias("part")).agg(F.count("*").alias("uses"))
        known = parts.select(F.col("key").alias("part"), F.col("f").alias(name)).join(uses, "part")
        return materialize(attach(cuts.withColumnRenamed(column, "part"), known, "part", "uses", max(1, cuts.count())).drop("part"), f"cuts_{name}")

    cuts = named.select("key", "lang", "words", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("key", "k", "a", "lang", "cut", _key(F.expr("slice(words, 1, cut)")).alias("first"), _key(F.expr("slice(words, cut + 1, k - cut)")).alias("rest"))
    priced = side(side(materialize(cuts, "cuts"), "first", "l"), "rest", "r").join(F.broadcast(totals), "lang")  # one row a language
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = priced.withColumn("score", score).groupBy("key", "lang", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    longer = named.where("k > 2").select(F.explode(F.array(_key(F.expr("slice(words, 1, k - 1)")), _key(F.expr("slice(words, 2, k - 1)")))).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    covered = F.coalesce(100 * F.col("longer") >= percent * F.col("a"), F.lit(False))
    phrase = F.expr("substring(key, length(lang) + 2)")
    return best.join(longer, "key", "left").select("lang", phrase.alias("phrase"), "k", "a", "best.l", "best.r", "n", "best.score", covered.alias("covered"))


#: Shares that a language's phrases are ranked in before the last ranking.
SHARES = 64


def top_collocations(docs: DataFrame, kept: int = KEPT, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first uncovered phrases by score, a and phrase."""
    rows = collocations(docs, longest, least, percent, lang_col, text_col).where(~F.col("covered")).drop("covered", "k")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "share").orderBy(*order)
    first = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= kept)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= kept)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
