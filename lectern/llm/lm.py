"""Language-model scoring: unigram baseline and online logistic mixing of hashed-context bit predictors.

A text is a row of tokens: its lower-cased words and one end. The model writes every token in two steps, bit by bit:

1. Its symbol, by a prefix code over the frequent words, the end, and classes of all other words (by their last two
   bytes). Predictors know, beside the place in the code: nothing; the symbol before; the two symbols before; the
   frequent word met last; and the word before itself.
2. A word that is only a class is then either one of the dictionary (its share of the class, less a discount) or
   spelled byte by byte. Predictors know the last two, three and four bytes and the whole word so far.

Each predictor holds counts of zeros and ones in hashed slots. Their log-odds are mixed by weights that a gate chooses
from how well the longest contexts are known, and the outcome is refined by an adaptive table. Counts, weights and tables
are learned from all training tokens: tasks count their documents, then run an online pass (each bit is taken out of the
counts before it is predicted), and what they learned is merged by its weight. Slots grow with the number of tokens up to
a bound (`TOKEN_BITS`, `SPELL_BITS`), so that they can be sent; words and their counts, which grow without one, meet the documents by hash.

Defined results: a null text counts as empty and holds the end alone; repeated rows are scored each; rows without an id
learn like those that are not held out; without training documents every bit is even; extra columns are ignored; an empty
table gives no rows. `bits_per_byte` is null for an empty text.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import LOWER, materialize, mix, text_chunks, word_bounds, word_hashes

#: Shares of all tokens from which a word has a symbol of its own, and from which its price is sent to every task: their
#: inverses bound the numbers of such words.
SYMBOL_SHARE, HOT_SHARE = 2e-4, 2e-6
CLASSES, FUNCTION_WORDS = 64, 128
#: Most bits of a slot number, by predictor, and least.
TOKEN_BITS, SPELL_BITS, LEAST_BITS = (16, 20, 20, 22, 22), (20, 21, 22, 22), 14
BLOCK, BATCH = 1 << 18, 1 << 14
#: Bytes of text, and words, whose bits a kernel holds at once (some 10 bits a byte).
BITS_BYTES, WORDS_AT_ONCE = 1 << 19, 8_192
GATES, STEPS, LIMIT, RATE = 16, 33, 8.0, 0.03

_C3 = np.uint64(0x9E3779B97F4A7C15)


# -- counts as one byte ----------------------------------------------------------------------------------------------

EXACT = 20  # counts with a sum below this are kept exactly, others as log-odds


def to_states(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    total = zeros + ones
    odds = np.log((ones + 0.1) / (zeros + 0.1))
    coarse = 210 + np.clip(np.rint((odds + LIMIT) * (45 / (2 * LIMIT))), 0, 45)
    return np.where(total < EXACT, total * (total + 1) // 2 + ones, coarse).astype(np.uint8)


def _state_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By state: log-odds of one, how well it is known (0 to 3), and the state with a zero or a one less."""
    odds, known, less = np.zeros(256, dtype=np.float32), np.zeros(256, dtype=np.intp), np.tile(np.arange(256, dtype=np.uint8)[:, None], (1, 2))
    for total in range(EXACT):
        for ones in range(total + 1):
            k = total * (total + 1) // 2 + ones
            odds[k] = np.log((ones + 0.1) / (total - ones + 0.1))
            known[k] = (total > 0) + (total > 2) + (total > 12)
            before = (total - 1) * total // 2
            less[k] = (before + min(ones, total - 1) if total else k, before + max(ones - 1, 0) if total else k)
    odds[210:] = np.arange(46) * (2 * LIMIT / 45) - LIMIT
    known[210:] = 3
    return odds, known, less


ODDS, KNOWN, LESS = _state_tables()
#: The same once a bit is taken out of the counts: for a zero, then for a one.
ODDS_LESS, KNOWN_LESS = ODDS[LESS.T].ravel(), KNOWN[LESS.T].ravel()


# -- bits and their mixer --------------------------------------------------------------------------------------------


def short(h: np.ndarray) -> np.ndarray:
    """The upper half of 64-bit hashes."""
    return (h >> np.uint64(32)).astype(np.uint32)


@dataclass
class Bits:
    """Bits of units in order: for each unit its contexts (a hash for each predictor), bits and owner; and all bits."""

    contexts: list[np.ndarray]
    lengths: np.ndarray  # at least 1
    owner: np.ndarray
    node: np.ndarray  # hashed place in the code, of each bit
    bit: np.ndarray

    def cuts(self) -> list[slice]:
        return [slice(a, a + BATCH) for a in range(0, len(self.bit), BATCH)]

    def slots(self, sizes: tuple[int, ...]) -> Iterator[Iterator[np.ndarray]]:
        """For each predictor the slots, BATCH bits at a time: one table is used at once, and what leads to it stays in cache."""
        for c, b in zip(self.contexts, sizes, strict=True):
            context = np.repeat(c, self.lengths)
            yield (((context[cut] + self.node[cut]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - b) for cut in self.cuts())

    def states(self, sizes: tuple[int, ...], tables: list[np.ndarray]) -> list[np.ndarray]:
        """Each predictor's state at each bit."""
        return [np.concatenate([np.take(table, slot) for slot in slots]) for table, slots in zip(tables, self.slots(sizes), strict=True)]


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


#: Steps into which mixed log-odds are cut.
FINE = 512


@dataclass
class Mixer:
    sizes: tuple[int, ...]
    states: list[np.ndarray]
    weights: np.ndarray  # GATES x (predictors + 1)
    refine: np.ndarray  # GATES x STEPS

    def inputs(self, odds: np.ndarray) -> list[np.ndarray]:
        """Weighted log-odds of each predictor by gate and state, given those of each state."""
        tables = [np.outer(w, odds) for w in self.weights[:, :-1].T]
        tables[0] += self.weights[:, -1:]
        return [t.astype(np.float32, copy=False).ravel() for t in tables]

    def final(self) -> np.ndarray:
        """Base-10 logarithm of the probability of a bit, by gate, step of the mixed log-odds, and bit."""
        at = (np.arange(FINE) + 0.5) / FINE * (STEPS - 1)
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        table = self.refine[:, low] * (1 - (at - low)) + self.refine[:, low + 1] * (at - low)
        p = np.clip(0.5 * _squash(at * (2 * LIMIT / (STEPS - 1)) - LIMIT)[None] + 0.5 * table, 1e-6, 1 - 1e-6)
        return np.log10(np.stack([1 - p, p], axis=2)).ravel()

    def log10_owners(self, bits: Bits, owners: int) -> np.ndarray:
        """Base-10 logarithm of the probability of each owner's bits."""
        if not len(bits.bit):
            return np.zeros(owners)
        logs, inputs, final = np.empty(len(bits.bit)), self.inputs(ODDS), self.final()
        states = bits.states(self.sizes, self.states)
        for cut in bits.cuts():
            gate, mixed, _ = mixed_odds([s[cut] for s in states], inputs, KNOWN)
            logs[cut] = np.take(final, ((gate * FINE + steps(mixed, FINE / (2 * LIMIT), 0, FINE - 1)) << 1) + bits.bit[cut])
        units = np.add.reduceat(logs, np.cumsum(bits.lengths) - bits.lengths)
        return np.bincount(bits.owner, units, owners)


def steps(mixed: np.ndarray, width: float, shift: float, most: int) -> np.ndarray:
    """The step, 0 to most, that mixed log-odds from -LIMIT on fall into; mixed is used up."""
    mixed += np.float32(LIMIT)
    mixed *= np.float32(width)
    mixed += np.float32(shift)
    np.maximum(mixed, np.float32(0), out=mixed)
    np.minimum(mixed, np.float32(most), out=mixed)
    return mixed.astype(np.intp)


def mixed_odds(states: list[np.ndarray], inputs: list[np.ndarray], known: np.ndarray, first: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Gate, mixed log-odds, and gate and state together for each predictor; known tells of states, counted from first."""
    gate = np.take(known, first + states[-1]) * 4 + np.take(known, first + states[-2])
    row = gate * len(known) + first
    places = [row + s for s in states]
    mixed = np.take(inputs[0], places[0])
    for table, place in zip(inputs[1:], places[1:], strict=True):
        mixed += np.take(table, place)
    return gate, mixed, places


def fresh(sizes: tuple[int, ...], states: list[np.ndarray]) -> Mixer:
    weights = np.full((GATES, len(sizes) + 1), 1.2 / len(sizes), dtype=np.float32)
    weights[:, -1] = 0
    return Mixer(sizes, states, weights, np.tile(_squash(np.linspace(-LIMIT, LIMIT, STEPS)), (GATES, 1)).astype(np.float32))


class Learner:
    """An online pass of gradient steps over a mixer; seen() gives what it learned as rows that add up over tasks."""

    def __init__(self, mixer: Mixer):
        self.mixer = Mixer(mixer.sizes, mixer.states, mixer.weights.copy(), mixer.refine)
        self.squares = np.full(mixer.weights.shape, 1e-3)
        self.bits = np.zeros(GATES)
        self.places = np.zeros(2 * GATES * STEPS)  # zeros and ones met at each place of the table

    def learn(self, bits: Bits) -> None:
        states = bits.states(self.mixer.sizes, self.mixer.states)
        for cut in bits.cuts():
            bit = bits.bit[cut].astype(np.intp)
            gate, mixed, places = mixed_odds([s[cut] for s in states], self.mixer.inputs(ODDS_LESS), KNOWN_LESS, bit << 8)
            error = (bits.bit[cut] - 1 / (1 + np.exp(-mixed))).astype(np.float64)
            count = np.bincount(gate, minlength=GATES)
            sums = [np.bincount(place, error, 512 * GATES).reshape(GATES, 512) for place in places]
            grad = np.stack([*[v @ ODDS_LESS for v in sums], sums[0].sum(axis=1)], axis=1) / np.maximum(1, count)[:, None]
            self.squares += grad * grad
            self.mixer.weights += (RATE * grad / np.sqrt(self.squares)).astype(np.float32)
            self.bits += count
            near = steps(mixed, (STEPS - 1) / (2 * LIMIT), 0.5, STEPS - 1)
            self.places += np.bincount(((gate * STEPS + near) << 1) + bit, minlength=2 * GATES * STEPS)

    def seen(self) -> pd.DataFrame:
        inputs = self.mixer.weights.shape[1]
        weights = pd.DataFrame({"kind": 0, "at": np.arange(GATES * inputs), "n": np.repeat(self.bits, inputs), "v": (self.mixer.weights * self.bits[:, None]).ravel()})
        return pd.concat([weights, pd.DataFrame({"kind": 1, "at": np.arange(GATES * STEPS), "n": self.places[::2] + self.places[1::2], "v": self.places[1::2]})])


Maker = Callable[[pa.RecordBatch], Iterator[Bits]]


def count_table(bits: Iterator[Bits], sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Zeros and ones of each slot, side by side, for each predictor."""
    tables = [np.zeros(2 << b, dtype=np.int32) for b in sizes]
    for part in bits:
        for table, slots in zip(tables, part.slots(sizes), strict=True):
            for cut, slot in zip(part.cuts(), slots, strict=True):
                np.add.at(table, (slot * np.uint32(2) + part.bit[cut]).astype(np.intp), np.int32(1))
    return tables


def count_states(rows: DataFrame, make: Maker, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """States of all slots after counting every bit of the rows; as many bytes reach the driver as there are slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = count_table((bits for batch in batches for bits in make(batch)), sizes)
        press = zstandard.ZstdCompressor(level=1)
        for k, table in enumerate(tables):
            cut = [(a, table[a : a + BLOCK]) for a in range(0, len(table), BLOCK)]
            cut = [(a, press.compress(t.tobytes())) for a, t in cut if t.any()]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(cut), pa.int32()), pa.array([a for a, _ in cut], pa.int32()), pa.array([b for _, b in cut], pa.binary())], names=["k", "at", "counts"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.int32).astype(np.int64) for b in part["counts"])
        states = zstandard.ZstdCompressor(level=1).compress(to_states(total[::2], total[1::2]).tobytes())
        return pd.DataFrame({"k": part["k"].iloc[:1], "at": part["at"].iloc[:1], "counts": [states]})

    kind = "k int, at int, counts binary"
    out = [np.zeros(1 << b, dtype=np.uint8) for b in sizes]
    for row in rows.mapInArrow(run, kind).groupBy("k", "at").applyInPandas(add, kind).toLocalIterator():
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.counts), dtype=np.uint8)
        out[row.k][row.at // 2 : row.at // 2 + len(part)] = part
    return out


def learn_mixer(rows: DataFrame, make: Maker, sizes: tuple[int, ...]) -> Mixer:
    """Counts, then gated weights and the refining table, from every bit of the rows."""
    mixer = fresh(sizes, count_states(rows, make, sizes))
    sent = rows.sparkSession.sparkContext.broadcast(mixer)  # its slots are bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(sent.value)
        for batch in batches:
            for bits in make(batch):
                learner.learn(bits)
        yield pa.RecordBatch.from_pandas(learner.seen(), preserve_index=False)

    learned = rows.mapInArrow(run, "kind long, at long, n double, v double").groupBy("kind", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()  # GATES * (inputs + STEPS) rows
    for r in learned.itertuples():
        if r.kind == 0 and r.n > 0:
            mixer.weights.reshape(-1)[r.at] = r.v / r.n
        elif r.kind == 1:
            mixer.refine.reshape(-1)[r.at] = (r.v + 8 * mixer.refine.reshape(-1)[r.at]) / (r.n + 8)
    return mixer


def sized(most: tuple[int, ...], bits: float) -> tuple[int, ...]:
    """Slot bits that grow with the number of bits to learn, up to the bound."""
    return tuple(int(np.clip(np.ceil(np.log2(max(2.0, bits))), LEAST_BITS, m)) for m in most)


# -- symbols ---------------------------------------------------------------------------------------------------------


@dataclass
class Code:
    """Symbols: frequent words in order of their hashes, then classes, then the end; and their prefix code."""

    hashes: np.ndarray  # of frequent words, sorted
    function: np.ndarray  # whether a symbol is a function word
    classes: np.ndarray  # class by last two bytes
    starts: np.ndarray
    lengths: np.ndarray
    nodes: np.ndarray  # hashed
    bits: np.ndarray

    @property
    def end(self) -> int:
        return len(self.starts) - 1

    def symbols(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        classes = len(self.hashes) + self.classes[tail].astype(np.int64)
        if not len(self.hashes):
            return classes
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, classes)


def prefix_code(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, nodes, bits) of a Huffman code; a node is a hashed place in its tree."""
    heap = [(w, k, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    top = len(weights)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        above[x], above[y] = (top, 0), (top, 1)
        heapq.heappush(heap, (a + b, top, top))
        top += 1
    starts, lengths, nodes, bits = [], [], [], []
    for k in range(len(weights)):
        path = []
        while k in above:
            k, bit = above[k]
            path.append((k, bit))
        starts.append(len(nodes))
        lengths.append(len(path))
        nodes += [n for n, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
    return np.array(starts), np.array(lengths), short(mix(np.array(nodes, dtype=np.uint64))), np.array(bits, dtype=np.uint8)


def _tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Last two bytes of words, lower-cased; a one-byte word has a zero in front."""
    last = LOWER[data[ends - 1]].astype(np.int64)
    return last + 256 * np.where(ends - starts > 1, LOWER[data[np.maximum(ends - 2, 0)]].astype(np.int64), 0)


def token_bits(code: Code, data: np.ndarray, offsets: np.ndarray) -> tuple[Bits, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits of all symbols, owned by documents; word hashes, their documents, symbols, words of each document)."""
    docs = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    per = np.diff(first)
    owner = np.repeat(np.arange(docs), per)
    words = code.symbols(h, _tails(data, starts, ends) if len(starts) else np.zeros(0, dtype=np.int64))
    at = np.arange(len(h)) + owner  # one more place for the end of each text before
    size = len(h) + docs
    symbol, whole = np.full(size, code.end, dtype=np.int64), np.zeros(size, dtype=np.uint64)
    symbol[at], whole[at] = words, h
    stops = np.cumsum(per + 1)
    doc = np.repeat(np.arange(docs), per + 1)
    heads = stops - per - 1
    place = np.arange(size) - heads[doc]

    def back(v: np.ndarray, k: int, none: int) -> np.ndarray:
        return np.where(place >= k, np.concatenate((v[:k], v[: len(v) - k]))[: len(v)], v.dtype.type(none))

    numbers = symbol.astype(np.uint64) + np.uint64(1)
    one, two = back(numbers, 1, 0), back(numbers, 2, 0)
    met = np.maximum.accumulate(np.where(code.function[symbol], np.arange(size), -1)) if size else np.zeros(0, dtype=np.int64)
    met = np.concatenate(([-1], met[:-1]))[:size]
    said = np.where(met >= heads[doc], numbers[np.maximum(met, 0)], np.uint64(0))
    hashed = [mix(one + np.uint64(1 << 40)), mix(said + np.uint64(2 << 40)), mix(back(whole, 1, 0) ^ np.uint64(3 << 40)), mix(one * _C3 + two + np.uint64(4 << 40))]
    lengths = code.lengths[symbol]
    places = np.repeat(code.starts[symbol] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    return Bits([np.zeros(size, dtype=np.uint32), *[short(x) for x in hashed]], lengths, doc, code.nodes[places], code.bits[places]), h, owner, words, per


# -- spelling --------------------------------------------------------------------------------------------------------


def spell(words: list[bytes], kinds: np.ndarray) -> Bits:
    """Bits of words and of a blank after each; kinds are their classes."""
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    heads = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(heads, lengths)
    kind = np.repeat(kinds.astype(np.uint64) + np.uint64(1), lengths)
    back = [np.where(place >= k, np.concatenate((np.zeros(min(k, len(data)), dtype=np.uint64), data[: max(0, len(data) - k)].astype(np.uint64))), np.uint64(256)) for k in range(1, 5)]
    contexts = []
    for order in (2, 3, 4):
        h = kind if order < 4 else np.zeros(len(data), dtype=np.uint64)
        for k in range(order):
            h = h * _C3 + back[k] + np.uint64(order)
        contexts.append(mix(h))
    powers = np.cumprod(np.full(int(lengths.max()), 0xD6E8FEB86659FD93, dtype=np.uint64), dtype=np.uint64)
    running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place], dtype=np.uint64)))
    contexts.append(mix(running[:-1] - np.repeat(running[heads], lengths) + place.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + kind * _C3))
    shifts = np.arange(7, -1, -1)
    bit = ((data[:, None] >> shifts) & 1).astype(np.uint8)
    node = _NODES[(data[:, None].astype(np.int64) | 256) >> (shifts + 1)]
    return Bits([short(c) for c in contexts], np.full(len(data), 8), np.repeat(np.arange(len(words)), lengths), node.ravel(), bit.ravel())


_NODES = short(mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 20)))


def _spelled(batch: pa.RecordBatch) -> Iterator[Bits]:
    """Bits of (word, class) rows."""
    for a in range(0, batch.num_rows, WORDS_AT_ONCE):
        part = batch.slice(a, WORDS_AT_ONCE)
        yield spell(part.column(0).to_pylist(), part.column(1).to_numpy())


# -- jobs ------------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """(h, word, c): every distinct lower-cased word, with its occurrences in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush() -> pa.RecordBatch:
            rows = [pa.array(list(held), pa.int64()), pa.array([v[0] for v in held.values()], pa.binary()), pa.array([v[1] for v in held.values()], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, names=["h", "word", "c"])

        for batch in batches:
            for flags, data, offsets in text_chunks(batch.column(0), batch.column(1)):
                starts, ends, first = word_bounds(data, offsets)
                h = word_hashes(data, starts, ends)
                learns = np.repeat(np.array(flags.to_pylist(), dtype=bool), np.diff(first))
                distinct, one, inverse = np.unique(h, return_index=True, return_inverse=True)
                c = np.bincount(inverse, learns, len(distinct)).astype(np.int64)
                text = LOWER[data].tobytes()
                for key, a, b, n in zip(distinct.view(np.int64).tolist(), starts[one].tolist(), ends[one].tolist(), c.tolist(), strict=True):
                    if (seen := held.get(key)) is None:
                        held[key] = [text[a:b], n]
                    else:
                        seen[1] += n
                if len(held) > 400_000:
                    yield flush()
        yield flush()

    rows = docs.select(train.alias("t"), text_col).mapInArrow(run, "h long, word binary, c long")
    return rows.groupBy("h").agg(F.first("word").alias("word"), F.sum("c").alias("c"))


def make_code(words: DataFrame, tokens: int, ends: int) -> tuple[Code, pd.DataFrame]:
    """The symbols' code, and tokens and kinds (n, kinds, ones, twos) of each class."""
    frequent = words.where(F.col("c") >= max(2.0, SYMBOL_SHARE * tokens)).select("h", "c").toPandas()  # 1 / SYMBOL_SHARE rows at most
    frequent["u"] = frequent["h"].to_numpy(dtype=np.int64).view(np.uint64)
    frequent = frequent.sort_values("u").reset_index(drop=True)
    rare = words.where((F.col("c") > 0) & (F.col("c") < max(2.0, SYMBOL_SHARE * tokens)))
    tail = F.conv(F.lpad(F.hex(F.substring("word", -2, 2)), 4, "0"), 16, 10).cast("int").alias("tail")
    tails = rare.groupBy(tail).agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos")).toPandas()  # 65,536 rows at most
    tails = tails.sort_values(["n", "tail"], ascending=[False, True])
    classes = np.full(1 << 16, CLASSES - 1, dtype=np.uint8)
    for k, t in enumerate(tails["tail"].head(CLASSES - 1).astype(int).tolist()):
        classes[t] = k
    tails["kind"] = classes[tails["tail"].to_numpy(dtype=np.int64)] if len(tails) else []
    stats = tails.groupby("kind")[["n", "kinds", "ones", "twos"]].sum().reindex(range(CLASSES), fill_value=0)
    weights = [*frequent["c"].astype(int).tolist(), *(stats["n"].astype(int) + 1).tolist(), ends + 1]
    function = np.zeros(len(weights), dtype=bool)
    function[frequent["c"].sort_values(ascending=False, kind="stable").index[:FUNCTION_WORDS]] = True
    return Code(frequent["u"].to_numpy(dtype=np.uint64), function, classes, *prefix_code(weights)), stats


def price_words(words: DataFrame, code: Code, stats: pd.DataFrame, speller: Broadcast, floor: float) -> DataFrame:
    """(h, c, base, model): base-10 logarithms of each word by the baseline, and of what its symbol leaves open."""
    n, kinds, ones, twos = (stats[c].to_numpy(dtype=np.float64) for c in ("n", "kinds", "ones", "twos"))
    discount = np.clip((ones + 1) / (ones + 2 * twos + 2), 0.1, 0.95)
    novel = np.where(n > 0, np.minimum(1.0, discount * kinds / np.maximum(n, 1)), 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(a, WORDS_AT_ONCE)
                names = part.column(1).to_pylist()
                h, c = part.column(0).to_numpy(), part.column(2).to_numpy().astype(np.float64)
                symbol = code.symbols(h.view(np.uint64), np.array([int.from_bytes(w[-2:], "big") for w in names]))
                model = np.zeros(len(h))
                rare = np.flatnonzero(symbol >= len(code.hashes))
                if len(rare):
                    kind = symbol[rare] - len(code.hashes)
                    letters = speller.value.log10_owners(spell([names[k] for k in rare.tolist()], kind), len(rare))
                    listed = np.maximum(c[rare] - discount[kind], 0) / np.maximum(n[kind], 1)
                    model[rare] = np.logaddexp(np.log(np.maximum(listed, 1e-300)), np.log(np.maximum(novel[kind], 1e-12)) + letters * np.log(10)) / np.log(10)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.log10(c + 1.0) - floor), pa.array(model)], names=["h", "c", "base", "model"])

    return words.select("h", "word", "c").mapInArrow(run, "h long, c long, base double, model double")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, total_bits, bits_per_byte) of each row."""
    session = docs.sparkSession
    train = ~F.coalesce(held_out, F.lit(False))
    words = materialize(word_counts(docs, text_col, train), "words")
    ends = docs.where(train).count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, distinct = total[0] + ends, total[1] + (ends > 0)
    code, stats = make_code(words, tokens, ends)
    frequent = F.col("h").isin(code.hashes.view(np.int64).tolist())

    def symbols(batch: pa.RecordBatch) -> Iterator[Bits]:
        for _, data, offsets in text_chunks(batch.column(0), batch.column(0), BITS_BYTES):
            yield token_bits(code, data, offsets)[0]

    tail = F.conv(F.lpad(F.hex(F.substring("word", -2, 2)), 4, "0"), 16, 10).cast("int")
    writer = learn_mixer(docs.where(train).select(text_col), symbols, sized(TOKEN_BITS, 6.0 * tokens))
    table = session.createDataFrame([(int(t), int(k)) for t, k in enumerate(code.classes) if k < CLASSES - 1], "tail int, kind int")
    spelled = words.where((F.col("c") > 0) & ~frequent).withColumn("tail", tail).join(F.broadcast(table), "tail", "left")  # CLASSES rows
    speller = learn_mixer(spelled.select("word", F.coalesce("kind", F.lit(CLASSES - 1)).alias("kind")), _spelled, sized(SPELL_BITS, 60.0 * distinct))
    floor = float(np.log10(tokens + distinct + 1))
    end = (float(np.log10(ends + 1)) - floor, int(ends > 0))
    sent = session.sparkContext.broadcast(writer)
    prices = materialize(price_words(words, code, stats, session.sparkContext.broadcast(speller), floor), "prices")
    hot = prices.where(F.col("c") >= max(1.0, HOT_SHARE * tokens)).select("h", "base", "model").toPandas().sort_values("h")  # 1 / HOT_SHARE rows at most
    known = session.sparkContext.broadcast((hot["h"].to_numpy(dtype=np.int64), hot["base"].to_numpy(dtype=np.float64), hot["model"].to_numpy(dtype=np.float64)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, model = known.value
        for batch in batches:
            for ids, data, offsets in text_chunks(batch.column(0), batch.column(1), BITS_BYTES):
                bits, h, owner, _, per = token_bits(code, data, offsets)
                h, n = h.view(np.int64), len(ids)
                written = sent.value.log10_owners(bits, n)
                digest = np.array([xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=np.uint64).view(np.int64)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                warm = keys[at] == h if len(keys) else np.zeros(len(h), dtype=bool)
                here = [np.bincount(owner[warm], v[at[warm]] if len(keys) else None, n) for v in (base, model)]
                rest, rest_owner = h[~warm], owner[~warm]
                order = np.lexsort((rest, rest_owner))
                rest, rest_owner = rest[order], rest_owner[order]
                new = np.concatenate(([True], (rest[1:] != rest[:-1]) | (rest_owner[1:] != rest_owner[:-1])))[: len(rest)]
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(rest)))
                rows = rest_owner[heads]
                mask = np.concatenate((np.zeros(len(heads), dtype=bool), np.ones(n, dtype=bool)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((rest[heads], mix(digest.view(np.uint64)).view(np.int64)))),
                        ids.take(pa.array(np.concatenate((rows, np.arange(n))))),
                        pa.array(np.concatenate((digest[rows], digest))),
                        pa.array(np.concatenate((times, np.zeros(n, dtype=np.int64))).astype(np.int32)),
                        *[pa.array(np.concatenate((np.zeros(len(heads), dtype=v.dtype), v)), mask=~mask) for v in (per + 1, np.bincount(owner[warm], minlength=n) + end[1], np.diff(offsets), here[0] + end[0], here[1] + written)],
                    ],
                    names=["h", "id", "digest", "times", "tokens", "known", "bytes", "base0", "model0"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    met = docs.select(id_col, text_col).mapInArrow(meet, f"h long, id {kind}, digest long, times int, tokens long, known long, bytes long, base0 double, model0 double")
    joined = met.join(prices, "h", "left")
    # a row of the corpus adds one row with tokens; equal rows add up and are dealt out again
    sums = joined.groupBy("id", "digest").agg(
        F.count("tokens").alias("rows"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.coalesce("known", F.lit(0)) + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum("bytes").alias("bytes"),
        F.sum(F.coalesce("base0", F.lit(0.0)) + F.coalesce(F.col("base") * F.col("times"), F.lit(0.0))).alias("base"),
        F.sum(F.coalesce("model0", F.lit(0.0)) + F.coalesce(F.col("model") * F.col("times"), F.lit(0.0))).alias("model"),
    )
    rows = F.col("rows")
    spread = sums.select(F.col("id").alias(id_col), *[(F.col(a) / rows).cast("long").alias(b) for a, b in (("tokens", "n_tokens"), ("known", "n_known"), ("bytes", "n_bytes"))], (F.col("base") / rows).alias("base_score"), (F.col("model") / rows).alias("score"), F.explode(F.sequence(F.lit(1), rows.cast("int"))).alias("_copy"))
    bits = F.col("score") * -float(np.log2(10))
    return spread.select(id_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("total_bits"), F.try_divide(bits, F.col("n_bytes").cast("double")).alias("bits_per_byte"))
