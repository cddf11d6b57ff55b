"""Language identification by a linear-chain conditional random field over words.

Emission features of a word are hashed affixes and byte n-grams, and the word itself as lexicon entry; transitions
between languages are learned with them, by gradient ascent on the likelihood of a bounded sample of word sequences
(`SAMPLE_SEQUENCES` of at most `SEQUENCE` words, chosen by hash from all training documents), half of them joined from
two documents, so that switching inside a text is seen. Prediction labels every word of a text, however long, by
forward-backward: `spans` gives the runs of words in one language, and `predict` the language with the largest sum of
marginals, with its mean marginal as the score. All texts of a batch advance together; those of more than `BLOCK` words
advance in blocks, whose transfer matrices carry the messages over the borders, so the marginals are those of one chain.

Defined results: `und` and score 0 for a null text, a text without a letter, and where nothing could be learned;
repeated rows are judged each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import LOWER, WORD, hash_sample, materialize, mix, text_chunks, word_bounds, word_hashes

SAMPLE_SEQUENCES, SEQUENCE, BLOCK = 6_000, 24, 256
#: Documents that are cut into sequences for the sample, chosen by hash.
SAMPLE_DOCS = 4_000
SLOTS = 1 << 18
EPOCHS, BATCH, RATE = 4, 200, 0.3

IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of words, and for each word the index of its first one."""
    lengths = ends - starts
    padded = lengths + 2  # a mark on either side
    heads = np.concatenate(([0], np.cumsum(padded)[:-1]))
    text = np.full(int(padded.sum()), 256, dtype=np.uint64)
    inner = np.arange(len(text)) - np.repeat(heads, padded)
    body = (inner > 0) & (inner <= np.repeat(lengths, padded))
    text[body] = LOWER[data[np.repeat(starts, padded)[body] + inner[body] - 1]]
    word = np.repeat(np.arange(len(starts)), padded)
    end = np.repeat(heads + padded, padded)
    slots, owners = [mix(word_hashes(data, starts, ends))], [np.arange(len(starts))]
    at = np.arange(len(text))
    gram = np.zeros(len(text), dtype=np.uint64)
    for n in range(1, 6):
        shifted = np.full(len(text), 0, dtype=np.uint64)
        shifted[: len(text) - n + 1] = text[n - 1 :]
        gram = gram * np.uint64(1021) + shifted + np.uint64(1)
        fits = (at + n <= end) & (n > 1)
        affix = (inner == 0) | (at + n == end)  # longer affixes, all shorter n-grams
        chosen = fits & (affix if n > 3 else True)
        slots.append(mix(gram[chosen] + np.uint64(n << 56)))
        owners.append(word[chosen])
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (slots[order] % np.uint64(SLOTS)).astype(np.int64), np.searchsorted(owners[order], np.arange(len(starts)))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # SLOTS x languages
    transitions: np.ndarray
    opening: np.ndarray

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        slots, first = features(data, starts, ends)
        return np.add.reduceat(self.weights[slots], first, axis=0)


def _lockstep(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of chains by falling length, their first rows in that order, and how many are longer than t, for each t."""
    order = np.argsort(-lengths, kind="stable")
    longer = np.searchsorted(-lengths[order], -np.arange(int(lengths.max()) if len(lengths) else 0), "left")
    return order, (np.cumsum(lengths) - lengths)[order], longer


def _sweep(p: np.ndarray, lengths: np.ndarray, moves: np.ndarray, entry: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """Marginals of chains; entry is what each first row is weighed by, exits the backward message at each last row."""
    order, heads, longer = _lockstep(lengths)
    ahead, back = np.empty_like(p), np.empty_like(p)
    for t, k in enumerate(longer.tolist()):
        at = heads[:k] + t
        x = p[at] * (entry[order] if t == 0 else ahead[at - 1] @ moves)
        ahead[at] = x / x.sum(axis=1, keepdims=True)
    back[heads + lengths[order] - 1] = exits[order]
    for t in range(len(longer) - 2, -1, -1):
        at = heads[: int(longer[t + 1])] + t
        x = (back[at + 1] * p[at + 1]) @ moves.T
        back[at] = x / x.sum(axis=1, keepdims=True)
    both = ahead * back
    return both / both.sum(axis=1, keepdims=True)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Marginals of chains given by their rows in scores, one chain after the other; every chain has a row or more."""
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    moves = np.exp(transitions - transitions.max())
    states = p.shape[1]
    start, ones = np.exp(opening - opening.max()).astype(p.dtype), np.ones(states, dtype=p.dtype)
    blocks = -(-lengths // BLOCK)
    chain = np.repeat(np.arange(len(lengths)), blocks)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    sizes = np.minimum(BLOCK, lengths[chain] - number * BLOCK)
    entry, exits = np.tile(start, (len(chain), 1)), np.tile(ones, (len(chain), 1))
    inner = np.flatnonzero(blocks[chain] > 1)
    if len(inner):
        rows = np.concatenate([np.arange(a, a + n) for a, n in zip((np.cumsum(sizes) - sizes)[inner].tolist(), sizes[inner].tolist(), strict=True)])
        q, (order, heads, longer) = p[rows], _lockstep(sizes[inner])
        carry = np.tile(np.eye(states, dtype=p.dtype), (len(inner), 1, 1))  # carry[k] maps the message before a block to the one at its end
        opens = number[inner][order] == 0  # nothing moves into the first row of a chain
        for t, k in enumerate(longer.tolist()):
            moved = carry[:k] @ moves
            if t == 0:
                moved[opens] = carry[opens]
            x = moved * q[heads[:k] + t][:, None, :]
            carry[:k] = x / x.sum(axis=(1, 2), keepdims=True)
        transfer = np.empty_like(carry)
        transfer[order] = carry
        message = start
        for k, b in enumerate(inner.tolist()):
            if number[b]:
                entry[b] = message @ moves
            x = (message if number[b] else start) @ transfer[k]
            message = x / x.sum()
        for k in range(len(inner) - 1, 0, -1):
            b = int(inner[k])
            if number[b]:
                x = transfer[k] @ exits[b]
                exits[b - 1] = x / x.sum()
    return _sweep(p, sizes, moves, entry, exits)


def train(sequences: list[tuple[str, str]], seed: int = 5) -> Model | None:
    """A model from (language, words) sequences; None if there are none."""
    languages = sorted({lang for lang, _ in sequences})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    size = len(languages)
    model = Model(languages, np.zeros((SLOTS, size), dtype=np.float32), np.zeros((size, size)), np.zeros(size))
    squares, move_squares = np.full((SLOTS, size), 1e-3, dtype=np.float32), np.full((size, size), 1.0)
    rows = [(languages.index(lang), [w.encode() for w in words.split(" ") if w]) for lang, words in sequences]
    rows = [r for r in rows if r[1]]
    for _ in range(EPOCHS if rows else 0):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            words, gold, lengths = [], [], []
            for k in order[a : a + BATCH]:
                lang, own = rows[k]
                parts = [(lang, own)]
                if rng.random() < 0.5:
                    parts.append(rows[int(rng.integers(len(rows)))])
                lengths.append(sum(len(w) for _, w in parts))
                for code, w in parts:
                    words += w
                    gold += [code] * len(w)
            sizes = np.array([len(w) for w in words])
            ends = np.cumsum(sizes)
            data = np.frombuffer(b"".join(words), dtype=np.uint8)
            slots, first = features(data, ends - sizes, ends)
            scores = np.add.reduceat(model.weights[slots], first, axis=0).astype(np.float64)
            lengths = np.array(lengths)
            marginals = forward_backward(scores, lengths, model.transitions, model.opening)
            error = -marginals
            error[np.arange(len(gold)), gold] += 1
            grad = np.zeros((SLOTS, size), dtype=np.float32)
            per = np.repeat(error, np.diff(np.append(first, len(slots))), axis=0).astype(np.float32)
            for c in range(size):
                grad[:, c] = np.bincount(slots, per[:, c], SLOTS)
            grad -= 1e-4 * model.weights
            squares += grad * grad
            model.weights += RATE * grad / np.sqrt(squares) * 0.2
            heads = np.cumsum(lengths) - lengths
            inner = np.ones(len(gold), dtype=bool)
            inner[heads] = False
            b = np.flatnonzero(inner)
            seen = np.zeros((size, size))
            np.add.at(seen, (np.array(gold)[b - 1], np.array(gold)[b]), 1)
            pair = marginals[b - 1][:, :, None] * np.exp(model.transitions - model.transitions.max())[None] * np.exp(scores[b] - scores[b].max(axis=1, keepdims=True))[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            step = (seen - pair.sum(axis=0)) / BATCH
            move_squares += step * step
            model.transitions += RATE * step / np.sqrt(move_squares)
    return model


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """A bounded sample of word sequences, chosen by hash."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("_text"))
    chosen = hash_sample(rows.select("_id"), F.col("_id"), SAMPLE_DOCS).distinct()
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    parts = rows.join(F.broadcast(chosen), "_id").select("lang", words.alias("w"))  # SAMPLE_DOCS bounds what is sent
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(SEQUENCE))
    parts = parts.select("lang", "w", F.explode(starts).alias("at")).select("lang", F.array_join(F.slice("w", F.col("at") + 1, F.lit(SEQUENCE)), " ").alias("words"))
    parts = materialize(parts, "sequences")
    return [(r[0], r[1]) for r in hash_sample(parts, F.col("words"), SAMPLE_SEQUENCES).collect()]


@dataclass
class Judged:
    """Words with a letter: byte starts and ends, document, and marginals."""

    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    marginals: np.ndarray


def _judge(model: Model, data: np.ndarray, offsets: np.ndarray) -> Judged:
    starts, ends, first = word_bounds(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    running = np.concatenate(([0], np.cumsum(IS_LETTER[data])))
    has = running[ends] > running[starts] if len(starts) else np.zeros(0, dtype=bool)
    starts, ends, owner = starts[has], ends[has], owner[has]
    if not len(starts):
        return Judged(starts, ends, owner, np.zeros((0, len(model.languages))))
    _, one, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    scores = model.emissions(data, starts[one], ends[one])[inverse]
    count = np.bincount(owner)
    return Judged(starts, ends, owner, forward_backward(scores, count[count > 0], model.transitions.astype(np.float32), model.opening.astype(np.float32)))


def spans(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, lang, probability): runs of words in one language; code points, end exclusive.

    A word has the language of its largest marginal, words without a letter are passed over, and the probability is the
    mean marginal of the run. Texts without a letter have no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS bounds its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if sent.value is not None else ():
            for ids, data, offsets in text_chunks(batch.column(0), batch.column(1)):
                judged = _judge(sent.value, data, offsets)
                best = judged.marginals.argmax(axis=1)
                new = np.ones(len(best), dtype=bool)
                new[1:] = (best[1:] != best[:-1]) | (judged.owner[1:] != judged.owner[:-1])
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(best)) - 1 if len(heads) else heads
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                owner = judged.owner[heads]
                zero = points[offsets[:-1]][owner]
                peak = np.add.reduceat(judged.marginals[np.arange(len(best)), best], heads) if len(heads) else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner)), pa.array((points[judged.starts[heads]] - zero).astype(np.int64)), pa.array((points[judged.ends[tails]] - zero).astype(np.int64)), pa.array([sent.value.languages[k] for k in best[heads].tolist()], pa.string()), pa.array((peak / np.maximum(1, tails - heads + 1)).astype(np.float64))],
                    names=[id_col, "start", "end", "lang", "probability"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, start long, end long, lang string, probability double")


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", unknown: str = "und") -> DataFrame:
    """(id, lang_pred, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS bounds its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for ids, data, offsets in text_chunks(batch.column(0), batch.column(1)):
                n = len(ids)
                names, scores = [unknown] * n, np.zeros(n)
                if model is not None:
                    judged = _judge(model, data, offsets)
                    count = np.bincount(judged.owner, minlength=n)
                    total = np.stack([np.bincount(judged.owner, judged.marginals[:, c], n) for c in range(len(model.languages))], axis=1)
                    best = total.argmax(axis=1)
                    plain = np.concatenate(([0], np.cumsum(IS_LETTER[data] & (data < 128))))
                    for k in np.flatnonzero(count > 0).tolist():
                        a, b = int(offsets[k]), int(offsets[k + 1])
                        if plain[b] > plain[a] or any(c.isalpha() for c in data[a:b].tobytes().decode("utf-8", "replace")):
                            names[k], scores[k] = model.languages[best[k]], min(1.0, total[k, best[k]] / count[k])
                yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves this remainder."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    return train(sample(docs, id_col, text_col, lang_col))
