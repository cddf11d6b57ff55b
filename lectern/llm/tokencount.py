"""Token counts of texts under a piece vocabulary, most of them without merging anything.

The library sees a text as one string: a mark for the start, marks for spaces, and merges of neighbours wherever the
merged string is a piece. No merge can cross a place that no piece spans, so the text falls apart there, and the parts
(pre-tokens) are merged each by itself with the same result:

1. before a space mark that follows anything but a space mark, since no piece holds such a pair (checked);
2. on both sides of a character that stands in no piece of two or more characters (line feeds, many symbols).

`prove` encodes each piece of the vocabulary alone, as a pre-token, with the library, once and on the driver. Those that
come back as one token make the table that is sent to the tasks: its size is bounded by the vocabulary. A task looks
each pre-token up; what is not in the table is merged by the library, distinct strings of a batch once, and short ones
are remembered up to a bound. The model's bytes travel with the task, so workers need no file.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted each, as are rows that
share an id or have none; very long texts are counted whole; strings like those of special tokens are plain text, which
is the library's default; extra columns are ignored; an empty table gives no rows. Nothing is ordered, so there are no ties.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
SPACE = "▁"

#: Merged pre-tokens that a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 400_000, 48


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class PreTokens:
    """The pre-tokens of texts under one model, and how many tokens the library makes of each."""

    def __init__(self, model: bytes):
        self.library = load(model)
        ids = range(self.library.vocab_size())
        self.pieces = [self.library.id_to_piece(i) for i in ids if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        long = [p for p in self.pieces if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            raise ValueError("a piece of the vocabulary spans the start of a word, so texts cannot be cut there")
        if self.library.encode(" a") == self.library.encode("a") or self.library.encode("a  a") == self.library.encode("a a"):
            raise ValueError("the model rewrites spaces; only models that keep texts as they are can be cut here")
        inner = "".join(sorted({c for p in long for c in p} - {SPACE}))
        self.pattern = re.compile(f"{SPACE}*[{re.escape(inner)}]+|{SPACE}+|[^{SPACE}]")
        #: A character in no long piece: it cuts off the mark that the library puts in front of every text.
        self.stop = next(c for c in map(chr, range(1, sys.maxunicode)) if c not in inner and c not in (SPACE, " "))
        self.before = len(self.library.encode(self.stop))

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def merged(self, tokens: list[str]) -> list[int]:
        """How many tokens the library makes of each pre-token, wherever it stands."""
        texts = [t[1:] if t[0] == SPACE and len(t) > 1 else self.stop + t for t in tokens]
        return [len(ids) - (self.before if text[0] == self.stop and token[0] != SPACE or token == SPACE else 0) for token, text, ids in zip(tokens, texts, self.library.encode(texts, num_threads=1), strict=True)]


def prove(model: bytes) -> frozenset[str]:
    """The pieces that, as pre-tokens, the library turns into exactly one token."""
    found = PreTokens(model)
    whole = [p for p in found.pieces if found.pattern.fullmatch(p)]
    return frozenset(p for p, n in zip(whole, found.merged(whole), strict=True) if n == 1)


class Counter:
    """Token counts of texts: pre-tokens of the proven table count one, the rest is merged."""

    def __init__(self, model: bytes, single: frozenset[str]):
        self.found, self.single = PreTokens(model), single
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """(tokens, pre-tokens that were counted directly) of each text."""
        single, known = self.single, self.known
        for text in texts:
            tokens = self.found.cut(text or "")
            rest = [t for t in tokens if t not in single]
            new = list({t for t in rest if t not in known})
            if new:
                known |= zip(new, self.found.merged(new), strict=True)
            direct = len(tokens) - len(rest)
            yield direct + sum(map(known.__getitem__, rest)), direct
            if new:
                for t in new:
                    if len(t) > REMEMBERED_CHARS:
                        del known[t]
                if len(known) > REMEMBERED:
                    known.clear()


#: The counter of the worker, under the digest of its model.
_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_direct) of each row; model_path is a file of the driver."""
    with open(model_path, "rb") as f:
        model = f.read()
    single, name = prove(model), hashlib.sha256(model).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((model, single))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(name)
        if counter is None:
            _counters.clear()
            counter = _counters[name] = Counter(*shared.value)
        for batch in batches:
            found = list(counter.counts(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]], names=["_id", "n_bytes", "n_tokens", "n_direct"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["_id"].dataType.simpleString()
    made = rows.select("_id", "_text", "n_bytes").mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long, n_direct long")
    return made.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_direct")
