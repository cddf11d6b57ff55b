"""Byte-level BPE: encoding, character offsets and decoding over Arrow batches.

The `tokenizers` library does the merges. A text is cut before each space that a non-space follows; the pre-tokenizer
cuts there as well, so the pieces can be encoded apart. Each worker keeps the ids of recent pieces, and only unseen
pieces reach the library, many in one call. Special tokens named in a text are ordinary text, unless asked for.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded each; columns other than the
named two are ignored (or kept by `encode(..., keep=True)`); a document of any length is encoded whole.
"""

from __future__ import annotations

import array
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern of the byte-level vocabulary's pre-tokenizer.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose ids a worker remembers, and the longest piece worth remembering.
CACHE_PIECES, CACHE_CHARS = 900_000, 48


def byte_table() -> dict[str, int]:
    """The printable character that stands for each byte: itself if visible, else the next free one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one vocabulary file of the tokenizers library, held once in a Python worker."""

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        chars = byte_table()
        vocab = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes[k] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.lengths = np.array([len(b) for b in self.bytes])
        self.kind = np.uint16 if len(self.bytes) <= 1 << 16 else np.uint32
        self.pack = functools.partial(array.array, "H" if self.kind is np.uint16 else "I")
        self.seen: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}
        self.chars = {b: c for c, b in chars.items()}
        self.odd = re.compile(r" (?:\s|$)")
        self.foreign = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\u024f]")
        self.pattern = regex.compile(PRETOKENS)

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def _merged(self, pretokens: set[str]) -> list[str]:
        """Have the library's BPE model merge pre-tokens that are not known yet, written in byte characters.

        Gives those that are too long to be remembered after this call.
        """
        if len(self.merged) > CACHE_PIECES:
            self.merged.clear()
        long = []
        for p in pretokens.difference(self.merged):
            chars = p.encode().decode("latin-1").translate(self.chars)
            self.merged[p] = self.pack([t.id for t in self.tokenizer.model.tokenize(chars)]).tobytes()
            if len(p) > CACHE_CHARS:
                long.append(p)
        return long

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that each follow a space. Latin pieces are cut into pre-tokens here, others by the library."""
        out, latin = {}, []
        for p in pieces:
            if self.foreign.search(p):
                out[p] = self._raw(" " + p).tobytes()
            else:
                latin.append(p)
        cut = self.pattern.findall("".join([" " + p for p in latin]))
        long = self._merged(set(cut))
        merged, at = self.merged, -1
        parts: list[list[bytes]] = [[] for _ in latin]
        for c in cut:
            at += c[0] == " " and len(c) > 1
            parts[at].append(merged[c])
        for p in long:
            del merged[p]
        return out | {p: b"".join(x) for p, x in zip(latin, parts, strict=True)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        known, rows, unseen = self.seen, [], set()
        if len(known) > CACHE_PIECES:
            known.clear()
        for text in texts:
            if self.odd.search(text) or any(name in text for name in self.special):
                rows.append((None, text, None, None))
                continue
            head, *tail = text.split(" ")
            found = list(map(known.get, tail))
            gaps = [k for k, x in enumerate(found) if x is None] if None in found else []
            unseen.update([tail[k] for k in gaps])
            rows.append((found, head, tail, gaps))
        now = self._learn(unseen) if unseen else {}
        known.update((p, b) for p, b in now.items() if len(p) <= CACHE_CHARS)
        out = []
        for found, head, tail, gaps in rows:
            if found is None:
                out.append(self._raw(head))
                continue
            for k in gaps:
                found[k] = now[tail[k]]
            out.append(np.frombuffer((self._raw(head).tobytes() if head else b"") + b"".join(found), dtype=self.kind))
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of ids; a character whose bytes are cut off at either end becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def char_starts(self, ids: np.ndarray) -> np.ndarray:
        """For each token the character that holds its first byte (tokens inside a split character share it)."""
        raw = np.frombuffer(self.decode_bytes(ids.tolist()), dtype=np.uint8)
        chars = np.cumsum((raw & 0xC0) != 0x80) - 1
        heads = np.concatenate(([0], np.cumsum(self.lengths[ids])[:-1])).astype(np.int64)
        return chars[heads] if len(ids) else heads[:0]


@functools.lru_cache(maxsize=2)
def codec(path: str, special: bool = False) -> Codec:
    return Codec(path, special)


def encoded(batches: Iterator[pa.RecordBatch], path: str, id_col: str, text_col: str, docs_at_once: int = 256, special: bool = False) -> Iterator[tuple[list, list[str], list[np.ndarray]]]:
    """(ids of documents, texts, token ids) a few documents at a time; special: whether texts may name special tokens."""
    coder = codec(path, special)
    for batch in batches:
        for at in range(0, batch.num_rows, docs_at_once):
            part = batch.slice(at, docs_at_once)
            texts = [t or "" for t in part.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield part.column(batch.schema.get_field_index(id_col)).to_pylist(), texts, coder.encode(texts)


def _map(docs: DataFrame, id_col: str, text_col: str, schema: str, make: Callable) -> DataFrame:
    return docs.select(id_col, text_col).mapInArrow(make, schema)


def encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, char_starts array<int>) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocab)
        for keys, _, rows in encoded(batches, vocab, id_col, text_col):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([coder.char_starts(r).astype(np.int32) for r in rows], pa.list_(pa.int32()))],
                names=[id_col, "ids", "char_starts"],
            )

    return _map(docs, id_col, text_col, f"{id_col} long, ids array<int>, char_starts array<int>", run)


def decode(encodings: DataFrame, vocab: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocab)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return _map(encodings, id_col, "ids", f"{id_col} long, text string", run)


def round_trip_digests(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocab)
        decimal = [str(k) for k in range(len(coder.bytes))]
        for keys, _, rows in encoded(batches, vocab, id_col, text_col):
            lists = [r.tolist() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array([hashlib.sha256(" ".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in lists], pa.string()),
                    pa.array([hashlib.sha256(coder.decode_bytes(x)).hexdigest() for x in lists], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _map(docs, id_col, text_col, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)
