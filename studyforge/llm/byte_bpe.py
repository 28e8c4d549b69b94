"""Byte-level BPE by a sentencepiece model that is serialised from a vocabulary of ranks.

Each vocabulary entry becomes a piece spelt in one printable character a byte, with its
negative rank as score, under an identity normaliser; sentencepiece then merges the
adjacent pair of best score, leftmost first, which is the merge order of the ranks. Texts
are split into pre-tokens by the vocabulary's pattern and every pre-token is encoded by
itself; one that is a whole entry has that entry's id. Ids are decoded by the inverse of
the byte spelling.

The vocabulary is a file of at most a few MB; the driver builds the model from it and
sends it with the tasks, so executors need no file. A text is encoded in stretches of
pre-tokens, whatever its length. Defined results: null text counts as empty (no ids);
repeated rows are encoded again; an empty table gives no rows; other columns are left out,
so their names cannot clash.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

#: Pre-tokens that a worker process remembers, and the longest of them in characters.
KEPT, LONGEST = 800_000, 64
#: Bytes of texts whose pre-tokens are encoded together.
TOGETHER = 2_000_000
#: Texts of more characters are split into pre-tokens by stretches of so many.
LONG_TEXT, STRETCH = 1_000_000, 100_000


def byte_letters() -> str:
    """A printable character for each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


LETTERS = byte_letters()
#: Spelling of the unknown piece, which no bytes have.
UNKNOWN = "\ue000"
_SPELL = {b: c for b, c in enumerate(LETTERS)}
_BYTE = {c: b for b, c in enumerate(LETTERS)}


def spell(data: bytes) -> str:
    return data.decode("latin-1").translate(_SPELL)


def unspell(piece: str) -> bytes:
    return bytes(_BYTE[c] for c in piece)


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file: a base64 entry and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: a varint, a 32-bit float, or bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece of number i is the entry of i-th smallest rank; the unknown piece comes last."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    if max(ranks.values()) >= 1 << 24:
        raise ValueError("ranks of 2**24 and more are no exact scores")
    out = bytearray()
    for entry, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out += _field(1, _field(1, spell(entry).encode()) + _field(2, float(-rank)))
    # fixed values: field numbers, model type 2 (BPE) and piece type 2 (unknown) of the public model format
    out += _field(1, _field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, 2))
    out += _field(2, _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, model: bytes, ids: np.ndarray, pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern)
        self.ids = ids.astype("<u4")
        self.entries = [unspell(self.pieces.id_to_piece(i)) for i in range(len(ids))]
        self.whole = {e: self.ids[i].tobytes() for i, e in enumerate(self.entries)}
        self.by_id = dict(zip(ids.tolist(), self.entries, strict=True))
        self.known: dict[str, bytes] = {}

    def learn(self, pre_tokens: set[str]) -> dict[str, bytes]:
        """Id bytes of pre-tokens, four for each id."""
        out, rest = {}, []
        for p in pre_tokens:
            if (whole := self.whole.get(data := p.encode())) is not None:
                out[p] = whole
            else:
                rest.append((p, spell(data)))
        for (p, _), found in zip(rest, self.pieces.encode([s for _, s in rest], num_threads=1) if rest else [], strict=True):
            out[p] = self.ids[found].tobytes()
        return out

    def stretches(self, text: str) -> Iterator[list[str]]:
        found = (m.group() for m in self.split.finditer(text))
        while some := list(islice(found, STRETCH)):
            yield some

    def ids_of(self, parts: list[list[str]]) -> list[bytes]:
        """Id bytes of lists of pre-tokens; those not known yet are encoded together."""
        seen = set().union(*parts)
        fresh = self.learn({p for p in seen if p not in self.known})
        if len(self.known) + len(fresh) > KEPT:
            fresh |= {p: self.known[p] for p in seen if p in self.known}
            self.known.clear()
        self.known |= fresh
        out = [b"".join(map(self.known.__getitem__, part)) for part in parts]
        for p in fresh:
            if len(p) > LONGEST:
                del self.known[p]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Id bytes of each text; long texts go by themselves, in stretches."""
        out = [b""] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= LONG_TEXT]
        for i, ids in zip(short, self.ids_of([self.split.findall(texts[i]) for i in short]), strict=True):
            out[i] = ids
        for i in {*range(len(texts))} - {*short}:
            out[i] = b"".join(self.ids_of([part])[0] for part in self.stretches(texts[i]))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict = {}


def _codec(model: bytes, ids: bytes, pattern: str) -> Codec:
    """The process's own codec for a model, so that tasks share its pre-tokens."""
    key = (hash(model), hash(ids), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(model, np.frombuffer(ids, "<u4"), pattern)
    return _CODECS[key]


def model_of(vocabulary: str) -> tuple[bytes, bytes]:
    """Serialised model and the id of each of its pieces, little-endian."""
    ranks = read_ranks(vocabulary)
    return serialise(ranks), np.array(sorted(ranks.values()), "<u4").tobytes()


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, each id as a little-endian unsigned 32-bit integer) of every whole text."""
    model, numbers = model_of(vocabulary)

    def run(batches):
        codec = _codec(model, numbers, pattern)
        for whole in batches:
            for b in slices(whole, "text", TOGETHER):
                ids = codec.encode([t or "" for t in b.column(1).to_pylist()])
                yield {"doc_id": b.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": pa.array(ids, pa.binary())}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, n_tokens long, ids binary")


def decode_ids(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Rows of encode_texts with the bytes that their ids stand for as `decoded`; null ids stand for none."""
    model, numbers = model_of(vocabulary)

    def run(batches):
        codec = _codec(model, numbers, pattern)
        for whole in batches:
            for b in slices(whole, "ids"):
                data = [codec.decode(x or b"") for x in b.column(2).to_pylist()]
                yield {"doc_id": b.column(0), "n_tokens": b.column(1), "ids": b.column(2), "decoded": pa.array(data, pa.binary())}

    return arrow_map(tokens.select("doc_id", "n_tokens", "ids"), run, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Digests of every text's ids and of the bytes decoded from them."""
    both = decode_ids(encode_texts(docs, vocabulary, pattern), vocabulary, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
