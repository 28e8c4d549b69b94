"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is the
product of its letters' vectors, rotated by two, one and no places; a text is the sum of its
trigrams; a language's prototype is the sum of its texts. A text gets the language whose
prototype has the largest cosine with it. Runs of other characters count as one space.

Learning sums one vector per task and language; the driver reads languages x dimensions
numbers. Defined results: null text or a text without a letter is `und` with score 0; equal
cosines go to the language first in order; repeated rows count each; with nothing to learn
from, all is `und`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

DIMENSIONS = 1024
BATCH_BYTES = 2_000_000
#: Texts, and different trigrams, whose dense counts and vectors are held at a time.
BATCH_ROWS, TRIGRAMS = 1_000, 8_192
#: Alphabets up to this size index trigrams directly; larger ones sort them.
DIRECT = 160


def held(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of doc_id as text falls in the fold; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(folds)) == fold


class Letters:
    """Random vectors by code point, made when first seen; 0 stands for a space."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed, self.known = dims, seed, {}

    def vector(self, code: int) -> np.ndarray:
        v = self.known.get(code)
        if v is None:
            bits = np.random.default_rng((self.seed, code)).integers(0, 2, self.dims, dtype=np.int8)
            v = self.known[code] = bits * 2 - 1
        return v


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram number) of every trigram, and the distinct trigrams' three code points."""
    lower = [t.lower() for t in texts]
    joined = "".join(f"\x00{t}\x00" for t in lower)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, lower), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), lens + 2)
    present = np.flatnonzero(np.bincount(code)) if len(code) else np.zeros(0, np.int64)
    letters = np.array([c for c in present.tolist() if chr(c).isalpha()], np.int64)
    table = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
    table[letters] = np.arange(1, len(letters) + 1)
    sym = table[code]
    # of a run of other characters one stays, so that every text starts and ends with one
    edge = np.ones(len(sym), bool)
    if len(sym) > 1:
        edge[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (doc[1:] != doc[:-1])
    sym, doc = sym[edge], doc[edge]
    k = len(letters) + 1
    if len(sym) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    ids = (sym[:-2] * k + sym[1:-1]) * k + sym[2:]
    same = (doc[:-2] == doc[2:]) & (sym[:-2] + sym[1:-1] + sym[2:] > 0)
    ids, doc = ids[same], doc[:-2][same]
    if k <= DIRECT:
        found = np.flatnonzero(np.bincount(ids, minlength=1)) if len(ids) else np.zeros(0, np.int64)
        back = np.zeros(k**3, np.int64)
        back[found] = np.arange(len(found))
        num = back[ids]
    else:
        found, num = np.unique(ids, return_inverse=True)
    points = np.concatenate([[0], letters])
    return doc, num, np.stack([points[found // (k * k)], points[found // k % k], points[found % k]], 1)


def bound(letters: Letters, codes: np.ndarray) -> np.ndarray:
    """float32 vectors of trigrams: rotate and multiply."""
    if not len(codes):
        return np.zeros((0, letters.dims), np.float32)
    used, at = np.unique(codes, return_inverse=True)
    at = at.reshape(codes.shape)
    v = np.stack([letters.vector(int(c)) for c in used])
    return (np.roll(v, 2, 1)[at[:, 0]] * np.roll(v, 1, 1)[at[:, 1]] * v[at[:, 2]]).astype(np.float32)


def bundled(letters: Letters, rows: int, row: np.ndarray, num: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sum of the trigrams' vectors for each row, a bounded number of different trigrams at a time."""
    if len(codes) > TRIGRAMS:  # else all are in one piece, and need no order
        by = np.argsort(num, kind="stable")
        row, num = row[by], num[by]
    out = np.zeros((rows, letters.dims))
    for lo in range(0, len(codes), TRIGRAMS):
        a, b = np.searchsorted(num, [lo, lo + TRIGRAMS]) if len(codes) > TRIGRAMS else (0, len(num))
        width = min(TRIGRAMS, len(codes) - lo)
        part = np.bincount(row[a:b] * width + num[a:b] - lo, minlength=rows * width).reshape(rows, width).astype(np.float32)
        out += part @ bound(letters, codes[lo : lo + width])
    return out


def learn(docs: DataFrame, dims: int = DIMENSIONS, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from docs' text and non-null lang."""

    def run(batches) -> Iterator[dict]:
        letters, sums = Letters(dims, seed), {}
        for whole in batches:
            for b in slices(whole, "text", BATCH_BYTES, BATCH_ROWS):
                langs = b.column(1).to_pylist()
                names = sorted(set(langs))
                number = {x: i for i, x in enumerate(names)}
                doc, num, codes = trigrams([t or "" for t in b.column(0).to_pylist()])
                which = np.array([number[x] for x in langs], np.int64)
                part = bundled(letters, len(names), which[doc], num, codes)
                for x, v in zip(names, part, strict=True):
                    sums[x] = sums.get(x, 0) + v.round().astype(np.int64)
        for x, v in sums.items():
            yield {"lang": [x] * dims, "at": np.arange(dims), "v": v}

    train = docs.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    total = arrow_map(train, run, "lang string, at int, v long").groupBy("lang", "at").agg(F.sum("v").alias("v")).collect()
    names = sorted({r["lang"] for r in total})
    out = np.zeros((len(names), dims))
    for r in total:
        out[names.index(r["lang"]), r["at"]] = r["v"]
    return names, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, seed: int = 11) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs; score is (1 + cosine) / 2."""
    protos = prototypes.astype(np.float32)

    def run(batches) -> Iterator[dict]:
        letters = Letters(protos.shape[1], seed)
        for whole in batches:
            for b in slices(whole, "text", BATCH_BYTES, BATCH_ROWS):
                doc, num, codes = trigrams([t or "" for t in b.column(1).to_pylist()])
                n = b.num_rows
                if not names or not len(codes):
                    yield {"doc_id": b.column(0), "lang_pred": ["und"] * n, "score": [0.0] * n}
                    continue
                v = bundled(letters, n, doc, num, codes)
                cos = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) @ protos.T
                best = cos.argmax(1)
                known = np.bincount(doc, minlength=n) > 0
                score = np.where(known, np.clip((1 + cos[np.arange(n), best].astype(float)) / 2, 0, 1), 0.0)
                yield {"doc_id": b.column(0), "lang_pred": [names[i] if k else "und" for i, k in zip(best.tolist(), known.tolist(), strict=True)], "score": score}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, lang_pred string, score double")


def language_of(docs: DataFrame, folds: int = 3, fold: int = 1, dims: int = DIMENSIONS) -> DataFrame:
    """Predictions for all of docs, learned from the documents outside the fold."""
    names, prototypes = learn(docs.where(~held(F.col("doc_id"), folds, fold)), dims)
    out = identify(docs, names, prototypes)
    return out.select("doc_id", held(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")
