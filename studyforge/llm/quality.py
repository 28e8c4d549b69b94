"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's counts of hashed words, word shapes (case, ending, whether the word repeats the one
before it), pairs of shapes and byte-class trigrams are weighted by rarity, made unit length
block by block and projected by a truncated singular value decomposition, fitted on a
bounded sample of labelled rows. The sample's vectors and labels are sent to all tasks (its
bound times 64 numbers); each task multiplies its documents' vectors with all of them, block
by block, and the nearest ones vote with a power of their cosine.

Inputs of a score are the texts alone. Defined results: null or empty texts, and any text
when there is nothing to learn from, score the share of label 1 in the balanced sample (0.5
if none); repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices
from .language_id import held
from .words import mix64, words_of

#: Columns of the blocks: words, shapes, pairs of shapes, byte-class trigrams.
BLOCKS = (1024, 512, 1024, 1536)
BLOCK_WEIGHTS = (0.4, 1.0, 1.0, 0.7)
WIDTH = sum(BLOCKS)
#: Most labelled rows that are learned from, for each label value.
SAMPLE = 2_500
RANK = 64
NEAREST = 25
POWER = 6
THRESHOLD = 0.3
BATCH_BYTES = 500_000
#: Texts whose features, a dense row each, are held at a time.
BATCH_ROWS = 1_000


def _classes() -> np.ndarray:
    """Byte classes: lower, upper, digit, space, line break, other letters' bytes, and each mark by itself."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = 5 if b >= 128 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() or b < 32 else 6 + b % 32
    return out


CLASSES = _classes()


def features(texts: list[str]) -> np.ndarray:
    """Counts, a row for each text."""
    n = len(texts)
    w = words_of(texts)
    d, cls = w.data, CLASSES[w.data]
    first, last = cls[w.start], cls[w.end - 1]
    second = cls[np.minimum(w.start + 1, w.end - 1)]
    again = np.zeros(len(w.doc), np.int64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    shape = ((first * 40 + second) * 40 + last) * 2 + again
    fold = lambda x, k, salt: (mix64(x.astype(np.uint64) * np.uint64(2) + np.uint64(salt)) % np.uint64(k)).astype(np.int64)
    same = w.doc[1:] == w.doc[:-1]
    pair = (shape[:-1] * 128_000 + shape[1:])[same]
    ends = np.cumsum(np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts), np.int64, n))
    at = np.searchsorted(ends, np.arange(len(d)), "right")
    tri = (cls[:-2] * 40 + cls[1:-1]) * 40 + cls[2:]
    inside = at[:-2] == at[2:]
    out = np.zeros((n, WIDTH), np.float32)
    base = 0
    for k, (doc, col) in zip(BLOCKS, ((w.doc, fold(w.hash, BLOCKS[0], 0)), (w.doc, fold(shape, BLOCKS[1], 1)), (w.doc[1:][same], fold(pair, BLOCKS[2], 0)), (at[:-2][inside], fold(tri[inside], BLOCKS[3], 1))), strict=True):
        out[:, base : base + k] = np.bincount(doc * k + col, minlength=n * k).reshape(n, k)
        base += k
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(weigh(counts, self.idf) @ self.basis)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Weighted vote of the nearest labelled vectors."""
        n = len(counts)
        if not len(self.labels):
            return np.full(n, self.prior)
        v = self.project(counts)
        k = min(NEAREST, len(self.labels))
        out = np.empty(n)
        for lo in range(0, n, 256):
            cos = v[lo : lo + 256] @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0.0).astype(float) ** POWER
            out[lo : lo + 256] = ((w * self.labels[near]).sum(1) + 1e-6 * self.prior) / (w.sum(1) + 1e-6)
        return np.clip(out, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x, base = np.log1p(counts) * idf, 0
    for k, w in zip(BLOCKS, BLOCK_WEIGHTS, strict=True):
        x[:, base : base + k] = _unit(x[:, base : base + k]) * np.float32(w)
        base += k
    return x


def fit(counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """Rarity weights, truncated SVD (randomised, fixed seed) and the labelled vectors."""
    if not len(labels):
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.3).astype(np.float32)
    x = weigh(counts, idf)
    k = min(rank + 16, *x.shape)
    q = np.linalg.qr(x @ np.random.default_rng(3).standard_normal((WIDTH, k)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
    return Model(idf, basis, _unit(x @ basis), labels.astype(np.float64), float(labels.mean()))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from at most `sample` labelled rows of each label, chosen by a hash of doc_id.

    docs and labels: what may be learned from; labels other than 0 and 1 are passed over.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).where(F.col("_id").isNotNull())
    some = [marked.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1)]
    # at most 2 * sample rows
    chosen = F.broadcast(some[0].unionByName(some[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(chosen, "_id").select("_y", "_id", "text")

    def run(batches) -> Iterator[dict]:
        for whole in batches:
            for b in slices(whole, "text", BATCH_BYTES, BATCH_ROWS):
                m = features([t or "" for t in b.column(2).to_pylist()])
                at = [np.flatnonzero(r) for r in m]
                yield {"y": b.column(0), "id": b.column(1), "at": at, "v": [r[i] for r, i in zip(m, at, strict=True)]}

    got = arrow_map(rows, run, "y int, id long, at array<int>, v array<float>").toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")[: 2 * sample]
    counts = np.zeros((len(order), WIDTH), np.float32)
    at, v = got["at"].combine_chunks(), got["v"].combine_chunks()
    for i, k in enumerate(order.tolist()):
        counts[i, at[k].values.to_numpy()] = v[k].values.to_numpy()
    return fit(counts, got["y"].to_numpy()[order])


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, learned outside the fold."""
    model = learn(docs.where(~held(F.col("doc_id"), folds, fold)), labels.where(~held(F.col("doc_id"), folds, fold)), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[dict]:
        for whole in batches:
            for b in slices(whole, "text", BATCH_BYTES, BATCH_ROWS):
                yield {"doc_id": b.column(0), "score": shared.value.score(features([t or "" for t in b.column(1).to_pylist()]))}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = arrow_map(rows, run, "doc_id long, score double")
    return out.select("doc_id", held(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject, with docs' columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [shared.value.score(features([t or "" for t in b.column(0).to_pylist()])) for b in slices(whole, "text", BATCH_BYTES, BATCH_ROWS)]
        return pa.array(np.concatenate(parts), pa.float64())

    return docs.where(score(F.col("text").cast("string")) >= THRESHOLD)
