"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents are to be taken target / source_size times each: the whole part is
certain, the fraction is a copy probability. Two fractional documents at a time trade word
mass, at random but with unchanged expectations, until one of them is 0 or 1, so the words
taken stay what they were. Long documents go first, so that what is left over at the end is
mostly part of a short one; a long one that is left is made whole by shorter ones of its leaf,
which take the difference and leave a short one open. Leaves
(source, hash of doc_id) round on their own; each sends its one fractional document up a
reduction tree that merges sixteen leaves at a time, down to one per source, where the last
one is rounded to the nearer side and shorter documents at hand take the difference.

All randomness is a hash of the seed and the pair's doc_ids, and leaves depend on the data
only, so reruns agree. Defined results: null text has size 0; documents without words are
taken 0 words; a null source is a source of its own, last in order; repeated rows are
separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

#: Default weights, repeated over the sources in code-point order.
WEIGHTS = (5.0, 2.0, 1.0)
LEAF_ROWS = 4_000
FAN = 16


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Share out sum(sizes) by weight; no target exceeds most * size, the excess is reshared."""
    total, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def _chance(seed: int, *parts) -> float:
    h = hashlib.blake2b(repr((seed, *parts)).encode(), digest_size=8).digest()
    return int.from_bytes(h, "little") / 2**64


def pivot(ids: list, sizes: list[int], probs: list[float], seed: int) -> list[float]:
    """Round probs pairwise; sum(size * prob) is kept, all but at most one end as 0 or 1."""
    p, open_ = list(probs), None
    eps = 1e-9
    for i in range(len(p)):
        if p[i] < eps or p[i] > 1 - eps:
            p[i] = float(round(p[i]))
            continue
        if open_ is None:
            open_ = i
            continue
        a, b = open_, i
        # words that can go from b to a, and from a to b
        up = min((1 - p[a]) * sizes[a], p[b] * sizes[b])
        down = min(p[a] * sizes[a], (1 - p[b]) * sizes[b])
        shift = up if _chance(seed, ids[a], ids[b], a, b) < down / (up + down) else -down
        p[a] += shift / sizes[a]
        p[b] -= shift / sizes[b]
        open_ = None
        for k in (a, b):
            if p[k] < eps or p[k] > 1 - eps:
                p[k] = float(round(p[k]))
            else:
                open_ = k
    return p


def hand_down(sizes: list[int], probs: list[float], rounded: list[float], chance: float) -> list[float]:
    """Make the open document whole, if shorter ones can take the difference; one of these stays open instead.

    sum(size * prob) is kept. The document is taken with the chance that it has left.
    """
    open_ = [i for i, x in enumerate(rounded) if 0 < x < 1]
    if len(open_) != 1:
        return rounded
    i, p, holder = open_[0], list(rounded), None
    p[i] = float(chance < rounded[i])
    extra = sizes[i] * (p[i] - rounded[i])
    others = (j for j in range(len(p)) if 0 < probs[j] < 1 and 0 < sizes[j] < sizes[i] and rounded[j] == (extra > 0))
    for j in sorted(others, key=lambda j: -sizes[j]):
        if sizes[j] > abs(extra):
            holder = j
        else:
            p[j] = 1.0 - p[j]
            extra -= sizes[j] if extra > 0 else -sizes[j]
    if abs(extra) > 1e-6:
        if holder is None:
            return rounded
        p[holder] -= extra / sizes[holder]
    return p


def settle(sizes: list[int], probs: list[float], rounded: list[float]) -> list[float]:
    """Round what is still open to the nearer side and return its words, largest first, through other documents at hand."""
    p = [float(round(x)) for x in rounded]
    extra = sum(n * (a - b) for n, a, b in zip(sizes, p, rounded, strict=True))
    for i in sorted(range(len(p)), key=lambda i: -sizes[i]):
        if rounded[i] in (0.0, 1.0) and 0 < probs[i] < 1 and 0 < sizes[i] <= abs(extra) and p[i] == (extra > 0):
            p[i] = 1.0 - p[i]
            extra -= sizes[i] if extra > 0 else -sizes[i]
    return p


CELL = "row long, doc_id long, source string, size long, whole long, prob double, leaf long"


def _round_leaf(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "row"], ascending=[False, True, True], na_position="last", kind="stable").reset_index(drop=True)
        ids, sizes = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]], pdf["size"].astype(int).tolist()
        p = pivot(ids, sizes, pdf["prob"].tolist(), seed)
        # a long document that short ones could not fill would be rounded alone at the top
        p = hand_down(sizes, pdf["prob"].tolist(), p, _chance(seed, "down", *ids[:1], len(ids)))
        if last:  # the document that no other can trade with goes to the nearer side
            p = settle(sizes, pdf["prob"].tolist(), p)
        pdf["prob"] = p
        return pdf

    return run


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and two hashes of the text of every row, and the row itself as `doc`."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("again"), text).alias("h2"), F.struct("*").alias("doc"))


def _named(sized: DataFrame) -> DataFrame:
    """sized with `row`, a number that names a row by its text and its rank among equal rows, the same in every run."""
    from pyspark.sql import Window as W

    same = F.row_number().over(W.partitionBy("doc_id", "source", "size", "h1", "h2").orderBy(F.lit(1)))
    return sized.withColumn("row", F.xxhash64("h1", "h2", same)).drop("h1", "h2")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """row, doc_id, source, size, source_size, target, copies, taken for every row of docs.

    `row` tells rows of equal doc_ids apart, by hashes of their texts and, for equal texts, by rank, so that
    reruns take the same texts. The driver holds a row per source, nothing per document.
    """
    base = _named(cut(_sized(docs).drop("doc"), "mix-sizes"))
    sums = sorted(((r["source"], r["words"], r["n"]) for r in base.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    want = targets([x[1] for x in sums], [weights[i % len(weights)] for i in range(len(sums))], most)
    schema = "source string, source_size long, target double, leaves long"
    plan = [(s, n, t, max(1, -(-k // LEAF_ROWS))) for (s, n, k), t in zip(sums, want, strict=True)]
    per = docs.sparkSession.createDataFrame(plan, schema)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # the plan has a row per source, as the driver's list above
    rows = base.join(F.broadcast(per.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("copies", copies)
    rows = rows.withColumn("whole", F.floor(F.col("copies") + 1e-12).cast("long"))
    rows = rows.withColumn("prob", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("copies") - F.col("whole"))).otherwise(0.0))
    cells = rows.withColumn("leaf", F.pmod(F.xxhash64("doc_id", "size", "row"), F.col("leaves")))
    names = [c.split()[0] for c in CELL.split(", ")]
    depth = max([p[3] for p in plan], default=1)
    level = cells.select(*names)
    done = None
    k = 0
    while True:
        last = depth <= 1
        level = cut(level.groupBy("source", "leaf").applyInPandas(_round_leaf(seed + k, last), CELL), "mix-level")
        whole = level.where(F.col("prob").isin(0.0, 1.0))
        done = whole if done is None else done.unionByName(whole)
        if last:
            break
        level = level.where(~F.col("prob").isin(0.0, 1.0)).withColumn("leaf", F.floor(F.col("leaf") / FAN).cast("long"))
        depth, k = -(-depth // FAN), k + 1
    out = done.join(F.broadcast(per.select(F.col("source").alias("_s"), "source_size", "target")), F.col("source").eqNullSafe(F.col("_s")))
    n = (F.col("whole") + F.col("prob").cast("long")).alias("copies")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", n, (n * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with docs' columns."""
    counts = mix(docs, **options).where("copies > 0").select(F.col("row").alias("their_row"), F.col("doc_id").alias("their_id"), F.col("source").alias("their_source"), F.col("size").alias("their_size"), "copies")
    # the row goes along whole, so that its columns may have any names
    keyed = _named(_sized(docs)).withColumnRenamed("doc_id", "id")
    on = F.col("id").eqNullSafe(F.col("their_id")) & F.col("source").eqNullSafe(F.col("their_source")) & (F.col("size") == F.col("their_size")) & (F.col("row") == F.col("their_row"))
    taken = keyed.join(counts, on)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
