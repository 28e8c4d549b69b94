"""Merkle-tree fingerprints of documents, sections and paragraphs.

A text is cut into paragraphs at newlines and these into leaves of at most 32 characters
that end at a space or sentence end. A paragraph's hash is made from its leaves' 64-bit hashes,
a section's from its paragraphs', the root's from its sections'. A section ends after a
paragraph whose hash is 0 mod 4, so an edit moves no later section's borders. Equal texts
have equal roots; from unequal roots, unequal branches lead to the edited leaves.

A fingerprint is written root|section:paragraph=leaf.leaf;paragraph=...|section:..., with the
first half of each leaf's hash; the likeness of two is 2 * common leaves / all leaves, counted
with repeats. It is 1 for equal roots alone: where the same leaves stand in another order, it
is 1 - 1 / (1 + all leaves).

Defined results: null text counts as empty, whose fingerprint has no section; two empty
texts are alike to 1.0; documents with equal doc_id are ordered by text; the document after
the last is the first, so a single row is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut

LEAF = re.compile(r"[^.!?\s][^.!?]{0,30}?[.!?]+\s*|.{1,31}(?:\s+|$)|.{1,32}", re.S)
#: Rows that one range of doc_ids is meant to hold.
RANGE_ROWS = 1_000
#: With more rows than these ranges hold, ranges grow; their rows are sorted on disk and streamed.
MOST_RANGES = 20_000
SAMPLE = 16


def _digest(data: bytes, size: int) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


class Tree:
    """sections: [(hash, [(hash, [leaf hash, ...]), ...]), ...]."""

    def __init__(self, text: str):
        self.sections: list[tuple[str, list[tuple[str, list[str]]]]] = []
        open_: list[tuple[str, list[str]]] = []
        for line in text.split("\n") if text else []:
            full = [_digest(x.encode("utf-8", "surrogatepass"), 8) for x in LEAF.findall(line)]
            h = _digest("".join(full).encode(), 8)
            open_.append((h, [x[:8] for x in full]))
            if int(h[:2], 16) % 4 == 0:
                self._close(open_)
                open_ = []
        if open_:
            self._close(open_)
        self.root = _digest("".join(h for h, _ in self.sections).encode(), 16)

    def _close(self, paragraphs) -> None:
        self.sections.append((_digest("".join(h for h, _ in paragraphs).encode(), 8), paragraphs))

    def __str__(self) -> str:
        return "|".join([self.root, *(f"{h}:{';'.join(f'{p}={".".join(leaves)}' for p, leaves in ps)}" for h, ps in self.sections)])

    def leaves(self) -> Counter:
        return Counter(x for _, ps in self.sections for _, leaves in ps for x in leaves)


def parse(fingerprint: str) -> list[tuple[str, list[tuple[str, list[str]]]]]:
    """Sections of a written fingerprint, as in Tree."""
    out = []
    for s in fingerprint.split("|")[1:]:
        h, _, ps = s.partition(":")
        out.append((h, [(p, x.split(".") if x else []) for p, _, x in (q.partition("=") for q in ps.split(";"))]))
    return out


def edited_branches(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) numbers of a whose branches are not in b; equal roots and sections are not descended."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return []
    theirs = parse(b)
    sections, paragraphs = {h for h, _ in theirs}, {p for _, ps in theirs for p, _ in ps}
    return [(i, j) for i, (h, ps) in enumerate(parse(a)) if h not in sections for j, (p, _) in enumerate(ps) if p not in paragraphs]


def likeness(a: Tree, b: Tree, la: Counter, lb: Counter) -> float:
    if a.root == b.root:
        return 1.0
    total = sum(la.values()) + sum(lb.values())
    # leaves in another order are no equal texts
    return min(2.0 * sum((la & lb).values()) / total, 1.0 - 1.0 / (1 + total)) if total else 0.0


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of docs."""

    def run(batches) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column(0), "fingerprint": [str(Tree(t or "")) for t in b.column(1).to_pylist()]}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches) -> Iterator[dict]:
    blank = lambda: {k.split()[0]: [] for k in OUT.split(", ")}
    out, size, prev = blank(), 0, None
    for b in batches:
        for place, heir, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            now = (place, doc, text, Tree(text))
            if prev is not None and prev[0] == place:
                _, pid, old, tree = prev
                n = len(old)
                new = old[: n - n // 2] + text[: n // 2]
                edited = Tree(new)
                la = tree.leaves()
                row = (pid, n, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), str(tree), str(edited), likeness(tree, edited, la, edited.leaves()), likeness(tree, now[3], la, now[3].leaves()))
                for col, v in zip(out.values(), row, strict=True):
                    col.append(v)
                size += n
            prev = None if heir else now
        if size > 1_000_000:
            yield out
            out, size = blank(), 0
    if out["doc_id"]:
        yield out


def _borders(rows: DataFrame) -> list[int]:
    """Borders between ranges of doc_ids, from a hash sample of SAMPLE ids a range; they even out tasks, no more."""
    total = rows.count()
    ranges = min(MOST_RANGES, -(-total // RANGE_ROWS))
    every = max(1, total // max(1, ranges * SAMPLE))
    ids = sorted(r[0] for r in rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).where(F.col("doc_id").isNotNull()).select("doc_id").distinct().limit(2 * MOST_RANGES * SAMPLE).collect())
    return sorted({ids[i * len(ids) // ranges] for i in range(1, ranges)}) if len(ids) > ranges > 1 else []


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to it and to the next document's.

    Documents are dealt to ranges of doc_id and sorted there; each range also gets a copy of
    the next range's first document, so no window spans the table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    borders = np.array(_borders(rows), np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(borders) + 1, np.int32)
        out[known] = np.searchsorted(borders, ids[known].astype("int64").to_numpy(), "right")
        return pd.Series(out)

    placed = rows.withColumn("place", place("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text")
    from pyspark.sql import Window as W

    # a row per range: its first document, which ends the range before it; the first of all ends the last
    firsts = cut(placed.groupBy("place").agg(F.min(order).alias("f")).select("place", F.col("f.doc_id").alias("doc_id"), F.col("f.text").alias("text")), "firsts")
    by = W.orderBy("place")
    places = firsts.select("place").withColumn("before", F.lag("place").over(by)).withColumn("before", F.coalesce("before", F.max("place").over(W.partitionBy())))
    heirs = firsts.join(places, "place").select(F.col("before").alias("place"), F.lit(True).alias("heir"), "doc_id", "text")
    both = placed.select("place", F.lit(False).alias("heir"), "doc_id", "text").unionByName(heirs)
    dealt = both.repartition(len(borders) + 2, "place").sortWithinPartitions("place", "heir", F.col("doc_id").asc_nulls_last(), "text")
    return arrow_map(dealt, _compare, OUT)
