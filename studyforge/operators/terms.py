"""Searches for a table of terms of any size: an automaton over blocks of terms, in one pass over the texts.

The automaton of a block is built in each worker process; a table that outgrows BLOCK_CHARS is
split by hash into blocks, each a pass of its own, so a task holds one block at a time. Texts are
neither shuffled nor compared with each term.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the terms that one automaton holds, about; the driver reads a block at a time.
BLOCK_CHARS = 4_000_000
#: Characters of text that are counted in one go.
CHUNK = 500_000

_AUTOMATA: dict = {}


def automaton(terms: tuple[str, ...]):
    """Automaton of a block, kept by the worker process until another block comes."""
    if terms not in _AUTOMATA:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            found.add_word(t, i)
        found.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[terms] = found
    return _AUTOMATA[terms]


def term_blocks(terms: DataFrame, column: str = "term") -> Iterator[tuple[str, ...]]:
    """The distinct, not empty terms in blocks."""
    own = terms.select(F.col(column).alias("term")).where("length(term) > 0").distinct()
    total = own.agg(F.sum(F.length("term"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    for b in range(blocks):
        got = tuple(sorted(r[0] for r in own.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).toLocalIterator()))
        if got:
            yield got


def contained(texts: DataFrame, terms: DataFrame, id_column: str, text_column: str, along: list[str] | None = None) -> DataFrame:
    """id, term and the columns `along` of every distinct term (column term) that a text contains; null texts contain none."""
    spark = texts.sparkSession
    own = [F.col(c) for c in along or []]
    rows, out = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *own).where("text IS NOT NULL"), None
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema) + ", term string"
    names = [*rows.drop("text").columns, "term"]

    for block in term_blocks(terms):

        def run(batches, block=block):
            found = automaton(block)
            for b in batches:
                at, hits = [], []
                for k, t in enumerate(b.column(1).to_pylist()):
                    own = {v for _, v in found.iter(t)}
                    at += [k] * len(own)
                    hits += [block[v] for v in sorted(own)]
                kept = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(kept.columns) if i != 1), pa.array(hits, pa.string())], names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def first_key(texts: DataFrame, keys: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, place: the smallest place (keys: place, term) of a term that each text contains; texts with none are left out.

    Terms given twice count by their first place. Places, not pairs, leave a pass.
    """
    spark = texts.sparkSession
    kind = texts.schema[id_column].dataType.simpleString()
    own = keys.where("length(term) > 0").groupBy("term").agg(F.min("place").cast("long").alias("place"))
    total = own.agg(F.sum(F.length("term"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    rows, out = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL"), None
    for k in range(blocks):
        got = {r["term"]: r["place"] for r in own.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).toLocalIterator()}
        if not got:
            continue
        block = tuple(sorted(got))
        places = [got[t] for t in block]

        def run(batches, block=block, places=places):
            found = automaton(block)
            for b in batches:
                best = [min((places[v] for _, v in found.iter(t)), default=None) for t in b.column(1).to_pylist()]
                at = [i for i, p in enumerate(best) if p is not None]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([best[i] for i in at], pa.int64())], ["id", "place"])

        part = rows.mapInArrow(run, f"id {kind}, place long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"id {kind}, place long")
    return out if blocks == 1 else out.groupBy("id").agg(F.min("place").alias("place"))


@lru_cache(1 << 16)
def keeps_apart(term: str) -> bool:
    """Whether a term's occurrences never overlap: no beginning of it is an end of it too."""
    return not any(term.endswith(term[:k]) for k in range(1, len(term)))


def piece_step(term: str, starts: list[int], piece: str) -> list[tuple[int, int]]:
    """What a piece does to the count of a term, for each number s of the term's characters that stand open before it.

    Returns (occurrences that end in the piece, characters open after it) for s = 0 .. len(term) - 1;
    starts are the places of all, also overlapping, occurrences inside the piece. Occurrences
    are taken from the left and do not overlap, as if the whole text were one.
    """
    m, out, known, apart = len(term), [], {}, keeps_apart(term)

    def rest(pos: int) -> tuple[int, int]:
        """Occurrences from pos on, and the end of the last one."""
        if apart:
            i = bisect_left(starts, pos)
            return (len(starts) - i, starts[-1] + m) if i < len(starts) else (0, pos)
        path = []
        while pos not in known:
            i = bisect_left(starts, pos)
            if i == len(starts):
                known[pos] = (0, pos)
                break
            path.append(pos)
            pos = starts[i] + m
        n, end = known[pos]
        for k, p in enumerate(reversed(path), 1):
            known[p] = (n + k, end)
        return n + len(path), end

    for s in range(m):
        across = (term[:s] + piece[: m - 1]).find(term) if s else -1
        n, end = rest(across + m - s) if 0 <= across < s else rest(0)
        crossed = 0 <= across < s
        left = piece[max(end, len(piece) - m + 1) :] if crossed or end else (term[:s] + piece)[-(m - 1) :] if m > 1 else ""
        out.append((n + crossed, next(k for k in range(min(m - 1, len(left)), -1, -1) if left.endswith(term[:k]))))
    return out


def composed(first: list[tuple[int, int]], then: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(n + then[s][0], then[s][1]) for n, s in first]


def whole_counts(texts: DataFrame, terms: DataFrame, order: str, text_column: str) -> DataFrame:
    """term, n: occurrences of each distinct term in the texts written one after the other by `order`.

    Occurrences are counted from the left without overlap and may cross from one text into the next, or over several.
    Texts are range-partitioned by their order; a task makes of its texts one step for each term, a
    function from open characters to (count, open characters), and the steps of all partitions are composed in order: a row for each term and
    partition. Rows of equal order have none among them. Null texts count as empty.
    """
    from pyspark import TaskContext

    rows = texts.select(F.col(order).alias("at"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    placed = rows.repartitionByRange(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at").sortWithinPartitions("at").select("text")
    step, out = "array<struct<n:bigint,open:int>>", None
    for block in term_blocks(terms):

        def run(batches, block=block):
            found, steps = automaton(block), [[(0, s) for s in range(len(t))] for t in block]
            before = [len(t) - 1 for t in block]

            def add(piece: str) -> None:
                starts: list[list[int]] = [[] for _ in block]
                for end, v in found.iter(piece):
                    starts[v].append(end - before[v])
                for i, t in enumerate(block):
                    steps[i] = composed(steps[i], piece_step(t, starts[i], piece))

            held, size = [], 0
            for b in batches:
                for t in b.column(0).to_pylist():
                    held.append(t)
                    size += len(t)
                    if size >= CHUNK:
                        add("".join(held))
                        held, size = [], 0
            add("".join(held))
            part = TaskContext.get().partitionId()
            for i in range(0, len(block), 10_000):
                some = steps[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(block[i : i + 10_000], pa.string()), pa.array([part] * len(some), pa.int32()), pa.array([[{"n": n, "open": s} for n, s in x] for x in some], pa.list_(pa.struct([("n", pa.int64()), ("open", pa.int32())])))], ["term", "part", "step"])

        part = placed.mapInArrow(run, f"term string, part int, step {step}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return texts.sparkSession.createDataFrame([], "term string, n long")
    steps = F.array_sort(F.collect_list(F.struct("part", "step")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("open"))

    def go(acc, x):
        then = F.element_at(x["step"], acc["open"] + 1)
        return F.struct((acc["n"] + then["n"]).alias("n"), then["open"].alias("open"))

    return out.groupBy("term").agg(F.aggregate(steps, start, go)["n"].alias("n"))
