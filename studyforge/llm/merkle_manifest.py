"""Merkle manifest of a data set: a mountain-range stack for each indexed partition, merged over partitions.

Every row is a leaf. The leaves of a list (a source's rows by doc_id) are range-partitioned by
their order and indexed from 0. Each partition walks its leaves with a stack that has the
unfinished run of every level: when a run of `fanout` children is full, its parent is hashed and
carried to the next level, as in counting to the base of the fanout. A run that starts before a partition,
or does not end in it, leaves its children open. The open nodes of all partitions, few for each, are then
merged level by level: joined by parent, hashed, and carried on. The last run of a list is hashed as it
is, without padding. What remains of each source is the list of a second tree, over the sources.

Proofs go from the roots down: a node's path is its siblings, then its parent's path, so that each
level joins its runs with the parents' paths (a parent's run has `fanout` children at most, so no key is hot).

Defined results: null fields are hashed as `-`; a null source is a list of its own and comes first; null ids come first
in their list; rows of equal doc_id are ordered by their leaves; equal rows are leaves each; a source of one row is its
own subroot, without siblings, and if it is the only source, its proof is the hash of nothing. Ids that are null are not
tampered with. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables

FANOUT = 16
#: Leaves of one indexed partition, about.
RANGE_ROWS = 100_000


def netted(*fields: Column) -> Column:
    """Fields in their hashed form: `-`, or byte count, colon and value, one after the other."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.concat(*parts)


def leaf_of(text: Column) -> Column:
    """Leaf of a row of documents, with this text."""
    c = F.col
    return F.sha2(netted(c("doc_id"), c("source"), c("lang"), c("n_chars"), text).cast("binary"), 256)


class MountainRange:
    """Stack of unfinished runs, one for each level, over nodes that come in order of their index.

    `record(level, index, digest, open)` gets every node once its parent is made here, or is known not to be.
    """

    def __init__(self, fanout: int, record: Callable[[int, int, str, bool], None]):
        self.fanout, self.record = fanout, record
        self.runs: list[list[tuple[int, str]]] = []

    def push(self, index: int, digest: str, level: int = 0) -> None:
        if level == len(self.runs):
            self.runs.append([])
        run = self.runs[level]
        run.append((index, digest))
        if index % self.fanout == self.fanout - 1:
            whole = len(run) == self.fanout
            peak = hashlib.sha256("".join(d for _, d in run).encode()).hexdigest() if whole else ""
            self._close(level, not whole)
            if whole:
                self.push(index // self.fanout, peak, level + 1)

    def _close(self, level: int, is_open: bool) -> None:
        for i, d in self.runs[level]:
            self.record(level, i, d, is_open)
        self.runs[level] = []

    def end(self) -> None:
        for level in range(len(self.runs)):
            self._close(level, True)


def _stacks(fanout: int):
    """All nodes that a partition's part of a list makes, with its leaves."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        start = t.column("start")[0].as_py()
        seen: list[list] = [[], [], [], []]
        stack = MountainRange(fanout, lambda *node: [c.append(v) for c, v in zip(seen, node, strict=True)])
        for k, digest in enumerate(t.column("digest").to_pylist()):
            stack.push(start + k, digest)
        stack.end()
        # a level's nodes are recorded in order, so the leaves' payload follows from their index
        row = pa.array([i - start if level == 0 else None for level, i in zip(seen[0], seen[1], strict=True)], pa.int64())
        key = t.column("key")[0].as_py()
        return pa.table({
            "key": pa.array([key] * len(row), pa.string()),
            "level": pa.array(seen[0], pa.int32()),
            "index": pa.array(seen[1], pa.int64()),
            "digest": pa.array(seen[2], pa.string()),
            "open": pa.array(seen[3], pa.bool_()),
            "doc_id": t.column("doc_id").combine_chunks().take(row),
            "source": t.column("source").combine_chunks().take(row),
            "changed": t.column("changed").combine_chunks().take(row),
        })

    return run


LEAVES = ("doc_id", "source", "changed")
NODES = "key string, level int, index long, digest string, open boolean, doc_id long, source string, changed string"


class Forest:
    """Trees over lists of leaves: nodes, and the height and size of each list.

    leaves: key (list), digest, doc_id, source, changed. The order within a key is by `order`; further ties do not matter.
    """

    def __init__(self, leaves: DataFrame, order: list[str], fanout: int, tables: Tables):
        self.fanout = fanout
        self.nodes, self.lists, self.top = self._build(leaves, order, tables)

    def _build(self, leaves: DataFrame, order: list[str], tables: Tables):
        spark = leaves.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // RANGE_ROWS))
        ranged = leaves.repartitionByRange(parts, "key", *order).sortWithinPartitions("key", *order)
        spent = Tables()
        placed = spent.cut(ranged.withColumn("at", F.monotonically_increasing_id()), "manifest-order").withColumn("part", F.shiftright("at", 33))
        runs = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
        before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        starts = runs.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        walked = placed.join(starts, ["key", "part"]).groupBy("key", "part").applyInArrow(_stacks(self.fanout), NODES)
        nodes = tables.cut(walked, "manifest-nodes")
        powers = [self.fanout**i for i in range(16) if self.fanout**i < 1 << 62]
        height = sum(((F.col("n") > p).cast("int") for p in powers[1:]), (F.col("n") > 1).cast("int"))
        lists = tables.cut(runs.groupBy("key").agg(F.sum("n").alias("n")).withColumn("height", height), "manifest-lists")
        spent.clear()
        top = lists.agg(F.max("height")).first()[0] or 0
        merged = None
        for level in range(top):
            open_ = nodes.where(F.col("open") & (F.col("level") == level)).select("key", "index", "digest")
            if merged is not None:
                open_ = open_.unionByName(merged)
            waiting = open_.join(lists.where(F.col("height") > level).select("key"), "key", "left_semi")
            run = F.array_sort(F.collect_list(F.struct("index", "digest")))
            made = waiting.groupBy("key", F.expr(f"index div {self.fanout}").alias("parent")).agg(run.alias("run"))
            digest = F.sha2(F.array_join(F.transform("run", lambda m: m["digest"]), "").cast("binary"), 256)
            merged = tables.cut(made.select("key", F.col("parent").alias("index"), digest.alias("digest")), "manifest-merged")
            more = merged.select("key", F.lit(level + 1).alias("level"), "index", "digest", *[F.lit(None).cast(t).alias(c) for c, t in nodes.dtypes if c in LEAVES])
            nodes = nodes.unionByName(more, allowMissingColumns=True)
        return nodes, lists, top

    def summits(self) -> DataFrame:
        """The one node that remains of each list."""
        return self.nodes.join(self.lists.select("key", "height"), "key").where("level = height")

    def descend(self, summits: DataFrame, carried: list[str]) -> DataFrame:
        """Leaves with their paths: for each level up to the root, a node's place in its run and its siblings.

        summits: key, level, path (of what lies above the list), and the carried columns.
        """
        own = [c for c in self.nodes.columns if c not in ("open", "level")]
        step = lambda c: F.struct((F.col("member.index") % self.fanout).cast("int").alias("at"), F.transform(F.filter(c, lambda m: m["index"] != F.col("member.index")), lambda m: m["digest"]).alias("others"))
        above = None
        for level in range(self.top, -1, -1):
            here = summits.where(F.col("level") == level).select("key", "path", *carried, *[F.col(c) for c in own if c != "key"])
            if above is not None:
                runs = self.nodes.where(F.col("level") == level).groupBy("key", F.expr(f"index div {self.fanout}").alias("_parent")).agg(F.array_sort(F.collect_list(F.struct(*[c for c in own if c != "key"]))).alias("_run"))
                up = above.select("key", F.col("index").alias("_parent"), "path", *carried)
                met = runs.join(up, ["key", "_parent"]).withColumn("member", F.explode("_run"))
                under = met.select("key", F.concat(F.array(step("_run")), "path").alias("path"), *carried, *[F.col(f"member.{c}").alias(c) for c in own if c != "key"])
                here = here.unionByName(under)
            above = here
        return above


def folded(path: Column, leaf: Column) -> Column:
    """Root that a leaf and its path give."""
    def up(digest, s):
        run = F.concat(F.slice(s["others"], F.lit(1), s["at"]), F.array(digest), F.slice(s["others"], s["at"] + 1, F.greatest(F.size(s["others"]), F.lit(1))))
        return F.sha2(F.array_join(run, "").cast("binary"), 256)

    return F.aggregate(path, leaf, up)


def proof(path: Column) -> Column:
    """Hash of all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["others"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, changed: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, source, leaf, path, subroot, root and changed leaf of every row of docs.

    changed: leaf that is to be checked against the row's path; by default its own.
    """
    tables, spent = Tables(), Tables()
    c = F.col
    docs = docs.select(c("doc_id").cast("long").alias("doc_id"), *[c(x).cast("string").alias(x) for x in ("source", "lang", "text")], c("n_chars").cast("long").alias("n_chars"))
    leaf = leaf_of(c("text"))
    key = F.coalesce(F.concat(F.lit("+"), c("source")), F.lit(""))
    leaves = spent.cut(docs.select(key.alias("key"), leaf.alias("digest"), "doc_id", "source", (leaf if changed is None else changed).alias("changed")), "manifest-leaves")
    # equal rows are dealt out by their place in the table, so that no range has to hold them all
    by_source = Forest(leaves.withColumn("row", F.monotonically_increasing_id()), ["doc_id", "digest", "row"], fanout, tables)
    spent.clear()
    subroots = tables.cut(by_source.summits().select(F.lit("").alias("key"), "digest", F.lit(None).cast("long").alias("doc_id"), F.col("key").alias("source"), F.col("digest").alias("changed")), "manifest-subroots")
    over = Forest(subroots, ["source"], fanout, tables)
    empty = F.array().cast("array<struct<at:int,others:array<string>>>")
    root = over.summits().select("key", "level", "index", "digest", *LEAVES, empty.alias("path"), F.col("digest").alias("root"))
    tops = over.descend(root, ["root"]).select(F.col("source").alias("key"), F.col("digest").alias("subroot"), "root", "path")
    tops = tables.cut(tops, "manifest-tops")
    whole = by_source.summits().select("key", "level", "index", "digest", *LEAVES).join(tops, "key")
    return by_source.descend(whole, ["subroot", "root"]).select("doc_id", "source", F.col("digest").alias("leaf"), "path", "subroot", "root", "changed")


def tampered(doc_id: Column, text: Column) -> Column:
    """The text in lower case (A-Z only) where 5 divides the id's crc32."""
    small = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, small).otherwise(text)


def verify_tampered(docs: DataFrame) -> DataFrame:
    """Manifest digests of every row, and whether its leaf, from tampered text where that is due, still folds to the root."""
    m = manifest(docs, changed=leaf_of(tampered(F.col("doc_id"), F.col("text"))))
    fold = m.withColumn("folded_root", folded(F.col("path"), F.col("changed")))
    return fold.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
