"""Exact dedup by Patricia-trie owners.

Texts are equal when identical after the white-space bytes are deleted. Each input
partition inserts its full byte strings into a radix trie, which leaves one string per
distinct text and partition; only those are shuffled, to the partition of their length and
content hash, and inserted into tries again. A terminal node stores the owner alone: most
code points in the original text, then smallest doc_id, with the count of its rows; the
rows themselves leave the task as they come, with the number of their terminal node. A trie
that outgrows its budget spills whole subtrees: a stub stays where the subtree hung, strings
that reach it follow it to its file, and each file is finished in a trie of its own, which
may spill in turn. So a task holds its budget, or one text if that is longer.

Defined results: null text counts as empty; all empty texts form one group; a null doc_id
sorts after every other; repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import pickle
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, arrow_map, cut, slices

#: What a node and an owner are taken to need beside their bytes.
NODE_BYTES, OWNER_BYTES = 250, 350


class Node:
    """label: bytes from the parent; kids by first byte; owner if a string ends here; file if the subtree was spilled."""

    __slots__ = ("label", "kids", "owner", "file")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.file = label, None, None, None


class Owner:
    """Number of the terminal node, the best row so far and the rows counted."""

    __slots__ = ("number", "tag", "chars", "id", "rows")

    def __init__(self, number: int, tag: bytes, chars: int, doc_id: int | None, rows: int):
        self.number, self.tag, self.chars, self.id, self.rows = number, tag, chars, doc_id, rows

    def take(self, chars: int, doc_id: int | None, rows: int) -> None:
        if (-chars, doc_id is None, doc_id or 0) < (-self.chars, self.id is None, self.id or 0):
            self.chars, self.id = chars, doc_id
        self.rows += rows


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def spill_folder() -> str | None:
    """Where this executor spills what belongs to a running task, as Spark's own shuffles do."""
    return (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None


class RadixTrie:
    """Compressed trie over byte strings within a byte budget, owners at its terminal nodes.

    numbers: where the numbers of new owners come from, shared with the tries of spilled subtrees.
    """

    def __init__(self, budget: int, numbers: Iterator[int]):
        self.budget, self.numbers = budget, numbers
        self.root, self.held, self.owners, self.spilled = Node(b""), 0, 0, 0

    def reach(self, key: bytes) -> tuple[Node, int]:
        """The terminal node of a key, made if absent, or the stub on its way, and how many bytes lead there."""
        node, at, n = self.root, 0, len(key)
        while at < n and node.file is None:
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                leaf = Node(key[at:])
                node.kids = node.kids or {}
                node.kids[key[at]] = leaf
                self.held += n - at + NODE_BYTES
                return leaf, n
            if key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            k = shared_prefix(kid.label, key[at : at + len(kid.label)])
            mid = Node(kid.label[:k])
            kid.label = kid.label[k:]
            mid.kids = {kid.label[0]: kid}
            node.kids[key[at]] = mid
            self.held += NODE_BYTES
            node, at = mid, at + k
        return node, at

    def add(self, key: bytes, tag: bytes, chars: int, doc_id, rows: int, member, number: int | None = None) -> int | None:
        """Count rows of a key to its owner; the owner's number, or None if the subtree is in a file, with all of this."""
        node, at = self.reach(key)
        if node.file is not None:
            pickle.dump((key[at:], tag, chars, doc_id, rows, member, number), node.file)
            return None
        if node.owner is None:
            node.owner = Owner(next(self.numbers) if number is None else number, tag, chars, doc_id, rows)
            self.held += OWNER_BYTES
            self.owners += 1
        else:
            node.owner.take(chars, doc_id, rows)
        number = node.owner.number
        if self.held > self.budget and self.owners > 1:  # a single string is held, however long
            self.spill()
        return number

    def sizes(self) -> dict[int, int]:
        """Bytes held by the subtree of each node, by the node's id."""
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.kids.values() if node.kids else ()
        out: dict[int, int] = {}
        for node in reversed(order):
            own = len(node.label) + NODE_BYTES + (OWNER_BYTES if node.owner else 0)
            out[id(node)] = own + sum(out[id(k)] for k in node.kids.values()) if node.kids else own
        return out

    def spill(self) -> None:
        """Put the largest subtrees into files until half of the budget is free; one that holds over half of it is entered, not spilled.

        A stub keeps the first byte of its label, the rest goes along with the strings.
        """
        size = self.sizes()
        found = [(-size[id(k)], k.label[:1], k) for k in (self.root.kids or {}).values() if k.file is None]
        heapq.heapify(found)
        entered, goal = itertools.count(), self.held - self.budget // 2
        while found and goal > 0:
            large, _, node = heapq.heappop(found)
            if -large > self.budget // 2 and node.kids:
                for kid in node.kids.values():
                    if kid.file is None:
                        heapq.heappush(found, (-size[id(kid)], next(entered).to_bytes(8, "big"), kid))
                continue
            file = tempfile.TemporaryFile(dir=spill_folder())
            inner, stubs = unhung(node, node.label[1:])
            for key, o in inner:
                pickle.dump((key, o.tag, o.chars, o.id, o.rows, None, o.number), file)
                self.owners -= 1
            for prefix, old in stubs:
                for key, *rest in records(old):
                    pickle.dump((prefix + key, *rest), file)
            node.label, node.kids, node.owner, node.file = node.label[:1], None, None, file
            freed = -large - 1 - NODE_BYTES
            goal -= freed
            self.held -= freed
            self.spilled += 1

    def drain(self) -> Iterator[tuple]:
        """(key, owner, None) of every terminal node, and (None, number, member) of rows that went to files; the trie is spent."""
        top, self.root = self.root, Node(b"")
        inner, stubs = unhung(top, b"")
        for key, owner in inner:
            yield key, owner, None
        for prefix, file in stubs:
            below = RadixTrie(self.budget, self.numbers)
            yield from below.refill(file)
            for tail, owner, member in below.drain():
                yield None if tail is None else prefix + tail, owner, member

    def refill(self, file) -> Iterator[tuple]:
        """Insert what a spilled subtree's file holds; yields the rows whose owner is told at once."""
        for key, tag, chars, doc_id, rows, member, number in records(file):
            told = self.add(key, tag, chars, doc_id, rows, member, number)
            if told is not None and member is not None:
                yield None, told, member


def unhung(top: Node, prefix: bytes) -> tuple[Iterator[tuple[bytes, Owner]], list[tuple[bytes, object]]]:
    """Terminal nodes of a subtree as (prefix and bytes below its top, owner), and its stubs as (same, file), listed once the first are spent.

    The subtree is taken apart on the way, so what was read is held no longer.
    """
    stubs: list[tuple[bytes, object]] = []

    def walk():
        todo = [(top, prefix)]
        while todo:
            node, key = todo.pop()
            if node.owner is not None:
                yield key, node.owner
            if node.file is not None:
                stubs.append((key, node.file))
            if node.kids:
                todo += [(kid, key + kid.label) for kid in node.kids.values()]
                node.kids = None

    return walk(), stubs


def records(file) -> Iterator[tuple]:
    """What was written to a spilled subtree's file, which is closed (and so gone) at the end."""
    with file:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


class Rows:
    """Columns under way to Spark, handed on when they hold enough."""

    def __init__(self, schema: str, most: int = 4_000_000):
        self.names, self.most = [c.split()[0] for c in schema.split(", ")], most
        self.cols, self.held = {n: [] for n in self.names}, 0

    def put(self, size: int, *row) -> None:
        for col, v in zip(self.cols.values(), row, strict=True):
            col.append(v)
        self.held += size

    def full(self, least: int = -1) -> Iterator[dict]:
        """The columns, if they hold more than least bytes (by default, enough)."""
        if self.held > (self.most if least < 0 else least):
            out, self.cols, self.held = self.cols, {n: [] for n in self.names}, 0
            yield out


LOCAL = "doc_id long, n_chars long, text_sha256 string, owner long, n_bytes long, tag binary, body binary, best_chars long, best_id long, members long"
TOPS = "owner long, top long, keep_id long, group_size long"


def _first_number() -> Iterator[int]:
    from pyspark import TaskContext

    return itertools.count(TaskContext.get().partitionId() << 40)


def _local(digest_bytes: int, budget: int):
    """Rows with the number of their terminal node (body null), and terminal nodes with their string (doc_id null)."""

    def run(batches):
        trie, out = RadixTrie(budget, _first_number()), Rows(LOCAL)

        def member(number, row):
            doc_id, chars, tag = row
            out.put(300, doc_id, chars, tag.hex(), number, None, None, None, None, None, None)

        for whole in batches:
            for b in slices(whole, "text"):
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    text = text or ""
                    body = text.encode("utf-8", "surrogatepass").translate(None, SPACE_BYTES)
                    row = (doc_id, len(text), hashlib.sha256(body).digest())
                    number = trie.add(body, row[2], row[1], doc_id, 1, row)
                    if number is not None:
                        member(number, row)
                        yield from out.full()
        for body, owner, row in trie.drain():
            if body is None:
                member(owner, row)
            else:
                out.put(len(body) + 300, None, None, None, owner.number, len(body), owner.tag[:digest_bytes], body, owner.chars, owner.id, owner.rows)
            yield from out.full()
        yield from out.full(0)

    return run


def _owners(budget: int):
    """(owner, top): whose terminal node of an input partition became which one here; (null, top, ...): what a terminal node found."""

    def run(batches):
        trie, out = RadixTrie(budget, _first_number()), Rows(TOPS)
        for whole in batches:
            for b in slices(whole, "body"):
                names = b.schema.names
                for r in zip(*(b.column(i).to_pylist() for i in range(len(names))), strict=True):
                    x = dict(zip(names, r, strict=True))
                    number = trie.add(bytes(x["body"]), bytes(x["tag"]), x["best_chars"], x["best_id"], x["members"], x["owner"])
                    if number is not None:
                        out.put(64, x["owner"], number, None, None)
                yield from out.full()
        for body, owner, member in trie.drain():
            out.put(64, *((member, owner, None, None) if body is None else (None, owner.number, owner.id, owner.rows)))
            yield from out.full()
        yield from out.full(0)

    return run


def exact_groups(docs: DataFrame, digest_bytes: int = 32, budget: int = 96_000_000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    digest_bytes: how much of the content hash deals texts to partitions; any value gives the
    same groups, since tries compare whole byte strings. budget: bytes that the trie of one
    task holds in memory.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = cut(arrow_map(rows, _local(digest_bytes, budget), LOCAL), "trie-local")
    texts = local.where(F.col("body").isNotNull()).select("owner", "n_bytes", "tag", "body", "best_chars", "best_id", "members")
    tops = cut(arrow_map(texts.repartition("n_bytes", "tag"), _owners(budget), TOPS), "trie-owners")
    found = tops.where("owner IS NULL").select("top", "keep_id", "group_size")
    owners = tops.where("owner IS NOT NULL").select("owner", "top").join(found, "top").drop("top")
    out = local.where(F.col("body").isNull()).select("doc_id", "n_chars", "text_sha256", "owner").join(owners, "owner")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_chars")


def keep_owners(docs: DataFrame, **options) -> DataFrame:
    """docs without the copies: of equal texts only the owner's row stays, once even if the row repeats."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(F.encode(F.translate(text, SPACE_BYTES.decode(), ""), "UTF-8"), 256)
    # the row goes along whole, so that its columns may have any names
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), sha.alias("sha"), F.char_length(text).alias("chars"))
    owners = exact_groups(docs, **options).where("kept").select("keep_id", "text_sha256", "n_chars").distinct()
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("text_sha256")) & (F.col("chars") == F.col("n_chars"))
    return keyed.join(owners, same, "left_semi").dropDuplicates(["id", "sha"]).select("doc.*")
