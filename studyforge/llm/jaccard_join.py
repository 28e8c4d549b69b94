"""Exact similarity join on word-shingle sets with set-relation skipping.

Documents with equal sets share a vertex. A set's tokens are in one order: hashes ascending,
after which come those that are frequent, counted in all documents (any order gives exact
results; this one saves work). Two sets with overlap o or more have
their first common token at a place with o tokens or more from there on in both of them
(the entry's `slack`), so a set enters the index with its first n - ceil(0.75 * n) + 1
tokens, and an entry meets another only if both slacks reach the overlap that their sizes
ask for.

Index-level skipping: a list's entries stand by size and position in blocks of BLOCK, and two
blocks are skipped as a whole where their sizes or greatest slacks rule out every pair.

Single sets carry a bitmap in which each token flips one bit; as many bits as two bitmaps
differ in, so many tokens at least does one set have and the other not, which rules out most
of the pairs that share about half of their tokens before they leave the list.

Answer-level skipping: sets that share their lowest tokens with a pivot are compared with it
first. Those that link to it become its members; only what they differ in (plus: tokens that
the pivot lacks; minus: the pivot's that they lack) is kept. The pivot enters the index for
its whole group, members only with their plus tokens, so a group of any size is about one
entry a list. The pivot's overlap with another set, computed once, then bounds that of all
members (by the length of the longest plus). Where it does not decide, the set is held against
the group's centre, the tokens that most of its sets have: a member's overlap is at most that of
the centre, less what the member lacks of it, and as many tokens as both have beside it. So
the set meets the members with which it shares tokens beside the centre, and others only
where the centre's tokens alone may make a link. Members that are linked through their
group already are never compared, nor are sets that a first look at a few neighbours in each
list has brought into one component.

Tokens are 64-bit hashes of shingles; a vertex is known by size and two 64-bit sums of its
tokens' hashes. Defined results: texts without words, or null, have size 0 and a component of
their own; repeated rows and equal sets are one vertex; null doc_ids are left out of the
minimum (a component of only such has a null id); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, arrow_map, cut, only, slices
from .words import mix64, words_of

SIZE = 5
#: Tokens of a set by which its pivot is found, and how many of them both must share (smaller sets: all).
LOWEST, SHARED = 8, 3
#: How many documents hold a frequent token.
FREQUENT = 15
#: Tokens are counted by their low bits, so many name the bucket and so many the token in it; those that agree in them count as one.
BUCKET_BITS, LOW_BITS = 12, 28
#: Tokens that a task counts before it passes them on.
COUNTED = 1 << 21
#: Greatest bits of the table of frequent tokens (16 MB); where more than a sixteenth as many tokens are frequent, the most frequent ones are told.
TABLE_BITS = 1 << 27
#: Documents with a token from which on its list is dealt to several tasks.
LIST = 200_000
#: Shards of a list at most; its entries stand once in each of so many cells.
SHARDS = 1024
BLOCK = 32
#: Pairs that one verifying group has at most, more or less.
GROUP = 512
#: Entries from which on a list's neighbours are looked at first, how many after each, and how many of them are compared with a set.
CROWD, NEIGHBOURS, FIRST = 4, 2, 3
#: A group's sets nearest to its centre that are tried for a link before all others are.
TRIES = 8
BATCH_BYTES = 1_000_000
#: Bits of a set's bitmap.
BITS = 512
#: Bitmaps that are broadcast at most; the driver holds several copies of what is broadcast.
BITMAPS = 50_000
BATCH_ROWS = 1_500
_CELLS = 1 << 12
_BIG = (1 << 31) - 1
_K = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, token) of all distinct shingles, by text, then token."""
    w = words_of(texts)
    n = np.bincount(w.doc, minlength=len(texts))
    h = np.zeros(max(0, len(w.hash) - size + 1), np.uint64)
    for i in range(size):
        h = h * _K + w.hash[i : i + len(h)] if len(h) else h
    inside = w.doc[: len(h)] == w.doc[size - 1 :] if len(h) else np.zeros(0, bool)
    doc, h = w.doc[: len(h)][inside], h[inside]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        first = np.searchsorted(w.doc, short)
        whole = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            has = n[short] > i
            whole[has] = whole[has] * _K + w.hash[first[has] + i]
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, whole + n[short].astype(np.uint64) * np.uint64(0x51ED27)])
    h = mix64(h)
    by = np.lexsort((h, doc))
    doc, h = doc[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _vertices(n: int, doc: np.ndarray, h: np.ndarray, twins: frozenset = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size, vertex and second signature of each text; vertices among `twins` are told apart by that signature."""
    sizes = np.bincount(doc, minlength=n)
    sums = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    starts = np.flatnonzero(np.diff(np.concatenate([[-1], doc])))
    for s, salt in zip(sums, (0x1234567, 0x7654321), strict=True):
        if len(h):
            s[doc[starts]] = np.add.reduceat(mix64(h + np.uint64(salt)), starts)
    v, sig = mix64(sums[0] + sizes.astype(np.uint64)).view(np.int64), sums[1].view(np.int64)
    if twins:
        v = np.where(np.isin(v, list(twins)), v ^ sig, v)
    return sizes, v, sig


def _in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys.view(np.uint64) % np.uint64(64 * len(table))).astype(np.int64)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def bit_table(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bits set at the keys' values mod `bits`, a power of two; the driver reads bits / 64 numbers at most."""
    # the residue of the unsigned value, as `bits` is a power of two
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def _texts(batches) -> Iterator:
    for whole in batches:
        for b in slices(whole, "text", BATCH_BYTES, BATCH_ROWS):
            if b.num_rows:
                yield b, [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]


def row_key(id_: Column, text: Column) -> tuple[Column, Column]:
    """`row` and `key`, two hashes that together name a row by doc_id and text: ids may be null or repeated."""
    id_, text = id_.cast("long"), text.cast("string")
    return F.xxhash64(id_, text).alias("row"), F.xxhash64(F.lit("key"), text, id_).alias("key")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, row, key."""
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(id_.alias("doc_id"), text.alias("text"), *row_key(id_, text))


def _bitmaps(n: int, doc: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """BITS / 64 numbers for each set, whose bits are flipped by its tokens."""
    flips = np.bincount(doc * BITS + (h % np.uint64(BITS)).astype(np.int64), minlength=n * BITS).reshape(n, BITS) & 1
    return list(np.packbits(flips.astype(np.uint8), axis=1).view(np.int64))


ABOUT = "doc_id long, row long, key long, n long, v long, sig long, low array<long>, bits array<long>"


def describe(docs: DataFrame) -> DataFrame:
    """Row, set size, vertex, lowest tokens and bitmap of every row."""

    def run(batches) -> Iterator[dict]:
        for b, texts in _texts(batches):
            doc, h = shingles(texts)
            sizes, v, sig = _vertices(len(texts), doc, h)
            ends = np.cumsum(sizes)
            hs = h.view(np.int64)
            low = [hs[e - k : e - k + min(k, LOWEST)] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield {"doc_id": b.column(0), "row": b.column(2), "key": b.column(3), "n": sizes, "v": v, "sig": sig, "low": low, "bits": _bitmaps(len(texts), doc, h)}

    return arrow_map(keyed_texts(docs), run, ABOUT)


def _low(token: np.ndarray) -> np.ndarray:
    return token.view(np.uint64) & np.uint64((1 << BUCKET_BITS + LOW_BITS) - 1)


def _count(batches) -> Iterator[dict]:
    """Counts of a task's tokens, a row for each bucket."""

    def passed(held: list[np.ndarray]) -> dict:
        low, k = np.unique(_low(np.concatenate(held)), return_counts=True)
        bucket, first = np.unique(low >> np.uint64(LOW_BITS), return_index=True)
        ends = np.append(first[1:], len(low)).tolist()
        low, k = (low & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint32), k.astype(np.uint32)
        spans = list(zip(first.tolist(), ends, strict=True))
        return {"bucket": bucket.astype(np.int32), "low": [low[i:j].tobytes() for i, j in spans], "k": [k[i:j].tobytes() for i, j in spans]}

    held, n = [], 0
    for _, texts in _texts(batches):
        held.append(shingles(texts)[1])
        n += len(held[-1])
        if n >= COUNTED:
            yield passed(held)
            held, n = [], 0
    if n:
        yield passed(held)


def _frequent(batches) -> Iterator[dict]:
    """Tokens of FREQUENT or more documents, for rows of _count by bucket."""

    def summed(bucket: int, lows: list[bytes], ks: list[bytes]) -> dict:
        low, k = np.frombuffer(b"".join(lows), np.uint32), np.frombuffer(b"".join(ks), np.uint32)
        by = np.argsort(low, kind="stable")
        low, k = low[by], k[by].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        k = np.add.reduceat(k, first)
        often = k >= FREQUENT
        return {"token": (bucket << LOW_BITS) + low[first][often].astype(np.int64), "k": k[often]}

    key, lows, ks = None, [], []
    for b in batches:
        for bucket, low, k in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != key and lows:
                yield summed(key, lows, ks)
                lows, ks = [], []
            key = bucket
            lows.append(low)
            ks.append(k)
    if lows:
        yield summed(key, lows, ks)


def frequent_tokens(docs: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Bit table of the tokens that FREQUENT or more documents hold, and by their low bits the shards of those whose lists may be long."""
    parts = arrow_map(keyed_texts(docs).select("text"), _count, "bucket int, low binary, k binary")
    counts = arrow_map(parts.repartition("bucket").sortWithinPartitions("bucket"), _frequent, "token long, k long")
    tables = Tables()
    counts = tables.cut(counts, "frequent")
    by = sorted(((r["k"], r["n"]) for r in counts.groupBy(F.least("k", F.lit(1000)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, told = FREQUENT, 0
    for k, n in by:
        if told + n > TABLE_BITS // 16:
            break
        least, told = k, told + n
    bits = min(TABLE_BITS, 1 << max(10, (16 * told).bit_length()))
    table = bit_table(counts.where(F.col("k") >= least), "token", bits)
    shards = F.least(F.ceil(F.col("k") / LIST), F.lit(SHARDS)).cast("int")
    # fewer than all entries / LIST
    long_ = {r["token"]: r["shards"] for r in counts.select("token", shards.alias("shards")).where("shards > 1").collect()}
    tables.clear()
    return table, long_


def sets_of(docs: DataFrame, rows: DataFrame, twins: frozenset) -> DataFrame:
    """v, tokens (ascending) of the documents that `rows` (row, key) names."""

    def run(batches) -> Iterator[dict]:
        for _, texts in _texts(batches):
            doc, h = shingles(texts)
            sizes, v, _ = _vertices(len(texts), doc, h, twins)
            ends = np.cumsum(sizes)
            yield {"v": v, "tokens": [h[e - k : e].tobytes() for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]}

    return arrow_map(only(keyed_texts(docs), rows, ["row", "key"]).select("text"), run, "v long, tokens binary")


#: An index entry: least and greatest size of the group's sets, tokens from here on, whether the group is one set.
ENTRIES = "token long, cell int, part int, g long, lo int, hi int, slack int, solo boolean"


def _dealt(shards: dict[int, int], token: np.ndarray, **columns: np.ndarray) -> dict:
    """Entries, those of long lists once in each cell of their part's row and column."""
    token = token.view(np.int64)
    count = np.ones(len(token), np.int64)
    if shards:
        names = np.array(sorted(shards), np.int64)
        low = _low(token).view(np.int64)
        at = np.minimum(np.searchsorted(names, low), len(names) - 1)
        count = np.where(names[at] == low, np.array([shards[k] for k in names.tolist()], np.int64)[at], 1)
    part = (mix64(columns["g"].view(np.uint64)) % count.astype(np.uint64)).astype(np.int64)
    i = np.repeat(np.arange(len(token)), count)
    other = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    own = part[i]
    return {"token": token[i], "cell": np.minimum(own, other) * _CELLS + np.maximum(own, other), "part": own} | {k: c[i] for k, c in columns.items()}


def _ordered(late: np.ndarray, doc: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each set in the index's order, and their positions."""
    h = h[np.lexsort((h, _in_table(late, h), doc))]
    return h, np.arange(len(h)) - (np.cumsum(sizes) - sizes)[doc]


def _prefix(n: np.ndarray) -> np.ndarray:
    """Last position at which the first common token with any answer may stand."""
    return n - (3 * n + 3) // 4


def entries_of_texts(docs: DataFrame, late, shards: dict[int, int], twins: frozenset) -> DataFrame:
    """Index entries of sets that stand for themselves."""

    def run(batches) -> Iterator[dict]:
        seen: set[int] = set()
        for _, texts in _texts(batches):
            doc, h = shingles(texts)
            sizes, v, _ = _vertices(len(texts), doc, h, twins)
            new = np.array([n > 0 and x not in seen and not seen.add(x) for n, x in zip(sizes.tolist(), v.tolist(), strict=True)], bool)
            h, pos = _ordered(late.value, doc, h, sizes)
            use = new[doc] & (pos <= _prefix(sizes)[doc])
            d, n = doc[use], sizes[doc[use]]
            yield _dealt(shards, h[use], g=v[d], lo=n, hi=n, slack=n - pos[use], solo=np.ones(len(d), bool))

    return arrow_map(docs.select("text"), run, ENTRIES)


def entries_of_pivots(sets: DataFrame, groups: DataFrame, late, shards: dict[int, int]) -> DataFrame:
    """Index entries of pivots for all sets of their groups.

    A member's first common token, if the pivot has it, stands at most `less` places later
    here; it has at most `more` tokens from there on beyond the pivot's.
    """

    def run(batches) -> Iterator[dict]:
        for b in batches:
            for v, raw, lo, hi, more, less in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                h = np.frombuffer(raw, np.uint64)
                n = np.array([len(h)])
                h, pos = _ordered(late.value, np.zeros(len(h), np.int64), h, n)
                use = pos <= _prefix(np.array([hi]))[0] + less
                k = np.ones(int(use.sum()), np.int64)
                yield _dealt(shards, h[use], g=k * v, lo=k * lo, hi=k * hi, slack=len(h) - pos[use] + more, solo=k == 0)

    rows = only(sets, groups.withColumnRenamed("p", "v"), ["v"], "inner").select("v", "tokens", "lo", "hi", "more", "less")
    return arrow_map(rows, run, ENTRIES)


def entries_of_members(members: DataFrame, shards: dict[int, int]) -> DataFrame:
    """Index entries of members for the tokens that their pivots lack, one for a group, token and batch."""

    def run(batches) -> Iterator[dict]:
        for b in batches:
            p, n, plus, at = (b.column(i).to_pylist() for i in range(4))
            token = np.frombuffer(b"".join(plus), np.uint64)
            pos = np.frombuffer(b"".join(at), np.int32).astype(np.int64)
            i = np.repeat(np.arange(len(p)), [len(x) // 8 for x in plus])
            g, size = np.array(p, np.int64)[i], np.array(n, np.int64)[i]
            use = pos <= _prefix(size)
            token, pos, g, size = token[use], pos[use], g[use], size[use]
            if not len(token):
                continue
            by = np.lexsort((g, token))
            token, pos, g, size = token[by], pos[by], g[by], size[by]
            first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (g[1:] != g[:-1])]))
            lo, hi, slack = np.minimum.reduceat(size, first), np.maximum.reduceat(size, first), np.maximum.reduceat(size - pos, first)
            yield _dealt(shards, token[first], g=g[first], lo=lo, hi=hi, slack=slack, solo=np.zeros(len(first), bool))

    return arrow_map(members.select("p", "n", "plus", "at"), run, ENTRIES)


def _lists(batches) -> Iterator[list[np.ndarray]]:
    """Whole index lists: columns of several lists at a time, never a list in two parts."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        last = other[-1] + 1 if len(other) else 0
        held = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols]
    if held is not None:
        yield held


def _need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap that sets of at least these sizes need: 100 * overlap >= 75 * (a + b - overlap)."""
    return (3 * (a + b) + 6) // 7


def _may_link(lo: tuple, hi: tuple, slack: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets of these ranges of size can link by a first common token with these slacks; the overlap needed."""
    a, b = np.maximum(lo[0], (3 * lo[1] + 3) // 4), np.maximum(lo[1], (3 * lo[0] + 3) // 4)
    need = _need(a, b)
    return (a <= hi[0]) & (b <= hi[1]) & (np.minimum(*slack) >= need), need


def _starts(token: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])])


def _common(batches) -> Iterator[dict]:
    """Entries of lists with two groups or more."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    for columns in _lists(batches):
        token, cell, _, g, *_ = columns
        start = np.flatnonzero(_starts(token, cell))
        many = np.minimum.reduceat(g, start) != np.maximum.reduceat(g, start)
        use = np.repeat(many, np.diff(np.append(start, len(token))))
        if use.any():
            yield {name: c[use] for name, c in zip(names, columns, strict=True)}


def _neighbours(batches) -> Iterator[dict]:
    """Pairs of a few neighbours of about one size in each long list, which stands in an order of its own."""
    for token, cell, part, g, lo, hi, slack, _ in _lists(batches):
        number = np.cumsum(_starts(token, cell)) - 1
        lo, hi, slack = (x.astype(np.int64) for x in (lo, hi, slack))
        use = np.flatnonzero((np.bincount(number)[number] >= CROWD) & (cell // _CELLS == part))
        # places where no first common token of sets alike stands are left to the whole look
        use = use[slack[use] >= _need(lo[use], lo[use])]
        band = np.floor(np.log(np.maximum(lo, 1)) * 8).astype(np.int64)
        use = use[np.lexsort((mix64((g[use] ^ token[use]).view(np.uint64)), band[use], number[use]))]
        for d in range(1, NEIGHBOURS + 1):
            i, j = use[:-d], use[d:]
            ok = (number[i] == number[j]) & (g[i] != g[j])
            i, j = i[ok], j[ok]
            ok = _may_link((lo[i], lo[j]), (hi[i], hi[j]), (slack[i], slack[j]))[0]
            if ok.any():
                yield {"a": np.minimum(g[i], g[j])[ok], "b": np.maximum(g[i], g[j])[ok], "t": token[i][ok]}


PAIRS = "a long, b long, t long, rest int, need int"


def _pairs(batches) -> Iterator[dict]:
    """Pairs of groups of different components within each list, blocks of entries that cannot link skipped."""
    for token, cell, part, g, lo, hi, slack, solo, comp, bits in _lists(batches):
        start = np.flatnonzero(_starts(token, cell))
        many = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
        length = np.diff(np.append(start, len(token)))
        number = np.repeat(np.arange(len(start)), length)
        use = np.flatnonzero(many[number])
        if not len(use):
            continue
        lo, hi, slack = (x.astype(np.int64) for x in (lo, hi, slack))
        # by size, then position: blocks have entries alike in both
        band = np.floor(np.log(np.maximum(lo, 1)) * 8).astype(np.int64)
        use = use[np.lexsort((-slack[use] / hi[use], band[use], number[use]))]
        number, token, cell, part, g, lo, hi, slack, solo, comp = (x[use] for x in (number, token, cell, part, g, lo, hi, slack, solo, comp))
        bits = np.concatenate(bits[use].tolist()).view(np.uint64).reshape(len(use), -1)
        diagonal = cell // _CELLS == cell % _CELLS
        start = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        within = np.arange(len(use)) - np.repeat(start, np.diff(np.append(start, len(use))))

        def pairs_of(i: np.ndarray, j: np.ndarray):
            ok, need = _may_link((lo[i], lo[j]), (hi[i], hi[j]), (slack[i], slack[j]))
            ok &= (comp[i] != comp[j]) & ((part[i] != part[j]) | diagonal[i])
            i, j, need = i[ok], j[ok], need[ok]
            both = solo[i] & solo[j]
            near = ~both | (np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= lo[i] + lo[j] - 2 * need)
            i, j, need, both = i[near], j[near], need[near], both[near]
            a, b, t = np.minimum(g[i], g[j]), np.maximum(g[i], g[j]), token[i]
            rest = np.where(both, np.minimum(slack[i], slack[j]) - 1, _BIG)
            # groups of several sets count no common tokens, so one row is enough
            many = np.flatnonzero(~both)
            if len(many):
                many = many[np.unique(np.stack([a[many], b[many]]), axis=1, return_index=True)[1]]
                keep = np.sort(np.concatenate([np.flatnonzero(both), many]))
                a, b, t, rest, need = a[keep], b[keep], t[keep], rest[keep], need[keep]
            return {"a": a, "b": b, "t": t, "rest": rest, "need": need} if len(a) else None

        block = np.flatnonzero(within % BLOCK == 0)
        i = np.arange(len(use) - 1)
        for d in range(1, BLOCK):
            i = i[i + d < len(use)]
            i = i[(number[i] == number[np.minimum(i + d, len(use) - 1)]) & (within[i] % BLOCK + d < BLOCK)]
            if not len(i):
                break
            if (rows := pairs_of(i, i + d)) is not None:
                yield rows
        size = np.diff(np.append(block, len(use)))
        least, most, reach = np.minimum.reduceat(lo, block), np.maximum.reduceat(hi, block), np.maximum.reduceat(slack, block)
        x, d = np.arange(len(block) - 1), 1
        while len(x):
            x = x[x + d < len(block)]
            x = x[number[block[x]] == number[block[x + d]]]
            y = x + d
            can = _may_link((least[x], least[y]), (most[x], most[y]), (reach[x], reach[y]))[0]
            for at in range(0, int(can.sum()), 256):
                p, q = x[can][at : at + 256], y[can][at : at + 256]
                grid_i, grid_j = np.divmod(np.arange(BLOCK * BLOCK), BLOCK)
                inside = (grid_i < size[p][:, None]) & (grid_j < size[q][:, None])
                if (rows := pairs_of((block[p][:, None] + grid_i)[inside], (block[q][:, None] + grid_j)[inside])) is not None:
                    yield rows
            d += 1


def _links(ov, a, b):
    return 100 * ov >= 75 * (a + b - ov)


COMPARED = "a long, b long, na int, nb int, ov int"
DELTAS = ", plus binary, at binary, minus binary"


def _compare(late, beyond: bool = False):
    """Overlaps of each group's pairs, which come after its sets; with `late`, of links only, and what b and a differ in; `beyond`: with what b has and a lacks."""

    def run(batches) -> Iterator[dict]:
        key, held = None, {}
        for batch in batches:
            t, ca, cb, a, b, tokens = (batch.column(i).to_pylist() for i in range(6))
            out = {k: [] for k in ("a", "b", "na", "nb", "ov", "plus", "at", "minus")[: 8 if late is not None else 5 + beyond]}
            for here, x, y, raw in zip(zip(t, ca, cb, strict=True), a, b, tokens, strict=True):
                if here != key:
                    key, held = here, {}
                if raw is not None:
                    held[x] = np.frombuffer(raw, np.uint64)
                    continue
                pivot, own = held[x], held[y]
                at = np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)
                common = pivot[at] == own
                row = [x, y, len(pivot), len(own), int(common.sum())]
                if beyond:
                    row.append(own[~common].view(np.int64))
                if late is not None:
                    if not _links(row[4], row[2], row[3]):
                        continue
                    lacks = np.ones(len(pivot), bool)
                    lacks[at[common]] = False
                    place = np.empty(len(own), np.int32)
                    place[np.lexsort((own, _in_table(late.value, own)))] = np.arange(len(own), dtype=np.int32)
                    row += [own[~common].tobytes(), place[~common].tobytes(), pivot[lacks].tobytes()]
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            if out["a"]:
                yield out

    return run


def compare(sets: DataFrame, pairs: DataFrame, tables: Tables, late=None, beyond: bool = False) -> DataFrame:
    """Overlaps of the distinct pairs (a, b) of sets (v, tokens); `beyond`: with the tokens that b has and a lacks.

    Pairs with the same t are compared in one group, to which each of their sets goes once;
    many such pairs are dealt to cells by both their ends, those of one a by the other.
    """
    about = pairs.groupBy("t").agg(F.count(F.lit(1)).alias("pairs"), (F.min("a") == F.max("a")).alias("one"))
    cells = F.ceil(F.when(F.col("one"), F.col("pairs") / GROUP).otherwise(F.sqrt(F.col("pairs") / GROUP)))
    dealt = pairs.join(about.select("t", "one", cells.alias("cells")), "t")
    cell = [F.when(F.col("one"), 0).otherwise(F.pmod(F.xxhash64("a"), F.col("cells"))).cast("int").alias("ca"), F.pmod(F.xxhash64("b"), F.col("cells")).cast("int").alias("cb")]
    dealt = dealt.select("t", *cell, "a", "b")
    ends = tables.cut(dealt.select("t", "ca", "cb", F.explode(F.array("a", "b")).alias("v")).distinct(), "ends")
    rows = only(sets, ends, ["v"], "inner").select("t", "ca", "cb", F.col("v").alias("a"), F.lit(None).cast("long").alias("b"), "tokens").unionByName(dealt.withColumn("tokens", F.lit(None).cast("binary")))
    grouped = rows.repartition("t", "ca", "cb").sortWithinPartitions("t", "ca", "cb", F.col("b").asc_nulls_first())
    return arrow_map(grouped, _compare(late, beyond), COMPARED + (DELTAS if late is not None else ", plus array<long>" if beyond else ""))


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """v, comp (smallest vertex reachable) of every vertex in edges (a, b), by label exchange and pointer jumping."""
    both = tables.cut(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), "edges")
    labels = tables.cut(both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("comp").alias("c")), "w").groupBy("v").agg(F.min("c").alias("c"))
        step = labels.join(near, "v").select("v", F.least("comp", "c").alias("comp"), F.col("comp").alias("was"))
        jump = step.select(F.col("v").alias("comp"), F.col("comp").alias("c2"))
        new = tables.cut(step.join(jump, "comp", "left").select("v", F.least("comp", F.coalesce("c2", "comp")).alias("comp"), "was"), "labels")
        labels = new.select("v", "comp")
        if new.where("comp != was").limit(1).count() == 0:
            return labels


def pivot_pairs(vertices: DataFrame) -> DataFrame:
    """a (pivot), b: for each set the sets of its lists with smallest and greatest number that share most of its lowest tokens.

    A list holds the sets of about one size that have a token among their lowest.
    """
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int")
    low = vertices.select("v", "n", band.alias("band"), F.explode("low").alias("token"))
    lists = low.groupBy("token", "band").agg(F.count(F.lit(1)).alias("k"), F.array(F.min("v"), F.max("v")).alias("pivots")).where("k > 1")
    met = low.join(lists, ["token", "band"]).select("v", "n", F.posexplode("pivots").alias("end", "p")).where("v != p")
    most = met.groupBy("v", "end", "p").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")).where(F.col("shared") >= F.least(F.lit(SHARED), "n"))
    return most.groupBy("v", "end").agg(F.max_by("p", F.struct("shared", "p")).alias("a")).select("a", F.col("v").alias("b")).distinct()


def _open(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of pivots or single sets that do not link but whose members may; with both groups' least size and greatest plus."""
    for end, n in (("a", "na"), ("b", "nb")):
        about = groups.select(F.col("p").alias(end), F.col("lo").alias(f"lo_{end}"), F.col("more").alias(f"more_{end}"))
        pairs = pairs.join(about, end, "left").withColumns({f"lo_{end}": F.coalesce(f"lo_{end}", n), f"more_{end}": F.coalesce(f"more_{end}", F.lit(0))})
    need = need_of(F.greatest("lo_a", F.ceil(F.col("lo_b") * 0.75)), F.greatest("lo_b", F.ceil(F.col("lo_a") * 0.75)))
    return pairs.where(~_links(F.col("ov"), F.col("na"), F.col("nb"))).where(F.col("more_a") + F.col("more_b") > 0).where(F.col("ov") + F.col("more_a") + F.col("more_b") >= need)


def need_of(a: Column, b: Column) -> Column:
    """As _need, for columns."""
    return F.floor((3 * (a + b) + 6) / 7)


def _moved(batches) -> Iterator[dict]:
    """A row for each token that a member has and its pivot lacks (gained), or the other way round."""
    for b in batches:
        p, *raw = (b.column(i).to_pylist() for i in range(3))
        for gained, some in zip((True, False), raw, strict=True):
            token = np.frombuffer(b"".join(some), np.int64)
            yield {"p": np.repeat(np.array(p, np.int64), [len(x) // 8 for x in some]), "token": token, "gained": np.full(len(token), gained)}


def _centred(batches) -> Iterator[dict]:
    """Tokens that each set of a group has and the group's centre lacks, and how many it lacks of the centre's."""
    for b in batches:
        out = {k: [] for k in ("p", "x", "n", "plus", "lost")}
        for p, x, n, plus, minus, added, removed in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            plus, minus, added, removed = np.frombuffer(plus, np.int64), np.frombuffer(minus, np.int64), np.array(added, np.int64), np.array(removed, np.int64)
            own = np.concatenate([np.setdiff1d(plus, added), np.setdiff1d(removed, minus)])
            lost = len(np.setdiff1d(minus, removed)) + len(np.setdiff1d(added, plus))
            for column, value in zip(out.values(), (p, x, n, own, lost), strict=True):
                column.append(value)
        yield out


def _centre(batches) -> Iterator[dict]:
    for b in batches:
        tokens = []
        for raw, added, removed in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            kept = np.setdiff1d(np.frombuffer(raw, np.uint64), np.array(removed, np.int64).view(np.uint64))
            tokens.append(np.union1d(kept, np.array(added, np.int64).view(np.uint64)).tobytes())
        yield {"v": b.column(0), "tokens": tokens}


def _centre_of(p: Column) -> Column:
    """The number that a group's centre has among the vertices."""
    return F.xxhash64(F.lit("centre"), p)


def centres(members: DataFrame, groups: DataFrame, sets: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Of each of the groups (p): the centre as a set (v, tokens), and all its sets, the pivot too (p, x, n, plus, lost).

    The centre has the tokens that most of the group's sets have, so what a pivot alone has or lacks
    is no difference of its members from it.
    """
    mine = members.join(groups, "p", "left_semi").select("p", "x", "n", "plus", "minus")
    most = mine.groupBy("p").agg(F.count(F.lit(1)).alias("k"))
    moved = arrow_map(mine.select("p", "plus", "minus"), _moved, "p long, token long, gained boolean").groupBy("p", "gained", "token").agg(F.count(F.lit(1)).alias("n"))
    moved = moved.join(most, "p").where("2 * n > k + 1").groupBy("p").agg(*(F.collect_list(F.when(which, F.col("token"))).alias(name) for name, which in (("added", F.col("gained")), ("removed", ~F.col("gained")))))
    none = F.array().cast("array<long>")
    about = tables.cut(groups.join(moved, "p", "left").select("p", F.coalesce("added", none).alias("added"), F.coalesce("removed", none).alias("removed")), "about")
    pivots = only(sets.withColumnRenamed("v", "p"), about, ["p"], "inner", 10_000)
    centre = arrow_map(pivots.select(_centre_of(F.col("p")).alias("v"), "tokens", "added", "removed"), _centre, "v long, tokens binary")
    nothing = F.lit(b"")
    sets_ = mine.unionByName(pivots.select("p", F.col("p").alias("x"), (F.length("tokens") / 8).cast("int").alias("n"), nothing.alias("plus"), nothing.alias("minus")))
    own = only(sets_, about, ["p"], "inner", 10_000).select("p", "x", "n", "plus", "minus", "added", "removed")
    return tables.cut(centre, "centres"), tables.cut(arrow_map(own, _centred, "p long, x long, n int, plus array<long>, lost int"), "own")


def probes_of(open_: DataFrame, members: DataFrame, sets: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Sets to be held against whole groups, for open pairs (a, b), and the groups' sets as `centres` has them.

    The smaller side of a pair, a single set or each set of a group, goes to the larger: a (the pivot),
    b (the set), n, nc, ov (sizes of set and centre, their overlap) and what the set has beyond the centre.
    """
    size = members.groupBy("p").agg(F.count(F.lit(1)).alias("k"))
    for end in ("a", "b"):
        open_ = open_.join(size.select(F.col("p").alias(end), F.col("k").alias(f"k_{end}")), end, "left")
    k = [F.coalesce(f"k_{end}", F.lit(0)) for end in ("a", "b")]
    larger = F.when(k[0] >= k[1], F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = tables.cut(open_.select(larger.alias("s"), (F.least(*k) == 0).alias("single")).select("s.a", "s.b", "single"), "sides")
    centre, own = centres(members, sides.select(F.col("a").alias("p")).distinct(), sets, tables)
    among = members.select("p", "x").unionByName(members.select("p", F.col("p").alias("x")).distinct())
    each = sides.where("NOT single").select("a", F.col("b").alias("p")).join(among, "p").select("a", F.col("x").alias("b"))
    pairs = tables.cut(sides.where("single").select("a", "b").unionByName(each).distinct(), "probes")
    named = pairs.select(_centre_of(F.col("a")).alias("a"), "b", F.col("a").alias("t"))
    found = compare(sets.unionByName(centre), named, tables, beyond=True)
    return tables.cut(found.join(named, ["a", "b"]).select(F.col("t").alias("a"), "b", F.col("nb").alias("n"), F.col("na").alias("nc"), "ov", "plus"), "probes"), own


def sharing(probes: DataFrame, own: DataFrame) -> DataFrame:
    """a, b, t: a group's sets and probes that share tokens which its centre lacks, so many that they may link."""
    beyond = probes.select(F.col("a").alias("p"), "b", F.col("n").alias("nb"), "ov", F.explode("plus").alias("token"))
    met = own.select("p", "x", "n", F.explode("plus").alias("token")).join(beyond, ["p", "token"])
    gain = met.groupBy("p", "x", "b").agg(F.count(F.lit(1)).alias("gain"), F.first("n").alias("n"), F.first("nb").alias("nb"), F.first("ov").alias("ov"))
    return gain.where(F.col("ov") + F.col("gain") >= _least_link(F.col("n"), F.col("nb"))).select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b"), F.col("p").alias("t"))


def central(probes: DataFrame, own: DataFrame, most: int | None) -> DataFrame:
    """a, b, t: probes and a group's sets that may link by the centre's tokens alone, with the `most` sets that lack fewest of these."""
    first = own.select("p", "x", "n", "lost")
    if most is not None:
        first = first.withColumn("turn", F.row_number().over(W.partitionBy("p").orderBy("lost", "x"))).where(F.col("turn") <= most)
    # of what the set lacks of the centre, the probe has all but nc - ov tokens
    common = F.col("ov") - F.greatest(F.lit(0), F.col("lost") - (F.col("nc") - F.col("ov")))
    met = first.join(probes.select(F.col("a").alias("p"), "b", F.col("n").alias("nb"), "nc", "ov"), "p").where(common >= _least_link(F.col("n"), F.col("nb")))
    return met.select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b"), F.col("p").alias("t"))


def _least_link(a: Column, b: Column) -> Column:
    """Overlap of a link between sets of these sizes; more than either has where the sizes rule it out."""
    return F.when(4 * F.least(a, b) >= 3 * F.greatest(a, b), need_of(a, b)).otherwise(F.lit(_BIG))


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, row, key, n and comp, the class, for every row of docs; rows without words have n 0 and a comp in common."""
    tables = Tables()
    about = tables.cut(describe(docs), "about")
    signs = F.count_distinct(F.struct("sig", "n")) > 1
    twins = frozenset(r["v"] for r in about.where("n > 0").groupBy("v").agg(signs.alias("twins")).where("twins").select("v").collect())
    if twins:  # so many as 64-bit hashes collide by chance
        about = about.withColumn("v", F.when(F.col("v").isin(*twins), F.col("v").bitwiseXOR(F.col("sig"))).otherwise(F.col("v")))
    if about.where("n > 0").limit(1).count() == 0:
        out = cut(about.select("doc_id", "row", "key", "n", F.col("v").alias("comp")), "classes")
        tables.clear()
        return out
    sc = docs.sparkSession.sparkContext
    table, shards = frequent_tokens(docs)
    late = sc.broadcast(table)
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "key"))
    vertices = about.where("n > 0").groupBy("v").agg(owner.alias("owner"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("bits").alias("bits"))
    vertices = tables.cut(vertices.select("v", "n", "low", "bits", "owner.row", "owner.key"), "vertices")

    def rows_of(which: DataFrame) -> DataFrame:
        return tables.cut(vertices.join(which.distinct(), "v", "left_semi").select("row", "key"), "rows")

    # groups of sets that link to a pivot
    near = tables.cut(pivot_pairs(vertices), "near")
    sets = tables.cut(sets_of(docs, rows_of(near.select(F.col("a").alias("v")).union(near.select("b"))), twins), "sets")
    stars = tables.cut(compare(sets, near.withColumn("t", F.col("a")), tables, late), "stars")
    edges = stars.select("a", "b")
    # a set belongs to its smaller pivot, or, where it has none and is none itself, to the greater
    mine = stars.where("a < b").groupBy("b").agg(F.min("a").alias("a"))
    known = mine.select("b").union(mine.select("a"))
    mine = mine.unionByName(stars.where("a > b").groupBy("b").agg(F.max("a").alias("a")).join(known, "b", "left_anti"))
    pivots = mine.select(F.col("a").alias("b")).distinct()
    members = stars.join(mine, ["a", "b"]).join(pivots, "b", "left_anti")
    members = tables.cut(members.select(F.col("a").alias("p"), F.col("b").alias("x"), "na", F.col("nb").alias("n"), "ov", "plus", "at", "minus"), "members")
    spread = members.groupBy("p").agg(F.least(F.min("n"), F.first("na")).alias("lo"), F.greatest(F.max("n"), F.first("na")).alias("hi"), F.max(F.col("n") - F.col("ov")).alias("more"), F.max(F.col("na") - F.col("ov")).alias("less"))
    groups = tables.cut(spread, "groups")
    # rows that do not stand for themselves in the index: copies, pivots, members
    told = vertices.join(members.select(F.col("x").alias("v")).union(groups.select("p")).withColumn("grouped", F.lit(True)), "v", "left").select("v", F.col("row").alias("r"), F.col("key").alias("k"), "grouped")
    silent = about.where("n > 0").join(told, "v").where("grouped OR row != r OR key != k").select("row", "key").distinct()
    solos = only(keyed_texts(docs), tables.cut(silent, "silent"), ["row", "key"], "left_anti")
    entries = entries_of_texts(solos, late, shards, twins).unionByName(entries_of_pivots(sets, groups, late, shards)).unionByName(entries_of_members(members, shards))
    index = tables.cut(arrow_map(entries.repartition("token", "cell").sortWithinPartitions("token", "cell"), _common, ENTRIES), "index")

    def compared(pairs: DataFrame) -> DataFrame:
        nonlocal sets
        lacking = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct().join(sets.select("v"), "v", "left_anti")
        sets = sets.unionByName(tables.cut(sets_of(docs, rows_of(lacking), twins), "sets"))
        return tables.cut(compare(sets, pairs, tables), "compared")

    # a first look joins groups of sets alike in work linear in their size
    met = arrow_map(index.repartition("token", "cell").sortWithinPartitions("token", "cell"), _neighbours, "a long, b long, t long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.min("t").alias("t"))
    turn = F.row_number().over(W.partitionBy("b").orderBy(F.col("k").desc(), "a"))
    first = compared(tables.cut(met.withColumn("turn", turn).where(F.col("turn") <= FIRST).select("a", "b", "t"), "first"))
    linked = _links(F.col("ov"), F.col("na"), F.col("nb"))
    edges = edges.unionByName(first.where(linked).select("a", "b"))
    labels = components(edges, tables)
    lists = index.join(labels.withColumnRenamed("v", "g"), "g", "left").select(*index.columns, F.coalesce("comp", "g").alias("comp"))
    lists = only(lists, vertices.select(F.col("v").alias("g"), "bits"), ["g"], "left", BITMAPS).select(*index.columns, "comp", "bits")
    found = arrow_map(lists.repartition("token", "cell").sortWithinPartitions("token", "cell"), _pairs, PAIRS)
    # all common tokens up to the last of these rows have one, so what follows it bounds the overlap
    pairs = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("rest").alias("rest"), F.min("need").alias("need"), F.min("t").alias("t"))
    pairs = pairs.where(F.col("shared") + F.col("rest").cast("long") >= F.col("need")).select("a", "b", "t").join(first, ["a", "b"], "left_anti")
    rest = compared(tables.cut(pairs, "pairs"))
    edges = edges.unionByName(rest.where(linked).select("a", "b"))
    labels = components(edges, tables)

    def apart(pairs: DataFrame) -> DataFrame:
        one, two = labels.select(F.col("v").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("v").alias("b"), F.col("comp").alias("cb"))
        return tables.cut(pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb"), "open")

    # pairs that other links have joined need no look at members; of the others, those that share more than the centre's tokens
    # are compared, and by the centre's alone a few sets that have most of them, which join most; all of the rest's come last
    open_ = apart(_open(first.unionByName(rest), groups))
    if open_.limit(1).count():
        probes, own = probes_of(open_, members, sets, tables)
        for some in (central(probes, own, TRIES).unionByName(sharing(probes, own)), None):
            if some is None:
                probes = apart(probes)
                some = central(probes, own, None)
            some = tables.cut(some.groupBy("a", "b").agg(F.min("t").alias("t")), "pairs")
            if not some.limit(1).count():
                continue
            edges = edges.unionByName(tables.cut(compare(sets, some, tables), "compared").where(linked).select("a", "b"))
            labels = components(edges, tables)
    out = cut(about.join(labels, "v", "left").select("doc_id", "row", "key", "n", F.coalesce("comp", "v").alias("comp")), "classes")
    tables.clear()
    late.destroy()
    return out


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; Jaccard of 0.75 or more links."""
    out = _classes(docs)
    # a written table, so that a join with a large class can be split
    smallest = cut(out.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("smallest")), "smallest")
    return out.join(smallest, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """docs with one row of each similarity class: the smallest doc_id's; rows without words all stay.

    A row is known by its doc_id and text: null or repeated ids over different texts are
    different rows, null ids come last, and of one id's texts in a class the one with the
    smallest hash stays. Rows with equal ids and texts are copies of each other, so one of
    them stays. Other columns, whatever their names, go along.
    """
    known = cut(_classes(docs).where("n > 0").groupBy("comp", "doc_id", "row", "key").agg(F.count(F.lit(1)).alias("k")), "known")
    first = cut(known.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "key")).alias("first")), "first")
    told = known.join(first, "comp").withColumn("stays", (F.col("row") == F.col("first.row")) & (F.col("key") == F.col("first.key")))
    gone, again = (cut(told.where(which).select("row", "key"), "known") for which in ("NOT stays", "stays AND k > 1"))
    whole = docs.select(F.struct("*").alias("doc"), *row_key(F.col("doc_id"), F.col("text")))
    left = only(whole, gone, ["row", "key"], "left_anti")
    once = only(left, again, ["row", "key"], "left_anti")
    return once.unionByName(only(left, again, ["row", "key"]).dropDuplicates(["row", "key"])).select("doc.*")
