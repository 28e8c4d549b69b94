"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens. In round r source s is owed floor(r * w_s / D) tokens in
all, so the fraction it could not be served is its deficit and carries into the next
round; D is chosen so that a full round serves one window. The rounds, one after the
other, form a stream that is cut into windows, so a window that ends within a round
carries the rest of the quanta into the next window. Because the owed totals are closed
forms in r, a task places its documents from queue offsets alone: deficits carry across
partitions through those offsets and no window is built by a driver or a single task.

Weights are shares of 65536. By default they are the sources' own shares of all tokens,
the one mixture that every window can hold when all documents are packed; with other
weights the sources that outlast the rest share the last windows.

Documents may be cut anywhere. The tail is cut into power-of-two windows, which need no
padding. Defined results: null text counts as empty (its end token only); a null source is
a queue of its own; repeated rows are packed again; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, slices

PARTS = 65_536
#: Distinct pieces that a worker process remembers, and their characters.
WORDS_KEPT, CHARS_KEPT = 800_000, 24_000_000


#: One encoder for each tokenizer and worker process, so that tasks share its words.
_ENCODERS: dict = {}


def _encoder(path: str, end_id: int):
    """Function from texts to id bytes (two or four each), the same ids as encoding whole texts.

    A single space between two non-space characters always starts a new pre-token together
    with what follows it, so the pieces of a text cut there encode alike in any text; and so
    do letters, the marks after them and a line break between two such runs. Letters are pre-tokens
    as they are, so the tokenizer's model gets them without its pre-tokenizer. Texts with other
    white-space runs beside a space, or with a special token's text, are encoded whole.
    """
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = _make_encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _make_encoder(path: str, end_id: int):
    import os
    import re
    from array import array

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    from .byte_bpe import spell

    tok = Tokenizer.from_file(path)
    specials = [t.content for t in tok.get_added_tokens_decoder().values()]
    kind = "H" if _ids_are_short(path, end_id) else "I"
    end = array(kind, [end_id]).tobytes()
    odd = re.compile(r" \s|\s ").search
    # white space other than the space and the line break
    rare = re.compile(r"[^\S \n]").search
    # letters, then marks that are no apostrophe: two pre-tokens of a byte-level tokenizer
    letters = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+").fullmatch
    signs = ".,;:!?$%&*#"
    plain = tok.normalizer is None and isinstance(tok.pre_tokenizer, pre_tokenizers.ByteLevel) and tok.pre_tokenizer.use_regex and not tok.pre_tokenizer.add_prefix_space
    bare = Tokenizer(tok.model)
    cache: dict[str, bytes] = {}
    held = 0

    def encode(parts: list[str], by=tok) -> list[bytes]:
        return [array(kind, e.ids).tobytes() for e in by.encode_batch_fast(parts, add_special_tokens=False)]

    def learn(words: set[str]) -> list[str]:
        """Put words into the cache, the letters and marks of a word apart; gives those that are not worth keeping."""
        nonlocal held
        # strings alone are held here: many small tuples would keep the garbage collector busy
        whole, marked, broken, stems, tails = [], [], [], set(), {"\n"}
        for w in words:
            if "\n" in w:
                lines = w[w[0] == " " :].split("\n")
                if not plain or not all(letters(x.rstrip(signs)) for x in lines):
                    whole.append(w)
                    continue
                broken.append(w)
                # only the first letters follow a space, unless they begin the text
                stems.add((" " if w[0] == " " else "") + lines[0].rstrip(signs))
                stems.update([" " + x.rstrip(signs) for x in lines[1:]])
                tails.update([x[len(x.rstrip(signs)) :] for x in lines])
                continue
            stem = w.rstrip(signs)
            if not plain or not letters(stem, stem[:1] == " "):
                whole.append(w)
                continue
            stems.add(stem)
            if len(stem) < len(w):
                marked.append(w)
                tails.add(w[len(stem) :])
        cache.update(zip(whole, encode([w[1:] if w[0] == " " else " " + w for w in whole]), strict=True))
        fresh = [x for x in stems if x not in cache]
        spelt = [("\u0120" + x if x.isascii() else "\u0120" + spell(x.encode())) if x[0] != " " else spell(x[1:].encode()) for x in fresh]
        cache.update(zip(fresh, encode(spelt, bare), strict=True))
        tails = list(tails)
        marks = dict(zip(tails, encode(tails), strict=True))
        for w in marked:
            stem = w.rstrip(signs)
            cache[w] = cache[stem] + marks[w[len(stem) :]]
        for w in broken:
            first, *rest = w[w[0] == " " :].split("\n")
            stem = first.rstrip(signs)
            ids = cache[" " + stem if w[0] == " " else stem] + marks[first[len(stem) :]]
            for x in rest:
                stem = x.rstrip(signs)
                ids += marks["\n"] + cache[" " + stem] + marks[x[len(stem) :]]
            cache[w] = ids
        held += sum(map(len, whole)) + sum(map(len, fresh)) + sum(map(len, marked))
        return broken

    def run(texts: list[str]) -> list[bytes]:
        nonlocal held
        if len(cache) > WORDS_KEPT or held > CHARS_KEPT:
            cache.clear()
            held = 0
        pieces, ends = [], []
        for text in texts:
            if text and text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text and "\n " not in text and (rare(text) is None or odd(text) is None) and not any(s in text for s in specials):
                first = len(pieces)
                pieces += text.split(" ")
                # the first piece has no space before it: its key starts with one, which no other piece does
                pieces[first] = " " + pieces[first]
                ends.append((first, len(pieces)))
            else:
                ends.append(None)
        ids = list(map(cache.get, pieces))
        holes = [i for i, x in enumerate(ids) if x is None]
        if holes:
            passing = learn({pieces[i] for i in holes})
            for i in holes:
                ids[i] = cache[pieces[i]]
            for w in passing:
                del cache[w]
        whole = [t for t, e in zip(texts, ends, strict=True) if e is None]
        coded = iter(encode(whole)) if whole else iter(())
        return [(next(coded) if e is None else b"".join(ids[e[0] : e[1]])) + end for e in ends]

    return run


TOKENS = "doc_id long, source string, part long, at long, n long, ids binary"


def _tokenise(path: str, end_id: int):
    def run(batches) -> Iterator[dict]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        encode = _encoder(path, end_id)
        width = 2 if _ids_are_short(path, end_id) else 4
        for whole in batches:
            for b in slices(whole, "text", 2_000_000):
                sources = b.column(1).to_pylist()
                ids = encode([t or "" for t in b.column(2).to_pylist()])
                ns = [len(x) // width for x in ids]
                at = []
                for s, n in zip(sources, ns, strict=True):
                    at.append(seen.get(s, 0))
                    seen[s] = at[-1] + n
                yield {"doc_id": b.column(0), "source": sources, "part": [part] * len(ns), "at": at, "n": ns, "ids": ids}

    return run


def _ids_are_short(path: str, end_id: int) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size() <= 65_536 and end_id < 65_536


class Rounds:
    """Closed forms of the round-robin for queue totals and weights (in 65536ths)."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int):
        self.t, self.w, self.window = totals.astype(np.int64), weights.astype(np.int64), window

    def served(self, r: np.ndarray) -> np.ndarray:
        """Tokens of each source served before round r; rows follow r."""
        return np.minimum(self.t, (r[:, None] * self.w) // PARTS * self.window + (r[:, None] * self.w) % PARTS * self.window // PARTS)

    def round_of(self, s: int, j: np.ndarray) -> np.ndarray:
        """Round in which token j of source s is served."""
        w = int(self.w[s])
        owed = lambda r: (r * w) // PARTS * self.window + (r * w) % PARTS * self.window // PARTS
        r = np.maximum(0, ((j + 1).astype(np.float64) * PARTS / (self.window * w)).astype(np.int64) - 2)
        while (low := owed(r + 1) <= j).any():
            r = r + low
        return r

    def runs(self, s: int, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, offset in it, position in the stream, length) of tokens at .. at+n-1 of queue s, for many documents."""
        first, last = self.round_of(s, at), self.round_of(s, at + n - 1)
        many = last - first + 1
        doc = np.repeat(np.arange(len(at)), many)
        r = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]
        used, back = np.unique(r, return_inverse=True)
        start, low, high = (np.empty(len(used), np.int64) for _ in range(3))
        for k in range(0, len(used), 4096):
            now, nxt = self.served(used[k : k + 4096]), self.served(used[k : k + 4096] + 1)
            start[k : k + 4096] = now.sum(1) + (nxt[:, :s] - now[:, :s]).sum(1)
            low[k : k + 4096], high[k : k + 4096] = now[:, s], nxt[:, s]
        x, y = np.maximum(low[back], at[doc]), np.minimum(high[back], (at + n)[doc])
        pos = start[back] + x - low[back]
        some = y > x
        doc, x, y, pos = doc[some], x[some], y[some], pos[some]
        # rounds that follow each other in the stream make one run
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != (pos + y - x)[:-1])
        ends = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
        return doc[new], (x - at[doc])[new], pos[new], y[ends] - x[new]


def window_pieces(pos: np.ndarray, length: np.ndarray, total: int, window: int) -> tuple[np.ndarray, ...]:
    """(run, skipped tokens of the run, sequence, offset in it, length), cut where sequences end.

    The last total mod window tokens go to sequences of descending powers of two.
    """
    full = total // window
    tail = [full * window]
    while tail[-1] < total:
        tail.append(tail[-1] + (1 << ((total - tail[-1]).bit_length() - 1)))
    tail = np.array(tail, np.int64)

    def sequence(p):
        k = np.searchsorted(tail, p, "right") - 1
        return np.where(p < tail[0], p // window, full + k), np.where(p < tail[0], p // window * window, tail[np.maximum(k, 0)])

    first, _ = sequence(pos)
    last, _ = sequence(pos + length - 1)
    many = last - first + 1
    run = np.repeat(np.arange(len(pos)), many)
    seq = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + first[run]
    begin = np.where(seq <= full, seq * window, tail[np.clip(seq - full, 0, len(tail) - 1)])
    end = np.where(seq < full, begin + window, tail[np.clip(seq - full + 1, 0, len(tail) - 1)])
    a, b = np.maximum(begin, pos[run]), np.minimum(end, (pos + length)[run])
    return run, a - pos[run], seq, a - begin, b - a


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _place(names: list, totals: list[int], weights: list[int], window: int, width: int, with_ids: bool):
    def run(batches) -> Iterator[dict]:
        plan = Rounds(np.array(totals), np.array(weights), window)
        index, total = {s: i for i, s in enumerate(names)}, sum(totals)
        kind = np.dtype("<u2" if width == 2 else "<u4")
        for whole in batches:
            for b in slices(whole, "ids", 2_000_000):
                x = {f: b.column(i) for i, f in enumerate(b.schema.names)}
                queue = np.array([index[s] for s in x["source"].to_pylist()], np.int64)
                n, at = x["n"].to_numpy(), x["at"].to_numpy() + x["base"].to_numpy()
                wide = np.frombuffer(b"".join(x["ids"].to_pylist()), kind).astype("<u4")
                raw, begins = memoryview(wide).cast("B"), np.cumsum(n) - n
                parts = []
                for s in np.unique(queue).tolist():
                    mine = np.flatnonzero(queue == s)
                    doc, lo, pos, length = plan.runs(s, at[mine], n[mine])
                    which, skip, seq, off, k = window_pieces(pos, length, total, window)
                    parts.append((mine[doc[which]], lo[which] + skip, k, seq, off))
                doc, lo, k, seq, off = (np.concatenate(c) for c in zip(*parts, strict=True))
                cut_at = (begins[doc] + lo) * 4
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(cut_at.tolist(), (cut_at + 4 * k).tolist(), strict=True)]
                out = {"doc_id": x["doc_id"].take(pa.array(doc)), "start": lo, "length": k, "ids_crc32": crc, "doc_tokens": n[doc], "sequence_id": seq, "offset": off, "source": x["source"].take(pa.array(doc))}
                if with_ids:
                    out["ids"] = [wide[i:j] for i, j in zip((cut_at // 4).tolist(), (cut_at // 4 + k).tolist(), strict=True)]
                yield out

    return run


def mixture_parts(totals: list[int], weights: list[float] | None) -> list[int]:
    """Weights as 65536ths, one at least; by default the totals' own shares."""
    w = np.array(totals if weights is None else weights, float)
    w = np.ones(len(totals)) if w.sum() <= 0 else w / w.sum()
    return [max(1, int(x)) for x in np.round(w * PARTS)]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, weights: dict | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs in windows of `window` tokens (a power of two); with_ids adds each piece's ids.

    weights: target proportion of tokens by source. The plan is a row per source, which the
    driver reads; everything else stays in tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    tokens = cut(arrow_map(rows, _tokenise(tokenizer, end_id), TOKENS), "tokens")
    from pyspark.sql import Window as W

    sums = tokens.groupBy("source", "part").agg(F.sum("n").alias("sum_n"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = cut(sums.withColumn("base", F.coalesce(F.sum("sum_n").over(before), F.lit(0))), "queues")
    queues = sorted(((r["source"], r["t"]) for r in bases.groupBy("source").agg(F.sum("sum_n").alias("t")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    names, totals = [q[0] for q in queues], [q[1] for q in queues]
    parts = mixture_parts(totals, None if weights is None else [weights.get(s, 0.0) for s in names])
    width = 2 if _ids_are_short(tokenizer, end_id) else 4
    b = bases.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "base")
    placed = tokens.join(b, (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "at", "base", "n", "ids")
    return arrow_map(placed, _place(names, totals, parts, window, width, with_ids), PIECES + (", ids array<int>" if with_ids else ""))
