"""Secret scans with one combined deterministic automaton.

All rule regexes become one automaton by subset construction and minimisation; its
transition array over byte classes reads every byte of a text once, for all rules. Where it
accepts, the rule's reversed automaton walks back to the leftmost start and its anchored
one forward to the longest end, so a rule's matches are leftmost and do not overlap.

A batch's texts lie in one buffer, cut into lanes after bytes that lead every state back to
the start; the lanes advance together, one array step for each byte. A long stretch without
such a byte is cut anywhere: its lanes begin in the start state too, and those that turn out
to follow another state are walked again from that one, until none changes.

Defined results: null text counts as empty (no spans, the hash of the empty string);
repeated rows give a row each; an empty table gives no rows. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re._parser as sre
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

LANE = 1024


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches shorter than `least` are dropped after they have been consumed.

    value: measure the assigned value alone.
    """

    kind: str
    regex: str
    least: int = 0
    value: bool = False
    base: bool = False


#: Fixed values. Least lengths are checked after a match, which keeps counters and their
#: products out of the automaton; `hex` counts in it, since a letter or two match often.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", least=8, value=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


@dataclass
class Nfa:
    """Thompson fragments: arcs[state] = [(byte set as a 256-bit int, target)], eps[state] = targets."""

    arcs: list = field(default_factory=list)
    eps: list = field(default_factory=list)

    def state(self) -> int:
        self.arcs.append([])
        self.eps.append([])
        return len(self.arcs) - 1


def _bytes_of(items, fold: bool) -> int:
    out, negate = 0, False
    for op, arg in items:
        name = str(op)
        if name == "NEGATE":
            negate = True
        elif name == "LITERAL":
            out |= 1 << arg
        elif name == "RANGE":
            out |= sum(1 << c for c in range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"not supported in a rule: {name}")
    if fold:
        for c in range(65, 91):
            both = 1 << c | 1 << c + 32
            if out & both:
                out |= both
    return ~out & (1 << 256) - 1 if negate else out


def _build(nfa: Nfa, seq, start: int, fold: bool, back: bool) -> int:
    """Add a parsed sequence after start (reversed if back); returns its end state."""
    items = list(seq)
    for op, arg in reversed(items) if back else items:
        name = str(op)
        if name in ("LITERAL", "IN"):
            end = nfa.state()
            nfa.arcs[start].append((_bytes_of([(op, arg)] if name == "LITERAL" else arg, fold), end))
            start = end
        elif name == "SUBPATTERN":
            start = _build(nfa, arg[3], start, fold or bool(arg[1] & 2), back)
        elif name == "BRANCH":
            end = nfa.state()
            for way in arg[1]:
                first = nfa.state()
                nfa.eps[start].append(first)
                nfa.eps[_build(nfa, way, first, fold, back)].append(end)
            start = end
        elif name == "MAX_REPEAT":
            low, high, what = arg
            for _ in range(low):
                start = _build(nfa, what, start, fold, back)
            if high == sre.MAXREPEAT:
                loop = nfa.state()
                nfa.eps[start].append(loop)
                nfa.eps[_build(nfa, what, loop, fold, back)].append(loop)
                start = loop
            else:
                end = nfa.state()
                nfa.eps[start].append(end)
                for _ in range(high - low):
                    start = _build(nfa, what, start, fold, back)
                    nfa.eps[start].append(end)
                start = end
        else:
            raise ValueError(f"not supported in a rule: {name}")
    return start


@dataclass
class Automaton:
    """next[state * classes + cls[byte]]; accepts[state] is a bit mask of rules; state 0 is dead if anchored."""

    cls: np.ndarray
    classes: int
    next: np.ndarray
    accepts: np.ndarray
    start: int


def compile_rules(regexes: list[str], search: bool, back: bool = False) -> Automaton:
    """One minimal automaton for all regexes; search: a match may start at any byte."""
    nfa, starts, ends = Nfa(), [], {}
    for i, r in enumerate(regexes):
        s = nfa.state()
        starts.append(s)
        end = _build(nfa, sre.parse(r), s, False, back)
        ends[end] = ends.get(end, 0) | 1 << i
    return _minimal(*_subsets(nfa, starts, ends, search))


def _subsets(nfa: Nfa, starts: list[int], ends: dict[int, int], search: bool):
    sets = {s for arcs in nfa.arcs for s, _ in arcs}
    sig: dict[tuple, int] = {}
    order = sorted(sets)
    cls = np.array([sig.setdefault(tuple(s >> b & 1 for s in order), len(sig)) for b in range(256)], np.int64)
    sample = [int(np.flatnonzero(cls == k)[0]) for k in range(len(sig))]

    def closure(states) -> int:
        seen, todo = 0, list(states)
        while todo:
            s = todo.pop()
            if not seen >> s & 1:
                seen |= 1 << s
                todo += nfa.eps[s]
        return seen

    step = [[closure([t for chars, t in nfa.arcs[s] if chars >> b & 1]) for b in sample] for s in range(len(nfa.arcs))]
    first = closure(starts)
    number, todo, rows = {0: 0}, [0], []
    if first not in number:
        number[first] = 1
        todo.append(first)
    at = 0
    while at < len(todo):
        members, cur = [], todo[at]
        while cur:
            low = cur & -cur
            members.append(low.bit_length() - 1)
            cur ^= low
        row = []
        for k in range(len(sample)):
            to = first if search else 0
            for s in members:
                to |= step[s][k]
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
        at += 1
    accepts = np.zeros(len(todo), np.int64)
    for i, s in enumerate(todo):
        for e, mask in ends.items():
            if s >> e & 1:
                accepts[i] |= mask
    return cls, np.array(rows, np.int64), accepts, number[first]


def _minimal(cls: np.ndarray, rows: np.ndarray, accepts: np.ndarray, start: int) -> Automaton:
    """Merge equivalent states by refining the accept partition until it is stable."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    rep = np.unique(block, return_index=True)[1]
    # the dead (or first) state keeps number 0
    perm = np.argsort(rep, kind="stable")
    rank = np.empty(len(rep), np.int64)
    rank[perm] = np.arange(len(rep))
    nxt, acc = rank[block[rows[rep[perm]]]], accepts[rep[perm]]
    return Automaton(cls, rows.shape[1], nxt.astype(np.int32).ravel(), acc, int(rank[block[start]]))


class Scanner:
    """The combined automaton and, for each rule, its anchored and its reversed one."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = compile_rules([r.regex for r in rules], search=True)
        self.ahead = [compile_rules([r.regex], search=False) for r in rules]
        self.behind = [compile_rules([r.regex], search=False, back=True) for r in rules]
        self.alone = [compile_rules([r.regex], search=True) for r in rules]
        to = self.all.next.reshape(-1, self.all.classes)
        resets = [k for k in range(self.all.classes) if (to[:, k] == self.all.start).all()]
        self.resets = np.isin(self.all.cls, resets)
        if not self.resets[10] or self.all.accepts[self.all.start]:
            raise ValueError("rules must not match across lines or match nothing")

    def events(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, rule mask) wherever the combined automaton accepts; one pass over data, which ends in a newline."""
        a, n = self.all, len(data)
        cut = np.flatnonzero(self.resets[data]) + 1
        want = np.arange(LANE, n, LANE)
        starts = np.unique(np.concatenate([[0], cut[np.minimum(np.searchsorted(cut, want), len(cut) - 1)]]))
        starts = starts[starts < n]
        lens = np.diff(np.append(starts, n))
        # lanes without such a byte are cut anywhere; the states in which they begin are guessed and put right
        many = -(-lens // (4 * LANE))
        turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(starts, many) + turn * 4 * LANE
        lens = np.diff(np.append(starts, n))
        codes = a.cls.astype(np.uint8)[data]
        first = np.full(len(starts), a.start, np.int32)
        last = np.empty(len(starts), np.int32)
        todo = np.arange(len(starts))
        lane, pos, mask = (np.zeros(0, np.int64) for _ in range(3))
        while len(todo):
            last[todo], *found = self._walk(codes, starts[todo], lens[todo], first[todo])
            old = ~np.isin(lane, todo)
            lane, pos, mask = (np.concatenate([x[old], y]) for x, y in zip((lane, pos, mask), (todo[found[0]], *found[1:]), strict=True))
            after = todo[todo + 1 < len(starts)] + 1
            todo = after[(turn[after] > 0) & (first[after] != last[after - 1])]
            first[todo] = last[todo - 1]
        by = np.argsort(pos, kind="stable")
        return pos[by], mask[by]

    def _walk(self, codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
        """The state after each lane, and lane, end and rule mask of all that is accepted, in one pass over the lanes."""
        a, none = self.all, np.zeros(0, np.int64)
        hits = [(none, none, none)]
        order = np.argsort(-lens, kind="stable")
        at, lens, state = starts[order], lens[order], state[order]
        has = a.accepts != 0
        for k in np.searchsorted(-lens, -np.arange(lens[0]), side="left").tolist():
            s = a.next.take(state[:k] * a.classes + codes.take(at[:k]))
            state[:k] = s
            at[:k] += 1
            good = np.flatnonzero(has.take(s))
            if len(good):
                hits.append((order[good], at[good], a.accepts[s[good]]))
        out = np.empty(len(order), np.int32)
        out[order] = state
        return [out, *(np.concatenate(x) for x in zip(*hits, strict=True))]

    def first_start(self, rule: int, data: bytes, end: int, low: int) -> int:
        """Leftmost start of a match that ends at end and starts at low or later; -1 if none."""
        a, found = self.behind[rule], -1
        s, cls, nxt, k = a.start, a.cls, a.next, a.classes
        for i in range(end - 1, low - 1, -1):
            s = nxt[s * k + cls[data[i]]]
            if a.accepts[s]:
                found = i
            elif s == nxt[s * k] and (nxt[s * k : s * k + k] == s).all():
                break
        return found

    def next_end(self, rule: int, data: bytes, low: int, high: int) -> int:
        """First end of a match that starts at low or later; beyond high if none."""
        a = self.alone[rule]
        s, cls, nxt, k = a.start, a.cls, a.next, a.classes
        for i in range(low, high):
            s = nxt[s * k + cls[data[i]]]
            if a.accepts[s]:
                return i + 1
        return high + 1

    def last_end(self, rule: int, data: bytes, start: int, high: int) -> int:
        a, found = self.ahead[rule], -1
        s, cls, nxt, k = a.start, a.cls, a.next, a.classes
        for i in range(start, high):
            s = nxt[s * k + cls[data[i]]]
            if a.accepts[s]:
                found = i + 1
            elif (nxt[s * k : s * k + k] == s).all():
                break
        return found

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end) in bytes, in that order."""
        joined = b"\n".join(texts) + b"\n"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        pos, mask = self.events(np.frombuffer(joined, np.uint8))
        reached = [0] * len(self.rules)
        wait = [0] * len(self.rules)
        for doc, e, m in zip(np.searchsorted(ends, pos).tolist(), pos.tolist(), mask.tolist(), strict=True):
            begin = int(ends[doc - 1]) + 1 if doc else 0
            for r in range(len(self.rules)):
                if not m >> r & 1 or e <= reached[r] or e < wait[r]:
                    continue
                start = self.first_start(r, joined, e, max(begin, reached[r]))
                if start < 0:  # what ends here began in the match before
                    wait[r] = self.next_end(r, joined, max(begin, reached[r]), int(ends[doc]))
                    continue
                stop = self.last_end(r, joined, start, int(ends[doc]))
                reached[r] = stop
                rule = self.rules[r]
                if rule.least and (value_length(joined[start:stop]) if rule.value else stop - start) < rule.least:
                    continue
                out[doc].append((start - begin, r, stop - begin))
        for spans in out:
            spans.sort()
        return out


def value_length(match: bytes) -> int:
    """Length of the assigned value: what follows the first : or = and its spaces and quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return len(rest) - (rest[:1] in (b"'", b'"'))


def _code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    out, at, chars = [], 0, 0
    points = sorted({p for s, _, e in spans for p in (s, e)})
    where = {}
    for p in points:
        chars += len(text[at:p].decode("utf-8", "surrogatepass"))
        at, where[p] = p, chars
    for s, r, e in spans:
        out.append((where[s], r, where[e]))
    return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans array<struct<kind,start,end>> for every row of docs, by start, then in the rules' order."""
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]

    def run(batches) -> Iterator[dict]:
        for whole in batches:
            for b in slices(whole, "text", 4_000_000):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
                found = scanner.scan(texts)
                spans = [[{"kind": kinds[r], "start": s, "end": e} for s, r, e in _code_points(t, f)] for t, f in zip(texts, found, strict=True)]
                yield {"doc_id": b.column(0), "spans": spans}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the hash of their spans and all spans as text."""
    base = [r.kind for r in rules if r.base]
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    found = find_secrets(docs, rules)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    n = [of(k).alias(f"n_{k}") for k in base]
    own = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(base)), text), ",")
    return found.select("doc_id", *n, F.sha2(F.encode(own, "UTF-8"), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))
