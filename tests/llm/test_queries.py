"""The numbered queries against brute force over whole test tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest

from studyforge.llm import queries as Q

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are absent")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_op3_equals_all_pairs(spark):
    docs = docs_of(SMALL)
    sets = {}
    for d in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"] or ""))
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(k for k in sets if sets[k])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(Q.op3_jaccard_join(spark, SMALL))}
    assert got == {k: (len(s), find(k)) for k, s in sets.items()}


def rank_quality(scored, labels):
    """Area under the ROC curve of (doc_id, score)."""
    pos = [s for d, s in scored if labels.get(d) == 1]
    neg = [s for d, s in scored if labels.get(d) == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_op4_learns_what_labels_mark(spark):
    got = rows(Q.op4_quality(spark, MORE))
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in docs_of(MORE))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{MORE}/labels.parquet").to_pylist()}
    assert rank_quality([(r["doc_id"], r["score"]) for r in got if r["held_out"]], labels) > 0.9


def test_op6_sums_come_near_targets(spark):
    docs = docs_of(MORE)
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append(d["doc_id"])
    order = sorted(by, key=lambda s: (s is None, s or ""))
    got = {r["doc_id"]: r for r in rows(Q.op6_mixing(spark, MORE))}
    assert {k: r["size"] for k, r in got.items()} == size
    total, want, open_ = sum(size.values()), {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while open_:
        share = {s: (total - sum(want.values())) * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * sum(size[d] for d in by[s])]
        for s in over or list(open_):
            want[s] = min(share[s], 3 * sum(size[d] for d in by[s]))
            del open_[s]
    for s, ids in by.items():
        assert all(math.isclose(got[d]["target"], want[s]) for d in ids)
        assert all(got[d]["taken"] <= 3 * size[d] and got[d]["taken"] % max(1, size[d]) == 0 for d in ids)
        assert abs(sum(got[d]["taken"] for d in ids) - want[s]) <= max(0.02 * want[s], max(size[d] for d in ids) / 2)
    again = {r["doc_id"]: r["taken"] for r in rows(Q.op6_mixing(spark, MORE))}
    assert again == {k: r["taken"] for k, r in got.items()}


def test_op7_counts_slots_and_copies(spark):
    docs = docs_of(MORE)
    got = rows(Q.op7_sharding(spark, MORE))
    text = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "rows" and r["grown_shard"] is None for r in got)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    groups = defaultdict(set)
    for r in got:
        groups[text[r["doc_id"]]].add(r["shard"])
    many = [g for t, g in groups.items() if sum(1 for x in text.values() if x == t) > 1]
    assert sum(len(g) == 1 for g in many) >= 0.9 * len(many)


@pytest.mark.parametrize("sf", [SMALL, MORE])
def test_op8_equals_its_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.sql(Q.OP8_SQL).fetchall()
    assert sorted(map(tuple, Q.op8_exact_dedup(spark, sf).collect())) == sorted(want)


def test_op9_edits_and_likeness(spark):
    docs = sorted(docs_of(SMALL), key=lambda d: d["doc_id"])
    got = {r["doc_id"]: r for r in rows(Q.op9_fingerprints(spark, SMALL))}
    assert len(got) == len(docs)
    by_text = defaultdict(set)
    for i, d in enumerate(docs):
        a, b, r = d["text"] or "", docs[(i + 1) % len(docs)]["text"] or "", got[d["doc_id"]]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[a].add(r["fingerprint"])
        if len(a) > 400 and a != b:
            assert 0.25 < r["near_edited"] < 0.95 and r["near_edited"] > r["near_next"]
    assert all(len(x) == 1 for x in by_text.values()) and len({x for s in by_text.values() for x in s}) == len(by_text)


def test_op10_finds_the_language(spark):
    docs = {d["doc_id"]: d for d in docs_of(MORE)}
    got = rows(Q.op10_language_id(spark, MORE))
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    known = {d["lang"] for d in docs.values()} - {None}
    right = total = 0
    for r in got:
        d = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] == "und"
            continue
        assert r["lang_pred"] in known
        if r["held_out"] and d["lang"] is not None:
            right, total = right + (r["lang_pred"] == d["lang"]), total + 1
    assert right / total > 0.9


def test_op2_takes_every_page_once(spark):
    pages = {p["page_id"]: p for p in pq.read_table(f"{MORE}/pages.parquet").to_pylist()}
    got = rows(Q.op2_html_text(spark, MORE))
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        assert all(line == " ".join(line.split()) and line for line in r["text"].split("\n")) or not r["text"]
        assert "<script" not in r["text"] and "</" not in r["text"]
    assert sum(1 for r in got if r["text"]) > 0.8 * len(got)
