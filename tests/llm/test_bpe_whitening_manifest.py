"""Byte-level BPE, whitening and the Merkle manifest against brute force."""

import hashlib
import os
import random
import zlib
from math import floor

import numpy as np
import pyarrow.parquet as pq
import pytest

from studyforge.llm import byte_bpe, whitening
from studyforge.llm import merkle_manifest as manifest
from studyforge.llm import queries as Q
from studyforge.llm.common import tokenizer_path

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are absent")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table_of(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def tik():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_bpe(got, docs, tik):
    want = []
    for d in docs:
        ids = np.array(tik.encode_ordinary(d["text"] or ""), "<u4")
        want.append((d["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@needs_tables
def test_op11_equals_tiktoken_over_the_whole_table(spark, tik):
    check_bpe(Q.op11_byte_bpe(spark, MORE).collect(), table_of(MORE, "documents"), tik)


def test_bpe_of_odd_texts(spark, tik, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " ", "\x00\x01", "a" * 3_000, "ab" * 9_000, "x" * 200 + "é" * 50, "\U0001f600 你好　\n\n  end", "<|endoftext|> 's 'T I'll", "​﻿", "1234567 ٤٥"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(300)) for _ in range(30)]
    docs = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    docs += [docs[5], {"doc_id": None, "text": "again"}]
    df = spark.createDataFrame([(d["doc_id"], d["text"], 7, "x") for d in docs], "doc_id long, text string, ids int, decoded string")
    import public_tokenizers

    args = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    check_bpe(byte_bpe.round_trip(df, *args).collect(), docs, tik)
    assert byte_bpe.round_trip(df.limit(0), *args).count() == 0
    # a small memory of pre-tokens, and texts in stretches, change nothing
    monkeypatch.setattr(byte_bpe, "KEPT", 3)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 40)
    monkeypatch.setattr(byte_bpe, "STRETCH", 5)
    model, ids = byte_bpe.model_of(args[0])
    codec = byte_bpe.Codec(model, np.frombuffer(ids, "<u4"), args[1])
    for t, ids in zip(texts, codec.encode([t or "" for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(t or "")
        assert codec.decode(ids).decode() == (t or "")


def test_every_entry_of_the_vocabulary_is_a_piece_with_its_id():
    ranks = byte_bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    model, ids = byte_bpe.model_of(tokenizer_path("byte_bpe_50k.tiktoken"))
    codec = byte_bpe.Codec(model, np.frombuffer(ids, "<u4"), r"(?s).+")
    assert {e: int(codec.ids[i]) for i, e in enumerate(codec.entries)} == ranks
    assert [codec.pieces.get_score(i) for i in (0, 9, 50_000)] == [0.0, -9.0, -50_000.0]
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0})


def brute_whitening(rows, k=4):
    kept = [(i, [floor(256.0 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    y = np.array([[(n * a - b) / n for a, b in zip(x, s, strict=True)] for x in fit])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = []
    for i, x in kept:
        w = np.array([(n * a - b) / n for a, b in zip(x, s, strict=True)]) @ u / np.sqrt(e)
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        out += [(i, c + 1, n, dev, w[c], e[c] / (y * y).sum() * n) for c in range(len(e))]
    return out


def same_whitening(got, want):
    assert len(got) == len(want)
    got, want = sorted(got, key=lambda r: r[:4]), sorted(want, key=lambda r: r[:4])
    assert [tuple(r[:4]) for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in x if r[1] == c]) for x in (got, want))
        sign = np.sign(a @ b)
        assert np.abs(a * sign - b).max() < 1e-8
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert {r[6] for r in got} == {got[0][6]} and got[0][6] < 1e-9


@needs_tables
def test_op12_equals_dense_eigenvectors_over_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table_of(MORE, "embeddings")]
    same_whitening(Q.op12_whitening(spark, MORE).collect(), brute_whitening(rows))


def test_whitening_leaves_out_unfit_rows_and_keeps_repeats(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(6)]) for i in range(60)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    rows += [rows[3], (100, rows[3][1]), (101, None), (102, [1.0, None, 0, 0, 0, 0]), (103, [float("nan")] + [0.0] * 5), (104, [float("inf")] + [0.0] * 5), (None, rows[5][1])]
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component string")
    got = [(r["vec_id"] if r["vec_id"] is not None else -1, *list(r)[1:]) for r in whitening.whiten(df).collect()]
    same_whitening([(*g[:3], int(g[3]), *g[4:]) for g in got], brute_whitening([(-1 if i is None else i, v) for i, v in rows]))


def test_whitening_of_poor_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], kind)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])], kind)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in same) == [(i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], kind)).collect()
    assert {r["component"] for r in line if r["whitened"] is None} == {2}
    assert {round(r["explained"], 9) for r in line if r["component"] == 1} == {1.0}
    # numbers that squares of longs cannot hold
    far = whitening.whiten(spark.createDataFrame([(1, [3e12]), (2, [-3e12])], kind)).collect()
    x = [floor(256 * float(np.float32(s * 3e12))) for s in (1, -1)]
    assert {int(r["deviation"]) for r in far} == {(2 * x[0] - sum(x)) ** 2}


def test_range_finder_stays_narrow_where_the_spectrum_falls(spark, tmp_path):
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    x = np.floor(256 * (rng.standard_normal((3_000, 40)) * np.geomspace(30, 1e-3, 40)) @ turn).astype(int)
    spark.createDataFrame([(r,) for r in x.tolist()], "x array<bigint>").repartition(40).write.parquet(str(tmp_path / "fit"))
    fit = spark.read.parquet(str(tmp_path / "fit"))
    n, sums = whitening.exact_sums(fit, 40)
    assert (n, sums) == (3_000, x.sum(axis=0).tolist())
    mean = x.mean(axis=0)
    e, u, trace, width = whitening.principal_components(fit, mean, n, 4, 12, 6, 1e-10, 5)
    want, vec = np.linalg.eigh(np.cov(x.T, bias=True))
    assert width == 16 and np.allclose(e, want[::-1][:4], rtol=1e-10) and np.isclose(trace, want.sum())
    assert np.abs(np.abs((u * vec[:, ::-1][:, :4]).sum(axis=0)) - 1).max() < 1e-12
    # a flat spectrum needs the full dimension
    flat = spark.createDataFrame([(r,) for r in rng.integers(-99, 99, (500, 40)).tolist()], "x array<bigint>")
    assert whitening.principal_components(flat, np.zeros(40), 500, 4, 12, 3, 1e-12, 5)[3] == 40


H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, text):
    out = ""
    for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(out)


def tree(nodes, fanout=16):
    """Root and, for each leaf, its siblings by level as (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // fanout * fanout : i // fanout * fanout + fanout]
            paths[k].append((run[: i % fanout], run[i % fanout + 1 :]))
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def brute_manifest(docs):
    lists = {}
    for d in docs:
        lists.setdefault(d["source"], []).append(d)
    names = sorted(lists, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        lists[s].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
        trees[s] = tree([leaf(d, d["text"]) for d in lists[s]])
    root, over = tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, over, strict=True):
        for d, path in zip(lists[s], trees[s][1], strict=True):
            steps = path + up
            text = d["text"]
            if text is not None and d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            fold = leaf(d, text)
            for before, after in steps:
                fold = H(*before, fold, *after)
            out.append((d["doc_id"], leaf(d, d["text"]), trees[s][0], root, H(*[x for b, a in steps for x in b + a]), fold, fold == root))
    return sorted(out, key=str)


@needs_tables
@pytest.mark.parametrize("sf", [SMALL, MORE])
def test_op13_equals_brute_force_over_the_whole_table(spark, sf):
    got = sorted((tuple(r) for r in Q.op13_merkle_manifest(spark, sf).collect()), key=str)
    assert got == brute_manifest(table_of(sf, "documents"))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("count,sources", [(0, 1), (1, 1), (16, 1), (17, 1), (257, 2), (300, 40), (700, 3)])
def test_manifest_of_odd_tables(spark, count, sources):
    rng = random.Random(count)
    docs = [{"doc_id": rng.choice([None, rng.randrange(60), i + 100]), "text": rng.choice([None, "", "Aé你" * rng.randrange(9), "Same Text"]), "lang": rng.choice([None, "en"]), "source": rng.choice([None, "", *[f"s{k}" for k in range(sources)]]) if sources > 1 else "s", "n_chars": rng.choice([None, i])} for i in range(count)]
    docs += docs[:5] if count > 20 else []
    df = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"], "x", 1) for d in docs], DOCS + ", key string, index int").repartition(5)
    got = sorted((tuple(r) for r in manifest.verify_tampered(df).collect()), key=str)
    assert got == (brute_manifest(docs) if docs else [])


def test_stack_leaves_edges_open():
    seen = []
    stack = manifest.MountainRange(4, lambda *n: seen.append(n))
    digests = {i: str(i) for i in range(6, 45)}
    for i, d in digests.items():
        stack.push(i, d)
    stack.end()
    leaves = {n[1]: n[3] for n in seen if n[0] == 0}
    assert [i for i, is_open in sorted(leaves.items()) if is_open] == [6, 7, 44]
    # parents 2 to 10 are made here; run 0 to 3 began before and run 8 to 11 is not full
    assert sorted((n[1], n[3]) for n in seen if n[0] == 1) == [(2, True), (3, True), *[(i, False) for i in range(4, 8)], (8, True), (9, True), (10, True)]
    assert [(n[1], n[2]) for n in seen if n[0] == 2] == [(1, H(*[H(*[str(4 * p + j) for j in range(4)]) for p in range(4, 8)]))]


@needs_tables
def test_op13_equals_its_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = db.sql(Q.OP13_SQL)
    got = Q.op13_merkle_manifest(spark, SMALL).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
