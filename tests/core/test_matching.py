"""Sums of matches in rows against plain loops, and what a search writes."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from studyforge.operators import index as I
from studyforge.operators import matching as M
from studyforge.operators import relevance


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    units = [(u, sorted({rng.choice("abcdefghij") for _ in range(rng.randrange(0, 6))})) for u in range(300)]
    wants = [(k, g, rng.choice([0.25, 0.5, 1.0]), 0.5) for k in range(12) for g in sorted({rng.choice("abcdefghijkl") for _ in range(4)})]
    df = spark.createDataFrame(units, "unit long, grams array<string>").repartition(3)
    return df, spark.createDataFrame(wants, "key long, gram string, weight double, least double"), units, wants


def plain(units, wants):
    out = {}
    for u, grams in units:
        for k, g, w, _ in wants:
            if g in grams:
                out[k, u] = out.get((k, u), 0) + w
    return {p: s for p, s in out.items() if s >= 0.5}


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_sums_equal_a_loop(rows, monkeypatch, few):
    df, want_df, units, wants = rows
    monkeypatch.setattr(M, "FEW", few)
    got = {(r["key"], r["unit"]): r["have"] for r in M.summed(df, want_df).collect()}
    assert got == pytest.approx(plain(units, wants))
    best = {(r["key"], r["unit"], r["place"]) for r in M.best(M.summed(df, want_df, most=5), 5).collect()}
    every, want = plain(units, wants), set()
    for k in range(12):
        order = sorted((-s, u) for (q, u), s in every.items() if q == k)[:5]
        want |= {(k, u, i + 1) for i, (_, u) in enumerate(order)}
    assert best == want


def test_units_over_several_batches_and_full_tasks(rows, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(M, "HELD", 8)
    rng = random.Random(5)
    data = [(u, no, w, 0.0) for u in range(40) for no in range(5) for w in (rng.choice([0.5, 1.0]),) if rng.random() < 0.6]
    cols = list(zip(*data, strict=True))
    cuts = [0, 1, 2, 30, 31, len(data)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in cols], ["unit", "no", "weight", "least"]) for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = {(u, no): w for u, no, w, _ in data}
    got = [(u, no, h) for b in M._run(batches, None, 0.0) for u, no, h in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    assert {(u, no): h for u, no, h in got} == whole and len(got) == len(whole)
    kept = {(u, no) for b in M._run(batches, 3, 0.0) for u, no in zip(*[c.to_pylist() for c in b.columns[:2]], strict=True)}
    for no in range(5):
        assert {u for _, u in sorted((-w, u) for (u, n), w in whole.items() if n == no)[:3]} <= {u for u, n in kept if n == no}
    near = {(u, no) for b in M._run(batches, 3, 0.5) for u, no in zip(*[c.to_pylist() for c in b.columns[:2]], strict=True)}
    assert near == set(whole) and isinstance(np.zeros(1), np.ndarray)


def test_searches_write_no_table_of_postings(spark, monkeypatch):
    """Every table that an index or a search writes has at most as many rows as there are units, or grams of the queries."""
    rng, sizes = random.Random(9), {}
    letters = "国防军事思想战争信息化装备民兵制度安全的和"
    units = [(i, rng.choice("甲乙"), "".join(rng.choice(letters) for _ in range(30)) + "。") for i in range(400)]

    def spy(df, name, keep=I.stored):
        out = keep(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    for module in (I, M, relevance):
        monkeypatch.setattr(module, "stored", spy)
    index = I.Index(spark.createDataFrame(units, "unit long, chapter string, sentence string"), I.CJK)
    texts = spark.createDataFrame([(1, "国防思想", "甲", 0.3)], "key long, text string, chapter string, least double")
    assert index.top(texts.select("key", "text"), 5).count() == 5
    assert index.covering(texts.select("key", "text", "least")).count() >= 0
    assert index.related(texts.select("key", F.col("text").alias("stem"), "chapter", "least")).count() >= 0
    q = spark.createDataFrame([(1, "国防", ["军事", "的"])], "question long, stem string, options array<string>")
    assert relevance.verdict_pool(q, index, 4, 8).count() == 8
    assert max(sizes.values()) <= len(units)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_retrieval_hashes_no_pairs(spark):
    """Pairs of query and unit are not aggregated by a plan's node, and the best come out whatever a task holds."""
    from studyforge.operators import retrieval

    units = spark.createDataFrame([(u, f"word{u % 7} other{u % 3} same") for u in range(60)], "unit long, sentence string")
    q = spark.createDataFrame([(1, "word3 same"), (2, "other1 none")], "query long, text string")
    top = retrieval.candidates(q, units, 12)
    assert "Aggregate" not in _plan(top)
    got = [(r["unit"], r["hits"]) for r in top.where("query = 1").orderBy("place").collect()]
    both = [u for u in range(60) if u % 7 == 3]
    assert got == [(u, 2) for u in both] + [(u, 1) for u in range(60) if u not in both][: 12 - len(both)]


@pytest.mark.parametrize("few", [1_000_000, 7, 1])
def test_pairs_meet_their_units_without_a_shuffle_of_texts(rows, monkeypatch, few):
    """One broadcast, several, or a shuffled join beyond SLICES: the rows of a plain join."""
    df, *_ = rows
    pairs = df.sparkSession.createDataFrame([(k, u) for k in range(3) for u in range(0, 30, 2)] + [(9, 999)], "key long, unit long")
    want = sorted(tuple(r) for r in pairs.join(df, "unit").select("key", "unit", F.size("grams")).collect())
    monkeypatch.setattr(M, "FEW", few)
    got = M.beside(pairs, df)
    assert sorted(tuple(r) for r in got.select("key", "unit", F.size("grams")).collect()) == want
    if few > 1:
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_grams_are_cut_once(spark, rows):
    """No filter on the size of the cut grams stands before the lookup, as it would cut them again for each unit."""
    want_df = rows[1]
    units = spark.createDataFrame([(1, "a b"), (2, "")], "unit long, sentence string").select("unit", F.array_distinct(F.split("sentence", " ")).alias("grams"))
    got = M.summed(units, want_df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 1
    assert {r["unit"] for r in got.collect()} <= {1}


def test_units_with_a_term_are_found_without_a_shuffle(spark):
    """Short, empty, repeated and upper-case terms too; neither texts nor grams are exchanged."""
    from studyforge.operators import retrieval

    units = [(1, "The Cat sat"), (2, "a cat"), (3, None), (4, "İ no"), (5, "")]
    left = [(1, "CAT"), (2, "a"), (3, "cat s"), (4, "cat"), (5, ""), (6, None), (7, "dog")]
    got = retrieval.containing(spark.createDataFrame(left, "query int, term string"), spark.createDataFrame(units, "unit long, sentence string"))
    want = {(q, u, s) for q, t in left for u, s in units if t is not None and s is not None and t.lower() in s.lower()}
    assert {(r["query"], r["unit"], r["sentence"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_step_does_not_walk_all_occurrences_of_a_term_that_cannot_overlap(monkeypatch):
    """As many look-ups for 5,000 occurrences as for few; counts and open characters are those of a walk, also for terms that overlap themselves."""
    from studyforge.operators import terms

    calls = []
    look = terms.bisect_left
    monkeypatch.setattr(terms, "bisect_left", lambda a, x: calls.append(x) or look(a, x))
    assert terms.piece_step("abc", list(range(0, 15000, 3)), "abc" * 5000)[0] == (5000, 0)
    assert len(calls) <= 3
    rng = random.Random(4)
    for term in ("ab", "aab", "aa", "aba", "abc"):
        for _ in range(200):
            head, piece = term[: rng.randrange(len(term))], "".join(rng.choices("abc", [4, 3, 1], k=rng.randrange(1, 14)))
            starts = [i for i in range(len(piece)) if piece.startswith(term, i)]
            n, rest = terms.piece_step(term, starts, piece)[len(head)]
            assert n == (head + piece).count(term)
            left = (head + piece).split(term)[-1]
            assert rest == max(k for k in range(len(term)) if left.endswith(term[:k]))


def test_pairs_take_their_units_text_along(spark, monkeypatch):
    """Whatever a batch holds, each pair has its own unit's columns, those it was matched on too, and no join of pairs with units stands in the plan."""
    rng = random.Random(12)
    rows = [(u * 7, rng.choice("xy"), f"text {u}", rng.sample("abcdef", rng.randrange(6))) for u in range(300)] + [(9_001, None, None, ["a", "b"]), (9_002, "x", "none", None)]
    units = spark.createDataFrame(rows, "unit long, chapter string, sentence string, grams array<string>")
    wants = [(k, g, c, 1.0 + k, 2.0 * (1 + k)) for k in range(4) for g in "abz" for c in "xy"]
    df = spark.createDataFrame(wants, "key long, gram string, chapter string, weight double, least double")
    told = {(k, u, c, s) for u, c, s, gs in rows for k in range(4) if c is not None and {"a", "b"} <= set(gs or [])}
    free = {(k, u, c, s) for u, c, s, gs in rows for k in range(4) if {"a", "b"} <= set(gs or [])}
    plain = df.where("chapter = 'x'").drop("chapter")
    for few in (1_000_000, 1):
        monkeypatch.setattr(M, "FEW", few)
        for size in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            a = M.summed(units, df, ("gram", "chapter"), along=("chapter", "sentence"))
            b = M.summed(units, plain, along=("sentence", "chapter"))
            assert sorted(tuple(r) for r in a.select("key", "unit", "chapter", "sentence").collect()) == sorted(told)
            assert sorted(map(repr, (tuple(r) for r in b.select("key", "unit", "chapter", "sentence").collect()))) == sorted(map(repr, free))
            assert few == 1 or "unit" not in "".join(x for x in _plan(a).splitlines() if "Join" in x)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(M, "FEW", 1_000_000)
    assert M.summed(units, plain.where("key > 9"), along=("chapter", "sentence")).collect() == []


def test_broadcast_pairs_are_bounded_whatever_the_units_number(spark, rows, monkeypatch):
    """Searches send no pairs to units' texts; other joins of pairs broadcast SLICES * PAIRS of them at most."""
    joined = []
    monkeypatch.setattr(I, "beside", lambda *a: joined.append(a) or M.beside(*a))
    index = I.Index(spark.createDataFrame([(u, "c", f"war army {u % 5} peace") for u in range(40)], "unit long, chapter string, sentence string"))
    texts = spark.createDataFrame([(1, "army war", "army war", "c", 0.2), (2, "peace war army", "peace", "d", 0.5)], "key long, stem string, text string, chapter string, least double")
    found = index.supporting(texts).collect() + index.related(texts.select("key", "stem", "chapter", "least")).collect()
    assert found and index.top(texts.select("key", "text"), 3, slack=0.0).count() == 6 and not joined
    monkeypatch.setattr(M, "PAIRS", 2)
    pairs = spark.createDataFrame([(k, k) for k in range(2 * M.SLICES + 1)], "key long, unit long")
    plan = M.beside(pairs, rows[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("held", [50, 200])
def test_pairs_below_a_full_list_are_dropped_as_they_come(monkeypatch, held):
    """A task sorts few of its pairs again once its lists are full, and keeps the best of each key, ties by unit."""
    monkeypatch.setattr(M, "HELD", held)
    rng, seen, batches, want = random.Random(5), [], [], {}
    for b in range(100):
        rows = [(u, no, rng.choice([0.1, 0.2, 0.3, 0.4]), 0.0) for u in range(b * 10, b * 10 + 10) for no in rng.sample(range(7), 4) if no < 6 or b > 90]
        for u, no, w, _ in rows:
            want.setdefault(no, []).append((-w, u))
        batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["unit", "no", "weight", "least"]))
    plain = M._best
    monkeypatch.setattr(M, "_best", lambda *a: seen.append(len(a[0])) or plain(*a))
    got = {}
    for b in M._run(batches, 5, 0.0):
        for u, no, have in zip(*[c.to_pylist() for c in b.columns]):
            got.setdefault(no, []).append((-have, u))
    assert got.keys() == want.keys() and all(sorted(got[no])[:5] == sorted(want[no])[:5] for no in want)
    assert sum(seen) < sum(b.num_rows for b in batches)
