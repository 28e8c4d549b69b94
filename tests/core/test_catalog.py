"""Every core query with SQL equals DuckDB over the same tables."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from studyforge.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def db():
    d = duckdb.connect()
    d.sql("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        d.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return d


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    want = db.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_two_key_dedupe_is_the_greedy_pass(spark):
    from studyforge.operators.folds import two_key_dedupe

    rows = [(0, "s1", "c1"), (1, "s2", "c1"), (2, "s2", "c2"), (3, "s3", "c3")]
    pool = spark.createDataFrame(rows, "ord int, stem string, concept string")
    assert sorted(r["ord"] for r in two_key_dedupe(pool, "ord", "stem", "concept").collect()) == [0, 2, 3]
    all_rows = [(r["question"], r["stem"], r["concept"]) for r in spark.read.parquet(f"{SF}/part.parquet").selectExpr("p_partkey question", "p_name stem", "concat_ws('|', p_type, p_brand) concept").collect()]
    seen_a, seen_b, want = set(), set(), []
    for k, a, b in sorted(all_rows):
        if a not in seen_a and b not in seen_b:
            want.append(k)
            seen_a.add(a)
            seen_b.add(b)
    assert sorted(r["question"] for r in catalog.QUERIES["exam_pool_dedupe"](spark, SF).collect()) == want


def test_first_matches_find_parts_of_words_short_terms_and_unspaced_text(spark):
    from studyforge.operators.retrieval import first_matches

    units = ["An unbreakable record", "a break in the code", "国防的对象一是侵略", "Breaking news", "the re", "break break", "unbreak", "break"]
    terms = ["break", "BREAK", "re", "的对象", "防", "in th", "no such", "e", "", None]
    u = spark.createDataFrame(list(enumerate(units)), "unit long, sentence string")
    t = spark.createDataFrame(list(enumerate(terms)), "query long, term string")
    want = [(q, k, i + 1) for q, term in enumerate(terms) if term is not None for i, k in enumerate([k for k, s in enumerate(units) if term.lower() in s.lower()][:4])]
    assert sorted(map(tuple, first_matches(t, u).collect())) == want


@pytest.fixture(scope="module")
def evidence(spark):
    """Two questions, a crowd of units of another chapter before the own ones, and what brute force finds for each."""
    texts = [f"alpha bravo delta gamma number{k}" for k in range(450)] + ["alpha bravo omega other words here", "gamma delta alpha omega", "nothing in common"]
    units = [(k, "hot" if k < 450 else "own", t) for k, t in enumerate(texts)]
    queries = [(1, "alpha bravo delta gamma", "alpha bravo", "own"), (2, "alpha bravo delta gamma", "alpha bravo", "none"), (3, "gamma delta omega", "delta", None), (4, "unheard words", "x", "own")]
    u = spark.createDataFrame(units, "unit long, chapter string, sentence string")
    return spark.createDataFrame(queries, "query long, text string, answer string, chapter string"), u, queries, units


def test_evidence_is_ranked_like_brute_force(evidence):
    """The answer's cover by words and pairs of words, its run, and the stem's score, in the stem's own chapter first."""
    from studyforge.functions.spans import fit
    from studyforge.operators.index import WORDS, Index

    q, u, queries, units = evidence
    words = lambda t: [w for w in t.split() if len(w) >= 2]
    pairs = lambda t: {" ".join(p) for p in zip(words(t), words(t)[1:], strict=False)}
    every = {k: set(words(t)) | pairs(t) for k, _, t in units}
    df = {w: sum(w in g for g in every.values()) / len(units) for w in set().union(*every.values())}
    weight = lambda w: (1 + 60 * df[w]) ** (-1.3 if " " in w else -1.6) if w in df else 0.05
    best = {}
    for query, text, answer, chapter in queries:
        own, stem = set(words(answer)) | pairs(answer), set(words(text))
        for k, c, t in units:
            cover = sum(weight(w) for w in own & every[k]) / sum(map(weight, own)) if own else 0.0
            run, base = fit(answer, t), set(words(t))
            hit = sum(1 + min(len(w), 6) / 12 for w in stem & base) / len(stem)
            like = 0.62 * hit + 0.28 * len(stem & base) / len(stem | base) + 0.10 * (c == chapter)
            parts = (0.50, 0.22, 0.28) if len(answer.replace(" ", "")) <= 6 else (0.38, 0.36, 0.26)
            rank = round(parts[0] * run + parts[1] * cover + parts[2] * min(like, 1.0), 6)
            if cover >= 0.45 and run >= 0.5 and len(answer) >= 2:
                best[query] = min(best.get(query, (9,)), (0 if chapter in (None, c) else 2, -rank, k))
    targets = q.select(F.col("query").alias("key"), F.col("text").alias("stem"), F.col("answer").alias("text"), "chapter", F.lit(0.45).alias("least"))
    got = {r["key"]: (r["unit"], r["rank"]) for r in Index(u, WORDS).find(targets).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[2] for k, v in best.items()} and got[1][0] == 450
    assert all(abs(v[1] + best[k][1]) < 1e-5 for k, v in got.items())


def test_evidence_takes_a_tokeniser_and_a_general_chapter(spark):
    from studyforge.operators.index import CJK, Index

    u = spark.createDataFrame([(1, "其他", "国防的对象，一是侵略，二是武装颠覆"), (2, "通用", "国防的对象，一是侵略，二是武装颠覆和分裂。"), (3, "一", "没有关系"), (4, "一", "一是侵略是什么？")], "unit long, chapter string, sentence string")
    q = spark.createDataFrame([(1, "国防的对象一是侵略", "一是侵略", "一", 0.45)], "key long, stem string, text string, chapter string, least double")
    i = Index(u, CJK)
    assert [(r["unit"], r["pool"]) for r in i.find(q, general="通用").collect()] == [(2, 1)]
    # the chapter's own unit shares a gram with the stem, so others are not related
    assert {r["unit"] for r in i.related(q.withColumn("least", F.lit(0.3))).collect()} == {4}
