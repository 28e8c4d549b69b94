"""Bounded searches, the ladder and term searches against plain loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from studyforge.operators import index as I
from studyforge.operators import ladder, terms

PUNCT = re.compile(r"[，。、；：？！“”‘’（）《》〈〉【】\[\](),.;:?!\"'·…—\-_/\\|~`]")


def norm(s):
    return "".join(PUNCT.sub("", s).split())


def gram(s, n):
    t = norm(s)
    return {t[i : i + n] for i in range(len(t) - n + 1)}


class Plain:
    """Every unit looked at for every search."""

    def __init__(self, units):
        self.units, n, self.w = units, len(units), {}
        for size, power in ((2, 1.6), (3, 1.3)):
            df = {}
            for _, _, s in units:
                for g in gram(s, size):
                    df[g] = df.get(g, 0) + 1
            for g, k in df.items():
                self.w[g] = max(self.w.get(g, 0), (1 + 60 * k / n) ** -power)

    def cover(self, text, s):
        own = gram(text, 2) | gram(text, 3)
        whole = sum(self.w.get(g, 0.05) for g in own)
        return round(sum(self.w.get(g, 0.05) for g in own if g in gram(s, 2) | gram(s, 3)) / whole, 9) if whole else 0.0


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    letters = "国防军事思想战争信息化装备民兵制度安全的和"
    units = [(i, rng.choice("甲乙丙"), "".join(rng.choice(letters) for _ in range(rng.randrange(6, 40))) + "。") for i in range(400)]
    units += [(400, "甲", "国防的对象，一是侵略，二是武装颠覆和分裂。"), (401, "乙", "国防有哪些？"), (402, "丙", "在武装力量体制上，一般分为中央军、地方军和边防军。")]
    df = spark.createDataFrame(units, "unit long, chapter string, sentence string")
    return Plain(units), I.Index(df, I.CJK), rng, letters


def test_bounded_searches_equal_a_scan(spark, corpus):
    plain, index, rng, letters = corpus
    texts = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))), rng.choice([0.1, 0.3, 0.6])) for k in range(40)]
    df = spark.createDataFrame(texts, "key long, text string, least double")
    got = {(r["key"], r["unit"]): r["cover"] for r in index.covering(df).collect()}
    want = {(k, u): c for k, t, least in texts for u, _, s in plain.units if (c := plain.cover(t, s)) >= least}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)
    top = {(r["key"], r["place"]): r["unit"] for r in index.top(df.select("key", "text"), 7).collect()}
    for k, t, _ in texts:
        order = sorted(((-plain.cover(t, s), u) for u, _, s in plain.units if plain.cover(t, s) > 0))[:7]
        assert [top.get((k, p)) for p in range(1, len(order) + 1)] == [u for _, u in order] and (k, len(order) + 1) not in top


def plain_keywords(s):
    out = []
    for w in re.findall(r"[一-鿿]+|[A-Za-z]{2,}|\d+(?:\.\d+)?", s):
        if not "一" <= w[0] <= "鿿":
            out.append(w)
        elif len(w) <= 4:
            out += [w] if len(w) >= 2 else []
        else:
            out += [w[i : i + n] for n in (4, 3, 2) for i in range(len(w) - n + 1)]
    return list(dict.fromkeys(out))


def test_related_units_equal_a_scan(spark, corpus):
    plain, index, rng, letters = corpus
    stems = [(k, "".join(rng.choice(letters + "5x ") for _ in range(rng.randrange(2, 16))), rng.choice(["甲", "丁", None]), rng.choice([0.2, 0.45])) for k in range(30)]
    got = {(r["key"], r["unit"]): r["score"] for r in index.related(spark.createDataFrame(stems, "key long, stem string, chapter string, least double")).collect()}
    want = {}
    for k, stem, chapter, least in stems:
        kws, own = plain_keywords(stem), gram(stem, 2)
        pool = [u for u in plain.units if own & gram(u[2], 2)]
        pool = [u for u in pool if u[1] == chapter] or pool
        for u, c, s in pool:
            base = gram(s, 2)
            hit = sum(1 + min(len(w), 6) / 12 for w in kws if w in s)
            score = (hit / len(kws) * 0.62 + len(own & base) / len(own | base) * 0.28 + (c == chapter) * 0.1) if kws else 0.0
            if round(score, 9) >= least:
                want[k, u] = score
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)


QUESTIONS = [
    # question, kind, stem, chapter, options, letters, answer, old; rung, unit, text
    (1, "single", "国防的对象是____", "甲", ["侵略和武装颠覆、分裂", "民兵"], ["A"], None, None, "evidence", 400, "侵略和武装颠覆、分裂 — 国防的对象，一是侵略，二是武装颠覆和分裂。"),
    (2, "single", "下列不属于武装力量体制的是", "丙", ["中央军", "地方军", "边防军", "民兵"], ["D"], None, None, "negative", 402, "正确答案：民兵（武装力量体制的组成项不含它）。依据：在武装力量体制上，一般分为中央军、地方军和边防军。"),
    (3, "multi", "短", None, ["国家", "阶级"], ["A", "B"], None, None, "template", None, None),
    (4, "multi", "无字母", None, ["国家"], ["Z"], None, None, "template", None, "本题答案由原卷答案串解析，建议对照原卷核实。"),
    (5, "judge", "任意", None, None, None, None, "原有", "kept", None, "原有"),
    (6, "judge", "毫无关系xyzzy", None, None, None, None, "人工校订：讲义", "template", None, "人工校订：讲义　本题库未收录教材中的直接出处。"),
    (7, "fill", "武装力量体制上一般分为____", None, None, None, "中央军、地方军和边防军", None, "evidence", 402, "正确答案：中央军、地方军和边防军。在武装力量体制上，一般分为中央军、地方军和边防军。"),
    (8, "short", "qwerty", None, None, None, None, None, "bank", None, "参考答案见下方（本题库收录的是原卷参考答案要点）。"),
    (9, "multi", "国防的对象", "甲", ["侵略，二是武装颠覆", "火星移民计划书草案"], ["A", "B"], None, None, "longest", 400, None),
    (10, "essay", "x", None, None, None, None, None, None, None, None),
]


def test_each_rung(spark, corpus):
    kind = "question long, kind string, stem string, chapter string, options array<string>, letters array<string>, answer string, old string"
    got = {r["question"]: r for r in ladder.explain(spark.createDataFrame([q[:8] for q in QUESTIONS], kind), corpus[1]).collect()}
    assert sorted(got) == [q[0] for q in QUESTIONS if q[1] != "essay"]
    for q in QUESTIONS[:-1]:
        r = got[q[0]]
        # the longest of two options as long as each other is the first
        assert (r["rung"], r["unit"]) == q[8:10], (q, r)
        assert q[10] is None or r["text"] == q[10], r
    assert {got[1]["source"], got[5]["source"], got[6]["source"], got[8]["source"]} == {"textbook", "bank", "manual"} and got[1]["ref"] == "甲" and got[8]["ref"] == ""
    assert ladder.explain(spark.createDataFrame([], kind), corpus[1]).count() == 0


def test_terms_equal_nested_loops(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, rng.choice([None, "", "".join(rng.choice("abcc ") for _ in range(rng.randrange(60)))])) for i in range(80)]
    words = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(0, 5))) for _ in range(40)})
    df = spark.createDataFrame(texts, "id long, text string").repartition(7)
    keys = spark.createDataFrame([(p, w) for p, w in enumerate(words + words[:3])], "place long, term string")
    whole = "".join(t or "" for _, t in texts)
    for size in (terms.BLOCK_CHARS, 20):  # one automaton, and many
        monkeypatch.setattr(terms, "BLOCK_CHARS", size)
        got = {(r["id"], r["term"]) for r in terms.contained(df, keys, "id", "text").collect()}
        assert got == {(i, w) for i, t in texts if t is not None for w in words if w and w in t}
        first = {r["id"]: r["place"] for r in terms.first_key(df, keys, "id", "text").collect()}
        assert first == {i: min(p) for i, t in texts if t and (p := [k for k, w in enumerate(words) if w and w in t])}
        counts = {r["term"]: r["n"] for r in terms.whole_counts(df, keys, "id", "text").collect()}
        assert counts == {w: whole.count(w) for w in words if w}
    monkeypatch.setattr(terms, "CHUNK", 3)
    assert {r["term"]: r["n"] for r in terms.whole_counts(df, keys, "id", "text").collect()} == counts
    assert terms.contained(df, keys.limit(0), "id", "text").count() == terms.first_key(df, keys.limit(0), "id", "text").count() == terms.whole_counts(df, keys.limit(0), "id", "text").count() == 0


def test_pieces_compose_to_the_whole_count():
    rng = random.Random(1)
    for _ in range(3_000):
        term = "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
        pieces = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 3, 9, 30]))) for _ in range(rng.randint(1, 5))]
        step = [(0, s) for s in range(len(term))]
        for p in pieces:
            step = terms.composed(step, terms.piece_step(term, [i for i in range(len(p)) if p.startswith(term, i)], p))
        assert step[0][0] == "".join(pieces).count(term)


def test_fit_and_clips(spark):
    from studyforge.functions import spans
    from studyforge.functions import text as T

    assert spans.fit("侵略和武装颠覆、分裂", "一是侵略，二是武装颠覆和分裂。") == pytest.approx(6 / 8)
    assert spans.fit("", "x") == spans.fit(None, None) == 0.0
    assert spans.fit("和平", "平与和平") == 1.0 and spans.han_run("中国abc国防", "我国防abc") == 2
    c = lambda *a: spark.range(1).select(*a).first()[0]
    assert c(T.clip(F.lit("x" * 300), F.lit("absent"))) == "x" * 160 + "…"
    assert c(T.clip(F.lit("y" * 100 + "KEY" + "z" * 300), F.lit("KEY"))) == "…" + "y" * 53 + "KEY" + "z" * 106 + "…"
    assert c(T.pick_sentence(F.lit("甲。乙 丙；丁"), F.lit("乙丙"))) == "乙 丙；"
    assert c(T.trim(F.lit("　\t a b\n　"))) == "a b"
    assert c(T.keywords(F.lit("C4ISR 第1.5万 侵略和武装"))) == ["4", "ISR", "1.5", "侵略和武", "略和武装", "侵略和", "略和武", "和武装", "侵略", "略和", "和武", "武装"]
    assert c(T.atoms(F.lit("abcdefg侵略和武装3.5"))) == ["abcdefg", "侵略和武", "装", "3.5"]
