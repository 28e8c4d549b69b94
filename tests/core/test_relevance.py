"""Relevance measures, re-selection, verdicts and contrasts on Chinese text, by hand-worked cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from studyforge.functions import predicates, spans
from studyforge.operators import contrast, relevance
from studyforge.operators import index as I


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_measures(spark):
    lit = F.lit
    assert one(spark, relevance.part_cover(lit("逐渐模糊，战役行动"), lit("战争层次会逐渐模糊")), relevance.part_cover(lit("和"), lit("和平")), relevance.part_cover(lit(""), lit("x"))) == (1.0, 1.0, 1.0)
    assert one(spark, relevance.char_cover(lit("甲乙丙丁"), lit("乙甲")), relevance.phrase(lit("短语、人的因素、更长一些的")), relevance.phrase(lit("中"))) == (0.5, "更长一些的", "中")
    stem, sentence = lit("国防的对象是____"), lit("国防的对象，一是侵略，二是武装颠覆和分裂。")
    assert one(spark, relevance.on_topic(stem, sentence, lit("侵略、武装颠覆")), relevance.on_topic(stem, sentence, lit("民兵训练")), relevance.on_topic(stem, lit("海军成立日"), lit("海军")), relevance.on_topic(lit("?"), sentence, lit(""))) == (True, False, False, True)
    assert (spans.cover("七大战区", "七个军区调整为5大战区"), spans.cover("5个", "共5个"), spans.cover("6", "1906年"), spans.cover("五个战区", "5个战区"), spans.cover("", "x")) == (pytest.approx(3 / 4), 1.0, 0.0, 1.0, 0.0)


UNITS = [
    (0, "国防", "国防有哪些要素，国防的对象是什么？"),
    (1, "国防", "国防的对象，一是侵略，二是武装颠覆和分裂。"),
    (2, "国防", "国防的对象是国防要防备的行为。"),
    (3, "通用", "如秦汉的征兵制、隋唐的府兵制、宋朝的募兵制、明朝的卫所兵役制、清初的八旗制等。"),
    (4, "通用", "美国陆军的数字化部队建设很早。"),
]


def test_reselect(spark):
    index = I.Index(spark.createDataFrame(UNITS, "unit long, chapter string, sentence string"), I.CJK)
    rows = [(1, "国防的对象是____", "侵略、武装颠覆和分裂", None), (2, "国防的对象是____", "侵略、武装颠覆和分裂", " 国防的对象，一是侵略，二是武装颠覆和分裂。"), (3, "毫无关系的题干", "火星移民", "旧"), (4, "毫无关系的题干", "", None), (5, "国防的对象是____", "侵略", "旧")]
    got = {r["question"]: (r["action"], r["unit"]) for r in relevance.reselect(spark.createDataFrame(rows, "question long, stem string, answer string, reason string"), index).collect()}
    assert got == {1: ("filled", 1), 2: ("kept", 1), 3: ("dropped", None), 4: ("none", None), 5: ("replaced", 1)}


def test_contrasts(spark):
    units = spark.createDataFrame([(u, s) for u, _, s in UNITS], "unit long, sentence string")
    t = contrast.TEMPLATES[0]
    why = {x: t for x in "ABCD"}
    rows = [
        (1, "秦汉时期的兵役制度是", ["征兵制", "募兵制", "府兵制度", " "], ["A"], why),
        (2, "现代部队", ["军舰", "数字化部队建设很早", "民兵"], ["A"], {"B": t, "C": "具体的说明"}),
        (3, "宋朝的制度", ["募兵制", "卫所兵役制"], ["A"], {"B": t}),
    ]
    got = {(r["question"], r["i"]): (r["kind"], r["scope"], r["right_option"], r["right_scope"]) for r in contrast.contrasts(spark.createDataFrame(rows, "question long, stem string, options array<string>, letters array<string>, why map<string,string>"), units).collect()}
    assert got[1, 1] == ("contrast", "宋朝", "征兵制", "秦汉")
    # no sentence gives the longer name or its core a scope
    assert got[1, 2] == ("pending", None, None, None)
    assert got[2, 1][:2] == ("scope", "美国") and (2, 2) not in got and (1, 3) not in got
    assert got[3, 1] == ("contrast", "明朝", "募兵制", "宋朝")
    texts = [r["text"] for r in contrast.contrasts(spark.createDataFrame(rows[:1], "question long, stem string, options array<string>, letters array<string>, why map<string,string>"), units).where("kind = 'contrast'").collect()]
    assert texts == ["你把“募兵制”和“征兵制”搞混了：“募兵制”是宋朝的，“征兵制”（本题答案）是秦汉的。"]


def test_verdicts(spark):
    index = I.Index(spark.createDataFrame(UNITS, "unit long, chapter string, sentence string"), I.CJK)
    rows = [(1, "single", "国防的对象是", ["侵略", "火星移民"], ["A"]), (2, "single", "国防的对象不包括", ["一是侵略，二是武装颠覆", "火星"], ["A"]), (3, "single", "兵役制度", ["火星移民", "宋朝的募兵制"], ["A"]), (4, "single", "zz", ["qq", "ww"], ["A"])]
    got = {r["question"]: r["verdict"] for r in relevance.verdicts(spark.createDataFrame(rows, "question long, kind string, stem string, options array<string>, letters array<string>"), index, F.col("chapter") == "国防").collect()}
    # a short option needs a word's borders, which Han characters are
    assert got == {1: "consistent", 2: "suspect_answer", 3: "suspect_answer", 4: "no_corpus_evidence"}


def test_exercises_are_those_of_the_plain_pattern_and_found_by_their_marks(spark):
    """A text without marks is read once, not once more for each run of 4 to 30 characters from each of its places."""
    plain = F.col("t").rlike(r"([^。？?]{4,30}[?？]){2,}|[?？]\s*$")
    rng = random.Random(3)
    odd = [("".join(rng.choice(rng.choice(["ab", "ab中?", "?？ 。a", "a\n ?", "a😀?b"])) for _ in range(rng.randrange(60))),) for _ in range(20_000)]
    got = spark.createDataFrame(odd, "t string").groupBy(plain.alias("a"), predicates.exercise(F.col("t")).alias("b")).count().collect()
    assert {(r["a"], r["b"]) for r in got} == {(True, True), (False, False)}
    texts = spark.range(4_000, numPartitions=4).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("word and "), 25)).alias("t")).localCheckpoint()

    def seconds(test):
        began = time.perf_counter()
        assert texts.where(test).count() == 0
        return time.perf_counter() - began

    seconds(predicates.exercise(F.col("t")))
    assert seconds(predicates.exercise(F.col("t"))) * 2 < seconds(plain)
