"""Rewriters, outlines and derived items on cases worked out by hand and against a pass in order."""

import re

import pytest
from pyspark.sql import functions as F

from studyforge.functions import rewrites as R
from studyforge.operators.derived import derived
from studyforge.operators.outline import outline

CLEAN = [
    (None, ""),
    ("", ""),
    (" 　\t", ""),
    ("( 一 ) 古 代 国 防古代国防始于公元前 21 世纪的夏王朝。", "古代国防始于公元前21世纪的夏王朝"),
    ("五、现代国防的基本特征现代国防的基本特征是多种手段", "现代国防的基本特征是多种手段"),
    ("5. 没有重复的一句话不会丢掉任何文字", "没有重复的一句话不会丢掉任何文字"),
    ("《国防法 》《 国防法 》规定", "《国防法》规定"),
    ("《国防法》 《兵役法》", "《国防法》 《兵役法》"),
    ("“演习”“演习”“演习”开始，，，结束。。", "“演习”开始，结束"),
    ("2020 年 12月 26 日 ， 修订 （ ）", "2020年12月26日，修订"),
    ("1 2 3 4 号", "1234号"),
    ("★ 知识 链接：国防", "国防"),
    ("a\x00b﻿c\x01d", "a bc d"),
    ("（二）", "（二）"),  # nothing but a number
]


def test_evidence_is_cleaned(spark):
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CLEAN)], "k int, t string").orderBy("k").select(R.clean_evidence(F.col("t"))).collect()]
    assert got == [w for _, w in CLEAN]


def test_cleaned_evidence_stays_as_it_is(spark):
    once = spark.createDataFrame([(t,) for t, _ in CLEAN if t], "t string").select(R.clean_evidence(F.col("t")).alias("a"))
    assert once.where(R.clean_evidence(F.col("a")) != F.col("a")).count() == 0


def test_settle_stops_at_rest_and_at_the_bound(spark):
    rows = spark.createDataFrame([("((((x))))",), ("x",), (None,)], "t string")
    peel = lambda s: F.regexp_replace(s, r"^\((.*)\)$", "$1")
    assert [r[0] for r in rows.select(R.settle(F.col("t"), peel, 2)).collect()] == ["((x))", "x", ""]
    assert [r[0] for r in rows.select(R.settle(F.col("t"), peel, 9)).collect()] == ["x", "x", ""]


def test_notes(spark):
    rows = [
        ("建议对照原卷核实", "r", "single", "web", None),
        (None, None, "single", None, R.NO_REASON),
        ("old", None, "judge", "web", R.JUDGE_NOTE + "。" + R.NO_REASON),
        ("old", "r", "judge", "web", R.JUDGE_NOTE),
        (R.NO_REASON + "。要点", "r", "short", "web", "要点"),
        ("人工校订。" + R.NO_REASON, None, "judge", "web", "人工校订"),
        (R.NO_REASON, None, "single", "manual", None),
        ("建议建议对照原卷核实对照原卷核实", "r", "single", "web", None),  # what is left after one pass is a phrase again
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n string, r string, t string, s string, want string")
    assert [r[0] for r in df.orderBy("k").select(R.note(*[F.col(c) for c in "nrts"])).collect()] == [r[-1] for r in rows]


NAMES = {"第一章甲": ["子", "丑", "寅"], "第二章乙": ["卯"]}


def sections(spark, t, ordered=True):
    d = spark.createDataFrame([(1, t)], "doc long, t string")
    return [(r["chapter"], r["section"], r["text"], [s["title"] for s in r["subs"]]) for r in outline(d, "doc", "t", NAMES, ordered).orderBy("chapter_no", "section_no").collect()]


def test_a_title_named_further_up_does_not_break_the_order(spark):
    t = "第一章甲见第二节丑 第一节子一 第二节丑二 第三节寅三"
    assert [s[1:3] for s in sections(spark, t)] == [("第一节子", "第一节子一"), ("第二节丑", "第二节丑二"), ("第三节寅", "第三节寅三")]
    assert [s[1] for s in sections(spark, t, ordered=False)] == ["第二节丑", "第一节子", "第三节寅"]


def test_outlines_without_titles_chapters_or_text(spark):
    assert sections(spark, None) == sections(spark, "") == sections(spark, "没有章") == []
    assert sections(spark, "第二章乙只有正文") == []
    assert sections(spark, "第二章乙正文第四节别的，再说") == [("第二章乙", "第四节别的", "第四节别的，再说", [])]
    assert sections(spark, "第一章甲第三节寅三第一节子一")[0][1:3] == ("第一节子", "第一节子一")  # 寅 stands before what is looked for first


def test_paragraphs_of_a_section(spark):
    t = "第一章甲第一节子\n  ㈠ 题目，正文\n㈡短\n\n 　⒈" + "长" * 30 + "\n正文㈢不在行首\n㈣《书》名"
    assert sections(spark, t)[0][3] == ["题目", "长" * 20, "㈣《书》名"]
    assert sections(spark, "=== PAGE 3 ===\n 17第一章甲第一节子\n8㈠ 一二三")[0][3] == ["一二三"]


def in_order(rows, most):
    """The pass that takes items one by one, as far as these tests' plain items need it."""
    fills, judges, asked, said = [], [], set(), set()
    for _, item, stem, options, answer in rows:
        right = options["ABCD".index(answer)]
        key = lambda s: re.sub(r"\W", "", re.sub("_{2,}", "", s))
        if len(fills) < most and key(stem) not in asked:
            asked.add(key(stem))
            fills.append(("fill", item, stem, right))
        if len(judges) < most:
            wrong = min((o for o in options if o != right), key=lambda o: (abs(len(o) - len(right)), options.index(o)))
            for o, a in ((right, "true"), (wrong, "false")):
                s = stem.replace("____", o)
                if key(s) not in said:
                    said.add(key(s))
                    judges.append(("judge", item, s, a))
    return fills + judges


@pytest.mark.parametrize("most", [1, 4, 7, 500])
def test_derived_items_are_those_of_a_pass_in_order(spark, most):
    words = ["aa", "bbb", "cccc", "dd", "eeeee", "ffff"]
    rows = [(k, f"q{k}", f"the stem {k * k % 9}{',' * (k % 2)} is ____ here", [words[(k + j * (1 + k % 2)) % 6] for j in range(4)] if k % 2 == 0 else words[:4], "ABCD"[k * 7 % 4]) for k in range(60)]
    df = spark.createDataFrame([(*r, "single") for r in rows], "ord int, item string, stem string, options array<string>, answer string, type string").repartition(5)
    got = [(r["kind"], r["item"], r["stem"], r["answer"]) for r in derived(df, "ord", most).orderBy("kind", "no").collect()]
    assert got == in_order(rows, most)
    if most == 500:
        assert sorted((r["kind"], r["item"], r["stem"], r["answer"]) for r in derived(df, "ord", None).collect()) == sorted(got)


def test_items_that_are_unfit_give_nothing(spark):
    good = ("single", "a stem with ____ in it", ["aa", "bb", "cc", "dd"], "A")
    bad = [
        ("multi", *good[1:]), (None, *good[1:]), ("single", None, *good[2:]), ("single", "two ____ blanks ____ here", *good[2:]), ("single", "no blank in it", *good[2:]),
        ("single", "____", *good[2:]), ("single", "x" * 117 + "____", *good[2:]), (*good[:2], ["aa", "bb", "cc"], "A"), (*good[:2], None, "A"), (*good[:2], ["aa", "bb", "cc", None], "A"),
        (*good[:2], ["aa", "bb", "cc", "d"], "A"), (*good[:2], ["aa", "bb", "cc", "以上都对"], "A"), (*good[:2], ["aa", "bb", "cc", "d；d"], "A"), (*good[:3], "E"), (*good[:3], "AB"), (*good[:3], None), (*good[:3], ""),
    ]
    schema = "ord int, item string, type string, stem string, options array<string>, answer string"
    df = spark.createDataFrame([(k, f"q{k}", *r) for k, r in enumerate(bad)], schema)
    assert derived(df, "ord").count() == 0 and derived(df.limit(0), "ord").count() == 0
    asks = spark.createDataFrame([(0, "q", "single", "下列不属于此类的是____的", good[2], "B")], schema)
    assert [(r["kind"], r["answer"]) for r in derived(asks, "ord").collect()] == [("fill", "bb")]
