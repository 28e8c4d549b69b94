"""Both zones of a paper, in blocks of any length."""

import pytest

from studyforge.sources import papers as P

PAPER = """=== PAGE 1 ===
前言 1. 不算
第一章　中国国防
一、单选题
1. 国防的主体是（ ）
A. 国家 B. 军队
C. 人民
和政党
2、我国国土面积
1.8万多平方千米的海岛 A．对 B．错 C. 不详 D. 无
3. 行内选项 A. 甲 B. 乙 C. 丙
还有一行
66.混合战争有哪些特点？论述题
67. 下一题
第二章 国家安全
4. 没有题型的题
判断题
5. 判断一题

=== PAGE 2 ===
答案
第一章 1-3 ACB
82.军事战略是筹划
全局的方略 83．第二个
第二章 5 对
第一章
82. 后来的答案"""


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_zones(spark, block):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(PAPER.split("\n"))] + [("g", i, t) for i, t in enumerate(["第一章 x", "填空题", "1. 只有", "一题"])], "file string, line_no long, line string").repartition(5)
    got = [(r["file"], r["chapter"], r["kind"], r["no"], r["stem"], list(r["options"])) for r in P.parse_paper(lines, block).orderBy("file", "item").collect()]
    one = "第一章 中国国防"
    assert got == [
        ("f", one, "单选题", 1, "国防的主体是（ ）", ["国家", "军队", "人民和政党"]),
        ("f", one, "单选题", 2, "我国国土面积1.8万多平方千米的海岛 A．对 B．错 C. 不详 D. 无", []),
        ("f", one, "单选题", 3, "行内选项", ["甲", "乙", "丙还有一行"]),
        ("f", one, "论述题", 66, "混合战争有哪些特点？", []),
        ("f", one, "论述题", 67, "下一题", []),
        ("f", "第二章 国家安全", "判断题", 5, "判断一题", []),
        ("g", "第一章 x", "填空题", 1, "只有一题", []),
    ]
    objective, numbered = P.parse_answers(lines, block)
    assert {(r["file"], r["key"]): r["objective"] for r in objective.collect()} == {("f", "第一章"): "1-3 ACB\n", ("f", "第二章"): "5 对"}
    assert {(r["key"], r["no"]): r["answer"] for r in numbered.collect()} == {("第一章", 82): "后来的答案", ("第一章", 83): "第二个"}
    assert P.parse_paper(lines.limit(0)).count() == 0


def test_answers_by_number_or_place(spark):
    items = spark.createDataFrame([("f", 1, 0), ("f", 9, 1), ("f", 8, 2)], "file string, no int, place int")
    key = spark.createDataFrame([("f", 1, "A"), ("g", 9, "B")], "file string, no int, answer string")
    place = spark.createDataFrame([("f", 0, "X"), ("f", 1, "Y")], "file string, place int, answer string")
    got = {r["no"]: (r["answer"], r["by"]) for r in P.attach_by_number_or_place(items, key, place, ["file"]).collect()}
    assert got == {1: ("A", "number"), 9: ("Y", "place"), 8: (None, None)}
