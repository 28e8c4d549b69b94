"""Bank audits, gates and imports on rows worked by hand."""

import pytest
from pyspark.sql import functions as F

from studyforge.functions import answers, predicates, text
from studyforge.operators import bank_audit as A
from studyforge.operators import progress as P
from studyforge.operators import upsert
from studyforge.sources import bindings as B

SCHEMA = "id string, num long, type string, stem string, options array<string>, letters array<string>, flag boolean, explanation string, part_answer string, part_note string, why map<string,string>, chapter string, section string, src string, ref string, hard boolean, source string, key_concept string, keywords array<string>, answer string"
GOOD = {"id": "q-1", "num": 1, "type": "single", "stem": "国防的主体是", "options": ["国家", "军队"], "letters": ["A"], "flag": None, "explanation": "正确答案：A、国家", "part_answer": "A（国家）", "part_note": None, "why": {"B": "军队只是其中一部分"}, "chapter": "one", "section": "s", "src": "bank", "ref": "", "hard": False, "source": "x", "key_concept": "国防", "keywords": ["国防"], "answer": None}


def rows(spark, *changes):
    return spark.createDataFrame([tuple({**GOOD, "id": f"q-{i}", "num": i, "stem": f"国防的主体是{i}号", **c}.values()) for i, c in enumerate(changes, 1)], SCHEMA)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_a_sound_row_and_a_row_of_nulls_break_no_rule_of_consistency(spark):
    assert found(A.consistency(rows(spark, {}))) == []
    nulls = spark.createDataFrame([(None,) * 20], SCHEMA)
    assert found(A.consistency(nulls)) == []
    assert found(A.consistency(nulls.where("false"))) == []
    assert A.gate(nulls).first()["reject_reason"] == "unknown type"


@pytest.mark.parametrize(
    ("change", "rules"),
    [
        ({"letters": ["C"], "part_answer": "", "explanation": ""}, ["R1"]),
        ({"type": "judge", "letters": None, "options": None, "part_answer": ""}, ["R2"]),
        ({"type": "multi"}, ["R2"]),
        ({"part_answer": "A（人民）"}, ["R3"]),
        ({"explanation": "题库：正确答案：B、C4ISR"}, []),
        ({"explanation": "解析。正确答案：B"}, ["R4"]),
        ({"explanation": "解析。正确答案：B-2轰炸机"}, []),
        ({"why": {"B": "与正确项 A/B 混淆"}}, ["R5"]),
        ({"why": {"B": "与正确项 A 混淆", "A": "x"}}, ["R6"]),
        ({"part_answer": "A、国家；B、军队"}, ["R9"]),
    ],
)
def test_each_rule_of_consistency(spark, change, rules):
    assert [r for r, _, _ in found(A.consistency(rows(spark, change)))] == rules


def test_groups_of_equal_and_conflicting_stems(spark):
    same = {"stem": "同 一 题？"}
    b = rows(spark, same, {**same, "options": ["军队 ", "国家"], "letters": ["B"], "part_answer": "B（国家）", "explanation": "", "why": {"A": "y"}}, {})
    assert found(A.consistency(b)) == [("R7", "q-1", 2), ("R8", "q-1", 2)]


def test_blanks_of_any_kind_do_not_count(spark):
    """Ideographic spaces, tabs and line breaks at the ends of texts, which the bank's own checks strip."""
    same = {"stem": "同一题"}
    assert found(A.consistency(rows(spark, same, {**same, "options": ["国家　", "\t军队"]}))) == [("R7", "q-1", 2)]
    assert found(A.consistency(rows(spark, {"part_answer": "　A（国家\t）\n"}))) == []
    bad = rows(spark, {"section": "　", "options": ["国家", "\t"], "explanation": "\n　"}, {"stem": "　\t"}, {"options": ["国家", "　"]})
    told = [(r, i) for r, i, _ in found(A.ingest(bad, bad.where("false"), ["one"]))]
    assert {("N4", "q-1"), ("N5", "q-1"), ("N7", "q-1"), ("N4", "q-3")} <= set(told)
    assert [r["reject_reason"] for r in A.gate(bad).orderBy("id").collect()] == ["too few options", "empty stem", "too few options"]
    lacking = rows(spark, {"keywords": None}, {"key_concept": None}, {"source": None}, {"letters": None})
    assert [(r, i) for r, i, _ in found(A.ingest(lacking, lacking.where("false"), ["one"])) if r == "N2"] == [("N2", f"q-{i}") for i in range(1, 5)]


def test_ingest_tells_gaps_repeats_and_missing_fields(spark):
    old = rows(spark, {"id": "old", "stem": "旧题"})
    new = rows(spark, {}, {"id": "q-2", "num": 2, "stem": "旧题"}, {"num": 4, "ref": None}, {"num": 5, "stem": "国防的主体是1号", "src": "web"}, {"num": 6, "type": "short", "letters": None, "answer": "答", "part_answer": "", "chapter": "two", "hard": None})
    assert found(A.ingest(new, old, ["one"])) == [("N1", "q-3", 1), ("N10", "q-4", 1), ("N11", "q-5", 1), ("N2", "q-3", 1), ("N4", "q-5", 1), ("N7", "q-5", 1), ("N8", "q-4", 1), ("N9", "q-2", 1)]


def test_gate_gives_the_first_reason_and_keeps_the_options(spark):
    out = A.gate(rows(spark, {}, {"options": ["国家", " "]}, {"explanation": " ", "src": "blog"}, {"why": {}}, {"why": {"A": "反向"}, "stem": "不属于国防的是"}, {"letters": ["A", "B"], "type": "multi"}))
    got = {r["id"]: r["reject_reason"] for r in out.collect()}
    assert got == {"q-1": None, "q-2": "too few options", "q-3": "no explanation", "q-4": "no reason", "q-5": None, "q-6": "needless reason"}
    assert out.where("id = 'q-2'").first()["options"] == ["国家", " "]


def test_notes_only_a_passing_note_makes_later_ones_repeats(spark):
    fine = "军队只是国防力量的一部分，并不是国防的主体"
    n = [(1, "q-1", "B", "太短"), (2, "q-1", "B", fine), (3, "q-1", "B", fine), (4, "q-1", "A", fine), (5, "no", "B", fine), (6, "q-2", "B", fine + "容易混淆"), (7, "q-2", "B", "ISR" + fine)]
    notes = spark.createDataFrame(n, "ord int, id string, key string, text string")
    got = [r["reject_reason"] for r in A.note_gate(notes, rows(spark, {}, {})).orderBy("ord").collect()]
    assert got == ["length", None, "repeated", "not a wrong option", "unknown item", "empty phrase", "characters"]


def test_web_evidence_takes_the_first_row_that_passes_and_upgrades_weak_sources(spark):
    base = spark.createDataFrame([("a", "国防的主体", "template", "", None, None), ("b", "国防的主体", "web", "旧的依据", "https://blog.net/x", None), ("c", "国防的主体", "bank", "旧的依据", None, None)], "id string, stem string, src string, reason string, url string, disputed boolean")
    good, why = "https://www.gov.cn/x", "国防的主体是国家，这是公认的看法"
    inc = [("a", 1, True, "high", "https://blog.net", why, False), ("a", 2, True, "HIGH", good, why, True), ("a", 3, True, "high", good, why + "二", False), ("b", 1, True, "low", good, why, False), ("c", 1, True, "high", good, why, False), ("d", 1, True, "high", good, why, False), ("b", 0, True, "high", "https://notgov.cn/", why, None), ("b", 2, None, "high", good, why, None)]
    rows_ = spark.createDataFrame(inc, "id string, ord int, found boolean, confidence string, url string, reason string, disputed boolean")
    out, log = upsert.merge_web(base, rows_, ["gov.cn"])
    assert {r["id"]: (r["src"], r["url"], r["disputed"]) for r in out.collect()} == {"a": ("web", good, True), "b": ("web", good, False), "c": ("bank", None, False)}
    assert {(r["id"], r["ord"]): r["reject_reason"] for r in log.collect()} == {("a", 1): "source not allowed", ("a", 2): None, ("a", 3): "has evidence", ("b", 0): "has evidence", ("b", 1): None, ("b", 2): "has evidence", ("c", 1): "has evidence", ("d", 1): "unknown id"}
    few = rows_.where("id = 'a'").withColumn("reason", F.when(F.col("ord") == 2, "短").otherwise("完全没有关系的另一句话在这里"))
    assert sorted(r["reject_reason"] for r in upsert.merge_web(base, few, ["gov.cn"])[1].collect()) == ["off topic", "source not allowed", "too short"]


def test_import_replaces_or_merges(spark):
    s = "learner int, question int, seen int, correct int, wrong int, last_ts int, box int, fav boolean, wrong_flag boolean"
    a = spark.createDataFrame([(1, 1, 2, 1, 1, 5, 1, True, True)], s)
    b = spark.createDataFrame([(1, 1, 1, 3, -1, 9, 7, None, False), (1, 2, 1, 1, 0, 3, 2, False, False)], s)
    got = {r["question"]: (r["seen"], r["correct"], r["wrong"], r["box"], r["fav"], r["wrong_flag"]) for r in P.import_progress(a, b, "replace").collect()}
    assert got == {1: (3, 3, 0, 5, False, False), 2: (1, 1, 0, 2, False, False)}
    got = {r["question"]: (r["seen"], r["correct"], r["wrong"], r["box"], r["fav"], r["wrong_flag"]) for r in P.import_progress(a, b, "merge").collect()}
    assert got == {1: (5, 4, 1, 5, True, False), 2: (1, 1, 0, 2, False, False)}
    with pytest.raises(ValueError):
        P.import_progress(a, b, "other")


def test_exams_of_both_sides_local_first(spark):
    s = "exam int, learner int, ts int, total int, correct int"
    local = spark.createDataFrame([(5, 1, 10, 4, 9), (6, 1, 30, 0, 0)], s)
    other = spark.createDataFrame([(1, 1, 10, 4, 0), (2, 1, 20, 4, None), (3, 1, None, 4, 1)], s)
    assert [(r["ts"], r["correct"], r["score"], r["place"]) for r in P.merge_exams(local, other).orderBy("place").collect()] == [(20, 0, 0, 1), (10, 4, 100, 2)]


def test_exam_items_are_dealt_by_their_number(spark, monkeypatch):
    """A task holds about ITEMS rows however large the tables are, and only the newest times of a learner leave it."""
    sf = "/root/testdata/sf0.001"
    items = B.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(B, "ITEMS", items // 8)
    assert B.exam_items(spark, sf).rdd.getNumPartitions() >= 8
    s = "exam int, learner int, ts int, total int, correct int"
    local = spark.createDataFrame([(i, 1, i // 3, 4, i % 5) for i in range(90)], s)
    other = spark.createDataFrame([(1000 + i, 1, i, 4, 0) for i in range(0, 60, 2)], s)
    merged = P.merge_exams(local, other, 5)
    # of one ts the local exam with the smallest id stays
    assert [(r["ts"], r["correct"], r["place"]) for r in merged.orderBy("place").collect()] == [(58, 0, 1), (56, 0, 2), (54, 0, 3), (52, 0, 4), (50, 0, 5)]
    merged = P.merge_exams(local, other.where("ts < 20"), 5)
    assert [(r["ts"], r["correct"], r["place"]) for r in merged.orderBy("place").collect()] == [(t, 3 * t % 5 if 3 * t % 5 < 4 else 4, 30 - t) for t in (29, 28, 27, 26, 25)]
    assert merged._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_predicates(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    lines = ["33.我国的国防", "1.8万多千米", "8.89亿元", "1949年", " 3.x"]
    assert [one(predicates.numbered_question(F.lit(x))) for x in lines] == [True, False, False, False, False]
    assert [one(predicates.exercise(F.lit(x))) for x in ("什么是国防？", "国防是国家的。", "什么是国家的国防？什么是国家安全？答")] == [True, False, True]
    names = {"国防": "国防", " 国防历史 ": "国防历史", "2013年秋": "", "哪一个": "", "辛亥革命于 年爆发": "", "把思想发展": "", "国防的": "", "《孙子": "", "军": "", "秋冬": "秋冬", "年月日": "", None: ""}
    assert {k: one(predicates.concept(F.lit(k).cast("string"))) for k in names} == names
    assert one(predicates.negative(F.lit("不是甲的是"), "explain")) and not one(predicates.negative(F.lit("不是甲"), "explain"))
    assert not one(predicates.negative(F.lit("错误"), "audit", F.lit("judge")))


def test_sentences_and_blanks_are_trimmed_of_spaces_not_of_their_place(spark):
    r = spark.range(1).select(text.sentences(F.lit("0甲。 1乙。 丙2")).alias("s"), answers.normalise(F.lit("fill"), F.lit(" 0甲；1 ；乙2"))["blanks"].alias("b")).first()
    assert (r["s"], r["b"]) == (["0甲。", "1乙。", "丙2"], ["0甲", "1", "乙2"])
