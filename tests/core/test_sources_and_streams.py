import json
import os

import pytest
from pyspark.sql import functions as F

from studyforge.operators import progress as P
from studyforge.operators import upsert
from studyforge.sources import bank, bindings, sinks
from studyforge.streaming import progress as S

SF = "/root/testdata/sf0.001"


def test_bank_is_read_and_hydrated(spark, tmp_path):
    q = [
        {"id": "q-1", "type": "single", "stem": "s", "options": ["x", "y"], "answer": "b", "keywords": list("abcdefghij")},
        {"id": "q-1", "type": "judge", "stem": "t", "answer": True},
        {"id": "q-2", "type": "multi", "stem": "u", "options": ["x"], "answer": ["A"]},
        {"id": "q-3", "type": "fill", "stem": "v", "answer": ["a", "b"]},
        {"id": "q-4", "type": "odd", "stem": "w", "answer": None},
    ]
    (tmp_path / "bank.json").write_text(json.dumps({"questions": q}))
    got = {r["id"]: r for r in bank.hydrate(bank.read_bank(spark, str(tmp_path / "bank.json"))).collect()}
    assert sorted(got) == ["q-1", "q-1-1", "q-3"]
    assert got["q-1"]["answer"]["letters"] == ["B"] and len(got["q-1"]["keywords"]) == 8
    assert got["q-1-1"]["answer"]["bool"] is True and got["q-3"]["answer"]["blanks"] == ["a", "b"]


def test_text_corpus_and_papers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("=== PAGE 3 ===\n第一章 总论\n这是一个足够长的句子用来测试。短。\n=== PAGE 4 ===\n另一个同样足够长的句子也在这里。\n", encoding="utf-8")
    units = bank.corpus_units(bank.read_lines(spark, str(tmp_path / "a.txt"))).orderBy("line_no").collect()
    assert [(r["page"], r["chapter"]) for r in units] == [(3, "第一章 总论"), (4, "第一章 总论")]
    (tmp_path / "p.txt").write_text("1. What\nis it?\nA. x\nB. y\n2. Next\nA. u\nB. v\n")
    (tmp_path / "k.txt").write_text("1-1 B\n2. AB\n2. A\n")
    items = bank.parse_questions(bank.read_lines(spark, str(tmp_path / "p.txt"))).withColumn("file", F.lit("f"))
    key = bank.parse_answer_key(bank.read_lines(spark, str(tmp_path / "k.txt"))).withColumn("file", F.lit("f"))
    got = {r["no"]: r for r in bank.attach_answers(items, key).collect()}
    assert got[1]["stem"] == "Whatis it?" and got[1]["options"] == ["x", "y"] and got[1]["answer"] == "B"
    assert got[2]["answer"] is None and got[2]["reject"] == "several answers"


def test_evidence_and_export(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "found": true}]')
    (tmp_path / "b.json").write_text('{"results": [{"id": "2"}]}')
    (tmp_path / "c.json").write_text("broken")
    got = sorted((r["file"], r["id"], r["error"] is not None) for r in bank.read_evidence(spark, str(tmp_path / "*.json")).collect())
    assert got == [("a.json", "1", False), ("b.json", "2", False), ("c.json", None, True)]
    (tmp_path / "x.json").write_text('{"app": "s", "ver": 1, "progress": {"q": {"seen": 2}, "__daily": {"seen": 9}}}')
    assert [(r["question"], r["seen"]) for r in bank.progress_rows(bank.read_export(spark, str(tmp_path / "x.json"))).collect()] == [("q", 2)]


def test_verified_write_and_compare_and_set(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.lit("a"))
    assert sinks.write_verified(df, str(tmp_path / "t"), ["id"]).count() == 5
    with pytest.raises(ValueError):
        sinks.write_verified(df.union(df), str(tmp_path / "u"), ["id"])
    patch = spark.createDataFrame([(1, "a", "b"), (2, "z", "a")], "id long, old string, new string")
    done = upsert.compare_and_set(df, patch, "id", "v")
    assert {r["id"]: r["v"] for r in done.collect()}[1] == "b"
    assert upsert.compare_and_set(done, patch, "id", "v").exceptAll(done).count() == 0
    with pytest.raises(Exception, match="neither"):
        upsert.compare_and_set(df, spark.createDataFrame([(1, "x", "y")], patch.schema), "id", "v").collect()


def test_merge_is_sanitised_and_commutes(spark):
    schema = "learner long, question long, seen long, correct long, wrong long, last_ts timestamp, box int, fav boolean, wrong_flag boolean"
    a = spark.createDataFrame([(1, 1, -5, 2, 1, None, 9, None, True), (1, 2, 1, 1, 0, None, 1, True, False)], schema)
    b = spark.createDataFrame([(1, 1, 1, 0, 1, None, 1, True, True)], schema)
    x, y = (sorted(map(tuple, P.merge(*p).collect())) for p in ((a, b), (b, a)))
    assert x == y and x[0][2:] == (4, 2, 2, None, 5, True, False) and x[1][2] == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").coalesce(1)
    n = events.count()
    rows = events.collect()
    for k in range(3):  # files in the order of time, as a log would be
        spark.createDataFrame(rows[k * n // 3 : (k + 1) * n // 3], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = S.read_attempts(spark, str(tmp_path / "in"), events.schema)
    last = {}

    def keep(df, _):
        last.update({(r["learner"], r["question"]): tuple(r)[2:] for r in df.collect()})

    S.fold_stream(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = {(r["learner"], r["question"]): tuple(r)[2:] for r in P.fold(bindings.attempts(spark, SF)).collect()}
    assert last == batch
    S.daily_stream(source).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "d")).option("checkpointLocation", str(tmp_path / "e")).trigger(availableNow=True).start().awaitTermination()
    closed = {(r["learner"], r["day"]): (r["n"], r["ok"]) for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    whole = {(r["learner"], r["day"]): (r["n"], r["ok"]) for r in P.daily(bindings.attempts(spark, SF)).collect()}
    assert closed and all(whole[k] == v for k, v in closed.items())
