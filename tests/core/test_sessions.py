"""Stored sessions: whole or void, entries checked one by one."""

import json

from studyforge.operators import sessions as S

BANK = [("s", "single", 3), ("m", "multi", 4), ("j", "judge", 0), ("f", "fill", 0), ("t", "short", None)]
ALL = {"ver": 1, "order": "seq", "ids": ["s", "m", "j", "f", "t", "s"]}


def frames(spark, *docs):
    rows = [(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "session int, json string"), spark.createDataFrame(BANK, "question string, type string, n_options int")


def test_a_session_is_whole_or_void(spark):
    bad = [None, "", "{", "[]", "3", "null", {}, ALL | {"ver": 2}, ALL | {"ver": "1"}, ALL | {"order": "none"}, ALL | {"order": None}, ALL | {"ids": []}, ALL | {"ids": "s"}, ALL | {"ids": ["s", "gone"]}, ALL | {"ids": ["s", 1]}, ALL | {"ids": ["s", None]}, ALL | {"ids": {"0": "s"}}]
    good = [ALL, ALL | {"i": "4.7x", "title": "", "seed": -3, "wrongMode": "0"}, ALL | {"i": 99, "title": "T", "seed": "n", "wrongMode": 0, "draft": []}, ALL | {"i": -1, "title": None, "wrongMode": {}}]
    got = S.restore_sessions(*frames(spark, *bad, *good), title="again").orderBy("session").collect()
    assert [r["session"] for r in got] == list(range(len(bad), len(bad) + len(good)))
    assert [(r["place"], r["title"], r["seed"], r["wrong_mode"]) for r in got] == [(0, "again", 0, False), (4, "again", -3, True), (5, "T", 0, False), (0, "again", 0, True)]
    assert got[0]["ids"] == ALL["ids"] and S.restore_sessions(*frames(spark)).count() == 0


def test_entries_are_checked_by_the_type_of_their_question(spark):
    drafts = [{"s": "A", "m": ["D", "A"], "j": False, "f": ["x", ""], "t": "", "gone": "A"}, {"s": "D", "m": ["A", "A"], "j": "true", "f": ["x", 1], "t": 5}, {"s": ["A"], "m": [], "j": None, "f": [], "t": None}, {"s": "", "m": ["E"], "j": 0, "f": [None], "t": "."}]
    want = [{"s": "A", "m": ["D", "A"], "j": False, "f": ["x", ""], "t": ""}, {}, {"m": [], "f": []}, {"t": "."}]
    rows = S.session_entries(*frames(spark, *[ALL | {"draft": d} for d in drafts])).collect()
    got = [{r["question"]: json.loads(r["value"]) for r in rows if r["session"] == k} for k in range(4)]
    assert got == want and {r["part"] for r in rows} == {"draft"}
    perm = {"s": ["C", "A", "B"], "m": ["A", "B", "C"], "j": [], "f": ["A"], "t": "A"}
    flag = {"s": True, "m": 1, "j": False, "t": "true"}
    got = S.session_entries(*frames(spark, ALL | {"perm": perm, "revealedRef": flag, "draft": [1], "res": "x"})).collect()
    assert sorted((r["part"], r["question"], r["value"]) for r in got) == [("flag", "j", "false"), ("flag", "s", "true"), ("perm", "j", "[]"), ("perm", "s", '["C","A","B"]')]


def test_results_need_a_verdict_and_an_answer(spark):
    res = [
        {"s": {"picked": "A", "ok": True, "ts": "7 s", "self": 1}, "m": {"picked": [], "ok": True}, "j": {"picked": False, "ok": False, "ts": -4}, "f": {"picked": [" ", "　"], "ok": True}, "t": {"ok": True, "self": True}},
        {"s": {"picked": "A", "ok": 1}, "m": {"picked": ["A"], "ok": True}, "j": {"ok": True, "self": True}, "f": {"picked": [" ", "x"], "ok": False}, "t": {"picked": None, "ok": True, "self": True}},
        {"s": None, "m": [], "j": "x", "f": {"picked": ["x"]}, "t": {"picked": " ﻿", "ok": True, "self": True}},
    ]
    rows = S.session_entries(*frames(spark, *[ALL | {"res": r} for r in res])).collect()
    got = sorted((r["session"], r["question"], json.loads(r["value"]), r["ok"], r["self"], r["ts"]) for r in rows)
    assert got == [(0, "j", False, False, False, 0), (0, "s", "A", True, True, 7), (0, "t", "", True, True, 0), (1, "f", [" ", "x"], False, False, 0), (1, "m", ["A"], True, False, 0)]


def test_documents_are_parsed_once(spark):
    """The plan of the valid heads has one parse of a document, not one for each condition on it."""
    from studyforge.operators import sessions

    docs = spark.createDataFrame([(1, '{"ver":1,"order":"seq","ids":["a"]}'), (2, None)], "session long, json string")
    heads = sessions._heads(docs, 1)
    assert [r["session"] for r in heads.select("session").collect()] == [1]
    assert heads._jdf.queryExecution().optimizedPlan().toString().count("parseJson") + heads._jdf.queryExecution().optimizedPlan().toString().count("parse_json") == 1


def test_no_side_of_a_join_is_broadcast(spark):
    """Sessions, their entries and the bank grow with the input, so the driver holds none of them, however small they seem."""
    from studyforge.plans import catalog

    ends = [S.session_entries(*frames(spark, ALL)), S.restore_sessions(*frames(spark, ALL)), *[catalog.QUERIES[q](spark, "/root/testdata/sf0.001") for q in ("session_entries", "restored_sessions")]]
    for df in ends:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
