"""A failed check leaves a versioned table as it was."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from studyforge.operators import rewriting
from studyforge.sources import commits


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/table"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_follow_each_other_and_may_read_the_one_before(spark, path):
    a = spark.createDataFrame([(1, "a"), (2, None)], "k long, t string")
    assert commits.current(spark, path) is None and commits.commit(a, path, ["k"]) == 0
    more = commits.current(spark, path).union(spark.createDataFrame([(3, "c")], a.schema))
    assert commits.commit(more, path, ["k"], append_only=True) == 1
    assert rows(commits.current(spark, path)) == [(1, "a"), (2, None), (3, "c")]
    assert commits.commit(a.limit(0), path, ["k"]) == 2 and commits.current(spark, path).count() == 0


@pytest.mark.parametrize(
    "change, check",
    [
        (lambda d: d.union(d), commits.KEYS),
        (lambda d: d.withColumn("t", F.upper("t")), commits.CHANGED),
        (lambda d: d.where("k > 1"), commits.CHANGED),
        (lambda d: d.unionByName(d.select((F.col("k") + 5).alias("k"), F.lit("bad").alias("t"))), "bad texts"),
    ],
)
def test_a_failed_check_changes_nothing(spark, path, change, check):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string")
    commits.commit(d, path, ["k"])
    tests = {"bad texts": F.col("t") == "bad"}
    with pytest.raises(commits.Refused) as e:
        commits.commit(change(d), path, ["k"], tests, append_only=True)
    assert dict(e.value.report)[check] > 0
    assert rows(commits.current(spark, path)) == [(1, "a"), (2, "b")]
    assert len(os.listdir(f"{path}/versions")) == len([c for c in os.listdir(f"{path}/commits") if not c.startswith(".")]) == 1
    dry = {r["check"]: r["n"] for r in commits.check(change(d), ["k"], tests, d).collect()}
    assert dry[check] == dict(e.value.report)[check] and set(dry) == {"bad texts", commits.KEYS, commits.CHANGED}
    assert commits.commit(d, path, ["k"], tests, append_only=True) == 1


def test_a_write_that_breaks_off_leaves_no_version(spark, path):
    d = spark.createDataFrame([(1, "a")], "k long, t string")
    commits.commit(d, path, ["k"])
    with pytest.raises(Exception, match="broken"):
        commits.commit(d.withColumn("t", F.raise_error(F.lit("broken")).cast("string")), path, ["k"])
    assert rows(commits.current(spark, path)) == [(1, "a")] and len(os.listdir(f"{path}/versions")) == 1


def test_the_second_of_two_writers_is_refused(spark, path, monkeypatch):
    d = spark.createDataFrame([(1, "a")], "k long, t string")
    commits.commit(d, path, ["k"])
    stale = commits._last(spark, path)
    assert commits.commit(d.withColumn("t", F.lit("b")), path, ["k"]) == 1
    monkeypatch.setattr(commits, "_last", lambda *_: stale)
    with pytest.raises(commits.Refused, match="another writer"):
        commits.commit(d.withColumn("t", F.lit("c")), path, ["k"])
    monkeypatch.undo()
    assert rows(commits.current(spark, path)) == [(1, "b")]


def test_rewrites_are_asserted_before_they_are_committed(spark, path):
    wrong = "与正确项 A / B 表述相近、容易混淆，注意区分限定语。"
    bank = [(1, ["A"], {"B": wrong, "A": rewriting.STALE}), (2, ["B"], {"A": rewriting.NOT_IN_CORPUS, "B": rewriting.NOT_IN_CORPUS}), (3, None, {"A": rewriting.STALE}), (4, ["A"], None), (5, ["A"], {"B": None})]
    df = spark.createDataFrame(bank, "id long, right array<string>, why map<string,string>")
    assert {r["rule"]: r["n"] for r in rewriting.report(df).collect()} == {"reference": 1, "stale": 2, "right option denied": 2}
    with pytest.raises(commits.Refused) as e:
        commits.commit(df, path, ["id"], rewriting.faults())
    assert {c: n for c, n in e.value.report if n} == {"wrong references left": 1, "stale phrases left": 2, "right options denied": 1}
    assert commits.current(spark, path) is None
    new = rewriting.rewrite(df)
    assert commits.commit(new, path, ["id"], rewriting.faults()) == 0
    back = commits.current(spark, path)
    assert {r["id"]: r["why"] for r in back.collect()} == {
        1: {"B": rewriting.NEUTRAL_REFERENCE, "A": rewriting.OF_RIGHT_OPTION}, 2: {"A": rewriting.NOT_IN_CORPUS, "B": rewriting.OF_RIGHT_OPTION},
        3: {"A": rewriting.NEUTRAL_STALE}, 4: None, 5: {"B": None},
    }
    assert sum(r["n"] for r in rewriting.report(back).collect()) == 0
