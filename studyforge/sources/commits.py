"""Tables that change by whole versions: stage, check, read back, commit or leave as it was.

A table is a folder with `versions/<name>` (Parquet) and `commits/number=<n>` (one row that names a version). A version counts once its
commit stands there; until then it is staging. Committing is one small write to a new folder, so it needs no rename of data and works
on any file system that Spark writes to.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COMMIT = "version string, rows long"
#: The names of the checks that every commit makes, beside the caller's.
ROWS, KEYS, CHANGED = "rows written", "keys repeated", "old rows changed"


class Refused(ValueError):
    """A check failed; the table is as it was. `report` has check and n of every check."""

    def __init__(self, path: str, report: list[tuple[str, int]]):
        super().__init__(f"{path}: " + ", ".join(f"{c}: {n}" for c, n in report if n))
        self.report = report


def _last(spark: SparkSession, path: str):
    """number, version, rows of the last commit; None before the first."""
    try:
        log = spark.read.schema(f"{COMMIT}, number int").json(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    top = log.agg(F.max_by(F.struct("number", "version", "rows"), "number").alias("c")).first()["c"]  # one row
    return top


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The last committed version; None if there is none."""
    last = _last(spark, path)
    return None if last is None else spark.read.parquet(f"{path}/versions/{last['version']}")


def _counts(checks: dict[str, Column]) -> list[Column]:
    return [F.count(F.when(bad, 1)).alias(name) for name, bad in checks.items()]


def _shared(df: DataFrame, keys: list[str], before: DataFrame | None) -> dict[str, int]:
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").count()
    return {KEYS: again, **({} if before is None else {CHANGED: before.exceptAll(df.select(*before.columns)).count()})}


def check(df: DataFrame, keys: list[str], checks: dict[str, Column], before: DataFrame | None = None) -> DataFrame:
    """check, n: what a commit of df would be refused for. Nothing is written.

    `checks` are conditions that no row may meet; null counts as not met. Keys are compared with nulls equal. With `before`, its rows
    have to be in df as they are.
    """
    one = df.agg(*_counts(checks)) if checks else df.sparkSession.range(1)
    named = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("n")) for c in checks])).alias("_c")).select("_c.*") if checks else df.sparkSession.createDataFrame([], "check string, n long")
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.when(F.col("_n") > 1, 1)).alias("n")).select(F.lit(KEYS).alias("check"), "n")
    out = named.unionByName(again)
    if before is not None:
        lost = before.exceptAll(df.select(*before.columns)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(CHANGED).alias("check"), "n")
        out = out.unionByName(lost)
    return out


def commit(df: DataFrame, path: str, keys: list[str], checks: dict[str, Column] | None = None, append_only: bool = False) -> int:
    """Make df the table's next version and return its number, from 0; Refused, with the table as it was, if a check fails.

    The checks are counted while the version is written, in the same pass; then it is read back: rows as counted, no key twice
    and, append-only, every row of the version before unchanged. df may read the current version. Of two writers that started from one
    version, the second is refused. An empty df is a version like any other.
    """
    spark, checks = df.sparkSession, checks or {}
    last = _last(spark, path)
    before = spark.read.parquet(f"{path}/versions/{last['version']}") if append_only and last is not None else None
    version, seen = uuid.uuid4().hex, Observation()
    staged = f"{path}/versions/{version}"
    try:
        df.observe(seen, F.count(F.lit(1)).alias(ROWS), *_counts(checks)).write.parquet(staged)
        told = seen.get
        back = spark.read.schema(df.schema).parquet(staged)
        rows = back.count()
        report = {**{c: told[c] for c in checks}, ROWS: abs(rows - told[ROWS]), **_shared(back, keys, before)}
        if any(report.values()):
            raise Refused(path, sorted(report.items()))
        number = 0 if last is None else last["number"] + 1
        try:
            spark.createDataFrame([(version, rows)], COMMIT).coalesce(1).write.mode("error").json(f"{path}/commits/number={number}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise Refused(path, [(f"version {number} was committed by another writer", 1)]) from e
    except BaseException:
        _delete(spark, staged)
        raise
    return number


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
