"""Learning state and daily counts over a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.progress import TOP_BOX
from ..sources.bindings import MARK, RIGHT, RIGHT_REDO, WRONG

OUT = "learner long, question long, seen long, correct long, wrong long, last_ts timestamp, box int, fav boolean, wrong_flag boolean"
HELD = "seen long, correct long, wrong long, last_ts timestamp, box int, fav boolean, wrong_flag boolean"


def read_attempts(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Attempts (learner, question, kind, ts, seq) of Parquet event files as they arrive; ts becomes a timestamp."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("long")
    return raw.select((F.col("user_id") % 10).alias("learner"), k.alias("question"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def step(state: tuple, kind: str, ts) -> tuple:
    """State (seen, correct, wrong, last_ts, box, fav, wrong_flag) after one attempt."""
    seen, correct, wrong, last, box, fav, flag = state
    if kind in (RIGHT, RIGHT_REDO):
        return seen + 1, correct + 1, wrong, ts, min(box + 1, TOP_BOX), fav, flag and kind != RIGHT_REDO
    if kind == WRONG:
        return seen + 1, correct, wrong + 1, ts, 1, fav, True
    return (seen, correct, wrong, last, box, not fav, flag) if kind == MARK else state


def fold_stream(attempts: DataFrame) -> DataFrame:
    """State of every (learner, question) after each batch. A batch's attempts count in (ts, seq) order; batches in theirs."""

    def run(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0, 0, None, 0, False, False)
        rows = pd.concat(list(pdfs)).sort_values(["ts", "seq"])
        for kind, ts in zip(rows["kind"], rows["ts"], strict=True):
            now = step(now, kind, ts.to_pydatetime())
        state.update(now)
        yield pd.DataFrame([[*key, *now]], columns=[c.split()[0] for c in OUT.split(", ")])

    return attempts.groupBy("learner", "question").applyInPandasWithState(run, OUT, HELD, "update", "NoTimeout")


def daily_stream(attempts: DataFrame, late: str = "2 days") -> DataFrame:
    """learner, day, n, ok of days that the watermark has closed; attempts later than `late` are not counted."""
    tried = attempts.where(F.col("kind").isin(RIGHT, RIGHT_REDO, WRONG)).withWatermark("ts", late)
    g = tried.groupBy("learner", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") != WRONG).alias("ok"))
    return g.select("learner", F.to_date("window.start").alias("day"), "n", "ok")
