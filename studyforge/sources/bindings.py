"""The test tables seen as attempts, questions, exams, corpus units, outline and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How an event counts. `view` opens a question, `signup` toggles its favourite mark.
RIGHT, RIGHT_REDO, WRONG, MARK = "click", "purchase", "error", "signup"
#: Exam items of a task, more or less.
ITEMS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """learner, question, kind, ts, seq: one row per event, ordered by (ts, seq)."""
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("long")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("learner"), k.alias("question"), F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("seq"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question, chapter, type, stem, concept, hard of the bank."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("question"), F.col("p_brand").alias("chapter"), F.col("p_type").alias("type"), F.col("p_name").alias("stem"), F.concat_ws("|", "p_type", "p_brand").alias("concept"), (F.col("p_size") >= 40).alias("hard"))


def exam_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exam, learner, ts, right: one row per exam item; tasks hold about ITEMS of them, however many there are."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parts = -(-li.count() // ITEMS) or 1
    o, li = o.repartition(parts, "o_orderkey"), li.repartition(parts, "l_orderkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("exam"), F.col("o_custkey").alias("learner"), F.col("o_orderdate").alias("ts"), (F.col("l_returnflag") == "A").alias("right"))
