"""Training corpus pipeline: quality filter, exact dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and
returns rows with the columns of `documents`; the last returns the packed pieces. `run`
writes each stage as Parquet in the folder of spark.checkpoint.dir and reads it again, so a
lost executor costs no more than the tasks it ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from studyforge.llm import stages
from studyforge.llm.common import cut, table

STAGES = [
    ("quality", stages.quality),
    ("exact_dedup", stages.exact_dedup),
    ("near_dedup", stages.near_dedup),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: Neither the classifier nor the random rounding can be said in SQL; tests/llm/test_edges.py
#: holds exact_dedup, near_dedup and mixing against what brute force keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
