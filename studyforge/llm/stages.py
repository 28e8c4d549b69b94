"""The stages of corpus_pipeline.py: (spark, docs, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality as quality_op
from .common import table, tokenizer_path
from .exact_dedup import keep_owners
from .jaccard_join import keep_one_per_class
from .mixing import mixed_documents
from .packing import pack


# What all stages have in common: rows keep their columns whatever their names; repeated rows are rows of their own
# unless the stage removes copies; an empty table stays empty.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled rows among docs.

    Null texts are scored as empty ones; null ids have no label; without labels of both kinds nothing is rejected;
    a score at the threshold stays.
    """
    model = quality_op.learn(docs, table(spark, sf_dir, "labels"))
    return quality_op.good_documents(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest stays; of those as long, the smallest doc_id's, null ids last.

    Null, empty and blank texts are equal to each other; of equal rows one stays.
    """
    return keep_owners(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity class stays, the one with the smallest doc_id; documents without words stay.

    Null ids come last; of one id's texts in a class the one of the smallest hash stays; of equal rows one.
    """
    return keep_one_per_class(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and blank texts have no words: the mix takes them once if their source's share is whole, as others of it; a null
    source is one of its own and comes last; rows of equal ids and sizes are told apart by their texts, so reruns take the same.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 2048 tokens; null and empty texts are their end token; a null source is a queue of its own."""
    return pack(docs, tokenizer_path())
