"""Declarative audits: duplicate and conflict groups, rule findings, validation gates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """rule, id of every row and rule that it breaks; all rules are tested in one pass over the rows."""
    hit = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull())
    return df.select(F.col(key).alias("id"), F.explode(hit).alias("rule")).select("rule", "id")


def first_reason(df: DataFrame, rules: Mapping[str, Column], name: str = "reject_reason") -> DataFrame:
    """df with the first rule that a row breaks, null if none."""
    return df.withColumn(name, F.coalesce(*[F.when(c, F.lit(r)) for r, c in rules.items()], F.lit(None).cast("string")))


def duplicate_groups(df: DataFrame, key: str, *on: Column) -> DataFrame:
    """digest, n, first, last of keys that several rows share; the key's hash is dealt, not its text."""
    digest = F.sha2(F.concat_ws("\x1f", *on), 256)
    g = df.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    return g.where("n > 1")


def conflict_groups(df: DataFrame, on: list[str], value: str) -> DataFrame:
    """Groups with different values; nulls are no value."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("values")).where("values > 1")


def length_stats(df: DataFrame, column: str, by: list[str], short: int = 20, long: int = 200) -> DataFrame:
    n = F.length(column)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 6).alias("avg_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.count_if(n < short).alias("short"), F.count_if(n > long).alias("long"))


def topic(c: Column, rules: Mapping[str, str], other: str = "other") -> Column:
    """The first topic whose pattern is found."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(list(rules.items())):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(other))
