"""Writers: verified writes, numbered batches, Markdown, shards and rule reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def batches(df: DataFrame, order: list, size: int, name: str = "batch") -> DataFrame:
    """Rows in batches of `size` by order: batch 0 has the first ones.

    Rows are numbered by range partitions, so no task sees the whole table.
    """
    return numbered(df, order, "_rn").withColumn(name, F.floor(F.col("_rn") / size).cast("long")).drop("_rn")


def numbered(df: DataFrame, order: list[str], name: str, blocks: int = 64) -> DataFrame:
    """Gapless numbers from 0 by order, whose first column is a number.

    Approximate quantiles of that column cut the table into blocks, which are numbered apart and
    offset by the counts before them; the driver sees the quantiles alone.
    """
    cuts = sorted(set(df.approxQuantile(order[0], [k / blocks for k in range(1, blocks)], 0.005)))
    x = F.col(order[0]).cast("double")
    block = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda c: c <= x))
    rows = df.withColumn("_p", block)
    sums = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    base = sums.select("_p", F.coalesce(before, F.lit(0)).alias("_base"))  # a row for each block
    inner = W.partitionBy("_p").orderBy(*order)
    return rows.withColumn("_in", F.row_number().over(inner) - 1).join(F.broadcast(base), "_p").withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_p", "_in", "_base")


def contiguous_shards(df: DataFrame, order: list, shards: int, total: int | None = None, name: str = "shard") -> DataFrame:
    """shards runs of ceil(n / shards) rows each; the last ones take what is left."""
    n = df.count() if total is None else total
    per = max(1, -(-n // shards))
    return batches(df, order, per, name)


def write_verified(df: DataFrame, path: str, keys: list[str], before: DataFrame | None = None) -> DataFrame:
    """Write Parquet to a new path and read it back; fails if counts differ, keys repeat or a row of `before` has changed."""
    df.write.mode("error").parquet(path)
    back = df.sparkSession.read.parquet(path)
    total, distinct = back.count(), back.select(*keys).distinct().count()
    if total != df.count() or total != distinct:
        raise ValueError(f"{path}: {total} rows with {distinct} keys were written of {df.count()}")
    if before is not None and before.exceptAll(back.select(*before.columns)).limit(1).count():
        raise ValueError(f"{path}: rows that were there have changed")
    return back


def rule_report(rules: list[str], findings: DataFrame) -> DataFrame:
    """rule, n for every rule, zeros included."""
    known = findings.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return known.join(findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


def markdown(df: DataFrame, batch: str, order: list[str], head: Column, body: Column) -> DataFrame:
    """batch, text: a section for each row, in order. A batch is one file, so its size is the caller's."""
    block = F.concat(F.lit("## "), head, F.lit("\n\n"), body, F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct(*order, block.alias("_md"))))
    return df.groupBy(batch).agg(F.array_join(F.transform(rows, lambda r: r["_md"]), "\n").alias("text"))


def export_envelope(progress: DataFrame, app: str, version: int, at: str) -> DataFrame:
    """learner, json: one document per learner."""
    fields = ["seen", "correct", "wrong", "lastTs", "box", "fav", "wrongFlag"]
    state = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("question").cast("string"), F.struct(*fields)))))
    one = progress.groupBy("learner").agg(state.alias("progress"))
    return one.select("learner", F.to_json(F.struct(F.lit(app).alias("app"), F.lit(version).alias("ver"), F.lit(at).alias("exportedAt"), "progress")).alias("json"))
