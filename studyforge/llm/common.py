"""Shared helpers: reading tables, cutting lineage, word and block arithmetic."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The bytes that count as white space in the operators' contracts.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch(spark: SparkSession) -> str:
    """Folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset (tests), a local master gets a temporary folder; a cluster without
    the setting is an error, since a machine-local folder would lose data.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Later stages restart from the files after a lost executor, and nothing upstream runs twice.
    """
    spark = df.sparkSession
    at = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


class Tables:
    """Intermediate tables of one operator, which `clear` deletes once its result stands in a table of its own."""

    def __init__(self):
        self.made: list[tuple[SparkSession, str]] = []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """As the function `cut`; the table is deleted by `clear`."""
        spark = df.sparkSession
        at = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(at)
        self.made.append((spark, at))
        return spark.read.schema(df.schema).parquet(at)

    def clear(self) -> None:
        for spark, at in self.made:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        self.made = []


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the taken ones (in any case)."""
    have = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def only(df: DataFrame, rows: DataFrame, on: list[str], how: str = "left_semi", most: int = 1_000_000) -> DataFrame:
    """df joined with a written table of keys, which is broadcast if it has at most so many rows and else shuffled with df."""
    return df.join(F.broadcast(rows) if rows.count() <= most else rows, on, how)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow for a function that yields dicts of columns (lists or arrays), cast to schema."""
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(st)

    def run(batches):
        for cols in f(batches):
            arrays = []
            for field in arrow:
                v = cols[field.name]
                if isinstance(v, pa.ChunkedArray):
                    v = v.combine_chunks()
                if not isinstance(v, pa.Array):
                    v = pa.array(v, field.type)
                arrays.append(v.cast(field.type) if v.type != field.type else v)
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, st)


def slices(batch: pa.RecordBatch, column: str, most: int = 8_000_000, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts hold at most so many bytes together (one row at least), of at most so many rows."""
    import numpy as np

    col = batch.column(batch.schema.get_field_index(column))
    if col.nbytes <= most and batch.num_rows <= rows or batch.num_rows <= 1:
        yield batch
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def dense_slots(df: DataFrame, group: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in blocks.

    `block` splits each group into pieces that one window task can hold; block totals are
    summed first, so a group of any size is numbered by many tasks.
    """
    from pyspark.sql import Window as W

    rows = df.withColumn("_block", block)
    sums = rows.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1) if group else W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = W.partitionBy(*group, "_block").orderBy(*order)
    cond = [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in [*group, "_block"]]
    keyed = rows.withColumn("_in", F.row_number().over(inner) - 1).alias("r")
    joined = keyed.join(starts.alias("s"), cond)
    cols = [F.col(f"r.{c}") for c in df.columns]
    return joined.select(*cols, (F.col("s._start") + F.col("r._in")).cast("long").alias(name))
