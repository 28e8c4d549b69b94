"""Order-dependent folds that no single window expresses."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once in the folder of spark.checkpoint.dir and read back, so that rounds have no lineage."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def two_key_dedupe(pool: DataFrame, order: str, a: str, b: str) -> DataFrame:
    """Rows that a pass in order would keep: those whose a and b no kept row before them has.

    A row that is left out registers neither key, so two first-wins filters give too few rows.
    The pass is done in rounds: every open row that is first among the open ones of both its
    keys is kept, and all open rows that share a key with it are left out. Keys are joined,
    never gathered; each round keeps at least the first open row, and most of a pool within a
    few rounds.
    """
    open_, kept = pool, None
    while True:
        first_a = open_.groupBy(a).agg(F.min(order).alias("_fa"))
        first_b = open_.groupBy(b).agg(F.min(order).alias("_fb"))
        won = stored(open_.join(first_a, a).join(first_b, b).where((F.col(order) == F.col("_fa")) & (F.col(order) == F.col("_fb"))).select(*pool.columns), "dedupe-kept")
        kept = won if kept is None else kept.unionByName(won)
        open_ = stored(open_.join(won.select(a), a, "left_anti").join(won.select(b), b, "left_anti"), "dedupe-open")
        if open_.limit(1).count() == 0:
            return kept.select(*pool.columns)


def mulberry32(seed: int, k: int) -> float:
    """The k-th number, from 1, of the generator that starts at seed: its state is seed plus k steps."""
    m = 0xFFFFFFFF
    a = (seed + k * 0x6D2B79F5) & m
    t = ((a ^ a >> 15) * (a | 1)) & m
    t ^= (t + ((t ^ t >> 7) * (t | 61) & m)) & m
    return ((t ^ t >> 14) & m) / 4294967296


def shuffled(n: int, seed: int) -> list[int]:
    """0 .. n-1 in Fisher-Yates order, from the end."""
    out = list(range(n))
    for k, i in enumerate(range(n - 1, 0, -1), 1):
        j = int(mulberry32(seed, k) * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def seeded_shuffle(df: DataFrame, group: str, order: str, seed: int) -> DataFrame:
    """group, item, place: a seeded shuffle of each group (an exam or chapter, whose size is bounded)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable").reset_index(drop=True)
        return pdf.iloc[shuffled(len(pdf), seed)].assign(place=range(len(pdf)))

    rows = df.select(F.col(group).alias("grp"), F.col(order).alias("item"))
    g, i = (rows.schema[c].dataType.simpleString() for c in ("grp", "item"))
    return rows.groupBy("grp").applyInPandas(run, f"grp {g}, item {i}, place int")


def sample_per_group(df: DataFrame, group: str, order: str, n: int, seed: int) -> DataFrame:
    """n rows of each group, by a seeded hash; reruns agree on any partitioning."""
    from pyspark.sql import Window as W

    turn = F.row_number().over(W.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), F.col(order)), order))
    return df.withColumn("_t", turn).where(F.col("_t") <= n).drop("_t")


#: Tails that tell a phrase from a term, and starts of a new item in a paper.
PHRASE_TAILS = "(始于|是|有|包括|分为|属于|成为|应当|必须)$"
ITEM_STARTS = (
    r"^\d{1,3}\s*[、.．)）]|^[（(]\s*\d{1,3}\s*[)）]|^[A-Ha-h]\s*[、.．)）]|^[一二三四五六七八九十]+\s*[、.．]"
    r"|^第[一二三四五六七八九十\d]+[章节讲部分]|^[【（(]?\s*(答案|解析|参考答案|判断题|单选题|多选题|填空题|简答题|名词解释)"
)
CLEAN_ENDS = r"[。！？；：\)）】”\"'\.]$|(答案|解析)[：:]\s*\S+$"


def pick_terms(terms, most: int = 6, longest: int = 12, tails: str = PHRASE_TAILS):
    """Terms in order, at most `most`: none that is part of one chosen before, none too long, no longer phrase with a verb's tail."""

    def step(chosen, t):
        no = F.exists(chosen, lambda c: F.contains(c, t)) | (F.length(t) > longest) | (t.rlike(tails) & (F.length(t) > 6))
        return F.when((F.size(chosen) < most) & ~no, F.concat(chosen, F.array(t))).otherwise(chosen)

    return F.aggregate(terms, F.array().cast("array<string>"), step)


def merge_lines(lines, most: int = 45, ends: str = CLEAN_ENDS, starts: str = ITEM_STARTS):
    """Lines of a page (array) with hard breaks undone: a line that starts no new item goes on the one before if that is short or unfinished.

    Runs of blanks become one; empty lines and lines of brackets alone go.
    """
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "[ \\t\u00a0]+", " ")))
    whole = F.filter(tidy, lambda x: ~x.rlike(r"^[()\[\]【】\s]*$"))

    def step(done, line):
        last = F.try_element_at(done, F.lit(-1))
        goes_on = last.isNotNull() & ~line.rlike(starts) & ((F.length(last) < most) | ~last.rlike(ends))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, line)))
        return F.when(goes_on, joined).otherwise(F.concat(done, F.array(line)))

    return F.aggregate(whole, F.array().cast("array<string>"), step)
