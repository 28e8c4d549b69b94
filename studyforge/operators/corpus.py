"""Corpus units: sentence repair by islands, deduplication, counts, loss reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import squeeze


def units(docs: DataFrame, ends: str = ".!?", least: int = 12, most: int = 220) -> DataFrame:
    """doc_id, chapter (source), pos, sentence: pieces of `docs` (doc_id, source, text) that end in a mark, of fair length."""
    pieces = F.regexp_extract_all("text", F.lit(f"([^{ends}]*[{ends}]|[^{ends}]+$)"))
    # not `posexplode`, before which Spark puts a filter that cuts the text once more; the length drops the null of a text without any
    rows = docs.select("doc_id", F.col("source").alias("chapter"), F.posexplode_outer(pieces).alias("pos", "s")).withColumn("sentence", F.trim(F.col("s"))).drop("s")
    return rows.where(F.length("sentence").between(least, most))


def pieces(docs: DataFrame, ends: str = ".!?") -> DataFrame:
    """doc_id, chapter, pos, sentence without any length test."""
    return units(docs, ends, 1, 1 << 30)


def loss_report(docs: DataFrame, least: int = 12, most: int = 220) -> DataFrame:
    """chapter, total, kept, too_short, too_long sentences."""
    n = F.length("sentence")
    return pieces(docs).groupBy("chapter").agg(F.count(F.lit(1)).alias("total"), F.count_if(n.between(least, most)).alias("kept"), F.count_if(n < least).alias("too_short"), F.count_if(n > most).alias("too_long"))


def _glued(rows: DataFrame, key: list[str], order: str, island: Column, texts: str, sep: str = "") -> DataFrame:
    marked = rows.withColumn("island", island)
    parts = F.array_sort(F.collect_list(F.struct(order, texts)))
    return marked.groupBy(*key, "island").agg(F.array_join(F.transform(parts, lambda p: p[texts]), sep).alias("sentence"), F.count(F.lit(1)).alias("pieces"))


def repair_broken(rows: DataFrame, fragment: str = r"^[a-z,;:)]", least: int = 8) -> DataFrame:
    """Join a piece that begins like a fragment, or has fewer than `least` characters, to the one before it.

    Islands: whether a piece starts one depends on the piece alone, and the first always does.
    """
    by = W.partitionBy("doc_id").orderBy("pos")
    broken = F.col("sentence").rlike(fragment) | (F.length(F.trim("sentence")) < least)
    starts = ~broken | (F.row_number().over(by) == 1)
    down = by.rowsBetween(W.unboundedPreceding, 0)
    return _glued(rows.withColumn("starts", starts.cast("int")), ["doc_id", "chapter"], "pos", F.sum("starts").over(down), "sentence", " ")


def carry_forward(rows: DataFrame, ends: str = ".!?", most: int = 300) -> DataFrame:
    """Join pieces up to and including the next one that ends in a mark; the unfinished tail stays whatever its length."""
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    done = F.col("sentence").rlike(f"[{ends}]$").cast("int")
    island = F.coalesce(F.sum("done").over(before), F.lit(0))
    out = _glued(rows.withColumn("done", done), ["doc_id", "chapter"], "pos", island, "sentence", " ")
    return out.where((F.length("sentence") <= most) | ~F.col("sentence").rlike(f"[{ends}]$"))


def first_wins(df: DataFrame, key: list[Column | str], order: list) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("_t", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_t = 1").drop("_t")


def dedupe_units(*corpora: DataFrame) -> DataFrame:
    """Union of unit tables (chapter, doc_id, pos, sentence); equal squeezed texts stay once, earlier tables first."""
    out = None
    for rank, c in enumerate(corpora):
        c = c.select(F.lit(rank).alias("corpus"), "chapter", "doc_id", "pos", "sentence")
        out = c if out is None else out.unionByName(c)
    return first_wins(out.withColumn("_k", F.xxhash64(squeeze(F.col("sentence")))), ["_k", squeeze(F.col("sentence"))], ["corpus", "doc_id", "pos"]).drop("_k")


def running_label(lines: DataFrame, pattern: str, name: str) -> DataFrame:
    """The last line above that fits the pattern, for each line of (file, line_no, line)."""
    head = F.regexp_extract("line", pattern, 1)
    down = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(F.when(head != "", head), ignorenulls=True).over(down))


def term_counts(units_: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: non-overlapping occurrences, summed over units; terms are words, so an equi-join on words finds the units."""
    from ..functions.text import words

    hits = units_.select(F.explode(words(F.col("sentence"))).alias("term"))
    return terms.join(hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))
