"""Blank-filling and judge items made from single-choice items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_stem, text

#: A blank, options that speak of other options, marks that no option may hold, and stems that no statement can be made of.
BLANK = "[_＿]{2,}"
OF_OTHERS = "^(以上|上述|全部|都|均|都是|均是|以上都|以上均|前三|以上各项)"
OPTION_MARKS = "[。；;！？]"
NO_STATEMENT = "下列说法|下列选项|以下哪些|下列哪些|包括哪些|错误的是|不正确的是|有误的是|不是|不属于|不包括|不正确|不符合|哪些|哪项|哪一"
LETTERS, OPTIONS, STEM, OPTION, LEAST = "ABCDEFGH", 4, (10, 120), (2, 20), 8
MOST = 150


def usable(rows: DataFrame) -> DataFrame:
    """The single-choice items with exactly one blank and four plain options, with `right` and the wrong option nearest to it in length."""
    o = F.col("options")
    plain = F.forall(o, lambda x: F.length(x).between(*OPTION) & ~x.rlike(BLANK) & ~x.rlike(OF_OTHERS) & ~x.rlike(OPTION_MARKS))
    fits = (F.col("type") == "single") & (F.size(o) == OPTIONS) & F.length("stem").between(*STEM) & (F.regexp_count(F.col("stem"), F.lit(BLANK)) == 1)
    at = F.instr(F.lit(LETTERS), text("answer"))
    kept = rows.where(fits & plain & (F.length(text("answer")) == 1) & at.between(1, OPTIONS)).withColumn("_at", at - 1)
    near = F.transform(o, lambda x, k: F.struct(F.abs(F.length(x) - F.length("right")).alias("d"), k.alias("k"), x.alias("o")))
    wrong = F.array_min(F.filter(near, lambda x: x["k"] != F.col("_at")))["o"]
    return kept.withColumn("right", F.get(o, F.col("_at"))).withColumn("wrong", wrong).drop("_at")


def _first(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each key: combined before the shuffle, no window over a key's rows."""
    cols = [c for c in rows.columns if c != "_key"]
    return rows.groupBy("_key").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")).select("_r.*")


def statement(stem: Column, option: Column) -> Column:
    """The stem with the option in its blank."""
    p = F.split(stem, BLANK)
    return F.concat(F.get(p, F.lit(0)), option, F.get(p, F.lit(1)))


def derived(rows: DataFrame, order: str, most: int | None = MOST) -> DataFrame:
    """kind (fill, judge), no, item, stem, answer from rows (item, type, stem, options, answer) in the order of `order`, which has no ties.

    A fill item keeps the stem, first of those with one key; an item gives a true and a false statement, in this order, the first of those
    with one key in all statements. Both lists end at `most` (null: never): an item is taken up while a list is shorter, so the last one may bring
    a judge item too many. A row that a key rules out takes no place. The ends are the smallest rows of each list, found
    without ordering the rest. Null stems, options and answers give nothing.
    """
    u = usable(rows).select(F.col(order).alias("_o"), "item", "stem", "right", "wrong").where(F.length("stem") >= LEAST)
    fill = _first(u.select(norm_stem(F.col("stem")).alias("_key"), "_o", "item", "stem", F.col("right").alias("answer")), ["_o"])
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), statement(F.col("stem"), F.col(c)).alias("said"), F.lit(a).alias("answer")) for k, (c, a) in enumerate((("right", "true"), ("wrong", "false")))]))
    said = u.where(~F.col("stem").rlike(NO_STATEMENT)).select("_o", "item", both.alias("_s")).select("_o", "item", "_s.*").where(F.length("said") >= LEAST)
    judge = _first(said.select(norm_stem(F.col("said")).alias("_key"), "_o", "_k", "item", F.col("said").alias("stem"), "answer"), ["_o", "_k"])
    if most is not None:
        fill, judge = fill.orderBy("_o").limit(most), judge.orderBy("_o", "_k").limit(most + 1)
    fill = fill.withColumn("_k", F.lit(0))
    if most is None:
        return fill.select(F.lit("fill").alias("kind"), F.lit(None).cast("int").alias("no"), "item", "stem", "answer").unionByName(judge.select(F.lit("judge").alias("kind"), F.lit(None).cast("int").alias("no"), "item", "stem", "answer"))

    def numbered(x: DataFrame, kind: str) -> DataFrame:
        return x.select(F.lit(kind).alias("kind"), F.row_number().over(W.orderBy("_o", "_k")).alias("no"), "_o", "item", "stem", "answer")  # at most `most` + 1 rows

    j = numbered(judge, "judge").withColumn("_n", F.min("no").over(W.partitionBy("_o"))).where(F.col("_n") <= most).drop("_n")
    return numbered(fill, "fill").unionByName(j).drop("_o")
