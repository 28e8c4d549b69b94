"""Rules that rewrite the reasons of a bank's options, with a report and assertions on the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outdated phrases and what stands in for them, and what must not be said of a right option.
WRONG_REFERENCE = r"与正确项\s*[A-H](?:\s*/\s*[A-H])*\s*表述相近、容易混淆，注意区分限定语。"
NEUTRAL_REFERENCE = "该表述与正确选项相近，容易混淆，注意区分题干限定的范围。"
STALE = "教材中仅零星出现，不是本考点的规范表述。"
NEUTRAL_STALE = "该说法教材中未出现或不属本考点的规范表述。"
NOT_IN_CORPUS = "该说法在本软件核对过的教材语料中查不到，属于为本题设置的干扰项。"
OF_RIGHT_OPTION = "该说法属于本题的正确选项。"


def steps(letter: Column, right: Column, said: Column) -> dict[str, tuple[Column, Column]]:
    """For each rule whether it takes hold of what is said of a letter, and the text after it; later rules see what earlier ones left."""
    a = F.regexp_replace(said, WRONG_REFERENCE, NEUTRAL_REFERENCE)
    b = F.replace(a, F.lit(STALE), F.lit(NEUTRAL_STALE))
    denied = F.array_contains(right, letter) & b.isin(NOT_IN_CORPUS, NEUTRAL_STALE)
    c = F.when(F.coalesce(denied, F.lit(False)), OF_RIGHT_OPTION).otherwise(b)
    return {"reference": (said.rlike(WRONG_REFERENCE), a), "stale": (F.contains(a, F.lit(STALE)), b), "right option denied": (F.coalesce(denied, F.lit(False)), c)}


def rewrite(rows: DataFrame, why: str = "why", right: str = "right") -> DataFrame:
    """rows with `why` (map of letter to text) rewritten; null maps and texts stay null. Running twice changes nothing."""
    return rows.withColumn(why, F.transform_values(why, lambda k, v: list(steps(k, F.col(right), v).values())[-1][1]))


def report(rows: DataFrame, why: str = "why", right: str = "right") -> DataFrame:
    """rule, n: how many texts each rule takes hold of, zeros included; counted in one pass."""
    e = rows.select(right, F.explode(why).alias("_k", "_v"))
    hits = steps(F.col("_k"), F.col(right), F.col("_v"))
    one = e.agg(*[F.count(F.when(hit, 1)).alias(name) for name, (hit, _) in hits.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n")) for name in hits])).alias("_r")).select("_r.*")


def faults(why: str = "why", right: str = "right") -> dict[str, Column]:
    """What no row may show once it is rewritten, as checks of a commit."""
    said = F.map_values(why)
    denied = F.map_filter(why, lambda k, v: F.array_contains(right, k) & (F.contains(v, F.lit(NOT_IN_CORPUS)) | F.contains(v, F.lit(NEUTRAL_STALE))))
    return {
        "wrong references left": F.exists(said, lambda v: v.rlike(WRONG_REFERENCE)),
        "stale phrases left": F.exists(said, lambda v: F.contains(v, F.lit(STALE))),
        "right options denied": F.size(denied) > 0,
    }
