"""Contrasts for wrong options from sentences that say which scope a concept belongs to.

A sentence gives pairs (concept, scope) where it reads "<scope> ... of <concept>"; a wrong option meets the pairs of its own or its
core's name by an equi-join, in sentences that hold the option. A sentence in which a right option has
another scope gives a contrast of the two; otherwise a scope that the stem does not name attributes the option. The
first sentence in order that gives either decides, contrast before attribution within it. Nothing is made up for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Scopes that a stem or a sentence may name.
SCOPES = "秦汉 秦朝 汉朝 隋唐 唐朝 隋朝 宋朝 北宋 南宋 明朝 清朝 清初 古代 近代 现代 当代 春秋 战国 三国 元朝 民国 中国 美国 俄罗斯 苏联 日本 印度 英国 法国 德国 陆军 海军 空军 空天军 战略 战术 信息化 机械化".split()
#: What joins scope and concept, and the general ends of a concept's name.
BETWEEN, CONCEPT = ".{0,8}?的", r"([\x{4e00}-\x{9fff}]{2,12})"
ENDS = "(制度|兵役制|主义|思想|武器|系统|政策|战略|理论)$"
#: Texts that say nothing, which may be replaced.
TEMPLATES = (
    "该表述与正确选项相近，容易混淆，注意区分题干限定的范围。",
    "属于相关但错误的选项，注意题干限定的范围。",
    "该说法在本软件核对过的教材语料中查不到，属于为本题设置的干扰项。",
    "该说法教材中未出现或不属本考点的规范表述。",
    "该说法教材中有，但指向的不是本题所问的考点。",
    "它属于该考点包含的内容，但本题问的是“不属于”的那一项。",
)


def core(c: Column, ends: str = ENDS) -> Column:
    """A concept's name without its general end."""
    return F.regexp_replace(c, ends, "")


def scope_pairs(units: DataFrame, scopes: list[str], between: str = BETWEEN, concept: str = CONCEPT) -> DataFrame:
    """unit, concept, scope: the scope that each sentence (unit, sentence) gives a concept first; matches go from the left and do not overlap."""
    pattern = f"({'|'.join(scopes)}){between}{concept}"
    found = units.select("unit", F.posexplode(F.regexp_extract_all("sentence", F.lit(f"({pattern})"), F.lit(1))).alias("pos", "m"))
    rows = found.select("unit", "pos", F.regexp_extract("m", pattern, 1).alias("scope"), F.regexp_extract("m", pattern, 2).alias("concept"))
    return rows.groupBy("unit", "concept").agg(F.min_by("scope", "pos").alias("scope"))


def contrasts(questions: DataFrame, units: DataFrame, scopes: list[str] = SCOPES, templates: tuple[str, ...] = TEMPLATES, ends: str = ENDS, between: str = BETWEEN, concept: str = CONCEPT) -> DataFrame:
    """question, i, kind, unit, scope, right_option, right_scope, text of each wrong option whose explanation is a template.

    questions: question, stem, options, letters, why (map of letter to text). kind: contrast, scope, or pending with null columns.
    Sentences are in order of unit; of right options with another scope, the first in order of the letters counts.
    """
    from .folds import stored

    c = F.col
    pairs = stored(scope_pairs(units, scopes, between, concept), "contrast-pairs")
    q = questions.select("question", "stem", "options", "letters", "why")
    each = q.select("question", "stem", "letters", "why", F.posexplode("options").alias("i", "option")).withColumn("letter", F.char(c("i") + 65))
    wrong = each.where(~F.array_contains("letters", c("letter")) & (T.trim(c("option")) != "") & F.element_at("why", c("letter")).isin(*templates))
    wrong = stored(wrong.select("question", "stem", "i", "option"), "contrast-options")
    right = q.select("question", F.posexplode("letters").alias("r", "l"), "options").select("question", "r", F.get("options", F.ascii("l") - 65).alias("right_option")).where("right_option <> ''")
    sentences = units.select("unit", "sentence")

    def scoped(rows: DataFrame, name: str, out: str, rank: str) -> DataFrame:
        """rows with the scope their option has in a unit, by its whole name (0) before its core (1)."""
        names = rows.withColumn("concept", F.explode(F.array(F.struct(c(name).alias("n"), F.lit(0).alias("k")), F.struct(core(c(name), ends).alias("n"), F.lit(1).alias("k"))))).select(*rows.columns, c("concept.n").alias("concept"), c("concept.k").alias(rank))
        return names.join(pairs, "concept").withColumnRenamed("scope", out)

    met = scoped(wrong, "option", "scope", "k").groupBy("question", "i", "stem", "option", "unit").agg(F.min_by("scope", "k").alias("scope"))
    met = stored(met.join(sentences, "unit").where(F.contains("sentence", "option") | F.contains("sentence", core(c("option"), ends))), "contrast-met")
    rights = scoped(right, "right_option", "right_scope", "k").groupBy("question", "r", "right_option", "unit").agg(F.min_by("right_scope", "k").alias("right_scope"))
    both = met.join(rights, ["question", "unit"]).where((c("right_option") != c("option")) & F.contains("sentence", c("right_option")) & (c("right_scope") != c("scope")))
    first = both.groupBy("question", "i", "unit").agg(F.min_by(F.struct("right_option", "right_scope"), "r").alias("right"))
    named = F.filter(F.array(*map(F.lit, scopes)), lambda s: F.contains(F.col("stem"), s))
    decided = met.join(first, ["question", "i", "unit"], "left").withColumn("named", named).where(c("right").isNotNull() | ~F.array_contains("named", c("scope")))
    best = decided.withColumn("_t", F.row_number().over(W.partitionBy("question", "i").orderBy("unit"))).where("_t = 1")
    contrast = F.format_string("你把“%s”和“%s”搞混了：“%s”是%s的，“%s”（本题答案）是%s的。", "option", "right.right_option", "option", "scope", "right.right_option", "right.right_scope")
    asked = F.coalesce(F.get("named", 0), F.lit("本题所问的范围"))
    attributed = F.format_string("“%s”（你选的）指的是%s的，不是本题所问的%s。", c("option"), c("scope"), asked)
    best = best.select("question", "i", "unit", "scope", "right.right_option", "right.right_scope", F.when(c("right").isNotNull(), "contrast").otherwise("scope").alias("found"), F.when(c("right").isNotNull(), contrast).otherwise(attributed).alias("text"))
    return wrong.select("question", "i").join(best, ["question", "i"], "left").select("question", "i", F.coalesce("found", F.lit("pending")).alias("kind"), "unit", "scope", "right_option", "right_scope", "text")
