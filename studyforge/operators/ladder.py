"""Explanations by a ladder: each question gets the strongest kind of evidence that any unit gives it.

All searches a question may need are made at once: its answers at their thresholds, the negative form,
the merely related units. Their accepted candidates stand in one table with their rung, and one window takes each question's
lowest rung, then its best unit; nothing is searched again when a rung fails. A question
without a candidate gets a template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.predicates import negative
from .folds import stored
from .index import Index, asks
from .matching import beside
from .terms import contained

#: Rungs in order. Cover that an answer must have on its rung, and score that a related unit must have by the question's kind.
RUNGS = {"kept": 0, "negative": 1, "evidence": 2, "wider": 3, "longest": 4, "second": 5, "related": 6, "bank": 7, "template": 8}
COVERS = {"evidence": 0.45, "wider": 0.34, "longest": 0.55, "second": 0.55}
SCORES = {"single": 0.45, "multi": 0.45, "short": 0.58, "judge": 0.5}
#: The asked-for concept of a negative stem, and the marks of a manual explanation.
CONCEPT = "不属于(.{2,20}?)的是|不包括(.{2,20}?)的是"
MANUAL = "人工校订|人工修正"
#: Texts of an explanation.
SAYS = {
    "short": "参考答案见下方。教材相关表述：",
    "bank": "参考答案见下方（本题库收录的是原卷参考答案要点）。",
    "multi_none": "本题库未收录教材中的直接出处，建议对照原卷核实各选项。",
    "multi_brief": "本题库未收录教材中的直接出处。可从国防的基本概念（国防随阶级和国家的产生而产生）理解，并对照原卷核实各选项。",
    "multi_unread": "本题答案由原卷答案串解析，建议对照原卷核实。",
    "judge_none": "本题库未收录教材中的直接出处。",
}


def prepared(questions: DataFrame, glue: str = "") -> DataFrame:
    """Questions (question, kind, stem, chapter, options, letters, answer, old) with what is searched for them.

    chosen: options that the letters name; correct: the first; combined: all; keys: the two longest; clear: stem without blanks.
    """
    c = F.col
    options, letters = (F.coalesce(c(x), F.array().cast("array<string>")) for x in ("options", "letters"))
    q = questions.withColumns({"options": options, "letters": letters, "old": T.trim(c("old")), "clear": F.regexp_replace(T.text("stem"), "[_＿]{2,}", " ")})
    named = F.filter(F.transform("letters", lambda x: F.when(x.rlike("^[A-H]$"), F.get("options", F.ascii(x) - 65))), lambda o: o.isNotNull())
    q = q.withColumn("chosen", named)
    by_length = F.transform(F.array_sort(F.transform("chosen", lambda o, i: F.struct((-F.length(o)).alias("n"), i.alias("i"), o.alias("o")))), lambda s: s["o"])
    return q.withColumns({"correct": F.coalesce(F.get("chosen", 0), F.lit("")), "combined": F.array_join("chosen", glue), "keys": F.slice(by_length, 1, 2)})


def _searches(q: DataFrame) -> DataFrame:
    """question, rung, text, cover of every answer that is searched for."""
    c, size = F.col, F.length("combined")

    def want(rung: str, text: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(RUNGS[rung]).alias("rung"), text.alias("text"), F.lit(COVERS[rung]).alias("cover")))

    multi = (c("kind") == "multi") & (size >= 8)
    answer = T.text("answer")
    wants = F.array(
        want("evidence", F.when(c("kind") == "single", c("correct")).when(c("kind") == "multi", c("combined")).otherwise(answer), (c("kind") == "single") | multi | ((c("kind") == "fill") & F.length(answer).between(2, 30))),
        want("wider", c("combined"), multi & (size > 14)),
        want("longest", F.get("keys", 0), multi & (F.size("keys") > 0)),
        want("second", F.get("keys", 1), multi & (F.size("keys") > 1)),
    )
    return q.select("question", "chapter", "clear", F.explode(F.filter(wants, lambda w: w.isNotNull())).alias("w")).select("question", "chapter", "clear", "w.*")


def negative_candidates(q: DataFrame, index: Index) -> DataFrame:
    """question, unit, rank: units that list two or more of the other options of a question that asks for the exception.

    rank: options listed, 1.4 for each word of the concept, half the stem's score, less 2 if the excluded answer is listed; 3 at least.
    """
    g, c = index.grams, F.col
    asked = q.where((c("kind") == "single") & negative(c("stem"), "explain"))
    found = F.regexp_extract(T.text("stem"), CONCEPT, 1)
    concept = F.regexp_replace(F.when(found != "", found).otherwise(F.regexp_extract(T.text("stem"), CONCEPT, 2)), "^[，,。 　]+|[，,。 　]+$", "")
    place = F.ascii(F.get("letters", 0)) - 65
    others = F.filter(F.transform(F.filter("options", lambda o, i: i != place), lambda o: T.squeeze(o)), lambda o: o != "")
    asked = asked.withColumns({"concept": concept, "others": others})
    listed = asked.select("question", F.explode("others").alias("term"))
    squeezed = index.units.select("unit", T.squeeze(c("sentence")).alias("squeezed"))
    hits = contained(squeezed, listed, "unit", "squeezed").join(listed, "term").groupBy("question", F.col("id").alias("unit")).agg(F.count(F.lit(1)).alias("listed")).where("listed >= 2")
    words = F.filter(g.keywords(F.when(c("concept") != "", c("concept")).otherwise(c("stem"))), lambda k: F.length(k) >= 3)
    own = asked.select("question", "concept", "correct", words.alias("named"), F.col("chapter").alias("wanted"), g.keywords(c("stem")).alias("keywords"), g.base(c("stem")).alias("own"))
    full = index.seen(stored(hits, "ladder-hits")).join(own, "question").where(~asks(c("sentence")))
    denied = F.contains(F.substring("sentence", 1, 6), F.lit("不")) & F.contains("sentence", "correct")
    named = F.size(F.filter("named", lambda k: g.has_keyword(k, c("sentence"), c("base"))))
    inside = (T.squeeze(c("correct")) != "") & F.contains(T.squeeze(c("sentence")), T.squeeze(c("correct")))
    rank = c("listed") + 1.4 * named + 0.5 * F.least(index.score(c("keywords"), c("own"), c("wanted")), F.lit(1.0)) - F.when(inside, 2.0).otherwise(0.0)
    return full.where(~denied).withColumn("rank", F.round(rank, 6)).where("rank >= 3").select("question", "unit", "rank")


def candidates(q: DataFrame, index: Index, general: str | None = None) -> DataFrame:
    """question, rung, pool, rank, unit of every accepted candidate of prepared questions."""
    manual = F.col("old").rlike(MANUAL)
    open_ = q.where(~(F.col("kind").isin("judge", "fill") & (F.col("old") != "") & ~manual))
    s = _searches(open_)
    key = F.struct("question", "text").alias("key")
    targets = s.groupBy("question", "text").agg(F.min("cover").alias("least"), F.first("chapter").alias("chapter"), F.first("clear").alias("stem")).select(key, "stem", "text", "chapter", "least")
    found = index.supporting(targets, general).select("key.question", "key.text", "unit", "cover", "pool", "rank")
    on = found.join(s.select("question", "text", "rung", F.col("cover").alias("least")), ["question", "text"]).where(F.col("cover") >= F.col("least"))
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in SCORES.items()])
    stems = open_.where(F.col("kind").isin(*SCORES)).where(~((F.col("kind") == "multi") & (F.length("combined") < 8)))
    stem = F.when(F.col("kind") == "short", F.col("stem")).otherwise(F.col("clear"))
    near = index.related(stems.select(F.col("question").alias("key"), stem.alias("stem"), "chapter", least.alias("least"))).withColumnRenamed("key", "question")
    rows = on.select("question", "rung", "pool", "rank", "unit")
    rows = rows.unionByName(near.select("question", F.lit(RUNGS["related"]).alias("rung"), F.lit(0).alias("pool"), F.col("score").alias("rank"), "unit"))
    return rows.unionByName(negative_candidates(open_, index).select("question", F.lit(RUNGS["negative"]).alias("rung"), F.lit(0).alias("pool"), "rank", "unit"))


def _written(reference: Column) -> dict[str, Column]:
    """The explanation's text, source and reference, of a question with its unit and rung."""
    c, lit = F.col, F.lit
    rung = lambda *names: c("step").isin(*[RUNGS[n] for n in names])
    head = F.concat(lit("正确答案："), F.array_join("letters", "、"), lit("（"), F.array_join("chosen", "；"), lit("）。"))
    some, about = F.substring("sentence", 1, 150), F.when(c("concept") != "", c("concept")).otherwise("该概念")
    picked = T.pick_sentence(c("sentence"), c("correct"))
    single = F.when(F.startswith(T.squeeze(picked), T.squeeze(c("correct"))), picked).otherwise(F.concat("correct", lit(" — "), picked))
    part = F.when(rung("longest"), F.get("keys", 0)).when(rung("second"), F.get("keys", 1)).otherwise(c("correct"))
    inside = F.contains(T.squeeze(c("sentence")), T.squeeze(c("correct")))
    none = F.concat(lit("正确答案："), "correct", lit("。本题库未收录教材中的直接出处，可结合「"), F.coalesce("chapter", lit("本课程")), lit("」相关内容理解。"))
    is_ = lambda k: c("kind") == k
    body = (
        F.when(rung("kept"), c("old"))
        .when(rung("negative"), F.concat(lit("正确答案："), "correct", lit("（"), about, lit("的组成项不含它）。依据："), some))
        .when(is_("single") & rung("evidence"), single)
        .when(is_("single") & rung("related"), F.concat(lit("正确答案："), "correct", lit("。相关表述："), F.when(inside, T.clip(c("sentence"), c("correct"))).otherwise(some)))
        .when(is_("single"), none)
        .when(is_("multi") & (F.size("chosen") == 0), SAYS["multi_unread"])
        .when(is_("multi") & (F.length("combined") < 8), F.concat(head, lit(SAYS["multi_brief"])))
        .when(is_("multi") & rung("related"), F.concat(head, lit("相关表述："), some))
        .when(is_("multi") & rung("template"), F.concat(head, lit(SAYS["multi_none"])))
        .when(is_("multi"), F.concat(head, T.pick_sentence(c("sentence"), part)))
        .when(is_("short") & rung("related"), F.concat(lit(SAYS["short"]), some))
        .when(is_("short"), SAYS["bank"])
        .when(is_("judge") & rung("related"), F.concat(lit("依据："), some))
        .when(is_("judge"), SAYS["judge_none"])
        .when(rung("evidence"), F.concat(lit("正确答案："), T.text("answer"), lit("。"), T.pick_sentence(c("sentence"), T.text("answer"))))
        .otherwise(F.concat(lit("正确答案："), T.text("answer"), lit("。")))
    )
    manual = c("old").rlike(MANUAL) & ~rung("kept")
    backed = c("unit").isNotNull()
    source = F.when(manual, "manual").when(rung("kept") | rung("bank"), "bank").when(backed, "textbook").otherwise("template")
    return {"text": F.when(manual, F.concat("old", lit("　"), body)).otherwise(body), "source": source, "ref": F.when(backed, reference).otherwise("")}


def explain(questions: DataFrame, index: Index, general: str | None = None, glue: str = "", reference: Column | None = None) -> DataFrame:
    """question, kind, rung, unit, text, source, ref: one row for each question of a known kind.

    A short question whose best related unit only asks falls back to the bank's own answer, as one without any does.
    """
    q = stored(prepared(questions, glue), "ladder-questions").where(F.col("kind").isin("single", "multi", "judge", "fill", "short"))
    first = F.row_number().over(W.partitionBy("question").orderBy("rung", "pool", F.desc("rank"), "unit"))
    best = candidates(q, index, general).withColumn("_t", first).where("_t = 1").select("question", "rung", "unit")
    sentences = index.units.select("unit", "sentence", F.col("chapter").alias("own"))
    # the best units are few, so they are sent to the units' texts
    full = q.join(beside(stored(best, "ladder-best"), sentences), "question", "left")
    manual = F.col("old").rlike(MANUAL)
    kept = F.col("kind").isin("judge", "fill") & (F.col("old") != "") & ~manual
    useless = (F.col("kind") == "short") & F.coalesce(asks(F.col("sentence")), F.lit(False))
    rung = F.when(kept, RUNGS["kept"]).when((F.col("kind") == "short") & (F.col("rung").isNull() | useless), RUNGS["bank"]).otherwise(F.coalesce("rung", F.lit(RUNGS["template"])))
    found = F.regexp_extract(T.text("stem"), CONCEPT, 1)
    concept = F.regexp_replace(F.when(found != "", found).otherwise(F.regexp_extract(T.text("stem"), CONCEPT, 2)), "^[，,。 　]+|[，,。 　]+$", "")
    gone = {x: F.when(useless | kept, F.lit(None)).otherwise(F.col(x)) for x in ("unit", "sentence")}
    full = full.withColumns({"concept": concept, "step": rung, **gone}).drop("rung")
    out = _written(F.col("own") if reference is None else reference)
    name = F.element_at(F.create_map(*[F.lit(x) for k, v in RUNGS.items() for x in (v, k)]), F.col("step"))
    return full.select("question", "kind", name.alias("rung"), "unit", *[v.alias(k) for k, v in out.items()])
