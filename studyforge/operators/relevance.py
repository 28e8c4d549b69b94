"""Re-selection of a question's evidence, and verdicts on its answer, from pools found by score bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.predicates import exercise, negative
from ..functions.spans import cover_score
from .folds import stored
from .index import Index
from .matching import beside, best, summed

#: Share of the stem a unit must cover, score that is accepted, bonus of a definition, what defines.
STEM_FLOOR, ACCEPTED, DEFINES = 0.20, 0.62, 0.12
DEFINITION = "(是指|指的是|就是指|称为|又叫|包括|分为|由.{2,20}组成|是指以)"
PARTS = "[、，,；;和与及/]+"
CLAUSES = "[，。；、（）()：:？！]"
CONTENT = r"[^\x{4e00}-\x{9fff}0-9A-Za-z%]"
#: Units in the pool of an answer; stem units and all units in the pool of a verdict.
ANSWER_POOL, STEM_POOL, VERDICT_POOL = 400, 40, 80


def content(c: Column) -> Column:
    """Han characters, Latin letters, digits and percent signs of a text."""
    return F.regexp_replace(T.text(c), CONTENT, "")


def shared(part: Column, whole: Column) -> Column:
    """Share of the part's characters (an array) that the whole has; 0 for none."""
    return F.coalesce(F.size(F.array_intersect(part, whole)) / F.nullif(F.size(part), F.lit(0)), F.lit(0.0))


def char_cover(answer: Column, sentence: Column) -> Column:
    own = T.characters(content(answer))
    return F.when(F.size(own) == 0, 1.0).otherwise(shared(own, T.characters(content(sentence))))


def answer_parts(answer: Column) -> Column:
    """Content of an answer's parts, those of two characters or more."""
    return F.filter(F.transform(F.split(T.text(answer), PARTS), content), lambda p: F.length(p) >= 2)


def part_cover(answer: Column, sentence: Column) -> Column:
    """Best cover of any part of an answer; the whole answer's if no part has any."""
    chars = T.characters(content(sentence))
    best = F.get(F.transform(F.array(chars), lambda s: F.aggregate(F.transform(answer_parts(answer), lambda p: shared(T.characters(p), s)), F.lit(0.0), lambda a, x: F.greatest(a, x))), 0)
    return F.when(best > 0, best).otherwise(char_cover(answer, sentence))


def phrase(answer: Column) -> Column:
    """The longest part of an answer, the first of those as long; its whole content if there is none."""
    parts = answer_parts(answer)
    longest = F.get(F.array_sort(F.transform(parts, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))), 0)["p"]
    return F.coalesce(longest, content(answer))


def on_topic(stem: Column, sentence: Column, answer: Column) -> Column:
    """Whether the sentence has enough of the stem's words, and a clause of it 60 % of a part of the answer."""
    terms = F.filter(T.keywords(F.regexp_replace(T.text(stem), "[_＿]{2,}", " ")), lambda t: F.length(t) >= 2)
    whole = T.squeeze(sentence)
    hit = F.size(F.filter(terms, lambda t: F.contains(whole, t)))
    told = (F.size(terms) == 0) | ((hit > 0) & ((hit / F.greatest(F.size(terms), F.lit(1)) >= 0.34) | (hit >= 2)))
    parts = F.filter(F.split(T.text(answer), CLAUSES), lambda p: F.length(T.trim(p)) >= 2)
    sets = F.filter(F.transform(parts, lambda p: T.characters(content(p))), lambda s: F.size(s) >= 2)
    clauses = F.transform(F.filter(F.split(T.text(sentence), CLAUSES), lambda c: F.length(T.squeeze(c)) >= 3), lambda c: T.characters(content(c)))
    return told & ((F.size(parts) == 0) | F.exists(clauses, lambda c: F.exists(sets, lambda p: shared(p, c) >= 0.6)))


def reselect(questions: DataFrame, index: Index) -> DataFrame:
    """question, unit, score, action for each question (question, stem, answer, reason).

    A unit must cover STEM_FLOOR of the stem, be no exercise, be on topic and have one of the stem's first ten words.
    It scores by the answer's best part, the answer's literal phrase, the stem, a definition's bonus
    and the distance of phrase and words. All units are scored; of equal ones, those in the answer's pool
    come first: with the literal phrase, then by cover of the answer. action: kept, replaced, filled, dropped or none.
    """
    c = F.col
    q = stored(questions.select("question", T.trim(F.regexp_replace(T.text("stem"), "[_＿]{2,}", " ")).alias("stem"), T.text("answer").alias("answer"), T.trim(c("reason")).alias("reason")), "reselect-questions")
    q = q.withColumns({"terms": F.slice(F.filter(T.keywords(c("stem")), lambda t: F.length(t) >= 2), 1, 10), "phrase": phrase(c("answer"))})
    stems, answers = q.select(c("question").alias("key"), c("stem").alias("text"), F.lit(STEM_FLOOR).alias("least")), q.where("answer <> ''").select(c("question").alias("key"), c("answer").alias("text"))
    weights = index.weighed(stems.select("text").unionByName(answers.select("text")))
    near = index.covering(stems, weights)
    pool = index.top(answers, ANSWER_POOL, weights, slack=0.0).select("key", "unit", "place")
    pairs = stored(near.join(pool, ["key", "unit"], "left").withColumnRenamed("key", "question"), "reselect-pairs")
    full = pairs.join(q, "question")
    s = c("sentence")
    has_term = (F.size("terms") == 0) | F.exists("terms", lambda t: F.contains(T.squeeze(s), t))
    fit = full.where(~exercise(s) & has_term & on_topic(c("stem"), s, c("answer")))
    literal = (F.length("phrase") >= 2) & (shared(T.characters(c("phrase")), T.characters(content(s))) >= 0.8)
    support = F.when(c("answer") == "", 1.0).otherwise(part_cover(c("answer"), s))
    score = support * 0.45 + literal.cast("int") * 0.30 + c("cover") * 0.25 + F.when(s.rlike(DEFINITION), DEFINES).otherwise(0.0) + 0.90 * T.proximity(s, c("phrase"), c("terms"))
    scored = fit.withColumns({"score": F.round(score, 6), "order": F.when(c("place").isNull(), 2).when(literal, 0).otherwise(1)})
    best = scored.withColumn("_t", F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), "order", "place", "unit"))).where("_t = 1").where(c("score") >= ACCEPTED)
    out = q.select("question", "reason").join(best.select("question", "unit", "score", "sentence"), "question", "left")
    new = T.trim_sentence(T.clean(c("sentence")))
    had = c("reason") != ""
    action = F.when(c("unit").isNull(), F.when(had, "dropped").otherwise("none")).when(~had, "filled").when(c("reason") == new, "kept").otherwise("replaced")
    return out.select("question", "unit", "score", action.alias("action"), F.when(c("unit").isNotNull(), new).alias("new_reason"))


def verdict_pool(questions: DataFrame, index: Index, stem_most: int = STEM_POOL, most: int = VERDICT_POOL) -> DataFrame:
    """question, unit, place: the units that share most words with the stem, then those that have a word of an option, by unit, `most` together.

    questions: question, stem, options. Each list is cut while it is dealt, so no list is gathered whole.
    """
    c, g = F.col, index.grams
    of = lambda text: questions.select(c("question").alias("key"), F.explode(g.base(text)).alias("gram"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("least")).distinct()
    rank = lambda *o: F.row_number().over(W.partitionBy("question").orderBy(*o))
    units = index.cut()
    first = stored(best(summed(units, of(c("stem")), most=stem_most), stem_most).select(c("key").alias("question"), "unit", "place"), "verdict-first")
    # a weight of 0 makes every unit that has a word alike, so a task keeps its first by number
    by_option = summed(units, of(F.array_join("options", " ")).withColumns({"weight": F.lit(0.0), "least": F.lit(0.0)}), most=stem_most + most).select(c("key").alias("question"), "unit")
    more = by_option.join(first, ["question", "unit"], "left_anti").withColumn("place", rank("unit") + stem_most).where(c("place") <= stem_most + most)
    return first.unionByName(more).withColumn("place", rank("place")).where(c("place") <= most)


def verdicts(questions: DataFrame, index: Index, primary: Column) -> DataFrame:
    """question, verdict, ans_min, ans_avg, dis_max, pool of questions (question, kind, stem, options, letters); primary: whether the unit in a row is of the first source.

    Each option's score is its best cover in the pool. No score at all: no evidence; an exception that is there, or a wrong option
    of 0.6 that beats the weakest right one by 0.25: suspect; else consistent, marked where no right option has a primary source.
    """
    c = F.col
    pool = stored(verdict_pool(questions, index), "verdict-pool")
    options = questions.select("question", F.posexplode("options").alias("i", "option"), "letters").withColumn("right", F.array_contains("letters", F.char(c("i") + 65)))
    seen = beside(pool, index.units.select("unit", "chapter", "sentence")).withColumn("primary", primary)
    scored = options.join(seen, "question", "left").withColumn("score", F.round(cover_score(c("option"), c("sentence")), 3))
    best = scored.groupBy("question", "i", "right").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"), F.max_by("primary", F.struct("score", -c("place"))).alias("primary"), F.count("unit").alias("pool"))
    own = lambda x: F.when(c("right"), x)
    per = best.groupBy("question").agg(
        F.coalesce(F.min(own(c("score"))), F.lit(0.0)).alias("ans_min"),
        F.round(F.coalesce(F.avg(own(c("score"))), F.lit(0.0)), 6).alias("ans_avg"),
        F.coalesce(F.max(F.when(~c("right"), c("score"))), F.lit(0.0)).alias("dis_max"),
        F.coalesce(F.max(own((c("score") > 0) & c("primary"))), F.lit(False)).alias("primary"),
        F.max("pool").alias("pool"),
    )
    full = questions.select("question", "kind", "stem").join(per, "question")
    suspect = (negative(c("stem"), "audit", c("kind")) & (c("ans_min") >= 0.5)) | ((c("dis_max") >= 0.6) & (F.round(c("dis_max") - c("ans_min"), 6) >= 0.25))
    verdict = F.when((c("pool") == 0) | ((c("ans_avg") == 0) & (c("dis_max") == 0)), "no_corpus_evidence").when(suspect, "suspect_answer").when(~c("primary") & (c("ans_avg") > 0), "consistent_secondary").otherwise("consistent")
    return full.select("question", verdict.alias("verdict"), "ans_min", "ans_avg", "dis_max", "pool")
