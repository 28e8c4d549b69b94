"""Learning state: attempts folded to progress, statistics, activity, exams, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clamp, pct
from ..sources.bindings import MARK, RIGHT, RIGHT_REDO, WRONG

STATE = ("seen", "correct", "wrong", "last_ts", "box", "fav", "wrong_flag")
TOP_BOX, MASTERED_BOX = 5, 3


def fold(attempts: DataFrame) -> DataFrame:
    """learner, question and state from attempts (learner, question, kind, ts, seq).

    A right answer raises the box by one, a wrong one sets it to 1; so the box is the number of
    right answers since the last wrong one, plus 1 if there was one. One shuffle serves the
    window and the aggregate.
    """
    later = W.partitionBy("learner", "question").orderBy(F.col("ts").desc(), F.col("seq").desc()).rowsBetween(W.unboundedPreceding, 0)
    right, wrong = F.col("kind").isin(RIGHT, RIGHT_REDO), F.col("kind") == WRONG
    rows = attempts.withColumn("wrongs_after", F.sum(wrong.cast("int")).over(later))
    tried = right | wrong
    when = F.struct("ts", "seq")
    out = rows.groupBy("learner", "question").agg(
        F.count_if(tried).alias("seen"),
        F.count_if(right).alias("correct"),
        F.count_if(wrong).alias("wrong"),
        F.max(F.when(tried, F.col("ts"))).alias("last_ts"),
        F.count_if(right & (F.col("wrongs_after") == 0)).alias("since"),
        (F.count_if(F.col("kind") == MARK) % 2 == 1).alias("fav"),
        F.max(F.when(wrong, when)).alias("last_wrong"),
        F.max(F.when(F.col("kind") == RIGHT_REDO, when)).alias("last_redo"),
    )
    flag = F.col("last_wrong").isNotNull() & (F.col("last_redo").isNull() | (F.col("last_wrong") > F.col("last_redo")))
    return out.select("learner", "question", "seen", "correct", "wrong", "last_ts", F.least(F.lit(TOP_BOX), F.col("since") + (F.col("wrong") > 0).cast("long")).cast("int").alias("box"), "fav", flag.alias("wrong_flag"))


def mastered():
    return (F.col("seen") > 0) & (F.col("box") >= MASTERED_BOX) & (F.col("correct") > 0)


def statistics(questions: DataFrame, progress: DataFrame) -> DataFrame:
    """dimension, value and counts: overall, by type and by chapter in one pass over questions and one learner group's progress."""
    per = progress.groupBy("question").agg(*[F.sum(c).alias(c) for c in ("seen", "correct", "wrong")], F.max("box").alias("box"), F.max("fav").alias("fav"), F.max("wrong_flag").alias("wrong_flag"))
    j = questions.join(per, "question", "left")
    seen, right = F.coalesce("seen", F.lit(0)), F.coalesce("correct", F.lit(0))
    rows = j.select("type", "chapter", seen.alias("seen"), right.alias("correct"), F.coalesce("box", F.lit(0)).alias("box"), F.coalesce("fav", F.lit(False)).alias("fav"), F.coalesce("wrong_flag", F.lit(False)).alias("wrong_flag"))
    g = rows.groupingSets([[], [F.col("type")], [F.col("chapter")]], F.col("type"), F.col("chapter")).agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("seen") > 0).alias("done"),
        F.sum("seen").alias("attempts"),
        F.sum("correct").alias("correct"),
        F.count_if(F.col("correct") > 0).alias("unique_correct"),
        F.count_if(mastered()).alias("mastered"),
        F.count_if((F.col("seen") > 0) & ~mastered()).alias("review"),
        F.count_if(F.col("seen") == 0).alias("untouched"),
        F.count_if("fav").alias("favourites"),
        F.count_if("wrong_flag").alias("wrong_marked"),
    )
    dim = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "type").otherwise("chapter")
    out = g.select(dim.alias("dimension"), F.coalesce("type", "chapter", F.lit("")).alias("value"), *[c for c in g.columns if c not in ("type", "chapter", "gid")])
    return out.withColumns({"accuracy": pct(F.col("unique_correct"), F.col("done")), "attempt_accuracy": pct(F.col("correct"), F.col("attempts"))})


def daily(attempts: DataFrame) -> DataFrame:
    """learner, day, n, ok of answered attempts."""
    tried = attempts.where(F.col("kind").isin(RIGHT, RIGHT_REDO, WRONG))
    return tried.groupBy("learner", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") != WRONG).alias("ok"))


def week_activity(days: DataFrame, progress: DataFrame, anchor: DataFrame) -> DataFrame:
    """learner, day, n, ok, rate for the 7 days up to anchor (one row, day).

    A learner without any attempt on those days gets the counts of last-answer days instead.
    """
    axis = anchor.select(F.explode(F.sequence(F.date_sub("day", 6), F.col("day"))).alias("day"))
    grid = progress.select("learner").distinct().join(F.broadcast(axis))  # seven rows
    log = grid.join(days, ["learner", "day"], "left").select("learner", "day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ok", F.lit(0)).alias("ok"))
    last = progress.where("last_ts IS NOT NULL").groupBy("learner", F.to_date("last_ts").alias("day")).agg(F.count(F.lit(1)).alias("ln"), F.count_if(F.col("correct") > 0).alias("lok"))
    j = log.join(last, ["learner", "day"], "left").withColumn("any", F.sum("n").over(W.partitionBy("learner")))
    pick = lambda a, b: F.when(F.col("any") > 0, F.col(a)).otherwise(F.coalesce(b, F.lit(0)))
    return j.select("learner", "day", pick("n", "ln").alias("n"), pick("ok", "lok").alias("ok")).withColumn("rate", pct(F.col("ok"), F.col("n")))


def review_queue(progress: DataFrame) -> DataFrame:
    """Attempted questions that are not mastered, longest unanswered first; turn counts from 1."""
    due = progress.where((F.col("seen") > 0) & ~mastered())
    return due.select("learner", "question", "last_ts", F.row_number().over(W.partitionBy("learner").orderBy("last_ts", "question")).alias("turn"))


def score_exams(items: DataFrame) -> DataFrame:
    """exam, learner, ts, total, correct, score, passed, stars; unanswered items are wrong ones."""
    g = items.groupBy("exam", "learner", "ts").agg(F.count(F.lit(1)).alias("total"), F.count_if("right").alias("correct"))
    s = pct(F.col("correct"), F.col("total"))
    return g.withColumn("score", s).withColumn("passed", F.col("score") >= 60).withColumn("stars", clamp(F.round(F.col("score") / 20), 0, 5).cast("int"))


def exam_history(exams: DataFrame, most: int = 50) -> DataFrame:
    """The newest exams of each learner, one per ts (the smallest exam id)."""
    one = exams.withColumn("_k", F.row_number().over(W.partitionBy("learner", "ts").orderBy("exam"))).where("_k = 1").drop("_k")
    return one.withColumn("place", F.row_number().over(W.partitionBy("learner").orderBy(F.col("ts").desc()))).where(F.col("place") <= most)


def sanitise(progress: DataFrame) -> DataFrame:
    """Counts not negative, seen at least correct + wrong, box 0 to 5."""
    pos = {c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in ("seen", "correct", "wrong")}
    p = progress.withColumns(pos)
    return p.withColumns({"seen": F.greatest("seen", F.col("correct") + F.col("wrong")), "box": clamp(F.coalesce("box", F.lit(0)), 0, TOP_BOX).cast("int"), "fav": F.coalesce("fav", F.lit(False)), "wrong_flag": F.coalesce("wrong_flag", F.lit(False))})


def merge(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Progress of two devices. Where both have a question, counts add up and a wrong mark survives below box 3; other rows pass as sanitised."""
    a, b = sanitise(local).alias("a"), sanitise(incoming).alias("b")
    j = a.join(b, ["learner", "question"], "full_outer")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    both = x("seen").isNotNull() & y("seen").isNotNull()
    add = lambda c: (F.coalesce(x(c), F.lit(0)) + F.coalesce(y(c), F.lit(0))).alias(c)
    box = F.greatest(x("box"), y("box"))
    flag = F.coalesce(x("wrong_flag"), F.lit(False)) | F.coalesce(y("wrong_flag"), F.lit(False))
    return j.select("learner", "question", add("seen"), add("correct"), add("wrong"), F.greatest(x("last_ts"), y("last_ts")).alias("last_ts"), box.alias("box"), (F.coalesce(x("fav"), F.lit(False)) | F.coalesce(y("fav"), F.lit(False))).alias("fav"), (flag & (~both | (box < MASTERED_BOX))).alias("wrong_flag"))


def merge_daily(*sides: DataFrame) -> DataFrame:
    """Daily logs added up; each side's ok is at most its n."""
    out = None
    for s in sides:
        s = s.select("learner", "day", F.greatest("n", F.lit(0)).alias("n"), F.least("ok", "n").alias("ok"))
        out = s if out is None else out.unionByName(s)
    return out.groupBy("learner", "day").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))


def import_progress(local: DataFrame, incoming: DataFrame, mode: str) -> DataFrame:
    """Progress after an import: `replace` keeps the incoming rows alone, `merge` adds them to the local ones."""
    if mode not in ("replace", "merge"):
        raise ValueError(f"mode is replace or merge, not {mode}")
    return sanitise(incoming) if mode == "replace" else merge(local, incoming)


def merge_exams(local: DataFrame, incoming: DataFrame, most: int = 50) -> DataFrame:
    """learner, ts, total, correct, score, place of the newest exams of both sides; of one ts the local one stays, then the smallest exam id.

    Exams without a time or items are left out, and correct answers are at least 0 and at most all.
    """
    cols = ("exam", "learner", "ts", "total", "correct")
    both = local.select(*cols, F.lit(0).alias("side")).unionByName(incoming.select(*cols, F.lit(1).alias("side"))).where("ts IS NOT NULL AND total > 0")
    # older times than a task's `most` newest ones of a learner are left out before rows are dealt by learner
    newest = both.withColumn("_t", F.dense_rank().over(W.partitionBy("learner").orderBy(F.col("ts").desc()))).where(F.col("_t") <= most)
    one = newest.groupBy("learner", "ts").agg(F.min_by(F.struct("total", "correct"), F.struct("side", "exam")).alias("e"))
    e = one.select("learner", "ts", "e.total", F.least(F.greatest(F.coalesce("e.correct", F.lit(0)), F.lit(0)), "e.total").alias("correct"))
    e = e.withColumn("score", pct(F.col("correct"), F.col("total")))
    return e.withColumn("place", F.row_number().over(W.partitionBy("learner").orderBy(F.col("ts").desc()))).where(F.col("place") <= most)


def session_rate(results: DataFrame) -> DataFrame:
    """session, answered, rate of results (session, question, seq, ok): the last result of a question counts."""
    last = results.groupBy("session", "question").agg(F.max_by("ok", "seq").alias("ok"))
    g = last.groupBy("session").agg(F.count(F.lit(1)).alias("answered"), F.count_if("ok").alias("right"))
    return g.select("session", "answered", pct(F.col("right"), F.col("answered")).alias("rate"))


def scope(questions: DataFrame, progress: DataFrame, kind: str) -> DataFrame:
    """Questions of one learner group's scope: all, wrong (marked), new (never answered), fav, review."""
    on = {"wrong": F.col("wrong_flag"), "fav": F.col("fav"), "review": (F.col("seen") > 0) & ~mastered()}
    if kind == "all":
        return questions
    if kind == "new":
        return questions.join(progress.where("seen > 0"), "question", "left_anti")
    return questions.join(progress.where(on[kind]), "question", "left_semi")


def next_after_last(progress: DataFrame, questions: DataFrame) -> DataFrame:
    """learner and the question that follows the last answered one in bank order, around the end."""
    last = progress.groupBy("learner").agg(F.max_by("question", F.struct("last_ts", "question")).alias("last"))
    ring = questions.agg(F.count(F.lit(1)).alias("total"))  # one row; ids are 0 .. total - 1
    return last.join(F.broadcast(ring)).select("learner", "last", F.pmod(F.col("last") + 1, F.col("total")).alias("next"))


def active_time(events: DataFrame, gap_s: int = 1800) -> DataFrame:
    """learner, session, seconds: attempts closer than the gap belong to one session; pauses between sessions don't count."""
    by = W.partitionBy("learner").orderBy("ts", "seq")
    step = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(by)
    rows = events.withColumn("step", step).withColumn("session", F.sum(F.when(F.col("step") <= gap_s, 0).otherwise(1)).over(by))
    return rows.groupBy("learner", "session").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("step") <= gap_s, F.col("step")).otherwise(0.0)).alias("seconds"))
