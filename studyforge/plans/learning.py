"""Queries on learning state: progress, statistics, activity, review, exams, merging."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import folds
from ..operators import progress as P
from ..sources import bindings as B
from .catalog import register

ATTEMPTS = r"""attempts AS (
  SELECT user_id % 10 AS learner, CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS BIGINT) AS question,
         event_type AS kind, ts, event_id AS seq FROM events)"""


def _progress_sql(name: str = "progress", where: str = "") -> str:
    return f"""{name}_w AS (
  SELECT *, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY learner, question ORDER BY ts DESC, seq DESC) AS after
  FROM attempts {where}),
{name}_g AS (
  SELECT learner, question, count(*) FILTER (kind IN ('click', 'purchase', 'error')) AS seen,
    count(*) FILTER (kind IN ('click', 'purchase')) AS correct, count(*) FILTER (kind = 'error') AS wrong,
    max(ts) FILTER (kind IN ('click', 'purchase', 'error')) AS last_ts,
    count(*) FILTER (kind IN ('click', 'purchase') AND after = 0) AS since,
    count(*) FILTER (kind = 'signup') % 2 = 1 AS fav,
    max(ts) FILTER (kind = 'error') AS lw, max(ts) FILTER (kind = 'purchase') AS lr
  FROM {name}_w GROUP BY learner, question),
{name} AS (
  SELECT learner, question, seen, correct, wrong, last_ts,
    CAST(least(5, since + CASE WHEN wrong > 0 THEN 1 ELSE 0 END) AS INTEGER) AS box, fav,
    lw IS NOT NULL AND (lr IS NULL OR lw > lr) AS wrong_flag
  FROM {name}_g)"""


QUESTIONS = "questions AS (SELECT p_partkey AS question, p_brand AS chapter, p_type AS type, p_name AS stem, p_type || '|' || p_brand AS concept, p_size >= 40 AS hard FROM part)"
PROGRESS = f"WITH {ATTEMPTS}, {_progress_sql()}"
MASTERED = "(seen > 0 AND box >= 3 AND correct > 0)"


def _progress(spark, sf):
    return P.fold(B.attempts(spark, sf))


@register("progress_state", f"{PROGRESS} SELECT * FROM progress")
def progress_state(spark, sf):
    return _progress(spark, sf)


def _pct(a, b):
    return f"CASE WHEN {b} > 0 THEN CAST(round({a} / {b} * 100) AS BIGINT) ELSE 0 END"


STATS = f"""{PROGRESS}, {QUESTIONS},
per AS (SELECT question, sum(seen) AS seen, sum(correct) AS correct, max(box) AS box, bool_or(fav) AS fav, bool_or(wrong_flag) AS wrong_flag FROM progress GROUP BY question),
j AS (SELECT type, chapter, coalesce(seen, 0) AS seen, coalesce(correct, 0) AS correct, coalesce(box, 0) AS box, coalesce(fav, false) AS fav, coalesce(wrong_flag, false) AS wrong_flag
  FROM questions LEFT JOIN per USING (question)),
s AS (SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(chapter) = 0 THEN 'chapter' ELSE 'all' END AS dimension, coalesce(type, chapter, '') AS value,
  count(*) AS total, count(*) FILTER (seen > 0) AS done, CAST(sum(seen) AS BIGINT) AS attempts, CAST(sum(correct) AS BIGINT) AS correct,
  count(*) FILTER (correct > 0) AS unique_correct, count(*) FILTER {MASTERED.replace("(seen", "(WHERE seen", 1)} AS mastered,
  count(*) FILTER (seen > 0 AND NOT {MASTERED}) AS review, count(*) FILTER (seen = 0) AS untouched,
  count(*) FILTER (fav) AS favourites, count(*) FILTER (wrong_flag) AS wrong_marked
  FROM j GROUP BY GROUPING SETS ((), (type), (chapter)))
SELECT *, {_pct("unique_correct", "done")} AS accuracy, {_pct("correct", "attempts")} AS attempt_accuracy FROM s"""


def _stats(spark, sf):
    return P.statistics(B.questions(spark, sf), _progress(spark, sf))


@register("stats_all", STATS)
def stats_all(spark, sf):
    return _stats(spark, sf)


@register("stats_by_chapter", f"SELECT * FROM ({STATS}) WHERE dimension = 'chapter'")
def stats_by_chapter(spark, sf):
    return _stats(spark, sf).where("dimension = 'chapter'")


@register("stats_by_type", f"SELECT * FROM ({STATS}) WHERE dimension = 'type'")
def stats_by_type(spark, sf):
    return _stats(spark, sf).where("dimension = 'type'")


DAILY = "daily AS (SELECT learner, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (kind <> 'error') AS ok FROM attempts WHERE kind IN ('click', 'purchase', 'error') GROUP BY ALL)"


@register("daily_counts", f"WITH {ATTEMPTS}, {DAILY} SELECT * FROM daily")
def daily_counts(spark, sf):
    return P.daily(B.attempts(spark, sf))


@register(
    "week_activity",
    f"""{PROGRESS}, {DAILY},
axis AS (SELECT CAST(max(ts) AS DATE) - CAST(i AS INTEGER) AS day FROM events, range(7) r(i) GROUP BY i),
grid AS (SELECT learner, day FROM (SELECT DISTINCT learner FROM progress), axis),
last AS (SELECT learner, CAST(last_ts AS DATE) AS day, count(*) AS ln, count(*) FILTER (correct > 0) AS lok FROM progress WHERE last_ts IS NOT NULL GROUP BY ALL),
j AS (SELECT g.learner, g.day, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok, coalesce(ln, 0) AS ln, coalesce(lok, 0) AS lok, sum(coalesce(n, 0)) OVER (PARTITION BY g.learner) AS s
  FROM grid g LEFT JOIN daily d ON g.learner = d.learner AND g.day = d.day LEFT JOIN last l ON g.learner = l.learner AND g.day = l.day),
p AS (SELECT learner, day, CASE WHEN s > 0 THEN n ELSE ln END AS n, CASE WHEN s > 0 THEN ok ELSE lok END AS ok FROM j)
SELECT *, {_pct("ok", "n")} AS rate FROM p""",
)
def week_activity(spark, sf):
    a = B.attempts(spark, sf)
    return P.week_activity(P.daily(a), P.fold(a), a.agg(F.to_date(F.max("ts")).alias("day")))


@register("review_pool", f"{PROGRESS} SELECT learner, question, last_ts, CAST(row_number() OVER (PARTITION BY learner ORDER BY last_ts, question) AS INTEGER) AS turn FROM progress WHERE seen > 0 AND NOT {MASTERED}")
def review_pool(spark, sf):
    return P.review_queue(_progress(spark, sf))


EXAMS = f"""items AS (SELECT o_orderkey AS exam, o_custkey AS learner, o_orderdate AS ts, l_returnflag = 'A' AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e0 AS (SELECT exam, learner, ts, count(*) AS total, count(*) FILTER (r) AS correct FROM items GROUP BY ALL),
e1 AS (SELECT *, {_pct("correct", "total")} AS score FROM e0),
exams AS (SELECT *, score >= 60 AS passed, CAST(least(greatest(round(score / 20), 0), 5) AS INTEGER) AS stars FROM e1)"""


@register("exam_scores", f"WITH {EXAMS} SELECT * FROM exams")
def exam_scores(spark, sf):
    return P.score_exams(B.exam_items(spark, sf))


@register(
    "exam_history_top50",
    f"""WITH {EXAMS}, one AS (SELECT * FROM exams QUALIFY row_number() OVER (PARTITION BY learner, ts ORDER BY exam) = 1)
SELECT *, CAST(row_number() OVER (PARTITION BY learner ORDER BY ts DESC) AS INTEGER) AS place FROM one QUALIFY place <= 50""",
)
def exam_history_top50(spark, sf):
    return P.exam_history(P.score_exams(B.exam_items(spark, sf)))


@register(
    "merge_progress",
    f"""WITH {ATTEMPTS}, {_progress_sql("a", "WHERE seq % 2 = 0")}, {_progress_sql("b", "WHERE seq % 2 = 1")}
SELECT coalesce(a.learner, b.learner) AS learner, coalesce(a.question, b.question) AS question,
  coalesce(a.seen, 0) + coalesce(b.seen, 0) AS seen, coalesce(a.correct, 0) + coalesce(b.correct, 0) AS correct, coalesce(a.wrong, 0) + coalesce(b.wrong, 0) AS wrong,
  greatest(a.last_ts, b.last_ts) AS last_ts, greatest(a.box, b.box) AS box, coalesce(a.fav, false) OR coalesce(b.fav, false) AS fav,
  (coalesce(a.wrong_flag, false) OR coalesce(b.wrong_flag, false)) AND (a.seen IS NULL OR b.seen IS NULL OR greatest(a.box, b.box) < 3) AS wrong_flag
FROM a FULL JOIN b ON a.learner = b.learner AND a.question = b.question""",
)
def merge_progress(spark, sf):
    a = B.attempts(spark, sf)
    return P.merge(P.fold(a.where("seq % 2 = 0")), P.fold(a.where("seq % 2 = 1")))


@register("merge_daily", f"WITH {ATTEMPTS}, {DAILY} SELECT * FROM daily")
def merge_daily(spark, sf):
    a = B.attempts(spark, sf)
    return P.merge_daily(P.daily(a.where("seq % 2 = 0")), P.daily(a.where("seq % 2 = 1")))


for _kind, _where in (("wrong", "bool_or(wrong_flag)"), ("fav", "bool_or(fav)"), ("review", f"bool_or(seen > 0 AND NOT {MASTERED})"), ("new", "NOT bool_or(seen > 0)")):
    _miss = "true" if _kind == "new" else "false"

    @register(f"scope_{_kind}", f"{PROGRESS}, {QUESTIONS}, p AS (SELECT question, {_where} AS take FROM progress GROUP BY question) SELECT q.* FROM questions q LEFT JOIN p USING (question) WHERE coalesce(take, {_miss})")
    def _scope(spark, sf, kind=_kind):
        return P.scope(B.questions(spark, sf), _progress(spark, sf), kind)


@register("next_question", f"{PROGRESS}, l AS (SELECT learner, arg_max(question, (last_ts, question)) AS last FROM progress WHERE last_ts IS NOT NULL GROUP BY learner) SELECT learner, last, (last + 1) % (SELECT count(*) FROM part) AS next FROM l")
def next_question(spark, sf):
    return P.next_after_last(_progress(spark, sf).where("last_ts IS NOT NULL"), B.questions(spark, sf))


@register(
    "active_time",
    f"""WITH {ATTEMPTS}, s AS (SELECT learner, ts, seq, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY learner ORDER BY ts, seq) AS step FROM attempts),
g AS (SELECT *, sum(CASE WHEN step <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY learner ORDER BY ts, seq) AS session FROM s)
SELECT learner, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(CASE WHEN step <= 1800 THEN step ELSE 0 END), 3) AS seconds FROM g GROUP BY learner, session""",
)
def active_time(spark, sf):
    return P.active_time(B.attempts(spark, sf)).withColumn("seconds", F.round("seconds", 3))


@register("exam_pool_dedupe")
def exam_pool_dedupe(spark, sf):
    q = B.questions(spark, sf)
    return folds.two_key_dedupe(q.select("question", "stem", "concept"), "question", "stem", "concept")


@register("seeded_shuffle")
def seeded_shuffle(spark, sf):
    return folds.seeded_shuffle(B.questions(spark, sf), "chapter", "question", 20261016)


@register("exam_sample")
def exam_sample(spark, sf):
    """Four questions of each type, a sampling operator."""
    return folds.sample_per_group(B.questions(spark, sf), "type", "question", 4, 7)


@register("page_window", "SELECT p_partkey AS question, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 100) AS BIGINT) AS page, p_brand AS chapter FROM part")
def page_window(spark, sf):
    rn = F.row_number().over(W.partitionBy("chapter").orderBy("question"))
    return B.questions(spark, sf).select("question", F.floor((rn - 1) / 100).cast("long").alias("page"), "chapter")


@register("chapter_counts", "SELECT p_brand AS chapter, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY p_brand")
def chapter_counts(spark, sf):
    return B.questions(spark, sf).groupBy("chapter").agg(F.count(F.lit(1)).alias("n"), F.min("question").alias("first_seen"))
