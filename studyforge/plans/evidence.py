"""Queries that find evidence for questions: bounded searches, the explanation ladder, pools, terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I
from ..operators import contrast, ladder, relevance, terms
from ..sources import bindings as B
from . import corpus as C
from .catalog import register

#: Words of a benchmark item from the a-th to the b-th; ITEM stands for the list of its words.
def _part(a, b):
    return f"array_join(slice(W, {a}, {b - a + 1}), ' ')"


#: Benchmark items seen as questions on their own text, in expressions that Spark reads; `_duck` makes them DuckDB's.
ITEMS = {
    "question": "item_id",
    "kind": "CASE item_id % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'multi' WHEN 2 THEN 'judge' WHEN 3 THEN 'fill' ELSE 'short' END",
    "stem": f"CASE WHEN item_id % 10 = 5 THEN '下列不属于' || {_part(1, 2)} || '的是 ' || {_part(3, 5)} WHEN item_id % 5 = 4 THEN {_part(1, 12)} ELSE {_part(1, 7)} || '____' END",
    "options": f"CASE WHEN item_id % 5 < 2 THEN ARR({_part(8, 9)}, {_part(5, 6)}, {_part(3, 4)}, CASE WHEN item_id % 10 = 5 THEN {_part(20, 23)} ELSE {_part(10, 12)} END) END",
    "letters": "CASE WHEN item_id % 10 = 5 THEN ARR('D') WHEN item_id % 5 = 0 THEN ARR('A') WHEN item_id % 5 = 1 THEN CASE item_id % 3 WHEN 0 THEN ARR('A', 'D') WHEN 1 THEN ARR('A', 'B', 'D') ELSE ARR('Z') END END",
    "answer": f"CASE WHEN item_id % 5 = 3 THEN {_part(6, 8)} END",
    "old": "CASE WHEN item_id % 7 = 3 THEN '原有解析' WHEN item_id % 11 = 5 THEN ' 人工校订：见讲义 ' END",
}


def _duck(e):
    return e.replace("array_join(slice(", "array_to_string(CUT(").replace("ARR(", "list_value(")


def questions(spark, sf):
    """Every benchmark item as a question, dealt over the chapters."""
    names = C._docs(spark, sf).agg(F.array_sort(F.collect_set("source")).alias("names"))
    items = B.table(spark, sf, "benchmark").withColumn("W", F.split("text", " ")).join(F.broadcast(names))
    chapter = F.get("names", F.pmod("item_id", F.greatest(F.size("names"), F.lit(1))).cast("int"))
    return items.select(*[F.expr(e.replace("ARR(", "array(")).alias(c) for c, e in ITEMS.items()], chapter.alias("chapter"))


QUOTED = T.PUNCTUATION.replace("'", "''")
NORM = f"regexp_replace(regexp_replace({{}}, '{QUOTED}', '', 'g'), '[\\s\\x{{{{3000}}}}]+', '', 'g')"
SQUEEZE = "regexp_replace({}, '[\\s\\x{{3000}}]+', '', 'g')"
KEY = f"regexp_replace({NORM}, '[和与及或、，,·的]', '', 'g')"
BASE = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '([\p{{L}}\p{{N}}]{{2,}})'))"
PAIRS = r"list_distinct(list_transform(range(1, greatest(len(regexp_extract_all(lower(coalesce({0}, '')), '([\p{{L}}\p{{N}}]{{2,}})')), 1)), lambda i: regexp_extract_all(lower(coalesce({0}, '')), '([\p{{L}}\p{{N}}]{{2,}})')[i] || ' ' || regexp_extract_all(lower(coalesce({0}, '')), '([\p{{L}}\p{{N}}]{{2,}})')[i + 1]))"
INDEX = f"""{C.PIECES},
u AS MATERIALIZED (SELECT doc_id * 100000 + pos AS unit, chapter, sentence, {BASE.format("sentence")} AS base, {PAIRS.format("sentence")} AS pairs FROM units),
post AS MATERIALIZED (SELECT unit, unnest(list_concat(base, pairs)) AS gram FROM u),
w AS MATERIALIZED (SELECT gram, hits, pow(1 + 60 * (hits / (SELECT count(*) FROM u)), CASE WHEN contains(gram, ' ') THEN -1.3 ELSE -1.6 END) AS weight FROM (SELECT gram, count(*) AS hits FROM post GROUP BY gram)),
names AS (SELECT list_sort(list(DISTINCT source)) AS names FROM documents WHERE text IS NOT NULL),
items AS (SELECT *, string_split(text, ' ') AS W FROM benchmark),
q0 AS MATERIALIZED (SELECT {", ".join(f"{_duck(e).replace('CUT(W, ', 'list_slice(W, ')} AS {c}" for c, e in ITEMS.items())}, (SELECT names[1 + items.item_id % len(names)] FROM names) AS chapter FROM items)"""


def _slices(sql):
    """DuckDB's list_slice takes the last place where Spark's slice takes a length."""
    import re

    return re.sub(r"list_slice\(W, (\d+), (\d+)\)", lambda m: f"W[{m[1]}:{int(m[1]) + int(m[2]) - 1}]", sql)


INDEX = _slices(INDEX)
SCORED = """round(CASE WHEN len(kw) = 0 THEN 0 ELSE list_sum(list_append(list_transform(list_filter(kw, lambda k: list_contains(u.base, k)), lambda k: 1 + least(length(k), 6) / 12.0), 0.0)) / greatest(len(kw), 1) * 0.62
  + len(list_intersect(kw, u.base)) / greatest(len(kw) + len(u.base) - len(list_intersect(kw, u.base)), 1) * 0.28 + CASE WHEN coalesce(u.chapter = chap, false) THEN 0.10 ELSE 0 END END, 9)"""
LONGEST = "coalesce(list_max(list_transform(range(1, length(a) + 1), lambda i: coalesce(list_max(list_transform(range(1, length(a) - i + 2), lambda n: CASE WHEN contains(b, substr(a, i, n)) THEN n ELSE 0 END)), 0))), 0)"
ASKS = f"regexp_matches(sentence, '{I.ASKS}')"

#: want(question, rung, text, least, stem, chap) to found(question, rung, unit, cover, fit, score, pool, rank).
FOUND = f"""wg AS MATERIALIZED (SELECT DISTINCT question, text, unnest(list_concat({BASE.format("text")}, {PAIRS.format("text")})) AS gram FROM want WHERE length({SQUEEZE.format("text")}) >= 2),
ww AS (SELECT wg.*, coalesce(weight, 0.05) AS weight FROM wg LEFT JOIN w USING (gram)),
whole AS (SELECT question, text, sum(weight) AS whole FROM ww GROUP BY question, text),
cov AS MATERIALIZED (SELECT question, text, unit, round(have / whole, 9) AS cover FROM (SELECT question, text, unit, sum(weight) AS have FROM ww JOIN post USING (gram) GROUP BY question, text, unit) JOIN whole USING (question, text)),
near AS MATERIALIZED (SELECT want.*, cov.unit, cov.cover, u.sentence, u.base, u.chapter, {KEY.format("text")} AS a, {KEY.format("sentence")} AS b, {BASE.format("stem")} AS kw, length({NORM.format("text")}) AS size
  FROM want JOIN cov USING (question, text) JOIN u USING (unit) WHERE cover >= least AND NOT {ASKS}),
fits AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0 ELSE round(least(1.0, {LONGEST} / length(a)), 9) END AS fit, {SCORED.replace("u.", "near.")} AS score FROM near),
found AS MATERIALIZED (SELECT question, rung, unit, cover, fit, score, CASE WHEN chap IS NULL OR chapter = chap THEN 0 ELSE 2 END AS pool,
  round(CASE WHEN size <= 6 THEN fit * 0.50 + cover * 0.22 + least(score, 1) * 0.28 ELSE fit * 0.38 + cover * 0.36 + least(score, 1) * 0.26 END, 6) AS rank FROM fits WHERE fit >= 0.5)"""
#: stems(question, stem, chap, least) to near_by(question, unit, score).
RELATED = f"""sk AS (SELECT *, {BASE.format("stem")} AS kw FROM stems),
met AS MATERIALIZED (SELECT DISTINCT question, unit FROM (SELECT question, unnest(kw) AS gram FROM sk) JOIN post USING (gram)),
told AS (SELECT DISTINCT question FROM met JOIN u USING (unit) JOIN sk USING (question) WHERE u.chapter = sk.chap),
near_by AS MATERIALIZED (SELECT * FROM (SELECT question, u.unit, least, {SCORED} AS score FROM met JOIN sk USING (question) JOIN u USING (unit) WHERE question NOT IN (SELECT question FROM told) OR u.chapter = sk.chap) WHERE score >= least)"""
#: Every item as one long answer.
ITEM_WANT = "want AS (SELECT item_id AS question, 0 AS rung, text, {} AS least, text AS stem, chapter AS chap FROM benchmark JOIN q0 ON item_id = question)"


def _index(spark, sf):
    return I.Index(C._units(spark, sf))


def _items(spark, sf, least):
    q = questions(spark, sf).select(F.col("question").alias("key"), "chapter")
    t = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("stem"), "text")
    return q.join(t, "key").withColumn("least", F.lit(least))


BEST = "best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY question ORDER BY pool, rank DESC, unit) = 1)"


@register("evidence_best", f"WITH {INDEX}, {ITEM_WANT.format(0.45)}, {FOUND}, {BEST} SELECT question AS query, unit, round(fit, 6) AS fit, round(cover, 6) AS cover, rank AS score FROM best")
def evidence_best(spark, sf):
    """The unit that supports each benchmark item best, its chapter's first."""
    best = _index(spark, sf).find(_items(spark, sf, 0.45))
    return best.select(F.col("key").alias("query"), "unit", F.round("fit", 6).alias("fit"), F.round("cover", 6).alias("cover"), F.col("rank").alias("score"))


@register("evidence_related", f"WITH {INDEX}, stems AS (SELECT item_id AS question, text AS stem, chapter AS chap, 0.3 AS least FROM benchmark JOIN q0 ON item_id = question), {RELATED} SELECT question AS query, unit, round(score, 6) AS score FROM near_by QUALIFY row_number() OVER (PARTITION BY question ORDER BY near_by.score DESC, unit) = 1")
def evidence_related(spark, sf):
    """The unit whose wording is nearest to each benchmark item."""
    from pyspark.sql import Window as W

    near = _index(spark, sf).related(_items(spark, sf, 0.3))
    first = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "unit"))
    return near.withColumn("_t", first).where("_t = 1").select(F.col("key").alias("query"), "unit", F.round("score", 6).alias("score"))


CHARS = "list_distinct(list_filter(string_split({}, ''), lambda x: x <> ''))"


@register(
    "evidence_screen",
    f"""WITH {INDEX}, {ITEM_WANT.format(0.45)}, {FOUND}, {BEST},
e AS (SELECT question AS query, {SQUEEZE.format("text")} AS a, {SQUEEZE.format("sentence")} AS b, {CHARS.format("text")} AS own, {CHARS.format("sentence")} AS other FROM best JOIN benchmark ON item_id = question JOIN u USING (unit)),
r AS (SELECT query, {LONGEST} AS run, len(list_intersect(own, other)) / len(own) AS cover FROM e)
SELECT query, CAST(run AS INTEGER) AS run, round(cover, 6) AS cover, run >= 4 OR cover >= 0.55 AS keep FROM r""",
)
def evidence_screen(spark, sf):
    """Whether the best unit of each benchmark item shares a run or most characters with it."""
    from ..operators import retrieval
    from ..operators.folds import stored
    from ..operators.matching import beside

    i, items = _index(spark, sf), _items(spark, sf, 0.45)
    # the best units are few, so they are sent to the units' texts
    best = beside(stored(i.find(items).select("key", "unit"), "screen-best"), i.units.select("unit", "sentence")).join(items.select("key", "text"), "key")
    return retrieval.screen(best.select(F.col("key").alias("query"), F.col("text").alias("answer"), "sentence")).select("query", "run", F.round("cover", 6).alias("cover"), "keep")


@register(
    "evidence_top",
    f"""WITH {INDEX}, {ITEM_WANT.format(0)}, wg AS (SELECT DISTINCT question, unnest(list_concat({BASE.format("text")}, {PAIRS.format("text")})) AS gram FROM want),
ww AS (SELECT wg.*, coalesce(weight, 0.05) AS weight FROM wg LEFT JOIN w USING (gram)), whole AS (SELECT question, sum(weight) AS whole FROM ww GROUP BY question),
cov AS (SELECT question, unit, round(have / whole, 9) AS cover FROM (SELECT question, unit, sum(weight) AS have FROM ww JOIN post USING (gram) GROUP BY question, unit) JOIN whole USING (question))
SELECT question AS query, unit, round(cover, 6) AS cover, CAST(row_number() OVER (PARTITION BY question ORDER BY cov.cover DESC, unit) AS INTEGER) AS place FROM cov QUALIFY place <= 40""",
)
def evidence_top(spark, sf):
    """The forty units that cover each benchmark item best, found by score bounds."""
    top = _index(spark, sf).top(_items(spark, sf, 0.0).select("key", "text"), 40)
    return top.select(F.col("key").alias("query"), "unit", F.round("cover", 6).alias("cover"), "place")


def _clip(text, need):
    t, n = f"({text})", f"({need})"
    at = f"(CASE WHEN strpos({t}, {n}) > 0 THEN strpos({t}, {n}) ELSE strpos({SQUEEZE.format(t)}, {SQUEEZE.format(n)}) END - 1)"
    a, z = f"greatest({at} - 53, 0)", f"least(length({t}), {at} + length({n}) + 106)"
    return f"CASE WHEN {at} < 0 THEN substr({t}, 1, 160) || CASE WHEN length({t}) > 160 THEN '…' ELSE '' END ELSE CASE WHEN {a} > 0 THEN '…' ELSE '' END || trim(substr({t}, {a} + 1, {z} - {a}), E' \\n\\t\\r') || CASE WHEN {z} < length({t}) THEN '…' ELSE '' END END"


def _pick(need):
    # units end at the first stop, so a unit is one part
    n = f"({need})"
    return f"CASE WHEN {SQUEEZE.format(n)} <> '' AND contains({SQUEEZE.format('sentence')}, {SQUEEZE.format(n)}) AND length(sentence) <= 160 THEN trim(sentence, E' \\n\\t\\r') ELSE {_clip('sentence', need)} END"


LADDER = f"""WITH {INDEX},
q AS MATERIALIZED (SELECT * REPLACE (coalesce(trim(old), '') AS old, coalesce(options, []) AS options, coalesce(letters, []) AS letters, coalesce(answer, '') AS answer), regexp_replace(stem, '[_＿]{{2,}}', ' ', 'g') AS clear,
  list_transform(list_filter(coalesce(letters, []), lambda l: l <= 'D'), lambda l: options[ascii(l) - 64]) AS chosen, regexp_extract(stem, '不属于(.{{2,20}}?)的是', 1) AS concept FROM q0),
q2 AS MATERIALIZED (SELECT *, coalesce(chosen[1], '') AS correct, array_to_string(chosen, ' ') AS combined,
  list_transform(list_sort(list_transform(range(1, len(chosen) + 1), lambda i: {{'n': -length(chosen[i]), 'i': i, 'o': chosen[i]}})), lambda s: s.o)[1:2] AS keys,
  kind IN ('judge', 'fill') AND old <> '' AND NOT regexp_matches(old, '人工校订|人工修正') AS kept FROM q),
want AS MATERIALIZED (
  SELECT question, rung, text, least, clear AS stem, chapter AS chap FROM (
    SELECT *, 2 AS rung, CASE kind WHEN 'single' THEN correct WHEN 'multi' THEN combined ELSE answer END AS text, 0.45 AS least FROM q2 WHERE kind = 'single' OR (kind = 'multi' AND length(combined) >= 8) OR (kind = 'fill' AND length(answer) BETWEEN 2 AND 30)
    UNION ALL SELECT *, 3, combined, 0.34 FROM q2 WHERE kind = 'multi' AND length(combined) > 14
    UNION ALL SELECT *, 4, keys[1], 0.55 FROM q2 WHERE kind = 'multi' AND length(combined) >= 8
    UNION ALL SELECT *, 5, keys[2], 0.55 FROM q2 WHERE kind = 'multi' AND length(combined) >= 8 AND len(keys) > 1) WHERE NOT kept),
{FOUND},
stems AS (SELECT question, CASE WHEN kind = 'short' THEN stem ELSE clear END AS stem, chapter AS chap, CASE kind WHEN 'short' THEN 0.58 WHEN 'judge' THEN 0.5 ELSE 0.45 END AS least FROM q2 WHERE kind <> 'fill' AND NOT kept AND NOT (kind = 'multi' AND length(combined) < 8)),
{RELATED},
neg AS (SELECT *, list_filter(list_transform(list_filter(list_zip(options, range(1, len(options) + 1)), lambda z: z[2] <> ascii(letters[1]) - 64), lambda z: {SQUEEZE.format("z[1]")}), lambda o: o <> '') AS others,
  list_filter({BASE.format("CASE WHEN concept <> '' THEN concept ELSE stem END")}, lambda k: length(k) >= 3) AS named, {BASE.format("stem")} AS kw, chapter AS chap FROM q2 WHERE kind = 'single' AND regexp_matches(stem, '不属于|不包括|不正确|错误的是|有误的是|不是.*的是|以下不是|不列入')),
nr AS (SELECT question, u.unit, len(list_filter(list_distinct(others), lambda o: contains({SQUEEZE.format("u.sentence")}, o))) AS listed, len(list_filter(others, lambda o: contains({SQUEEZE.format("u.sentence")}, o))) AS counted,
  1.4 * len(list_filter(named, lambda k: list_contains(u.base, k))) + 0.5 * least({SCORED}, 1) - CASE WHEN {SQUEEZE.format("correct")} <> '' AND contains({SQUEEZE.format("u.sentence")}, {SQUEEZE.format("correct")}) THEN 2 ELSE 0 END AS more
  FROM neg, u WHERE NOT {ASKS.replace("sentence", "u.sentence")} AND NOT (contains(substr(u.sentence, 1, 6), '不') AND contains(u.sentence, correct))),
rows AS (SELECT question, rung, pool, rank, unit FROM found UNION ALL SELECT question, 6, 0, score, unit FROM near_by UNION ALL SELECT question, 1, 0, round(counted + more, 6), unit FROM nr WHERE counted >= 2 AND round(counted + more, 6) >= 3),
best AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY question ORDER BY rung, pool, rank DESC, unit) = 1),
f AS (SELECT q2.*, CASE WHEN kept THEN 0 WHEN kind = 'short' AND (b.rung IS NULL OR {ASKS}) THEN 7 ELSE coalesce(b.rung, 8) END AS r, b.unit, sentence, u.chapter AS own FROM q2 LEFT JOIN best b USING (question) LEFT JOIN u USING (unit)),
g AS (SELECT * REPLACE (CASE WHEN r IN (0, 7) THEN NULL ELSE unit END AS unit), '正确答案：' || array_to_string(letters, '、') || '（' || array_to_string(chosen, '；') || '）。' AS head, substr(sentence, 1, 150) AS lead150, r <> 0 AND regexp_matches(old, '人工校订|人工修正') AS manual FROM f),
t AS (SELECT *, CASE WHEN r = 0 THEN old WHEN r = 1 THEN '正确答案：' || correct || '（' || CASE WHEN concept <> '' THEN concept ELSE '该概念' END || '的组成项不含它）。依据：' || lead150
  WHEN kind = 'single' AND r = 2 THEN CASE WHEN starts_with({SQUEEZE.format(f"({_pick('correct')})")}, {SQUEEZE.format("correct")}) THEN {_pick('correct')} ELSE correct || ' — ' || {_pick('correct')} END
  WHEN kind = 'single' AND r = 6 THEN '正确答案：' || correct || '。相关表述：' || CASE WHEN contains({SQUEEZE.format("sentence")}, {SQUEEZE.format("correct")}) THEN {_clip('sentence', 'correct')} ELSE lead150 END
  WHEN kind = 'single' THEN '正确答案：' || correct || '。本题库未收录教材中的直接出处，可结合「' || coalesce(chapter, '本课程') || '」相关内容理解。'
  WHEN kind = 'multi' AND len(chosen) = 0 THEN '{ladder.SAYS["multi_unread"]}' WHEN kind = 'multi' AND length(combined) < 8 THEN head || '{ladder.SAYS["multi_brief"]}'
  WHEN kind = 'multi' AND r = 6 THEN head || '相关表述：' || lead150 WHEN kind = 'multi' AND r = 8 THEN head || '{ladder.SAYS["multi_none"]}' WHEN kind = 'multi' THEN head || {_pick("CASE r WHEN 4 THEN keys[1] WHEN 5 THEN keys[2] ELSE correct END")}
  WHEN kind = 'short' THEN CASE WHEN r = 6 THEN '{ladder.SAYS["short"]}' || lead150 ELSE '{ladder.SAYS["bank"]}' END WHEN kind = 'judge' THEN CASE WHEN r = 6 THEN '依据：' || lead150 ELSE '{ladder.SAYS["judge_none"]}' END
  WHEN r = 2 THEN '正确答案：' || answer || '。' || {_pick('answer')} ELSE '正确答案：' || answer || '。' END AS body FROM g)
SELECT question, kind, {list(ladder.RUNGS)}[r + 1] AS rung, unit, CASE WHEN manual THEN old || '　' || body ELSE body END AS text, CASE WHEN manual THEN 'manual' WHEN r IN (0, 7) THEN 'bank' WHEN unit IS NOT NULL THEN 'textbook' ELSE 'template' END AS source, CASE WHEN unit IS NOT NULL THEN own ELSE '' END AS ref FROM t"""


@register("explain_ladder", LADDER)
def explain_ladder(spark, sf):
    """The explanation of every benchmark question, by the strongest evidence that any unit gives it."""
    return ladder.explain(questions(spark, sf), _index(spark, sf), glue=" ")


#: Benchmark items as questions whose evidence is chosen again.
AGAIN = {
    "question": "item_id",
    "stem": f"{_part(1, 6)} || '____'",
    "answer": f"CASE WHEN item_id % 5 = 2 THEN '' ELSE {_part(7, 8)} || '、' || {_part(9, 11)} END",
    "reason": f"CASE item_id % 3 WHEN 0 THEN '旧的依据' WHEN 1 THEN ' ' END",
}
HOLD = "regexp_replace({}, '[^\\x{{4e00}}-\\x{{9fff}}0-9A-Za-z%]', '', 'g')"


def _share(a, b):
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len({a}), 0), 0.0)"


COVER = f"""wg AS (SELECT DISTINCT key, text, unnest(list_concat({BASE.format("text")}, {PAIRS.format("text")})) AS gram FROM texts),
ww AS MATERIALIZED (SELECT wg.*, coalesce(weight, 0.05) AS weight FROM wg LEFT JOIN w USING (gram)), whole AS (SELECT key, text, sum(weight) AS whole FROM ww GROUP BY key, text),
cov AS MATERIALIZED (SELECT key, text, unit, round(have / whole, 9) AS cover FROM (SELECT key, text, unit, sum(weight) AS have FROM ww JOIN post USING (gram) GROUP BY key, text, unit) JOIN whole USING (key, text))"""


@register(
    "evidence_reselect",
    f"""WITH {INDEX}, a0 AS (SELECT {_slices(", ".join(f"{_duck(e).replace('CUT(W, ', 'list_slice(W, ')} AS {c}" for c, e in AGAIN.items()))} FROM items),
a AS MATERIALIZED (SELECT question, trim(regexp_replace(stem, '[_＿]{{2,}}', ' ', 'g')) AS stem, answer, coalesce(trim(reason), '') AS reason FROM a0),
texts AS (SELECT question AS key, stem AS text FROM a UNION ALL SELECT question, answer FROM a WHERE answer <> ''), {COVER},
pool AS (SELECT key, unit, row_number() OVER (PARTITION BY key ORDER BY cover DESC, unit) AS place FROM cov JOIN a ON key = question AND text = answer QUALIFY place <= 400),
p AS (SELECT *, list_filter(list_transform(string_split_regex(answer, '[、，,；;和与及/]+'), lambda x: {HOLD.format("x")}), lambda x: length(x) >= 2) AS parts,
  list_distinct(regexp_extract_all(stem, '([A-Za-z]{{2,}}|\\d+(?:\\.\\d+)?)')) AS words FROM a),
p2 AS (SELECT *, list_filter(words, lambda t: length(t) >= 2) AS terms, coalesce(list_sort(list_transform(range(1, len(parts) + 1), lambda i: {{'n': -length(parts[i]), 'i': i, 'p': parts[i]}}))[1].p, {HOLD.format("answer")}) AS phrase,
  list_filter(list_transform(list_filter(string_split_regex(answer, '[，。；、（）()：:？！]'), lambda x: length(trim(x)) >= 2), lambda x: {CHARS.format(HOLD.format("x"))}), lambda s: len(s) >= 2) AS sets, len(list_filter(string_split_regex(answer, '[，。；、（）()：:？！]'), lambda x: length(trim(x)) >= 2)) AS n_sets FROM p),
n AS (SELECT p2.*, cov.unit, cov.cover, pool.place, sentence, {SQUEEZE.format("sentence")} AS sq, {CHARS.format(HOLD.format("sentence"))} AS chars,
  list_transform(list_filter(string_split_regex(sentence, '[，。；、（）()：:？！]'), lambda x: length({SQUEEZE.format("x")}) >= 3), lambda x: {CHARS.format(HOLD.format("x"))}) AS clauses
  FROM p2 JOIN cov ON key = question AND text = stem AND cover >= 0.2 JOIN u USING (unit) LEFT JOIN pool ON pool.key = question AND pool.unit = cov.unit),
ok AS (SELECT *, terms[1:10] AS ten, len(list_filter(terms, lambda t: contains(sq, t))) AS hit, strpos(sq, phrase) AS spot FROM n WHERE NOT regexp_matches(sentence, '([^。？?]{{4,30}}[?？]){{2,}}|[?？]\\s*$')),
ok2 AS (SELECT *, list_filter(ten, lambda t: contains(sq, t)) AS have, len(list_filter(ten, lambda t: contains(substr(sq, greatest(spot - 14, 1), spot + length(phrase) + 14 - greatest(spot - 14, 1)), t))) AS close,
  coalesce(list_max(list_transform(parts, lambda x: {_share(CHARS.format("x"), "chars")})), 0) AS best_part, length(phrase) >= 2 AND {_share(CHARS.format("phrase"), "chars")} >= 0.8 AS literal FROM ok
  WHERE (len(terms) = 0 OR (hit > 0 AND (hit / len(terms) >= 0.34 OR hit >= 2))) AND (n_sets = 0 OR len(list_filter(clauses, lambda c: len(list_filter(sets, lambda s: {_share("s", "c")} >= 0.6)) > 0)) > 0)),
s AS (SELECT *, round((CASE WHEN answer = '' OR best_part > 0 THEN CASE WHEN answer = '' THEN 1 ELSE best_part END WHEN {HOLD.format("answer")} = '' THEN 1 ELSE {_share(CHARS.format(HOLD.format("answer")), "chars")} END) * 0.45 + CASE WHEN literal THEN 0.30 ELSE 0 END + cover * 0.25
  + CASE WHEN regexp_matches(sentence, '{relevance.DEFINITION}') THEN 0.12 ELSE 0 END + 0.90 * CASE WHEN length(sq) = 0 OR phrase = '' THEN 0 WHEN spot = 0 THEN CASE WHEN len(have) > 0 THEN 0.4 ELSE 0 END WHEN close >= 2 THEN 1 WHEN close = 1 THEN 0.6 ELSE 0 END, 6) AS score FROM ok2 WHERE len(ten) = 0 OR len(have) > 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question ORDER BY s.score DESC, CASE WHEN place IS NULL THEN 2 WHEN literal THEN 0 ELSE 1 END, place, unit) = 1)
SELECT a.question, CASE WHEN b.score >= 0.62 THEN b.unit END AS unit, CASE WHEN b.score >= 0.62 THEN b.score END AS score,
  CASE WHEN b.score >= 0.62 THEN CASE WHEN a.reason = '' THEN 'filled' ELSE 'replaced' END WHEN a.reason <> '' THEN 'dropped' ELSE 'none' END AS action FROM a LEFT JOIN b USING (question)""",
)
def evidence_reselect(spark, sf):
    """The unit that each benchmark question's explanation is to rest on, by topic, answer and stem."""
    q = B.table(spark, sf, "benchmark").withColumn("W", F.split("text", " ")).select(*[F.expr(e).alias(c) for c, e in AGAIN.items()])
    return relevance.reselect(q, _index(spark, sf)).drop("new_reason")


ASKED = {
    "question": "item_id",
    "kind": "CASE WHEN item_id % 6 = 5 THEN 'judge' ELSE 'single' END",
    "stem": f"CASE WHEN item_id % 4 = 1 THEN '不属于' ELSE '' END || {_part(1, 5)}",
    "options": f"ARR({_part(6, 7)}, {_part(8, 10)}, {_part(11, 11)}, {_part(18, 22)})",
    "letters": "CASE item_id % 3 WHEN 0 THEN ARR('A') WHEN 1 THEN ARR('B', 'C') ELSE ARR('D') END",
}
AUDIT = "regexp_replace(regexp_replace(translate({}, '（），。', '(),.'), '[\\x{{0}}-\\x{{1f}}]', '', 'g'), '[\\s\\x{{3000}}]+', '', 'g')"


@register(
    "textbook_verdicts",
    f"""WITH {INDEX}, a AS MATERIALIZED (SELECT {_slices(", ".join(f"{_duck(e).replace('CUT(W, ', 'list_slice(W, ')} AS {c}" for c, e in ASKED.items()))} FROM items),
p1 AS (SELECT question, unit, row_number() OVER (PARTITION BY question ORDER BY count(*) DESC, unit) AS place FROM (SELECT question, unnest({BASE.format("stem")}) AS gram FROM a) JOIN post USING (gram) GROUP BY question, unit QUALIFY place <= 40),
p2 AS (SELECT DISTINCT question, unit FROM (SELECT question, unnest({BASE.format("array_to_string(options, ' ')")}) AS gram FROM a) JOIN post USING (gram) ANTI JOIN p1 USING (question, unit)),
pool AS (SELECT question, unit, row_number() OVER (PARTITION BY question ORDER BY list_no, unit) AS place FROM (SELECT question, unit, place AS list_no FROM p1 UNION ALL SELECT question, unit, 1000 FROM p2) QUALIFY place <= 80),
o AS (SELECT question, i, options[i] AS option, list_contains(letters, chr(CAST(64 + i AS INTEGER))) AS ok FROM a, LATERAL (SELECT unnest(range(1, len(options) + 1)) AS i)),
x AS (SELECT o.*, pool.unit, pool.place, doc_id % 2 = 0 AS main, {AUDIT.format("option")} AS a, {AUDIT.format("sentence")} AS b FROM o LEFT JOIN pool USING (question) LEFT JOIN (SELECT *, CAST(floor(unit / 100000) AS BIGINT) AS doc_id FROM u) USING (unit)),
c AS (SELECT *, round(CASE WHEN a = '' THEN 0 WHEN length(a) < 3 THEN CASE WHEN regexp_matches(b, '(^|[^0-9A-Za-z])' || a || '($|[^0-9A-Za-z])') THEN 1 ELSE 0 END ELSE (CASE WHEN {LONGEST} >= 3 THEN {LONGEST} ELSE 0 END) / length(a) END, 3) AS score FROM x),
m AS (SELECT question, i, ok, coalesce(max(score), 0.0) AS score, arg_max(main, {{'s': score, 'p': -place}}) AS main, count(unit) AS n FROM c GROUP BY question, i, ok),
g AS (SELECT question, coalesce(min(score) FILTER (ok), 0.0) AS ans_min, round(coalesce(avg(score) FILTER (ok), 0.0), 6) AS ans_avg, coalesce(max(score) FILTER (NOT ok), 0.0) AS dis_max, coalesce(bool_or(score > 0 AND main) FILTER (ok), false) AS main, max(n) AS pool FROM m GROUP BY question)
SELECT question, CASE WHEN pool = 0 OR (ans_avg = 0 AND dis_max = 0) THEN 'no_corpus_evidence' WHEN (kind <> 'judge' AND contains(stem, '不属于') AND ans_min >= 0.5) OR (dis_max >= 0.6 AND round(dis_max - ans_min, 6) >= 0.25) THEN 'suspect_answer'
  WHEN NOT main AND ans_avg > 0 THEN 'consistent_secondary' ELSE 'consistent' END AS verdict, ans_min, ans_avg, dis_max, pool FROM g JOIN a USING (question)""",
)
def textbook_verdicts(spark, sf):
    """Whether the corpus bears out the answer of each benchmark question; units of even documents are the first source."""
    q = B.table(spark, sf, "benchmark").withColumn("W", F.split("text", " ")).select(*[F.expr(e.replace("ARR(", "array(")).alias(c) for c, e in ASKED.items()])
    return relevance.verdicts(q, _index(spark, sf), F.floor(F.col("unit") / 100000) % 2 == 0)


#: Scopes and the words around them in the test corpus.
SCOPES_EN, OF_EN, WORD_EN, ENDS_EN = ["the", "that", "with", "from", "for"], "[a-z, ]{0,20}? (?:of|in|and) ", "([a-z]{2,12})", "(ing|ion|ent)$"


@register(
    "distractor_contrast",
    f"""WITH {C.PIECES}, u AS (SELECT doc_id * 100000 + pos AS unit, sentence FROM units),
m AS (SELECT unit, k, ms[k] AS m FROM (SELECT unit, regexp_extract_all(sentence, '({"|".join(SCOPES_EN)}){OF_EN}{WORD_EN}') AS ms FROM u), LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS k)),
pairs AS MATERIALIZED (SELECT unit, concept, arg_min(scope, k) AS scope FROM (SELECT unit, k, regexp_extract(m, '({"|".join(SCOPES_EN)}){OF_EN}{WORD_EN}', 1) AS scope, regexp_extract(m, '({"|".join(SCOPES_EN)}){OF_EN}{WORD_EN}', 2) AS concept FROM m) GROUP BY unit, concept),
a AS MATERIALIZED (SELECT item_id AS question, text AS stem, list_distinct(regexp_extract_all(text, '[a-z]{{2,12}}')) AS opts FROM benchmark),
o AS MATERIALIZED (SELECT question, stem, k AS i, list_sort(opts)[k + 1] AS option, regexp_replace(list_sort(opts)[k + 1], '{ENDS_EN}', '') AS core, k % 4 = 0 AS ok FROM a, LATERAL (SELECT unnest(range(0, least(len(opts), 8))) AS k)),
s AS (SELECT question, i, unit, arg_min(scope, r) AS scope FROM (SELECT question, i, unit, scope, 0 AS r FROM o JOIN pairs ON concept = option UNION ALL SELECT question, i, unit, scope, 1 FROM o JOIN pairs ON concept = core) GROUP BY question, i, unit),
met AS (SELECT o.*, s.unit, s.scope, sentence FROM o JOIN s USING (question, i) JOIN u USING (unit) WHERE contains(sentence, option) OR contains(sentence, core)),
b AS (SELECT w.question, w.i, w.unit, arg_min({{'o': t.option, 's': t.scope}}, t.i) AS r FROM met w JOIN met t ON w.question = t.question AND w.unit = t.unit AND NOT w.ok AND t.ok AND w.option <> t.option AND contains(t.sentence, t.option) AND w.scope <> t.scope GROUP BY w.question, w.i, w.unit),
d AS (SELECT met.*, r FROM met LEFT JOIN b USING (question, i, unit) WHERE NOT ok AND (r IS NOT NULL OR NOT contains(stem, scope)) QUALIFY row_number() OVER (PARTITION BY question, i ORDER BY unit) = 1)
SELECT o.question, CAST(o.i AS INTEGER) AS i, CASE WHEN d.unit IS NULL THEN 'pending' WHEN r IS NULL THEN 'scope' ELSE 'contrast' END AS kind, d.unit, d.scope, r.o AS right_option, r.s AS right_scope FROM o LEFT JOIN d USING (question, i) WHERE NOT o.ok""",
)
def distractor_contrast(spark, sf):
    """What each wrong option of the benchmark questions belongs to, by scope pairs in the corpus."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{2,12})"))))
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("stem"), F.slice(words, 1, 8).alias("options"))
    every = F.array(*[F.lit(x) for x in "ABCDEFGH"])
    q = q.withColumns({"letters": F.filter(every, lambda x: ((F.ascii(x) - 65) % 4 == 0) & (F.ascii(x) - 65 < F.size("options"))), "why": F.map_from_arrays(every, F.array_repeat(F.lit(contrast.TEMPLATES[0]), 8))})
    return contrast.contrasts(q, C._units(spark, sf).select("unit", "sentence"), SCOPES_EN, contrast.TEMPLATES, ENDS_EN, OF_EN, WORD_EN).drop("text")


@register(
    "ordered_keys",
    """WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark), k AS (SELECT item_id * 1000 + i AS place, w[i] || ' ' || w[i + 1] AS term FROM w, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
t AS (SELECT term, min(place) AS place FROM k GROUP BY term) SELECT doc_id AS id, CAST(min(place) AS BIGINT) AS place FROM documents JOIN t ON contains(lower(text), term) GROUP BY doc_id""",
)
def ordered_keys(spark, sf):
    """The first pair of words, in the order of all benchmark items, that each document contains."""
    w = B.table(spark, sf, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w"))
    pairs = w.select("item_id", F.posexplode(F.slice("w", 1, F.size("w") - 1)).alias("i", "a"), "w")
    keys = pairs.select((F.col("item_id") * 1000 + F.col("i") + 1).alias("place"), F.concat("a", F.lit(" "), F.get("w", F.col("i") + 1)).alias("term"))
    return terms.first_key(B.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")), keys, "doc_id", "text")


@register(
    "corpus_term_counts",
    r"""WITH c AS (SELECT string_agg(lower(coalesce(text, '')), '' ORDER BY doc_id) AS t FROM documents), k AS (SELECT DISTINCT unnest(list_concat(regexp_extract_all(lower(text), '[\p{L}]{2,}'), regexp_extract_all(lower(text), '[\p{L}][.] ?[\p{L}]'))) AS term FROM benchmark)
SELECT term, CAST((length(t) - length(replace(t, term, ''))) / length(term) AS BIGINT) AS n FROM k, c""",
)
def corpus_term_counts(spark, sf):
    """Occurrences of every benchmark word in the documents written one after the other, across their borders too."""
    low = F.lower("text")
    words = F.concat(F.regexp_extract_all(low, F.lit(r"([\p{L}]{2,})")), F.regexp_extract_all(low, F.lit(r"([\p{L}][.] ?[\p{L}])")))
    keys = B.table(spark, sf, "benchmark").select(F.explode(words).alias("term"))
    return terms.whole_counts(B.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")), keys, "doc_id", "text")
