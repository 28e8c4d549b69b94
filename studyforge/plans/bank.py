"""Queries on a question bank: consistency, ingest checks and gates, notes, web evidence, exam merging."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import predicates as Q
from ..operators import bank_audit as A
from ..operators import progress as P
from ..operators import upsert
from ..sources import bindings as B
from .catalog import ORACLES, register
from .texts import evidence_sql

#: The parts seen as bank rows, in expressions that Spark and DuckDB both read; ARR stands for the list constructor.
FIELDS = {
    "id": "'q-' || lpad(cast(p_partkey AS string), 8, '0')",
    "num": "cast(floor(p_partkey / 2) + floor(p_partkey / 40) AS bigint)",
    "type": "CASE p_partkey % 7 WHEN 0 THEN 'single' WHEN 1 THEN 'multi' WHEN 2 THEN 'judge' WHEN 3 THEN 'fill' WHEN 4 THEN 'short' WHEN 5 THEN 'multi' ELSE CASE WHEN p_partkey % 5 = 0 THEN 'essay' ELSE 'single' END END",
    "stem": "CASE WHEN p_partkey % 11 = 0 THEN '下列不属于 ' || p_type || ' 的是' WHEN p_partkey % 11 = 1 THEN p_name || '____' WHEN p_partkey % 11 = 2 THEN '　\t' ELSE p_name || ' ' || p_type END",
    "options": "CASE WHEN p_partkey % 7 IN (0, 1, 5, 6) THEN CASE p_partkey % 4 WHEN 0 THEN ARR(p_type || CASE WHEN p_partkey % 8 = 0 THEN '　' ELSE '' END, 'old') WHEN 1 THEN ARR(p_type, 'old', p_brand) WHEN 2 THEN ARR(p_type, 'new', 'old', 'more') ELSE ARR(p_type, CASE WHEN p_partkey % 3 = 0 THEN '\t' ELSE '　\n' END, 'old') END END",
    "letters": "CASE WHEN p_partkey % 7 IN (0, 1, 5, 6) THEN regexp_extract_all(substr('ABCDBADAACEAB', cast(1 + p_size % 10 AS int), cast(1 + p_size % 3 AS int)), '[A-Z]', 0) END",
    "flag": "CASE WHEN p_partkey % 7 = 2 AND p_partkey % 5 <> 0 THEN p_size % 2 = 0 END",
    "answer": "CASE WHEN p_partkey % 7 IN (3, 4) THEN p_type END",
    "explanation": "CASE p_partkey % 8 WHEN 0 THEN '\n　' WHEN 1 THEN '正确答案：' || substr('ABCD', cast(1 + p_size % 4 AS int), 1) || '、C4ISR系统' WHEN 2 THEN p_name || '。正确选项是 A/B' WHEN 3 THEN '答案AB，正确答案:A' ELSE '解析；正确答案：C，D-2' END",
    "part_answer": "CASE p_partkey % 5 WHEN 0 THEN 'A（' || p_type || '）' WHEN 1 THEN 'A、B（old）' WHEN 2 THEN 'B；C、new' WHEN 3 THEN ' B(none of these) ' ELSE 'D' END",
    "part_note": "CASE WHEN p_partkey % 9 = 0 THEN '；正确答案：D' END",
    "why_keys": "CASE p_partkey % 3 WHEN 0 THEN ARR('A', 'C') WHEN 1 THEN ARR('B') ELSE ARR('H') END",
    "why_texts": "CASE p_partkey % 3 WHEN 0 THEN ARR('与正确项 B/C 不同', '属于' || p_type) WHEN 1 THEN ARR('与正确项A相反') ELSE ARR(' ') END",
    "chapter": "p_brand",
    "section": "CASE WHEN p_partkey % 17 = 0 THEN '　\n' WHEN p_partkey % 17 = 1 THEN NULL ELSE p_type END",
    "src": "CASE p_partkey % 7 WHEN 0 THEN 'web' WHEN 1 THEN 'textbook' WHEN 2 THEN 'manual' WHEN 3 THEN 'bank' WHEN 4 THEN 'template' WHEN 5 THEN 'blog' ELSE 'web' END",
    "ref": "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'p. 3' END",
    "source": "CASE WHEN p_partkey % 23 <> 1 THEN p_brand END",
    "key_concept": "CASE WHEN p_partkey % 29 <> 2 THEN p_type END",
    "keywords": "CASE WHEN p_partkey % 31 <> 3 THEN ARR(p_type) END",
    "hard": "CASE WHEN p_partkey % 19 <> 0 THEN p_size >= 40 END",
}
#: What counts as white space at a text's ends.
BLANKS = " \t\n\r\f\v\u00a0　"


def _trims(sql: str) -> str:
    """SQL whose trim and rtrim take off white space of any kind."""
    ends = []
    for m in re.finditer(r"\br?trim\(", sql):
        depth, k = 1, m.end()
        while depth:
            depth += (sql[k] == "(") - (sql[k] == ")")
            k += 1
        ends.append(k - 1)
    for k in sorted(ends, reverse=True):
        sql = sql[:k] + f", '{BLANKS}'" + sql[k:]
    return sql


CHAPTERS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#11", "Brand#12", "Brand#13"]


def bank(spark, sf):
    """Every part as a bank row."""
    p = B.table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("key"), *[F.expr(e.replace("ARR(", "array(")).alias(c) for c, e in FIELDS.items()])
    return rows.withColumn("why", F.map_from_arrays("why_keys", "why_texts")).drop("why_keys", "why_texts")


BANK = "bank AS (SELECT p_partkey AS key, " + ", ".join(f"{e.replace('ARR(', 'list_value(')} AS {c}" for c, e in FIELDS.items()) + " FROM part)"
PREPARED = f"""WITH {BANK}, b AS (
  SELECT *, type IN ('single', 'multi') AS obj, coalesce(options, []) AS opts, len(coalesce(options, [])) AS n,
    CASE WHEN type IN ('single', 'multi') THEN list_sort(list_distinct(coalesce(letters, []))) ELSE [] END AS ans FROM bank)"""
SHOWN = r"list_filter(string_split(substr('ABCDEFGH', 1, CAST(n AS INTEGER)), ''), lambda c: c <> '' AND (regexp_matches(part_answer, c || '\s*[、,，/；;（(]') OR ends_with(rtrim(part_answer), c)))"
FORE = r"regexp_replace(coalesce(explanation, '') || chr(10) || coalesce(part_note, ''), '[A-H]([A-Za-z0-9—-])', '#\1', 'g')"


@register(
    "bank_consistency",
    rf"""{PREPARED}, c AS (
  SELECT *, {SHOWN} AS shown, trim(part_answer) AS head,
    string_split(array_to_string(regexp_extract_all({FORE}, '(?:^|[\n。；;])\s*(?:正确答案[:：]|正确选项是)\s*([A-H](?:\s*[、,，/]\s*[A-H])*)', 1), ''), '') AS told FROM b),
d AS (SELECT *, regexp_extract(head, '^([A-H])\s*[（(](.+?)[）)]\s*$', 1) AS letter, trim(regexp_extract(head, '^([A-H])\s*[（(](.+?)[）)]\s*$', 2)) AS claim FROM c),
w AS (SELECT id, ans, why_keys[i] AS k, regexp_extract_all(regexp_extract(why_texts[i], '与正确项\s*([A-H](?:\s*/\s*[A-H])*)', 1), '[A-H]') AS refs FROM b, LATERAL (SELECT unnest(range(1, len(why_keys) + 1)) AS i)),
s AS (SELECT id, type, ans, regexp_replace(coalesce(stem, ''), '[^\x{{4e00}}-\x{{9fff}}A-Za-z0-9]', '', 'g') AS stem, list_sort(list_transform(opts, lambda o: trim(o))) AS o FROM b),
f AS (
  SELECT 'R1' AS rule, id, 1 AS n FROM b WHERE obj AND len(list_filter(ans, lambda c: instr('ABCDEFGH', c) > n)) > 0
  UNION ALL SELECT 'R2', id, 1 FROM b WHERE (type = 'multi' AND len(ans) < 2) OR (type = 'single' AND len(ans) <> 1) OR (type = 'judge' AND flag IS NULL)
  UNION ALL SELECT 'R3', id, 1 FROM d WHERE letter <> '' AND claim <> '' AND instr('ABCDEFGH', letter) <= n AND NOT contains(opts[instr('ABCDEFGH', letter)], claim) AND NOT contains(claim, opts[instr('ABCDEFGH', letter)])
  UNION ALL SELECT 'R4', id, 1 FROM d WHERE obj AND len(list_filter(told, lambda c: regexp_matches(c, '[A-H]') AND NOT list_contains(ans, c) AND instr('ABCDEFGH', c) <= greatest(n, 1))) > 0
  UNION ALL SELECT 'R5', id, count(*) FROM w WHERE len(refs) > 1 OR len(list_filter(refs, lambda c: NOT list_contains(ans, c))) > 0 GROUP BY id
  UNION ALL SELECT 'R6', id, count(*) FROM w WHERE list_contains(ans, k) GROUP BY id
  UNION ALL SELECT 'R7', min(id), count(*) FROM s GROUP BY stem, o HAVING count(*) > 1
  UNION ALL SELECT 'R8', min(id), count(*) FROM s WHERE type IN ('single', 'multi', 'judge') GROUP BY stem HAVING count(DISTINCT ans) > 1
  UNION ALL SELECT 'R9', id, 1 FROM d WHERE obj AND n > 0 AND len(shown) > 0 AND shown <> ans)
SELECT rule, id, CAST(n AS BIGINT) AS n FROM f""",
)
def bank_consistency(spark, sf):
    return A.consistency(bank(spark, sf))


WHY = r"""list_filter(string_split(substr('ABCDEFGH', 1, CAST(n AS INTEGER)), ''), lambda c: c <> '') AS every,
    list_filter(why_keys, lambda k: trim(why_texts[list_position(why_keys, k)]) <> '') AS said"""
UNCOVERED = "len(list_filter(every, lambda c: NOT list_contains(ans, c))) > 0 AND NOT (list_has_any(said, list_filter(every, lambda c: NOT list_contains(ans, c))) OR (regexp_matches(stem, '不属于|不包括|不是|不正确的|错误的是|除外|不对的') AND list_has_any(said, ans)))"
STRAY = "len(list_filter(why_keys, lambda k: NOT list_contains(every, k))) > 0"


@register(
    "bank_ingest",
    f"""{PREPARED}, c AS (SELECT *, {SHOWN} AS shown, {WHY}, list_filter(ans, lambda c: NOT (c >= 'A' AND c <= 'D') OR instr('ABCDEFGH', c) > n) AS beyond,
    id IS NULL OR type IS NULL OR stem IS NULL OR options IS NULL OR explanation IS NULL OR chapter IS NULL OR section IS NULL OR src IS NULL OR ref IS NULL OR part_answer IS NULL OR source IS NULL OR key_concept IS NULL OR keywords IS NULL OR (letters IS NULL AND flag IS NULL AND answer IS NULL) AS lacks FROM b),
new AS (SELECT * FROM c WHERE key % 2 = 1), old AS (SELECT * FROM c WHERE key % 2 = 0), whole AS (SELECT * FROM new WHERE NOT lacks),
f AS (
  SELECT 'N1' AS rule, id, 1 AS n FROM new WHERE num > (SELECT min(num) FROM new) AND num - 1 NOT IN (SELECT num FROM new)
  UNION ALL SELECT 'N1', id, count(*) FROM c GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'N2', id, 1 FROM new WHERE lacks OR type NOT IN ('single', 'multi', 'judge', 'fill', 'short')
  UNION ALL SELECT 'N3', id, 1 FROM whole WHERE (type = 'single' AND (len(ans) <> 1 OR len(beyond) > 0)) OR (type = 'multi' AND (len(letters) < 2 OR letters <> list_sort(list_distinct(letters)) OR len(beyond) > 0)) OR (type = 'judge' AND flag IS NULL)
  UNION ALL SELECT 'N4', id, CASE WHEN obj THEN CASE WHEN n < 2 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(opts, lambda o: trim(o) = '')) > 0 THEN 1 ELSE 0 END WHEN n > 0 THEN 1 ELSE 0 END FROM whole
  UNION ALL SELECT 'N5', id, CASE WHEN trim(explanation) = '' THEN 1 ELSE 0 END + CASE WHEN obj AND len(shown) > 0 AND shown <> ans THEN 1 ELSE 0 END FROM whole
  UNION ALL SELECT 'N6', id, CASE WHEN {STRAY} THEN 1 ELSE 0 END + CASE WHEN {UNCOVERED} THEN 1 ELSE 0 END FROM whole WHERE obj AND n > 0
  UNION ALL SELECT 'N7', id, CASE WHEN NOT list_contains({CHAPTERS}, chapter) THEN 1 ELSE 0 END + CASE WHEN trim(section) = '' THEN 1 ELSE 0 END FROM whole
  UNION ALL SELECT 'N8', id, CASE WHEN src = 'blog' THEN 1 ELSE 0 END + CASE WHEN src = 'web' AND trim(ref) = '' THEN 1 ELSE 0 END + CASE WHEN src = 'template' AND trim(ref) <> '' THEN 1 ELSE 0 END FROM whole
  UNION ALL SELECT 'N9', id, 1 FROM new WHERE EXISTS (SELECT 1 FROM old WHERE old.stem = new.stem AND old.opts = new.opts)
  UNION ALL SELECT 'N10', id, 1 FROM new WHERE EXISTS (SELECT 1 FROM new m WHERE m.stem = new.stem AND m.opts = new.opts AND m.num < new.num)
  UNION ALL SELECT 'N11', id, 1 FROM whole WHERE hard IS NULL)
SELECT rule, id, CAST(n AS BIGINT) AS n FROM f WHERE n > 0""",
)
def bank_ingest(spark, sf):
    """Odd parts as new rows, even ones as the bank they are to enter."""
    rows = bank(spark, sf)
    return A.ingest(rows.where("key % 2 = 1"), rows.where("key % 2 = 0"), CHAPTERS)


@register(
    "bank_gate",
    f"""WITH {BANK}, b AS (SELECT * REPLACE (list_filter(list_transform(coalesce(options, []), lambda o: trim(o)), lambda o: o <> '') AS options), type IN ('single', 'multi') AS obj,
  CASE WHEN type = 'single' THEN list_sort(list_distinct(coalesce(letters, []))) WHEN type = 'multi' THEN list_sort(list_distinct(list_filter(coalesce(letters, []), lambda c: c >= 'A' AND c <= 'D'))) ELSE [] END AS ans FROM bank),
m AS (SELECT *, len(options) AS n FROM b), c AS (SELECT *, {WHY} FROM m)
SELECT id, CASE WHEN type NOT IN ('single', 'multi', 'judge', 'fill', 'short') THEN 'unknown type' WHEN trim(coalesce(stem, '')) = '' THEN 'empty stem' WHEN obj AND n < 2 THEN 'too few options'
  WHEN type = 'judge' AND flag IS NULL THEN 'unreadable judgement' WHEN type = 'single' AND (len(ans) <> 1 OR ans[1] NOT IN ('A', 'B', 'C', 'D')) THEN 'bad single answer'
  WHEN type = 'multi' AND len(ans) < 2 THEN 'too few answers' WHEN obj AND len(list_filter(ans, lambda c: instr('ABCDEFGH', c) > n)) > 0 THEN 'answer beyond options'
  WHEN trim(coalesce(explanation, '')) = '' THEN 'no explanation' WHEN src NOT IN ('textbook', 'manual', 'bank', 'template', 'web') THEN 'unknown source' WHEN obj AND {STRAY} THEN 'stray reason'
  WHEN obj AND {UNCOVERED} THEN 'no reason' WHEN obj AND len(list_filter(every, lambda c: NOT list_contains(ans, c))) = 0 AND len(why_keys) > 0 THEN 'needless reason'
  WHEN src = 'web' AND ref = '' THEN 'web without ref' END AS reject_reason FROM c""",
)
def bank_gate(spark, sf):
    return A.gate(bank(spark, sf)).select("id", "reject_reason")


@register("bank_short_to_fill", f"WITH {BANK} SELECT id, CASE WHEN type = 'short' AND regexp_matches(stem, '[_＿]{{2,}}') AND length(answer) BETWEEN 1 AND 12 THEN 'fill' ELSE type END AS type FROM bank")
def bank_short_to_fill(spark, sf):
    return A.short_to_fill(bank(spark, sf)).select("id", "type")


@register("bank_negative_stems", f"WITH {BANK} SELECT id, " + ", ".join(f"regexp_matches(stem, '{p}'){' AND type <> ' + repr('judge') if u == 'audit' else ''} AS neg_{u}" for u, p in Q.NEGATIVE.items()) + " FROM bank")
def bank_negative_stems(spark, sf):
    return bank(spark, sf).select("id", *[Q.negative(F.col("stem"), u, F.col("type")).alias(f"neg_{u}") for u in Q.NEGATIVE])


NOTES = {
    "ord": "p_partkey",
    "id": "'q-' || lpad(cast(p_partkey - p_partkey % 3 AS string), 8, '0')",
    "key": "CASE WHEN p_partkey % 5 = 0 THEN 'A' ELSE 'C' END",
    "text": "CASE p_partkey % 4 WHEN 0 THEN '1、选项说的是另一个概念而不是本题的概念' WHEN 1 THEN '本项说的是另一个相近的概念而不是本题的概念' WHEN 2 THEN '本项说的是另一个概念，不是本题所说的概念' ELSE '太短的话' END",
}


@register(
    "note_gate",
    rf"""{PREPARED}, notes AS (SELECT {', '.join(f'{e} AS {c}' for c, e in NOTES.items())} FROM part),
j AS (SELECT notes.*, b.id IS NOT NULL AS known, why_keys, ans FROM notes LEFT JOIN b USING (id)),
r AS (SELECT *, CASE WHEN NOT known OR trim(text) = '' THEN 'unknown item' WHEN NOT list_contains(why_keys, key) THEN 'not a wrong option' WHEN list_contains(ans, key) THEN 'right option' END AS a,
  CASE WHEN length(trim(text)) NOT BETWEEN 15 AND 80 THEN 'length' WHEN regexp_matches(text, '{"|".join(A.PHRASES)}') THEN 'empty phrase' WHEN regexp_matches(text, '[A-Za-z]{{2,}}|\*\*|^#|^\d+[.、)]|`') THEN 'characters' END AS z FROM j)
SELECT ord, id, key, coalesce(a, CASE WHEN ord > min(CASE WHEN a IS NULL AND z IS NULL THEN ord END) OVER (PARTITION BY id, key) THEN 'repeated' END, z) AS reject_reason FROM r""",
)
def note_gate(spark, sf):
    notes = B.table(spark, sf, "part").selectExpr(*[f"{e} AS {c}" for c, e in NOTES.items()])
    return A.note_gate(notes, bank(spark, sf)).select("ord", "id", "key", "reject_reason")


WEB_BASE = {
    "id": "p_partkey",
    "stem": "p_name",
    "src": "CASE WHEN p_partkey % 3 = 0 THEN 'web' ELSE 'template' END",
    "reason": "CASE WHEN p_partkey % 6 < 3 THEN 'an old reason' ELSE '' END",
    "url": "CASE WHEN p_partkey % 2 = 0 THEN 'https://news.example.org/a' ELSE 'https://blog.example.net/b' END",
    "disputed": "false",
}
WEB_ROWS = {
    "id": "page_id % 211",
    "ord": "page_id",
    "found": "page_id % 7 <> 0",
    "confidence": "CASE page_id % 9 WHEN 0 THEN 'none' WHEN 1 THEN 'High' ELSE 'low' END",
    "url": "url",
    "reason": "CASE page_id % 4 WHEN 0 THEN 'too short' WHEN 1 THEN 'every small cold widget is new' WHEN 2 THEN '3. of a large hot gadget 。。' ELSE 'nothing of the kind is said' END",
    "disputed": "page_id % 10 = 3",
}
OVERLAP = r"len(list_intersect({}, {})) > 0"
RUNS = "list_filter(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3)), lambda g: regexp_full_match(g, '[\\p{{L}}\\p{{N}}]{{3}}'))"
STRONG = r"(regexp_matches({0}, '^https?://') AND (lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) = 'example.org' OR lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) LIKE '%.example.org'))"
WEB = f"""WITH base AS (SELECT {', '.join(f'{e} AS {c}' for c, e in WEB_BASE.items())} FROM part),
i AS (SELECT {', '.join(f'{evidence_sql(e) if c == "reason" else e} AS {c}' for c, e in WEB_ROWS.items())} FROM pages),
j AS (SELECT i.*, b.id IS NOT NULL AS known, b.stem, b.src, b.reason AS had, b.url AS before FROM i LEFT JOIN base b USING (id)),
r AS (SELECT *, CASE WHEN NOT known THEN 'unknown id' WHEN had <> '' AND NOT (src = 'web' AND NOT {STRONG.format('before')} AND {STRONG.format("coalesce(url, '')")}) THEN 'has evidence' WHEN NOT found THEN 'not found'
  WHEN NOT {STRONG.format("coalesce(url, '')")} THEN 'source not allowed' WHEN lower(confidence) NOT IN ('high', 'medium', 'low') THEN 'unknown confidence' WHEN length(reason) < 12 THEN 'too short'
  WHEN NOT ({OVERLAP.format(RUNS.format('stem'), RUNS.format('reason'))} OR len(list_filter(list_distinct(regexp_extract_all(lower(stem), '[\\p{{L}}\\p{{N}}]{{2,}}')), lambda w: contains(lower(reason), w))) >= 2) THEN 'off topic' END AS why FROM j),
l AS (SELECT *, min(CASE WHEN why IS NULL THEN ord END) OVER (PARTITION BY id) AS first FROM r)"""


def _web(spark, sf):
    base = B.table(spark, sf, "part").selectExpr(*[f"{e} AS {c}" for c, e in WEB_BASE.items()])
    rows = B.table(spark, sf, "pages").selectExpr(*[f"{e} AS {c}" for c, e in WEB_ROWS.items()])
    return upsert.merge_web(base, rows, ["example.org"], r"\p{L}\p{N}")


@register("web_merge", f"{WEB}, n AS (SELECT id, url, reason, disputed FROM l WHERE ord = first) SELECT b.id, b.stem, CASE WHEN n.id IS NULL THEN b.src ELSE 'web' END AS src, coalesce(n.reason, b.reason) AS reason, coalesce(n.url, b.url) AS url, coalesce(n.disputed, b.disputed) AS disputed FROM base b LEFT JOIN n USING (id)")
def web_merge(spark, sf):
    return _web(spark, sf)[0]


@register("web_rejects", f"{WEB} SELECT id, ord, CASE WHEN ord > first THEN 'has evidence' ELSE why END AS reject_reason FROM l")
def web_rejects(spark, sf):
    return _web(spark, sf)[1].select("id", "ord", "reject_reason")


@register(
    "merge_exams",
    """WITH x AS (SELECT o_orderkey AS exam, o_custkey % 10 AS learner, o_orderdate AS ts, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS correct FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
one AS (SELECT learner, ts, total, correct FROM x QUALIFY row_number() OVER (PARTITION BY learner, ts ORDER BY exam % 2, exam) = 1)
SELECT learner, ts, total, correct, CAST(round(correct / total * 100) AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY learner ORDER BY ts DESC) AS INTEGER) AS place FROM one QUALIFY place <= 50""",
)
def merge_exams(spark, sf):
    x = P.score_exams(B.exam_items(spark, sf)).withColumn("learner", F.col("learner") % 10)
    return P.merge_exams(x.where("exam % 2 = 0"), x.where("exam % 2 = 1"))


@register(
    "session_rate",
    r"""WITH r AS (SELECT user_id AS session, CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS BIGINT) AS question, event_type <> 'error' AS ok, event_id AS seq FROM events WHERE event_type IN ('click', 'purchase', 'error')),
l AS (SELECT session, question, arg_max(ok, seq) AS ok FROM r GROUP BY session, question)
SELECT session, count(*) AS answered, CAST(round(count(*) FILTER (ok) / count(*) * 100) AS BIGINT) AS rate FROM l GROUP BY session""",
)
def session_rate(spark, sf):
    """Every user's events as one session."""
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("long")
    e = B.table(spark, sf, "events").where("event_type IN ('click', 'purchase', 'error')")
    return P.session_rate(e.select(F.col("user_id").alias("session"), k.alias("question"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("seq")))


for _name in ("bank_consistency", "bank_ingest", "bank_gate", "note_gate"):
    ORACLES[_name] = _trims(ORACLES[_name])
