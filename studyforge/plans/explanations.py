"""Audit of explanations over the parts seen as explained questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.explanation_audit import explanations, web_sources
from ..sources import bindings as B
from .catalog import register
from .evidence import KEY, LONGEST, SQUEEZE

#: In expressions that Spark and DuckDB both read; ARR stands for the list constructor.
ROWS = {
    "id": "p_partkey",
    "type": "CASE p_partkey % 6 WHEN 0 THEN 'multi' WHEN 1 THEN 'judge' WHEN 2 THEN 'fill' WHEN 3 THEN 'short' ELSE 'single' END",
    "options": "CASE WHEN p_partkey % 6 IN (0, 4, 5) THEN ARR(p_type, p_brand, p_name, 'old') END",
    "letters": "CASE p_size % 6 WHEN 0 THEN ARR('A') WHEN 1 THEN ARR('B') WHEN 2 THEN ARR('C', 'A') WHEN 3 THEN ARR('D') WHEN 4 THEN NULL ELSE ARR('C') END",
    "flag": "CASE WHEN p_partkey % 4 <> 1 THEN p_size % 2 = 0 END",
    "answer": "CASE WHEN p_partkey % 7 <> 3 THEN p_name END",
    "explanation": """CASE p_partkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '　\n' WHEN 2 THEN ' 短 ' WHEN 3 THEN repeat(p_name || '; ', 60) WHEN 4 THEN '解析。正确答案：A、' || p_type || '；C（旧）' WHEN 5 THEN 'because of ' || p_name || ' it is 正确'
      WHEN 6 THEN '古 代　国防 ' || p_brand WHEN 7 THEN '《国防法》《国防法》' || p_type WHEN 8 THEN '正确答案: B ' WHEN 9 THEN 'the ' || substr(p_brand, 2) || ' and the rest' ELSE p_type || ' 与 ' || substr(p_brand, 1, 5) || ' 错 误' END""",
    "parts": "CASE p_partkey % 4 WHEN 0 THEN ARR(' ', '　') WHEN 1 THEN ARR(p_name, '国 防') WHEN 2 THEN NULL ELSE ARR('《军事》' || '《军事》') END",
}


def _fit(needle, hay):
    return f"list_transform([{{'a': {KEY.format(needle)}, 'b': {KEY.format(hay)}}}], lambda p: CASE WHEN p.a = '' OR p.b = '' THEN 0.0 ELSE {LONGEST.replace('length(a)', 'length(p.a)').replace('substr(a,', 'substr(p.a,').replace('contains(b,', 'contains(p.b,')} / length(p.a) END)[1]"


@register(
    "explanation_audit",
    rf"""WITH q0 AS (SELECT {', '.join(f"{e.replace('ARR(', 'list_value(')} AS {c}" for c, e in ROWS.items())} FROM part),
q1 AS (SELECT *, trim(coalesce(explanation, ''), ' 　' || chr(10)) AS e, coalesce(explanation, '') || chr(10) || array_to_string(coalesce(parts, []), chr(10)) AS whole,
  CASE WHEN type = 'multi' OR (type = 'single' AND len(letters) = 1) THEN coalesce(letters, []) ELSE [] END AS l FROM q0),
q2 AS (SELECT *, CASE type WHEN 'judge' THEN CASE WHEN coalesce(flag, false) THEN '正确' ELSE '错误' END WHEN 'single' THEN array_to_string(list_transform(l, lambda x: options[instr('ABCD', x)]), '') WHEN 'multi' THEN array_to_string(list_transform(l, lambda x: options[instr('ABCD', x)]), '') ELSE coalesce(answer, '') END AS a,
  rtrim(regexp_extract(e, '正确答案[:：]\s*([^。\n]*)', 1)) AS line FROM q1),
q3 AS (SELECT *, list_filter(['A', 'B', 'C', 'D'], lambda x: options IS NOT NULL AND (regexp_matches(line, x || '\s*[、,，/；;（(]') OR ends_with(line, x))) AS told FROM q2),
bare AS (SELECT * FROM q3 WHERE e <> '' AND a <> '' AND type <> 'short' AND NOT contains({SQUEEZE.format('e')}, {SQUEEZE.format('a')}) AND NOT (len(l) > 0 AND told = list_sort(l)) AND {_fit('a', 'e')} < 0.4),
o AS (SELECT id, e, l, k, options[k] AS o FROM bare, LATERAL (SELECT unnest(range(1, len(options) + 1)) AS k) WHERE type = 'single')
SELECT 'no explanation' AS rule, id FROM q3 WHERE e = '' UNION ALL SELECT 'too short', id FROM q3 WHERE e <> '' AND length(e) < 8 UNION ALL SELECT 'too long', id FROM q3 WHERE length(e) > 400
UNION ALL SELECT 'blanks between characters', id FROM q3 WHERE regexp_matches(whole, '[\x{{4e00}}-\x{{9fff}}][ \t\x{{3000}}]+[\x{{4e00}}-\x{{9fff}}]')
UNION ALL SELECT 'title twice', id FROM q3 WHERE contains(whole, '《国防法》《国防法》') OR contains(whole, '《军事》《军事》')
UNION ALL SELECT 'empty parts', id FROM q3 WHERE len(parts) > 0 AND len(list_filter(parts, lambda p: trim(p, ' 　') <> '')) = 0
UNION ALL SELECT 'answer not supported', id FROM bare
UNION ALL SELECT DISTINCT 'wrong option supported', id FROM o WHERE length({SQUEEZE.format('o')}) >= 3 AND k <> instr('ABCD', l[1]) AND {_fit('o', 'e')} >= 0.7""",
)
def explanation_audit(spark, sf):
    rows = B.table(spark, sf, "part").select(*[F.expr(e.replace("ARR(", "array(")).alias(c) for c, e in ROWS.items()])
    return explanations(rows)


#: Parts as questions with evidence from the web.
WEB = {
    "id": "p_partkey",
    "type": "CASE WHEN p_partkey % 6 < 4 THEN 'single' ELSE 'fill' END",
    "src": "CASE WHEN p_partkey % 5 <> 0 THEN 'web' WHEN p_partkey % 2 = 0 THEN 'textbook' END",
    "ref": "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' 　' ELSE p_name END",
    "url": "CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'ftp://a.b' ELSE 'https://' || p_brand END",
    "stem": "CASE p_partkey % 4 WHEN 0 THEN '国防的对象主要____是 ' || p_name WHEN 1 THEN p_name || '与' || p_type WHEN 2 THEN NULL ELSE '战争形态 1.5 倍于' || p_brand END",
    "options": "ARR('武装侵略', p_type, '颠覆和分裂活动', p_brand)",
    "letters": "ARR(substr('ABCD', cast(1 + p_size % 4 AS int), 1))",
    "flag": "cast(NULL AS boolean)",
    "answer": "CASE WHEN p_partkey % 10 <> 4 THEN '战争' END",
    "reason": """CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '国防的对象主要有武装侵略和武装颠覆' WHEN 2 THEN '这里什么都没有讲到过，也和题目毫不相干' || p_name WHEN 3 THEN '战争形态是战争' || p_partkey WHEN 4 THEN p_name || ' and ' || p_type
      WHEN 5 THEN '对象主要 国防的对 1.5' || p_brand WHEN 6 THEN '武装侵略国防的对象' ELSE '战 争形态的发展变化推动了新军事变革，' || p_type END""",
    "disputed": "CASE p_partkey % 11 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END",
}
RUNS = r"regexp_extract_all({}, '[\x{{4e00}}-\x{{9fff}}]+')"
HAN = r"list_distinct(regexp_extract_all({}, '[\x{{4e00}}-\x{{9fff}}]'))"
GRAMS = "list_concat(list_concat(list_transform(range(1, length(x) - 2), lambda i: substr(x, i, 4)), list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))), list_transform(range(1, length(x)), lambda i: substr(x, i, 2)))"
KEYWORDS = rf"list_distinct(flatten(list_transform(regexp_extract_all(s, '[\x{{4e00}}-\x{{9fff}}]+|[A-Za-z]{{2,}}|\d+(?:\.\d+)?'), lambda x: CASE WHEN NOT regexp_matches(x, '^[\x{{4e00}}-\x{{9fff}}]') OR length(x) <= 4 THEN [x] ELSE {GRAMS} END)))"


@register(
    "web_source_audit",
    rf"""WITH q0 AS (SELECT {', '.join(f"{e.replace('ARR(', 'list_value(')} AS {c}" for c, e in WEB.items())} FROM part),
w AS (SELECT *, regexp_replace(coalesce(stem, ''), '[_＿]{{2,}}', ' ', 'g') AS s, coalesce(reason, '') AS r, CASE WHEN type = 'single' THEN options[instr('ABCD', letters[1])] ELSE coalesce(answer, '') END AS a FROM q0 WHERE src = 'web'),
t AS (SELECT *, coalesce(list_max(list_transform({RUNS.format('s')}, lambda a: coalesce(list_max(list_transform({RUNS.format('r')}, lambda b: {LONGEST})), 0))), 0) AS run,
  len(list_filter({KEYWORDS}, lambda x: length(x) >= 2 AND contains(r, x))) AS hits, len(list_filter({HAN.format('r')}, lambda c: NOT contains(s, c) AND NOT contains(a, c))) AS own, substr({SQUEEZE.format('r')}, 1, 40) AS head FROM w)
SELECT 'no reference' AS rule, id, CAST(1 AS BIGINT) AS n FROM t WHERE trim(coalesce(ref, ''), ' 　') = '' UNION ALL SELECT 'no url', id, 1 FROM t WHERE NOT regexp_matches(coalesce(url, ''), '^https?://')
UNION ALL SELECT 'little shared text', id, run FROM t WHERE run < 4 UNION ALL SELECT 'off topic', id, hits FROM t WHERE run < 4 AND hits < 2 UNION ALL SELECT 'repeats the answer', id, own FROM t WHERE own < 6
UNION ALL SELECT 'shared reason', min(id), count(*) FROM t WHERE head <> '' GROUP BY head HAVING count(*) > 1 UNION ALL SELECT 'disputed', id, 1 FROM q0 WHERE disputed""",
)
def web_source_audit(spark, sf):
    rows = B.table(spark, sf, "part").select(*[F.expr(e.replace("ARR(", "array(")).alias(c) for c, e in WEB.items()])
    return web_sources(rows)
