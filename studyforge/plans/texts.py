"""Queries that rewrite texts: evidence, notes, outlines and items derived from others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewrites as R
from ..operators import rewriting
from ..operators.derived import derived
from ..operators.outline import outline
from ..sources import bindings as B
from ..sources import commits
from .catalog import register

HAN, GAP = r"\x{4e00}-\x{9fff}", r"[ \t\x{3000}]+"
#: The sentences of conversations with what extraction from pages leaves in them, for Spark and DuckDB alike.
NOISY = """CASE turn % 8 WHEN 0 THEN '12. ( 一 ) 古 代 国 防古代国防始于' || text WHEN 1 THEN '★知 识链接： 《国防法 》《国防法》 《 国防法》' || text || '。。；；'
  WHEN 2 THEN '国 防　法 规  ' || md5(text) || ' 是 2 0 2 0 年 （ ）的“演习”“演习”“演习”' WHEN 3 THEN '五、现代国防的特征现代国防的特征是' || text WHEN 4 THEN text WHEN 5 THEN '3.\t（二）' ELSE '，，、 ' || text || '　。；' END"""


def evidence_sql(c: str) -> str:
    """DuckDB's form of clean_evidence; it has no look-around and no back references, so neighbours are captured and overlaps take two turns."""
    s = f"regexp_replace(replace(replace(coalesce({c}, ''), chr(0), ' '), chr(65279), ''), '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g')"
    rules = [
        (r"^[\s\x{a0}\x{3000}.·。]+|^\p{Nd}{1,3}[\s\x{a0}\x{3000}]*[.、．][\s\x{a0}\x{3000}]*", ""),
        (r"^★?\s*知\s*识\s*链\s*接\s*[:：]?[\s\x{a0}\x{3000}]*", ""),
        (rf"([（(〔【《〈“”‘’]){GAP}", r"\1"),
        (rf"{GAP}([）)〕】》〉，。；：、！？])", r"\1"),
        (rf"([、，。；：！？]){GAP}", r"\1"),
        *[(r"([0-9]) +([0-9])", r"\1\2")] * 2,
        *[(rf"([{HAN}]){GAP}([{HAN}])", r"\1\2")] * 2,
        (rf"([{HAN}]){GAP}([0-9A-Za-z])", r"\1\2"),
        (rf"([0-9A-Za-z]){GAP}([{HAN}])", r"\1\2"),
        (r"[（(][\s\x{a0}\x{3000}]*[)）]", ""),
        *[(f"{m}{{2,}}", m) for m in "，。；、！？"],
    ]
    for pattern, new in rules:
        s = f"regexp_replace({s}, '{pattern}', '{new}', 'g')"
    for form in ("《[^》]{2,30}》", "“[^”]{2,30}”"):
        s = f"array_to_string(list_transform([regexp_extract_all({s}, '{form}|[\\s\\S]')], lambda l: list_filter(l, lambda x, i: length(x) = 1 OR i = 1 OR x <> coalesce(l[i - 1], '')))[1], '')"
    s = f"regexp_replace({s}, '[ \\t\\x{{3000}}]{{2,}}', ' ', 'g')"
    number = r"^([（(]\s*[一二三四五六七八九十\p{Nd}]+\s*[)）]|[一二三四五六七八九十\p{Nd}]+\s*[、.．])[\s\x{a0}\x{3000}]*"
    cuts = " ".join(f"WHEN instr(substr(b, {n + 1}, 22), substr(b, 1, {n})) > 0 THEN substr(b, {n} + instr(substr(b, {n + 1}, 22), substr(b, 1, {n})))" for n in range(8, 2, -1))
    s = f"list_transform([{s}], lambda s: list_transform([regexp_replace(s, '{number}', '')], lambda b: CASE WHEN b = '' THEN s WHEN length(b) < 12 THEN b {cuts} ELSE b END)[1])[1]"
    return f"trim({s}, ' 　' || chr(9) || '.·。，、；：')"


@register("evidence_cleaned", f"SELECT conv_id, turn, {evidence_sql(NOISY)} AS cleaned FROM conversations")
def evidence_cleaned(spark, sf):
    return B.table(spark, sf, "conversations").select("conv_id", "turn", R.clean_evidence(F.expr(NOISY)).alias("cleaned"))


NOTE = """CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '教材中未收录与该题直接对应的内容，建议对照原卷核实。' || p_name WHEN 2 THEN p_name || '。；教材中未收录教材中未收录与该题直接对应的内容与该题直接对应的内容，  ' || p_brand
  WHEN 3 THEN '  人工校订：' || p_type || '。。建议对照原卷核实' WHEN 4 THEN '本题库未收录教材中的直接出处，建议对照原卷核实' WHEN 5 THEN '。' WHEN 6 THEN p_name || '   ' || p_type ELSE '；' || p_brand || '建议建议对照原卷核实对照原卷核实、' END"""
NOTE_REASON = "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '　 ' ELSE p_name END"
NOTE_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'judge' WHEN 1 THEN 'short' WHEN 2 THEN NULL ELSE 'single' END"
NOTE_SOURCE = "CASE p_partkey % 11 WHEN 0 THEN 'manual' WHEN 1 THEN NULL ELSE 'textbook' END"


def _excuses() -> str:
    s = "old"
    for _ in range(4):
        for form in R.NO_REASON_FORMS:
            s = f"replace({s}, '{form}', '')"
        s = rf"trim(regexp_replace(regexp_replace({s}, '[。；，、]{{2,}}', '。', 'g'), '\s{{2,}}', ' ', 'g'), ' 。；，、')"
    return s


@register(
    "notes_rewritten",
    f"""WITH n AS (SELECT p_partkey AS item, regexp_replace(coalesce({NOTE}, ''), '^\\s+|\\s+$', '', 'g') AS old, trim(coalesce({NOTE_REASON}, ''), ' 　') = '' AS lacks, coalesce({NOTE_KIND}, '') = 'judge' AS judge, coalesce({NOTE_SOURCE}, '') = 'manual' AS manual FROM part),
t AS (SELECT *, {_excuses()} AS tail FROM n)
SELECT item, nullif(trim(CASE WHEN manual OR contains(old, '人工') THEN tail ELSE concat_ws('。', CASE WHEN judge THEN '{R.JUDGE_NOTE}' END, CASE WHEN lacks THEN '{R.NO_REASON}' END, CASE WHEN NOT judge THEN nullif(tail, '') END) END, '。'), '') AS note FROM t""",
)
def notes_rewritten(spark, sf):
    cols = [F.expr(e) for e in (NOTE, NOTE_REASON, NOTE_KIND, NOTE_SOURCE)]
    return B.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), R.note(*cols).alias("note"))


#: Chapters and their sections, as the outline of the textbook names them.
SECTIONS = {"第一章中国国防": ["国防概述", "国防法规", "国防建设"], "第二章国家安全": ["国家安全概述", "国际战略形势"], "第三章军事思想": []}
#: Documents as extracted outlines: titles named further up, left out or without a break after them, marks in lines, page heads.
OUTLINE = """CASE doc_id % 5 WHEN 0 THEN '=== PAGE 1 ===\n前言第一章的话\n 12第一章中国国防（含第二节国防法规等）第一节国防概述国防是\n㈠ 国防的含义：' || coalesce(text, '') || '\n\n 　㈡\t' || md5(coalesce(text, '')) || '，下\n㈢短\n第二节国防法规\n⒈《法》' || doc_id || '\n=== PAGE 22 ===\n㈣第三节国防建设' || doc_id
  WHEN 1 THEN '第二章国家安全第一节 安全之名' || coalesce(text, '') || '\n第三章军事思想\n㈠' || doc_id WHEN 2 THEN coalesce(text, '') WHEN 3 THEN NULL
  ELSE '第一章中国国防第三节国防建设' || doc_id || '\n㈠甲乙丙（丁）\n第一章中国国防第一节国防概述第二节国防法规第一节国防概述第三节国防建设 ' || coalesce(text, '') END"""
HEADING = "第[一二三]章(?:中国国防|国家安全|军事思想)"
ENDS = r"'^\s+|\s+$', '', 'g'"
TITLES = "CASE chapter " + " ".join(f"WHEN '{h}' THEN list_value({', '.join(repr(f'第{R_}节{n}') for R_, n in zip('一二三', names, strict=False))})" for h, names in SECTIONS.items() if names) + " ELSE [] END"


@register(
    "outline_sections",
    rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({OUTLINE}, ''), '=== PAGE \d+ ===', '', 'g'), '(?m)^\s*\d{{1,3}}(第|[㈠-㈩])', '\1', 'g'), '[ \t\x{{3000}}]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g'), {ENDS}) AS body FROM documents),
p AS (SELECT doc_id, list_filter(string_split(regexp_replace(body, '({HEADING})', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_matches(x, '^{HEADING}')) AS l FROM t),
c0 AS (SELECT doc_id, i AS chapter_no, l[i] AS body, regexp_extract(l[i], '^{HEADING}') AS chapter FROM p, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
c AS (SELECT *, {TITLES} AS titles FROM c0),
r AS (SELECT doc_id, chapter_no, chapter, body, titles, 0 AS k, CAST(1 AS BIGINT) AS nxt, CAST(NULL AS BIGINT) AS place, CAST('' AS VARCHAR) AS title FROM c
  UNION ALL SELECT doc_id, chapter_no, chapter, body, titles, k + 1, CASE WHEN hit > 0 THEN nxt + hit - 1 + length(titles[k + 1]) ELSE nxt END, CASE WHEN hit > 0 THEN nxt + hit - 1 END, titles[k + 1]
  FROM (SELECT *, instr(substr(body, nxt), titles[k + 1]) AS hit FROM r WHERE k < len(titles))),
a AS (SELECT doc_id, chapter_no, place, title FROM r WHERE place IS NOT NULL),
f AS (SELECT * FROM a UNION ALL SELECT doc_id, chapter_no, instr(body, s), s FROM (SELECT *, regexp_extract(body, '第[一二三四五六七八九十]+节\s*[^，。；：、\s]{{2,12}}') AS s FROM c ANTI JOIN a USING (doc_id, chapter_no)) WHERE s <> ''),
s AS (SELECT f.doc_id, f.chapter_no, chapter, row_number() OVER w AS section_no, title AS section, regexp_replace(substr(body, place, coalesce(lead(place) OVER w, length(body) + 1) - place), {ENDS}) AS text FROM f JOIN c USING (doc_id, chapter_no) WINDOW w AS (PARTITION BY f.doc_id, f.chapter_no ORDER BY place)),
b AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(\s*[㈠-㈩⒈-⒑])', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_replace(x, {ENDS})), lambda x: regexp_matches(x, '^[㈠-㈩⒈-⒑]') AND length(x) >= 4) AS l FROM s)
SELECT doc_id, CAST(chapter_no AS INTEGER) AS chapter_no, chapter, CAST(section_no AS INTEGER) AS section_no, section, CAST(length(text) AS BIGINT) AS chars, CAST(len(l) AS BIGINT) AS subs,
  array_to_string(list_transform(list_transform(l, lambda x: [x, regexp_replace(regexp_replace(substr(regexp_replace(string_split(x, chr(10))[1], '^[㈠-㈩⒈-⒑]\s*|\s+$', '', 'g'), 1, 20), '[，。；：()《》"“”‘’].*$', ''), {ENDS})]), lambda y: CASE WHEN y[2] <> '' THEN y[2] ELSE substr(y[1], 1, 18) END), '|') AS titles FROM b""",
)
def outline_sections(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.expr(OUTLINE).alias("t"))
    o = outline(d, "doc_id", "t", SECTIONS)
    titles = F.array_join(F.transform("subs", lambda s: s["title"]), "|")
    return o.select("doc_id", "chapter_no", "chapter", "section_no", "section", F.length("text").cast("long").alias("chars"), F.size("subs").cast("long").alias("subs"), titles.alias("titles"))


#: The parts as single-choice items, some of them unfit to make others of.
ITEMS = {
    "item": "p_partkey",
    "type": "CASE WHEN p_partkey % 7 = 3 THEN 'multi' ELSE 'single' END",
    "stem": "CASE p_partkey % 11 WHEN 0 THEN p_name || '是____和____的' WHEN 1 THEN '下列不属于' || p_name || '的是____' WHEN 2 THEN NULL WHEN 3 THEN p_name || '（ ）是＿＿＿，' || p_brand ELSE p_name || '是____' || p_brand END",
    "options": "ARR(p_type, p_brand, CASE p_partkey % 13 WHEN 0 THEN '以上都是' WHEN 1 THEN 'a；b' WHEN 2 THEN 'x' WHEN 4 THEN NULL ELSE p_type || ' x' END, p_name)",
    "answer": "substr('ABCDEABCD', cast(1 + p_size % 9 AS int), cast(1 + (CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END) AS int))",
}


@register(
    "derived_items",
    rf"""WITH i AS (SELECT {', '.join(f"{e.replace('ARR(', 'list_value(')} AS {c}" for c, e in ITEMS.items())} FROM part),
u0 AS (SELECT *, instr('ABCDEFGH', answer) AS right_at FROM i WHERE type = 'single' AND len(options) = 4 AND length(stem) BETWEEN 10 AND 120 AND len(regexp_extract_all(stem, '[_＿]{{2,}}')) = 1 AND length(answer) = 1
  AND len(list_filter(options, lambda o: length(o) BETWEEN 2 AND 20 AND NOT regexp_matches(o, '[_＿]{{2,}}|^(以上|上述|全部|都|均|前三)|[。；;！？]'))) = 4),
u AS (SELECT *, options[right_at] AS correct, list_sort(list_filter([{{'d': abs(length(options[k]) - length(options[right_at])), 'k': k, 'o': options[k]}} for k in range(1, 5)], lambda x: x.k <> right_at))[1].o AS wrong FROM u0 WHERE right_at BETWEEN 1 AND 4),
s AS (SELECT item, 0 AS k, regexp_replace(stem, '[_＿]{{2,}}', correct) AS stem, 'true' AS answer, stem AS asked FROM u UNION ALL SELECT item, 1, regexp_replace(stem, '[_＿]{{2,}}', wrong), 'false', stem FROM u),
g AS (SELECT * FROM s WHERE NOT regexp_matches(asked, '下列说法|下列选项|以下哪些|下列哪些|错误的是|有误的是|不是|不属于|不包括|不正确|不符合|哪些|哪项|哪一')
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(regexp_replace(regexp_replace(stem, '\(\s*\)|（\s*）', '', 'g'), '[_＿—-]{{2,}}', '', 'g'), '[^\p{{L}}\p{{N}}_]', '', 'g') ORDER BY item, k) = 1),
j0 AS (SELECT *, row_number() OVER (ORDER BY item, k) AS no FROM g), j AS (SELECT *, min(no) OVER (PARTITION BY item) AS first FROM j0),
f0 AS (SELECT item, stem, correct AS answer FROM u QUALIFY row_number() OVER (PARTITION BY regexp_replace(regexp_replace(regexp_replace(stem, '\(\s*\)|（\s*）', '', 'g'), '[_＿—-]{{2,}}', '', 'g'), '[^\p{{L}}\p{{N}}_]', '', 'g') ORDER BY item) = 1),
f AS (SELECT *, row_number() OVER (ORDER BY item) AS no FROM f0)
SELECT 'judge' AS kind, CAST(no AS INTEGER) AS no, item, stem, answer FROM j WHERE first <= 150 UNION ALL SELECT 'fill', CAST(no AS INTEGER), item, stem, answer FROM f WHERE no <= 150""",
)
def derived_items(spark, sf):
    rows = B.table(spark, sf, "part").select(*[F.expr(e.replace("ARR(", "array(")).alias(c) for c, e in ITEMS.items()])
    return derived(rows, "item")


#: The parts as bank rows whose reasons hold outdated phrases, two rows to a key here and there.
REASONS = {
    "id": "p_partkey - CASE WHEN p_partkey % 19 = 1 THEN 1 ELSE 0 END",
    "right": "CASE p_partkey % 5 WHEN 0 THEN ARR('A') WHEN 1 THEN ARR('B', 'C') WHEN 2 THEN NULL ELSE ARR('D') END",
    "a": "CASE p_partkey % 6 WHEN 0 THEN '与正确项 B/ C 表述相近、容易混淆，注意区分限定语。' || p_name WHEN 1 THEN '教材中仅零星出现，不是本考点的规范表述。' WHEN 2 THEN '该说法在本软件核对过的教材语料中查不到，属于为本题设置的干扰项。' WHEN 3 THEN NULL ELSE p_type END",
    "b": "CASE p_partkey % 7 WHEN 0 THEN '该说法教材中未出现或不属本考点的规范表述。' WHEN 1 THEN p_name || '教材中仅零星出现，不是本考点的规范表述。' WHEN 2 THEN '与正确项A表述相近、容易混淆，注意区分限定语。' ELSE p_brand END",
}
REASON_ROWS = f"""i AS (SELECT p_partkey AS row, {', '.join(f"{e.replace('ARR(', 'list_value(')} AS \"{c}\"" for c, e in REASONS.items())} FROM part),
e AS (SELECT row, id, 'A' AS k, "right" AS ok, a AS v FROM i UNION ALL SELECT row, id, 'B', "right", b FROM i),
s AS (SELECT *, regexp_replace(v, '{rewriting.WRONG_REFERENCE}', '{rewriting.NEUTRAL_REFERENCE}', 'g') AS v1, replace(v1, '{rewriting.STALE}', '{rewriting.NEUTRAL_STALE}') AS v2, coalesce(list_contains(ok, k) AND v2 IN ('{rewriting.NOT_IN_CORPUS}', '{rewriting.NEUTRAL_STALE}'), false) AS denied, CASE WHEN denied THEN '{rewriting.OF_RIGHT_OPTION}' ELSE v2 END AS v3 FROM e)"""


def _reasons(spark, sf):
    rows = B.table(spark, sf, "part").select(*[F.expr(e.replace("ARR(", "array(")).alias(c) for c, e in REASONS.items()])
    return rows.select("id", "right", F.create_map(F.lit("A"), "a", F.lit("B"), "b").alias("why"))


@register(
    "rewrite_report",
    f"""WITH {REASON_ROWS}
SELECT 'reference' AS rule, count(*) FILTER (regexp_matches(v, '{rewriting.WRONG_REFERENCE}')) AS n FROM s UNION ALL SELECT 'stale', count(*) FILTER (contains(v1, '{rewriting.STALE}')) FROM s UNION ALL SELECT 'right option denied', count(*) FILTER (denied) FROM s""",
)
def rewrite_report(spark, sf):
    return rewriting.report(_reasons(spark, sf))


@register("reasons_rewritten", f"WITH {REASON_ROWS} SELECT id, k AS letter, v3 AS said FROM s")
def reasons_rewritten(spark, sf):
    return rewriting.rewrite(_reasons(spark, sf)).select("id", F.explode("why").alias("letter", "said"))


@register(
    "commit_check",
    f"""WITH {REASON_ROWS},
w AS (SELECT row, coalesce(bool_or(regexp_matches(v3, '{rewriting.WRONG_REFERENCE}')), false) AS a, coalesce(bool_or(contains(v3, '{rewriting.STALE}')), false) AS b, coalesce(bool_or(list_contains(ok, k) AND (contains(v3, '{rewriting.NOT_IN_CORPUS}') OR contains(v3, '{rewriting.NEUTRAL_STALE}'))), false) AS c FROM s GROUP BY row)
SELECT 'wrong references left' AS "check", count(*) FILTER (a) AS n FROM w UNION ALL SELECT 'stale phrases left', count(*) FILTER (b) FROM w UNION ALL SELECT 'right options denied', count(*) FILTER (c) FROM w
UNION ALL SELECT 'keys repeated', count(*) FROM (SELECT id FROM i GROUP BY id HAVING count(*) > 1)""",
)
def commit_check(spark, sf):
    """What a commit of the rewritten rows would be refused for, as a dry run tells it."""
    return commits.check(rewriting.rewrite(_reasons(spark, sf)), ["id"], rewriting.faults())
