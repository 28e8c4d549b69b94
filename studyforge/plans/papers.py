"""Queries on exam papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bindings as B
from ..sources import papers
from .catalog import register

#: The turns of a conversation as lines of a paper: by their number, a chapter, a kind, questions, options and lines that go on.
DIGEST = "md5(coalesce(text, ''))"
LINE = f"""CASE turn % 7 WHEN 0 THEN '第三章 ' || substr({DIGEST}, 1, 6) WHEN 1 THEN '（一）单选题' WHEN 2 THEN cast(turn AS string) || '. ' || {DIGEST} WHEN 3 THEN 'A. ' || substr({DIGEST}, 1, 8) || ' B．' || substr({DIGEST}, 9, 8)
  WHEN 4 THEN {DIGEST} WHEN 5 THEN cast(turn AS string) || '、' || {DIGEST} || '论述题' ELSE '1.8万' || {DIGEST} END"""


@register(
    "paper_items",
    f"""WITH l AS (SELECT conv_id, turn, turn % 7 AS r, {DIGEST} AS d FROM conversations),
s AS (SELECT *, last_value(CASE WHEN r = 0 THEN '第三章 ' || substr(d, 1, 6) END IGNORE NULLS) OVER w AS chapter, last_value(CASE r WHEN 0 THEN '' WHEN 1 THEN '单选题' WHEN 5 THEN '论述题' END IGNORE NULLS) OVER w AS kind FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, last_value(CASE WHEN r IN (2, 5) AND chapter IS NOT NULL AND kind <> '' THEN turn WHEN r IN (0, 1, 5) THEN -1 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS item FROM s),
o AS (SELECT conv_id, item, any_value(chapter) AS chapter, max(CASE WHEN turn = item THEN kind END) AS kind, max(CASE WHEN r = 3 THEN turn END) AS opened FROM i WHERE item >= 0 GROUP BY conv_id, item),
p AS (SELECT o.*, (SELECT string_agg(CASE WHEN i.r = 6 THEN '1.8万' || i.d ELSE i.d END, '' ORDER BY i.turn) FROM i WHERE i.conv_id = o.conv_id AND i.item = o.item AND i.r <> 3 AND (opened IS NULL OR i.turn < opened)) AS stem,
  (SELECT string_agg(CASE WHEN i.r = 6 THEN '1.8万' || i.d ELSE i.d END, '' ORDER BY i.turn) FROM i WHERE i.conv_id = o.conv_id AND i.item = o.item AND i.turn > opened) AS more,
  (SELECT any_value(i.d) FROM i WHERE i.conv_id = o.conv_id AND i.turn = opened) AS od FROM o)
SELECT conv_id AS file, item, chapter, kind, CAST(item AS INTEGER) AS no, stem, CASE WHEN opened IS NULL THEN '' ELSE substr(od, 1, 8) || '|' || substr(od, 9, 8) || coalesce(more, '') END AS options FROM p""",
)
def paper_items(spark, sf):
    """Questions of papers whose lines are the turns of the conversations."""
    lines = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), F.expr(LINE).alias("line"))
    return papers.parse_paper(lines, 3).withColumn("options", F.array_join("options", "|"))
