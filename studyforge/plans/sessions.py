"""Queries on stored practice sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..sources import bindings as B
from .catalog import register

#: An order is a session, its parts the questions; small parts are the bank. The answers' JSON goes by the return flag.
ANSWER = "CASE flag WHEN 'A' THEN '\"A\"' WHEN 'N' THEN '[\"A\",\"B\"]' ELSE 'true' END"
TYPE = "CASE p_size % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'multi' WHEN 2 THEN 'judge' WHEN 3 THEN 'fill' ELSE 'short' END"
DOC = """concat('{"ver":', CASE WHEN o_orderpriority = '5-LOW' THEN '2' ELSE '1' END, ',"order":"', CASE o_orderstatus WHEN 'F' THEN 'seq' WHEN 'O' THEN 'rand' ELSE '' END,
'","ids":[', array_join(transform(items, x -> concat('"', x.q, '"')), ','), '],"i":"', size(items) - 2, 'th","seed":', o_orderkey, ',"title":"', CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE o_orderpriority END,
'","wrongMode":', CASE WHEN o_orderpriority = '2-HIGH' THEN '1' ELSE 'null' END, ',"draft":{', array_join(transform(items, x -> concat('"', x.q, '":', x.a)), ','), '},"perm":{', array_join(transform(items, x -> concat('"', x.q, '":["B","A"]')), ','),
'},"revealedRef":{', array_join(transform(items, x -> concat('"', x.q, '":', x.a)), ','), '},"res":{', array_join(transform(items, x -> concat('"', x.q, '":{"picked":', x.a, ',"ok":', x.line > 2, ',"ts":"', x.line, '"}')), ','), '}}')"""

VALID = f"""WITH i AS (SELECT l_orderkey AS session, l_partkey, max(l_returnflag) AS flag, min(l_linenumber) AS line FROM lineitem GROUP BY ALL),
m AS (SELECT session, 'q' || l_partkey AS question, {ANSWER} AS a, flag, line, {TYPE} AS type, p_size, count(*) FILTER (p_size > 48) OVER (PARTITION BY session) AS absent, count(*) OVER (PARTITION BY session) AS n FROM i JOIN part ON p_partkey = l_partkey),
v AS (SELECT m.*, o_orderkey, o_orderpriority, o_orderstatus FROM m JOIN orders ON o_orderkey = session WHERE absent = 0 AND o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW')"""


def _bank(spark, sf):
    return B.table(spark, sf, "part").where("p_size <= 48").select(F.concat(F.lit("q"), "p_partkey").alias("question"), F.expr(TYPE).alias("type"), (F.col("p_size") % 3 + 2).cast("int").alias("n_options"))


def _documents(spark, sf):
    one = B.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_returnflag").alias("flag"), F.min("l_linenumber").alias("line"))
    entry = F.struct("line", F.concat(F.lit("q"), "l_partkey").alias("q"), F.expr(ANSWER).alias("a"))
    items = one.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    return B.table(spark, sf, "orders").join(S.spread(items), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("session"), F.expr(DOC).alias("json"))


@register(
    "restored_sessions",
    f"""{VALID} SELECT session, n, CAST(greatest(0, n - 2) AS INTEGER) AS place, CASE o_orderstatus WHEN 'F' THEN 'seq' ELSE 'rand' END AS "order", CASE WHEN o_orderpriority = '1-URGENT' THEN 'again' ELSE o_orderpriority END AS title,
  session AS seed, o_orderpriority = '2-HIGH' AS wrong_mode, string_agg(question, ',' ORDER BY line, question) AS ids FROM v GROUP BY session, n, o_orderstatus, o_orderpriority""",
)
def restored_sessions(spark, sf):
    """Sessions all of whose questions are in the bank."""
    out = S.restore_sessions(_documents(spark, sf), _bank(spark, sf), title="again")
    return out.withColumn("n", F.size("ids").cast("long")).withColumn("ids", F.array_join("ids", ","))


@register(
    "session_entries",
    f"""{VALID}, f AS (SELECT *, CASE flag WHEN 'A' THEN type IN ('single', 'short') WHEN 'N' THEN type IN ('multi', 'fill') ELSE type = 'judge' END AS fits FROM v)
SELECT session, 'draft' AS part, question, a AS value, CAST(NULL AS BOOLEAN) AS ok, CAST(NULL AS BOOLEAN) AS self, CAST(NULL AS BIGINT) AS ts FROM f WHERE fits
UNION ALL SELECT session, 'perm', question, '["B","A"]', NULL, NULL, NULL FROM f WHERE p_size % 3 = 0
UNION ALL SELECT session, 'flag', question, a, NULL, NULL, NULL FROM f WHERE flag NOT IN ('A', 'N')
UNION ALL SELECT session, 'result', question, a, line > 2, false, CAST(line AS BIGINT) FROM f WHERE fits""",
)
def session_entries(spark, sf):
    """Drafts, orders of options, flags and results of those sessions that fit their questions."""
    return S.session_entries(_documents(spark, sf), _bank(spark, sf))
