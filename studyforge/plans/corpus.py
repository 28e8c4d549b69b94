"""Queries on the text corpus: units, repair, grams, retrieval, search, evidence."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, corpus, folds, retrieval, upsert
from ..sources import bindings as B
from ..sources import sinks
from .catalog import register

PIECES = r"""cut AS (SELECT doc_id, source AS chapter, regexp_extract_all(text, '([^.!?]*[.!?]|[^.!?]+$)') AS p FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT * FROM (SELECT doc_id, chapter, CAST(i - 1 AS INTEGER) AS pos, trim(p[i], ' ') AS sentence FROM cut, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)) WHERE length(sentence) > 0),
units AS (SELECT doc_id, chapter, pos, sentence FROM pieces WHERE length(sentence) BETWEEN 12 AND 220)"""
DIGEST = "md5(sentence) AS digest, length(sentence) AS n_chars"


def _docs(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", "source", "text").where("text IS NOT NULL")


def _digest(df):
    return df.withColumn("digest", F.md5("sentence")).withColumn("n_chars", F.length("sentence").cast("long")).drop("sentence")


@register("sentence_units", f"WITH {PIECES} SELECT doc_id, chapter, pos, {DIGEST} FROM units")
def sentence_units(spark, sf):
    return _digest(corpus.units(_docs(spark, sf)))


@register("unit_counts", f"WITH {PIECES} SELECT chapter, count(*) AS n FROM units GROUP BY chapter")
def unit_counts(spark, sf):
    return corpus.units(_docs(spark, sf)).groupBy("chapter").agg(F.count(F.lit(1)).alias("n"))


@register("corpus_loss", f"WITH {PIECES} SELECT chapter, count(*) AS total, count(*) FILTER (length(sentence) BETWEEN 12 AND 220) AS kept, count(*) FILTER (length(sentence) < 12) AS too_short, count(*) FILTER (length(sentence) > 220) AS too_long FROM pieces GROUP BY chapter")
def corpus_loss(spark, sf):
    return corpus.loss_report(_docs(spark, sf))


@register(
    "repaired_units",
    rf"""WITH {PIECES},
s AS (SELECT *, CASE WHEN (regexp_matches(sentence, '^[a-z,;:)]') OR length(trim(sentence, ' ')) < 8) AND row_number() OVER (PARTITION BY doc_id ORDER BY pos) > 1 THEN 0 ELSE 1 END AS starts FROM pieces),
g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM s),
o AS (SELECT doc_id, chapter, CAST(island AS BIGINT) AS island, string_agg(sentence, ' ' ORDER BY pos) AS sentence, count(*) AS pieces FROM g GROUP BY doc_id, chapter, island)
SELECT doc_id, chapter, island, pieces, {DIGEST} FROM o""",
)
def repaired_units(spark, sf):
    return _digest(corpus.repair_broken(corpus.pieces(_docs(spark, sf))))


@register(
    "carried_units",
    rf"""WITH {PIECES},
s AS (SELECT *, CASE WHEN regexp_matches(sentence, '[.!?]$') THEN 1 ELSE 0 END AS done FROM pieces),
g AS (SELECT *, coalesce(sum(done) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM s),
o AS (SELECT doc_id, chapter, CAST(island AS BIGINT) AS island, string_agg(sentence, ' ' ORDER BY pos) AS sentence, count(*) AS pieces FROM g GROUP BY doc_id, chapter, island)
SELECT doc_id, chapter, island, pieces, {DIGEST} FROM o WHERE length(sentence) <= 300 OR NOT regexp_matches(sentence, '[.!?]$')""",
)
def carried_units(spark, sf):
    return _digest(corpus.carry_forward(corpus.pieces(_docs(spark, sf))))


@register(
    "corpus_dedupe",
    rf"""WITH {PIECES}
SELECT doc_id, chapter, pos, {DIGEST} FROM units QUALIFY row_number() OVER (PARTITION BY regexp_replace(sentence, '[\s\x{{3000}}]+', '', 'g') ORDER BY doc_id, pos) = 1""",
)
def corpus_dedupe(spark, sf):
    return _digest(corpus.dedupe_units(corpus.units(_docs(spark, sf))).drop("corpus"))


WORDS = r"list_distinct(regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}]{{4,}})'))"
GRAMS = f"""{PIECES},
u AS (SELECT doc_id * 100000 + pos AS unit, chapter, sentence FROM units),
post AS (SELECT unit, unnest({WORDS.format("sentence")}) AS gram FROM u),
hits AS (SELECT gram, count(*) AS hits FROM post GROUP BY gram),
w AS (SELECT gram, hits, hits / (SELECT count(*) FROM u) AS df, pow(1 + 60 * (hits / (SELECT count(*) FROM u)), -1.6) AS weight FROM hits),
q AS (SELECT item_id AS query, unnest({WORDS.format("text")}) AS gram FROM benchmark)"""


def _units(spark, sf):
    return corpus.units(_docs(spark, sf)).select((F.col("doc_id") * 100000 + F.col("pos")).alias("unit"), "chapter", "sentence")


def _queries(spark, sf):
    return B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")


def _first_words(spark, sf):
    """Two words of each benchmark item, as a term."""
    first, second = (F.split_part("text", F.lit(" "), F.lit(k)) for k in (1, 2))
    return _queries(spark, sf).select("query", F.concat(first, F.lit(" "), second).alias("term"))


@register("gram_weight", f"WITH {GRAMS} SELECT gram, hits, round(df, 9) AS df, round(weight, 6) AS weight FROM w")
def gram_weight(spark, sf):
    u = _units(spark, sf)
    w = retrieval.weights(retrieval.postings(u), u)
    return w.withColumn("df", F.round("df", 9)).withColumn("weight", F.round("weight", 6))


@register(
    "retrieve_top",
    f"""WITH {GRAMS}, c AS (SELECT query, unit, count(*) AS hits FROM q JOIN post USING (gram) GROUP BY query, unit)
SELECT query, unit, hits, CAST(row_number() OVER (PARTITION BY query ORDER BY hits DESC, unit) AS INTEGER) AS place FROM c QUALIFY place <= 200""",
)
def retrieve_top(spark, sf):
    return retrieval.candidates(_queries(spark, sf), _units(spark, sf))


@register(
    "retrieve_ranked",
    f"""WITH {GRAMS}, qw AS (SELECT query, q.gram, coalesce(weight, 0.05) AS weight FROM q LEFT JOIN w USING (gram)),
whole AS (SELECT query, sum(weight) AS whole FROM qw GROUP BY query),
have AS (SELECT query, unit, sum(weight) AS have FROM qw JOIN post USING (gram) GROUP BY query, unit),
c AS (SELECT query, unit, round(have / whole, 9) AS cover FROM have JOIN whole USING (query))
SELECT query, unit, round(cover, 6) AS cover, CAST(row_number() OVER (PARTITION BY query ORDER BY cover DESC, unit) AS INTEGER) AS place FROM c QUALIFY place <= 10""",
)
def retrieve_ranked(spark, sf):
    u = _units(spark, sf)
    return retrieval.weighted_coverage(_queries(spark, sf), u, retrieval.weights(retrieval.postings(u), u), 10).withColumn("cover", F.round("cover", 6))


@register(
    "first_matches",
    f"""WITH {GRAMS}, t AS (SELECT item_id AS query, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS term FROM benchmark),
m AS (SELECT query, unit FROM t JOIN u ON contains(lower(sentence), lower(term)) WHERE regexp_matches(lower(term), '[\\p{{L}}\\p{{N}}]{{4,}}')
  AND list_contains({WORDS.format("sentence")}, regexp_extract(lower(term), '([\\p{{L}}\\p{{N}}]{{4,}})', 1)))
SELECT query, unit, CAST(row_number() OVER (PARTITION BY query ORDER BY unit) AS INTEGER) AS place FROM m QUALIFY place <= 4""",
)
def first_matches(spark, sf):
    """The part of first_containing that this query's SQL is limited to: the term's first word of four letters is a word of the unit."""
    pairs = retrieval.containing(_first_words(spark, sf), _units(spark, sf))
    return retrieval.first_units(pairs.where(F.array_contains(retrieval.word_grams(F.col("sentence")), F.try_element_at(T.words(F.col("term"), 4), F.lit(1)))))


@register(
    "first_containing",
    f"""WITH {PIECES}, u AS (SELECT doc_id * 100000 + pos AS unit, sentence FROM units), t AS (SELECT item_id AS query, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS term FROM benchmark)
SELECT query, unit, CAST(row_number() OVER (PARTITION BY query ORDER BY unit) AS INTEGER) AS place FROM t JOIN u ON contains(lower(sentence), lower(term)) QUALIFY place <= 4""",
)
def first_containing(spark, sf):
    return retrieval.first_matches(_first_words(spark, sf), _units(spark, sf))


OPTIONS = f"opts AS (SELECT item_id AS query, gram AS term, item_id % 2 = 0 AS chosen FROM (SELECT item_id, unnest({WORDS.format('text')}) AS gram FROM benchmark))"


def _options(spark, sf):
    return _queries(spark, sf).select("query", F.explode(retrieval.word_grams(F.col("text"))).alias("term"), (F.col("query") % 2 == 0).alias("chosen"))


@register("hit_rates", f"WITH {GRAMS}, {OPTIONS} SELECT chosen, count(*) AS options, count(*) FILTER (hits > 0) AS hits, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM opts LEFT JOIN hits ON term = gram GROUP BY chosen")
def hit_rates(spark, sf):
    return retrieval.hit_rates(_options(spark, sf), retrieval.postings(_units(spark, sf)))


@register("term_counts", f"WITH {PIECES}, t AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS term FROM benchmark), o AS (SELECT unnest(regexp_extract_all(lower(sentence), '([\\p{{L}}\\p{{N}}]{{1,}})')) AS term FROM units) SELECT t.term, count(o.term) AS n FROM t LEFT JOIN o ON t.term = o.term GROUP BY t.term")
def term_counts(spark, sf):
    return corpus.term_counts(corpus.units(_docs(spark, sf)), _options(spark, sf).select("term").distinct())


@register("search_all_keywords", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '') || ' ' || coalesce(source, '')), 'the') AND contains(lower(coalesce(text, '') || ' ' || coalesce(source, '')), 'and')")
def search_all_keywords(spark, sf):
    blob = F.concat_ws(" ", T.text("text"), T.text("source"))
    return B.table(spark, sf, "documents").where(T.search_match(blob, "The and")).select("doc_id")


@register("search_phrase", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'of the')")
def search_phrase(spark, sf):
    return B.table(spark, sf, "documents").where(T.phrase_match(T.text("text"), " Of The ")).select("doc_id")


@register("audit_duplicates", "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1 HAVING count(*) > 1")
def audit_duplicates(spark, sf):
    return audit.duplicate_groups(B.table(spark, sf, "documents"), "doc_id", T.text("text"))


@register("audit_conflicts", "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n, count(DISTINCT quality) AS \"values\" FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) > 1")
def audit_conflicts(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.sha2(T.text("text"), 256).alias("digest"))
    return audit.conflict_groups(d.join(B.table(spark, sf, "labels"), "doc_id"), ["digest"], "quality")


RULES = ("empty", "short", "long", "no_lang", "wrong_length", "double_space", "no_stop")


def _rules():
    t = T.text("text")
    return dict(zip(RULES, (t == "", F.length(t) < 20, F.length(t) > 5000, F.col("lang").isNull(), ~F.col("n_chars").eqNullSafe(F.length(t).cast("long")), F.contains(t, F.lit("  ")), ~t.rlike(r"[.!?]\s*$")), strict=True))


RULE_SQL = r"""t AS (SELECT doc_id, lang, n_chars, coalesce(text, '') AS t FROM documents),
f AS (SELECT unnest([CASE WHEN t = '' THEN 'empty' END, CASE WHEN length(t) < 20 THEN 'short' END, CASE WHEN length(t) > 5000 THEN 'long' END, CASE WHEN lang IS NULL THEN 'no_lang' END,
  CASE WHEN n_chars IS DISTINCT FROM length(t) THEN 'wrong_length' END, CASE WHEN contains(t, '  ') THEN 'double_space' END, CASE WHEN NOT regexp_matches(t, '[.!?]\s*$') THEN 'no_stop' END]) AS rule, doc_id AS id FROM t)"""


@register("audit_rules", f"WITH {RULE_SQL} SELECT rule, id FROM f WHERE rule IS NOT NULL")
def audit_rules(spark, sf):
    return audit.findings(B.table(spark, sf, "documents"), "doc_id", _rules())


@register("audit_report", f"WITH {RULE_SQL}, n AS (SELECT rule, count(*) AS n FROM f GROUP BY rule) SELECT r AS rule, coalesce(n, 0) AS n FROM unnest({list(RULES)}) k(r) LEFT JOIN n ON r = rule")
def audit_report(spark, sf):
    return sinks.rule_report(list(RULES), audit.findings(B.table(spark, sf, "documents"), "doc_id", _rules()))


@register("validation_gate", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN length(text) < 20 THEN 'short' WHEN length(text) > 5000 THEN 'long' END AS reject_reason FROM documents")
def validation_gate(spark, sf):
    few = {k: v for k, v in _rules().items() if k in ("empty", "short", "long")}
    return audit.first_reason(B.table(spark, sf, "documents"), few).select("doc_id", "reject_reason")


@register("length_stats", "SELECT source, count(*) AS n, round(avg(length(text)), 6) AS avg_len, CAST(min(length(text)) AS BIGINT) AS min_len, CAST(max(length(text)) AS BIGINT) AS max_len, count(*) FILTER (length(text) < 20) AS short, count(*) FILTER (length(text) > 200) AS long FROM documents GROUP BY source")
def length_stats(spark, sf):
    return audit.length_stats(B.table(spark, sf, "documents"), "text", ["source"]).withColumns({c: F.col(c).cast("long") for c in ("min_len", "max_len")})


@register("topics", "SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[0-9]{4}') THEN 'dated' WHEN regexp_matches(coalesce(text, ''), '(?i)licen[cs]e') THEN 'licence' WHEN regexp_matches(coalesce(text, ''), 'https?://') THEN 'linked' ELSE 'other' END AS topic FROM documents")
def topics(spark, sf):
    rules = {"dated": "[0-9]{4}", "licence": "(?i)licen[cs]e", "linked": "https?://"}
    return B.table(spark, sf, "documents").select("doc_id", audit.topic(T.text("text"), rules).alias("topic"))


HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"


@register(
    "web_evidence_upsert",
    rf"""WITH b AS (SELECT p_partkey AS id, 'base' AS url, p_partkey % 7 = 0 AS strong FROM part),
i AS (SELECT page_id % 150 AS id, page_id AS ord, page_id % 5 <> 0 AS found, url AS in_url, {HOST} = 'example.org' OR {HOST} LIKE '%.example.org' AS s FROM pages),
p AS (SELECT i.* FROM i JOIN b USING (id) WHERE found AND coalesce(in_url, '') <> ''),
g AS (SELECT id, CASE WHEN bool_or(s) THEN arg_min(in_url, ord) FILTER (s) ELSE arg_max(in_url, ord) END AS in_url, bool_or(s) AS in_strong FROM p GROUP BY id)
SELECT id, CASE WHEN NOT strong AND in_url IS NOT NULL THEN in_url ELSE url END AS url, CASE WHEN NOT strong AND in_url IS NOT NULL THEN in_strong ELSE strong END AS strong,
  CASE WHEN NOT strong AND in_url IS NOT NULL THEN CASE WHEN in_strong THEN 'upgraded' ELSE 'replaced' END WHEN in_url IS NOT NULL THEN 'kept strong' ELSE 'untouched' END AS action
FROM b LEFT JOIN g USING (id)""",
)
def web_evidence_upsert(spark, sf):
    base = B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("base").alias("url"), (F.col("p_partkey") % 7 == 0).alias("strong"))
    new = B.table(spark, sf, "pages").select((F.col("page_id") % 150).alias("id"), F.col("page_id").alias("ord"), (F.col("page_id") % 5 != 0).alias("found"), "url")
    return upsert.upsert_evidence(base, new, ["example.org"])


@register("compare_and_set", "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'checked' ELSE p_brand END AS value FROM part")
def compare_and_set(spark, sf):
    base = B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value"))
    patch = base.where("id % 10 = 0").select("id", F.col("value").alias("old"), F.lit("checked").alias("new"))
    return upsert.compare_and_set(base, patch, "id", "value")


@register("new_rows", "SELECT doc_id AS ord, md5(coalesce(text, '')) AS k FROM documents WHERE doc_id % 2 = 1 AND md5(coalesce(text, '')) NOT IN (SELECT md5(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) = 1")
def new_rows(spark, sf):
    """Texts of odd documents that no even one has: the two halves stand for a bank and what is to be added."""
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.md5(T.text("text")).alias("k"))
    return upsert.new_rows(d.where("ord % 2 = 1"), d.where("ord % 2 = 0"), ["k"]).select("ord", "k")


@register("id_assign", "SELECT doc_id, printf('q-%04d', row_number() OVER (ORDER BY doc_id)) AS id FROM documents")
def id_assign(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id")
    n = sinks.numbered(d, ["doc_id"], "n")
    return n.select("doc_id", F.format_string("q-%04d", F.col("n") + 1).alias("id"))


@register("shard_assign", "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / ceil((SELECT count(*) FROM documents) / 4.0)) AS BIGINT) AS shard FROM documents")
def shard_assign(spark, sf):
    return sinks.contiguous_shards(B.table(spark, sf, "documents").select("doc_id"), ["doc_id"], 4)


@register("batch_index", "WITH n AS (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 100) AS BIGINT) AS batch FROM documents) SELECT batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM n GROUP BY batch")
def batch_index(spark, sf):
    b = sinks.batches(B.table(spark, sf, "documents").select("doc_id"), ["doc_id"], 100)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@register("outline_flatten", "SELECT r_name AS chapter, n_name AS section, s_name AS sub FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey")
def outline_flatten(spark, sf):
    from ..sources.bank import outline_rows

    return outline_rows(_outline(spark, sf)).select("chapter", "section", F.col("sub.title").alias("sub"))


def _outline(spark, sf):
    """One document per region: {chapters: [{chapter, sections: [{section, text, subs: [{title}]}]}]}."""
    n, r, s = (B.table(spark, sf, t) for t in ("nation", "region", "supplier"))
    subs = s.groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_name").alias("title"))).alias("subs"))
    sections = n.join(subs, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("section"), F.lit("").alias("text"), "subs")).alias("sections"))
    return r.join(sections, F.col("r_regionkey") == F.col("n_regionkey")).select(F.array(F.struct(F.col("r_name").alias("chapter"), "sections")).alias("chapters"))


@register("outline_stats", "SELECT r_name AS chapter, count(DISTINCT n_name) AS sections, count(s_name) AS subs FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name")
def outline_stats(spark, sf):
    from ..sources.bank import outline_rows

    return outline_rows(_outline(spark, sf)).groupBy("chapter").agg(F.count_distinct("section").alias("sections"), F.count("sub.title").alias("subs"))


@register("charset_overlap", "SELECT item_id, len(list_distinct(list_filter(string_split(text, ''), lambda x: x <> ''))) AS own, len(list_intersect(list_distinct(string_split(text, '')), string_split('the quick brown fox', ''))) AS shared FROM benchmark")
def charset_overlap(spark, sf):
    own = T.characters(F.col("text"))
    return B.table(spark, sf, "benchmark").select("item_id", F.size(own).cast("long").alias("own"), F.size(F.array_intersect(own, T.characters(F.lit("the quick brown fox")))).cast("long").alias("shared"))


@register("picked_terms")
def picked_terms(spark, sf):
    """Up to six words of each benchmark item, rare and long ones first, none inside another."""
    u = _units(spark, sf)
    w = retrieval.postings(u).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    q = _queries(spark, sf).select("query", F.explode(retrieval.word_grams(F.col("text"))).alias("gram"))
    s = q.join(w, "gram", "left").withColumn("score", F.round(T.keyword_score(F.length("gram"), F.coalesce("df", F.lit(0))), 6))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "gram"))), lambda x: x["gram"])
    return s.groupBy("query").agg(ordered.alias("terms")).select("query", folds.pick_terms(F.col("terms")).alias("terms"))


@register("merged_turns")
def merged_turns(spark, sf):
    """Turns of each conversation with short unfinished ones joined to what follows."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    c = B.table(spark, sf, "conversations").groupBy("conv_id").agg(lines.alias("lines"))
    return c.select("conv_id", F.size("lines").alias("turns"), folds.merge_lines(F.col("lines")).alias("lines"))


@register("running_role", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations")
def running_role(spark, sf):
    down = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return B.table(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(down).alias("last_user"))
