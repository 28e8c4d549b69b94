"""Stored practice sessions: restored only whole, each field checked by the type of its question.

A session is a JSON document {ver, ids, order, i, title, seed, wrongMode, draft, perm, revealedRef, res}. It is
void unless it parses, has the version, a known order and a list of ids that are all texts and all in the bank: a
relational division, done as one join of the listed ids with the bank and a count for each session. Entries of a
valid session are checked one by one, and those that fail are left out while the others stay.

Documents of any shape are read as variants. Defined results: null, broken or non-object documents and documents
that repeat a key are void; an id listed twice is two places of the session but one question; entries of ids
that the session does not list are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import to_int
from .folds import stored

#: Letters of options, orders of a session, and what JavaScript's trim takes for white space.
LETTERS = "ABCDEFGH"
ORDERS = ("seq", "rand")
NOT_BLANK = r"[^\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Parts of a document that hold an entry for each question.
PARTS = {"draft": "$.draft", "perm": "$.perm", "flag": "$.revealedRef", "result": "$.res"}


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, *shapes: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).isin(*shapes), F.lit(False))


def _number(v: Column) -> Column:
    """The number that a variant is; null for a text or anything else."""
    return F.when(F.schema_of_variant(v).rlike(r"^(BIGINT|DECIMAL.*|DOUBLE)$"), _get(v, "$", "double"))


def _text(v: Column) -> Column:
    return F.when(_is(v, "STRING"), _get(v, "$", "string"))


def _strings(v: Column) -> Column:
    """The list of texts that a variant is; null if it is none or holds anything else."""
    found = F.when(_is(v, "ARRAY<STRING>", "ARRAY<VOID>"), _get(v, "$", "array<string>"))
    return F.when(F.forall(found, lambda x: x.isNotNull()), found)


def truthy(v: Column) -> Column:
    """Whether JavaScript takes a value for true."""
    plain = F.when(_is(v, "BOOLEAN"), _get(v, "$", "boolean")).when(_is(v, "STRING"), _text(v) != "").when(_number(v).isNotNull(), _number(v) != 0)
    return v.isNotNull() & F.when(_is(v, "VOID"), False).otherwise(F.coalesce(plain, F.lit(True)))


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted and merged: a document's entries are many times what Spark takes them for, and the driver holds a side that is broadcast."""
    return df.hint("merge")


def _heads(docs: DataFrame, version: int) -> DataFrame:
    """session, doc, ids of documents whose own fields are right."""
    # each document is parsed once: nothing is moved below an explode, while a filter on a plain column would repeat the parse
    parsed = docs.select("session", F.explode(F.array(F.try_parse_json("json"))).alias("doc"))
    told = F.struct(_strings(_get(F.col("doc"), "$.ids")).alias("ids"))
    rows = parsed.select("session", "doc", F.explode(F.array(told)).alias("t")).select("session", "doc", "t.ids")
    return rows.where((_number(_get(F.col("doc"), "$.ver")) == version) & (F.size("ids") > 0) & _text(_get(F.col("doc"), "$.order")).isin(*ORDERS))


def _members(heads: DataFrame, bank: DataFrame) -> DataFrame:
    """session, question, type, n_options: the distinct ids of sessions all of whose ids are in the bank."""
    listed = heads.select("session", F.explode(F.array_distinct("ids")).alias("question"))
    known = bank.select("question", F.col("type"), F.col("n_options"), F.lit(True).alias("found"))
    all_found = F.every(F.col("found").isNotNull()).over(W.partitionBy("session"))
    return listed.join(spread(known), "question", "left").withColumn("whole", all_found).where("whole").drop("whole", "found")


def restore_sessions(docs: DataFrame, bank: DataFrame, version: int = 1, title: str = "") -> DataFrame:
    """session, ids, place, order, title, seed, wrong_mode of every valid session.

    docs: session (unique), json. bank: question (unique), type, n_options. The place is put within
    the list, and an absent or empty title becomes the one given.
    """
    heads = _heads(docs, version)
    d = F.col("doc")
    as_text = lambda path: _get(d, path, "string")
    own = F.when(truthy(_get(d, "$.title")), as_text("$.title"))
    place = F.least(F.greatest(to_int(as_text("$.i")), F.lit(0)), F.size("ids") - 1)
    fields = heads.select(
        "session",
        "ids",
        place.cast("int").alias("place"),
        as_text("$.order").alias("order"),
        F.coalesce(own, F.lit(title)).alias("title"),
        to_int(as_text("$.seed")).alias("seed"),
        truthy(_get(d, "$.wrongMode")).alias("wrong_mode"),
    )
    # written, since they are read for the listed ids and again for the result
    fields = stored(fields, "sessions")
    return fields.join(spread(_members(fields, bank).select("session").distinct()), "session", "left_semi")


def _picked_ok(v: Column) -> Column:
    """Whether a value may be the answer under way to a question of its row's type."""
    letters = F.slice(F.split(F.lit(LETTERS), ""), 1, F.least(F.coalesce("n_options", F.lit(0)), F.lit(len(LETTERS))))
    many = _strings(v)
    distinct = (F.size(many) == F.size(F.array_distinct(many))) & (F.size(F.array_except(many, letters)) == 0)
    kind = F.coalesce("type", F.lit(""))
    ok = F.when(kind == "single", F.array_contains(letters, _text(v))).when(kind == "multi", distinct).when(kind == "judge", _is(v, "BOOLEAN")).when(kind == "fill", many.isNotNull()).otherwise(_text(v).isNotNull())
    return F.coalesce(ok, F.lit(False))


def _answered(v: Column) -> Column:
    """Whether a right-typed value says anything: no empty list, no blank text."""
    many = _strings(v)
    said = F.when(F.col("type") == "multi", F.size(many) > 0).when(F.col("type") == "fill", F.exists(many, lambda x: x.rlike(NOT_BLANK))).when(F.col("type").isin("single", "judge"), True).otherwise(_text(v).rlike(NOT_BLANK))
    return F.coalesce(said, F.lit(False))


def session_entries(docs: DataFrame, bank: DataFrame, version: int = 1) -> DataFrame:
    """session, part, question, value (JSON), ok, self, ts: entries of valid sessions that fit their question.

    part: draft, perm (an order of all the question's letters), flag (a boolean) or result ({picked, ok, self, ts};
    a short answer judged by the learner needs no pick). ok, self and ts are of results alone.
    """
    heads = _heads(docs, version)
    members = _members(heads, bank)
    parts = [F.struct(F.lit(p).alias("part"), _get(F.col("doc"), path, "map<string,variant>").alias("entries")) for p, path in PARTS.items()]
    rows = heads.select("session", F.explode(F.array(*parts)).alias("p")).select("session", "p.part", F.explode("p.entries").alias("question", "v"))
    j = rows.join(spread(members), ["session", "question"])
    v, part = F.col("v"), F.col("part")
    picked = F.when(part == "result", _get(v, "$.picked")).otherwise(v)
    ok, own, ts = _get(v, "$.ok"), _get(v, "$.self"), _get(v, "$.ts", "string")
    letters = _strings(v)
    n = F.coalesce("n_options", F.lit(0))
    order = (F.size(letters) == n) & (F.size(F.array_distinct(letters)) == n) & (F.size(F.array_except(letters, F.slice(F.split(F.lit(LETTERS), ""), 1, F.least(n, F.lit(len(LETTERS)))))) == 0)
    by_learner = (F.col("type") == "short") & _is(own, "BOOLEAN") & F.coalesce(_get(own, "$", "boolean"), F.lit(False)) & _get(v, "$.picked").isNull()
    result = _is(ok, "BOOLEAN") & (by_learner | (_picked_ok(picked) & _answered(picked)))
    keep = F.when(part == "perm", order).when(part == "flag", _is(v, "BOOLEAN")).when(part == "result", result).otherwise(_picked_ok(v))
    of_result = lambda c: F.when(part == "result", c)
    return j.where(keep).select(
        "session",
        "part",
        "question",
        F.coalesce(F.to_json(picked), F.lit('""')).alias("value"),
        of_result(_get(v, "$.ok", "boolean")).alias("ok"),
        of_result(truthy(own)).alias("self"),
        of_result(F.greatest(to_int(ts), F.lit(0))).alias("ts"),
    )
