"""Keyed updates: evidence upserts, compare-and-set patches, backfills and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rewrites import clean_evidence
from ..functions.text import CJK, grams, text, words
from .audit import first_reason

#: Fixed values.
CONFIDENCES = ("high", "medium", "low")
LEAST_REASON = 12


def host(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def authoritative(url, allowed: list[str]):
    """Whether a url's host is an allowed domain or below one."""
    h = host(url)
    out = F.lit(False)
    for d in allowed:
        out = out | (h == d) | h.endswith("." + d)
    return out


def upsert_evidence(base: DataFrame, incoming: DataFrame, allowed: list[str]) -> DataFrame:
    """base (id, url, strong) after incoming (id, ord, found, url), with action.

    Gates in order: unknown id, nothing found, no url. What passes replaces weak evidence, from any
    source; strong evidence (an allowed source) stays. merge_web has the full set of gates. Several rows for an id act one after the other, so the
    first strong one wins, or else the last.
    """
    strong = authoritative(F.col("in_url"), allowed)
    rows = incoming.select("id", "ord", "found", F.col("url").alias("in_url"))
    j = rows.join(base.select("id", F.lit(True).alias("known")), "id", "left")
    gates = {"unknown id": F.col("known").isNull(), "not found": ~F.coalesce("found", F.lit(False)), "no url": F.coalesce("in_url", F.lit("")) == ""}
    passed = first_reason(j, gates).where("reject_reason IS NULL").withColumn("in_strong", strong)
    pick = F.when(F.max("in_strong"), F.min_by("in_url", F.when(F.col("in_strong"), F.col("ord")))).otherwise(F.max_by("in_url", "ord"))
    best = passed.groupBy("id").agg(pick.alias("in_url"), F.max("in_strong").alias("in_strong"))
    out = base.join(best, "id", "left")
    take = ~F.coalesce("strong", F.lit(False)) & F.col("in_url").isNotNull()
    action = F.when(take & F.col("in_strong"), "upgraded").when(take, "replaced").when(F.col("in_url").isNotNull(), "kept strong").otherwise("untouched")
    return out.select("id", F.when(take, F.col("in_url")).otherwise(F.col("url")).alias("url"), F.when(take, F.col("in_strong")).otherwise(F.col("strong")).alias("strong"), action.alias("action"))


def on_topic(stem: Column, reason: Column, letters: str = CJK, least: int = 2) -> Column:
    """Whether a reason shares a run of three letters with the stem, or holds two or more of its words."""
    runs = lambda c: F.filter(grams(text(c), 3), lambda g: g.rlike(f"^[{letters}]{{3}}$"))
    terms = F.array_distinct(words(stem, 2, letters))
    return F.arrays_overlap(runs(stem), runs(reason)) | (F.size(F.filter(terms, lambda w: F.contains(F.lower(text(reason)), w))) >= least)


def merge_web(base: DataFrame, incoming: DataFrame, allowed: list[str], letters: str = CJK) -> tuple[DataFrame, DataFrame]:
    """base (id, stem, src, reason, url, disputed) after incoming (id, ord, found, confidence, url, reason, disputed), and each incoming row with its reject_reason.

    Gates in order: unknown id; has evidence already, unless it is a web source that is not allowed and the new one is; not found;
    source not allowed; unknown confidence; reason too short; off topic. Rows of an id act in their order: what is taken is from
    an allowed source, so all after the first accepted row find evidence already there.
    """
    b = base.select("id", "stem", F.col("src").alias("_src"), F.col("url").alias("_url"), (text("reason") != "").alias("_has"), F.lit(True).alias("_known"))
    url = F.trim(text("url"))
    rows = incoming.withColumns({"url": url, "reason": clean_evidence(F.col("reason"))}).join(b, "id", "left")
    good = authoritative(F.col("url"), allowed) & F.col("url").rlike("^https?://")
    better = (F.col("_src") == "web") & ~authoritative(text("_url"), allowed) & good
    gates = {
        "unknown id": F.col("_known").isNull(),
        "has evidence": F.col("_has") & ~F.coalesce(better, F.lit(False)),
        "not found": ~F.coalesce("found", F.lit(False)),
        "source not allowed": ~good,
        "unknown confidence": ~F.lower(text("confidence")).isin(*CONFIDENCES),
        "too short": F.length("reason") < LEAST_REASON,
        "off topic": ~on_topic(F.regexp_replace(text("stem"), "[_＿]{2,}", " "), F.col("reason"), letters),
    }
    tested = first_reason(rows, gates)
    first = tested.where("reject_reason IS NULL").groupBy("id").agg(F.min_by(F.struct("ord", "url", "reason", "disputed"), "ord").alias("_new"))
    log = tested.join(first.select("id", F.col("_new.ord").alias("_first")), "id", "left").withColumn("reject_reason", F.when(F.col("ord") > F.col("_first"), "has evidence").otherwise(F.col("reject_reason")))
    j = base.join(first, "id", "left")
    new = F.col("_new").isNotNull()
    take = {c: F.when(new, F.col("_new")[c]).otherwise(F.col(c)) for c in ("url", "reason")}
    out = j.withColumns({**take, "src": F.when(new, "web").otherwise(F.col("src")), "disputed": F.coalesce(F.when(new, F.col("_new.disputed")), "disputed", F.lit(False))})
    return out.select(*base.columns), log.select(*incoming.columns, "reject_reason")


def compare_and_set(base: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """base with patched values; patches (key, old, new). A row that is neither old nor new makes the query fail; running twice changes nothing."""
    j = base.join(patches.select(key, "old", "new"), key, "left")
    ok = F.col("new").isNull() | F.col(column).eqNullSafe(F.col("old")) | F.col(column).eqNullSafe(F.col("new"))
    value = F.when(~ok, F.raise_error(F.concat(F.lit(f"{column} has neither the old nor the new value at "), F.col(key).cast("string")))).when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col(column))
    return j.select(*[value.cast(base.schema[column].dataType).alias(c) if c == column else F.col(c) for c in base.columns])


def new_rows(incoming: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """Incoming rows whose key the base lacks; of repeated keys the first by ord stays."""
    once = incoming.withColumn("_t", F.row_number().over(W.partitionBy(*on).orderBy("ord"))).where("_t = 1").drop("_t")
    return once.join(base.select(*on), on, "left_anti")


def append_numbered(base: DataFrame, new: DataFrame, id_column: str, order: list[str], form: str = "q-%04d") -> DataFrame:
    """base and new rows, whose ids go on from the base's largest number."""
    from ..sources.sinks import numbered

    top = base.agg(F.coalesce(F.max(F.regexp_extract(id_column, r"(\d+)$", 1).cast("long")), F.lit(0)).alias("_top"))
    rows = numbered(new, order, "_n").join(F.broadcast(top)).withColumn(id_column, F.format_string(form, F.col("_top") + F.col("_n") + 1)).drop("_n", "_top")
    return base.unionByName(rows, allowMissingColumns=True)


def flag_by_id_or_stem(rows: DataFrame, by_id: DataFrame, by_stem: DataFrame, name: str = "hard") -> DataFrame:
    """The flag of the row's id if the id is listed (even if null), else that of its stem, else false."""
    a = by_id.select("id", F.col("flag").alias("_a"), F.lit(True).alias("_has"))
    b = by_stem.select("stem", F.col("flag").alias("_b"))
    j = rows.join(a, "id", "left").join(b, "stem", "left")
    return j.withColumn(name, F.coalesce(F.when(F.col("_has"), F.col("_a")).otherwise(F.col("_b")), F.lit(False))).drop("_a", "_b", "_has")


def backfill(rows: DataFrame, source: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Empty columns filled from the last source row of the key (by ord); `keep` columns never change."""
    cols = [c for c in rows.columns if c in source.columns and c not in (key, *keep)]
    last = source.groupBy(key).agg(*[F.max_by(c, "ord").alias(f"_{c}") for c in cols])
    j = rows.join(last, key, "left")
    return j.withColumns({c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}).select(*rows.columns)
