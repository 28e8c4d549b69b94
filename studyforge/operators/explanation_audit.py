"""Audits of explanations (is there one, does it support the answer, is it well set) and of their web sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import longest_han_run, span_fit
from ..functions.text import CJK, characters, keywords, squeeze, text, trim
from .audit import findings
from .bank_audit import LETTERS, _shown

#: Lengths of a good explanation, how much of the answer it shows, how much of a wrong option and how long that is.
SHORTEST, LONGEST = 8, 400
SUPPORT, WRONG_SUPPORT, LEAST_OPTION = 0.4, 0.7, 3
DECLARED = r"正确答案[:：]\s*([^。\n]*)"
SPACED = rf"[{CJK}][ \t\x{{3000}}]+[{CJK}]"
TWICE = r"(《[^》]{2,30}》)\1"


def answer_letters(kind: Column, letters: Column) -> Column:
    """The option letters of an answer, as given; a single choice with several has none."""
    known = F.filter(F.coalesce(letters, F.array().cast("array<string>")), lambda x: (F.length(x) == 1) & (F.instr(F.lit(LETTERS), x) > 0))
    none = F.array().cast("array<string>")
    return F.when(kind == "single", F.when(F.size(letters) == 1, known).otherwise(none)).when(kind == "multi", known).otherwise(none)


def answer_text(kind: Column, options: Column, letters: Column, flag: Column, answer: Column) -> Column:
    """The text that an explanation has to support: the chosen options joined, the verdict of a judge item, or the answer itself."""
    chosen = F.transform(answer_letters(kind, letters), lambda x: F.coalesce(F.get(options, F.instr(F.lit(LETTERS), x) - 1), F.lit("")))
    verdict = F.when(F.coalesce(flag, F.lit(False)), "正确").otherwise("错误")
    return F.when(kind.isin("single", "multi"), F.array_join(chosen, "")).when(kind == "judge", verdict).otherwise(text(answer))


def explanations(bank: DataFrame) -> DataFrame:
    """rule, id of every fault, over rows (id, type, options, letters, flag, answer, explanation, parts array<string>).

    An explanation supports an answer that it holds, of which it shows a run of two fifths, or whose letters it declares. Only rows that
    neither hold nor declare it are compared by runs, and of these only the unsupported single choices option by option. Short
    answers and empty ones are not compared. Null arrays and texts count as empty.
    """
    said = trim(F.col("explanation"))
    letters = answer_letters(F.col("type"), F.col("letters"))
    declared = _shown(F.size(F.coalesce("options", F.array().cast("array<string>"))), F.regexp_extract(said, DECLARED, 1))
    rows = bank.withColumns({"_e": said, "_l": letters, "_a": answer_text(*[F.col(c) for c in ("type", "options", "letters", "flag", "answer")]), "_d": declared})
    parts = F.coalesce("parts", F.array().cast("array<string>"))
    whole = F.concat(text("explanation"), F.lit("\n"), F.array_join(parts, "\n"))
    plain = findings(rows, "id", {
        "no explanation": F.col("_e") == "",
        "too short": (F.col("_e") != "") & (F.length("_e") < SHORTEST),
        "too long": F.length("_e") > LONGEST,
        "blanks between characters": whole.rlike(SPACED),
        "title twice": whole.rlike(TWICE),
        "empty parts": (F.size(parts) > 0) & F.forall(parts, lambda p: trim(p) == ""),
    })
    told = F.contains(squeeze(F.col("_e")), squeeze(F.col("_a"))) | ((F.size("_l") > 0) & (F.col("_d") == F.array_sort("_l")))
    asked = rows.where((F.col("_e") != "") & (F.col("_a") != "") & ~F.coalesce(F.col("type") == "short", F.lit(False)) & ~told)
    bare = asked.withColumn("_fit", span_fit(F.col("_a"), F.col("_e"))).where(F.col("_fit") < SUPPORT)
    option = bare.where("type = 'single'").select("id", "_e", "_l", F.posexplode("options").alias("_k", "_o"))
    option = option.where((F.length(squeeze(F.col("_o"))) >= LEAST_OPTION) & (F.col("_k") != F.instr(F.lit(LETTERS), F.get("_l", F.lit(0))) - 1))
    wrong = option.withColumn("_fit", span_fit(F.col("_o"), F.col("_e"))).where(F.col("_fit") >= WRONG_SUPPORT).select("id").distinct()
    return plain.unionByName(bare.select(F.lit("answer not supported").alias("rule"), "id")).unionByName(wrong.select(F.lit("wrong option supported").alias("rule"), "id"))


#: The shared run and the shared words that put a source on topic, the characters of its own that it needs, and how much of a reason is compared.
LEAST_RUN, LEAST_WORDS, LEAST_OWN, COMPARED = 4, 2, 6, 40
HAN_ONLY = rf"[^{CJK}]"


def web_sources(bank: DataFrame) -> DataFrame:
    """rule, id, n of every finding on web evidence, over rows (id, type, src, ref, url, stem, options, letters, flag, answer, reason, disputed).

    A reason that shares no run of four Han characters with the stem is reported as such (n is the run), and as off topic if it does not
    hold two of the stem's words either. One of whose distinct Han characters fewer than six are neither the stem's nor the answer's
    repeats the answer (n is how many are). Reasons that begin alike are one group, with its smallest id and its size; they are
    grouped by a hash. Disputed answers are reported whatever their source. Nulls count as empty.
    """
    stem, reason = F.regexp_replace(text("stem"), "[_＿]{2,}", " "), text("reason")
    web = bank.where(F.col("src") == "web").withColumns({"_s": stem, "_r": reason, "_a": answer_text(*[F.col(c) for c in ("type", "options", "letters", "flag", "answer")])})
    web = web.withColumn("_run", longest_han_run(F.col("_s"), F.col("_r")))
    hits = F.size(F.filter(keywords(F.col("_s")), lambda w: (F.length(w) >= 2) & F.contains(F.col("_r"), w)))
    han = lambda c: characters(F.regexp_replace(c, HAN_ONLY, ""))
    own = F.size(F.array_except(F.array_except(han(F.col("_r")), han(F.col("_s"))), han(F.col("_a"))))
    tested = web.select("id", "_run", hits.alias("_hits"), own.alias("_own"), (trim(F.col("ref")) == "").alias("_noref"), (~text("url").rlike("^https?://")).alias("_nourl"))
    short = F.col("_run") < LEAST_RUN
    rules = {
        "no reference": (F.col("_noref"), F.lit(1)),
        "no url": (F.col("_nourl"), F.lit(1)),
        "little shared text": (short, F.col("_run")),
        "off topic": (short & (F.col("_hits") < LEAST_WORDS), F.col("_hits")),
        "repeats the answer": (F.col("_own") < LEAST_OWN, F.col("_own")),
    }
    hit = F.filter(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), n.cast("long").alias("n"))) for r, (c, n) in rules.items()]), lambda x: x.isNotNull())
    single = tested.select("id", F.explode(hit).alias("_f")).select("_f.rule", "id", "_f.n")
    start = F.substring(squeeze(F.col("_r")), 1, COMPARED)
    shared = web.where(start != "").groupBy(F.sha2(start, 256).alias("_h")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    disputed = bank.where(F.coalesce("disputed", F.lit(False))).select(F.lit("disputed").alias("rule"), "id", F.lit(1).cast("long").alias("n"))
    return single.unionByName(shared.select(F.lit("shared reason").alias("rule"), "id", "n")).unionByName(disputed)
