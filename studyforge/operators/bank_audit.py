"""Audits of a question bank: consistency of its rows, checks and gates of new rows and notes.

A bank row has id, num (of the id), type, stem, options array<string>, letters array<string> (of the answer;
null where the answer has none), flag boolean (of judge items), explanation, part_answer, part_note,
why map<string,string> (option letter to reason), source, chapter, section, src, ref, key_concept, keywords array<string>,
answer (text of items without letters) and hard. White space of any kind at the ends of texts does not count. Null arrays, maps and
texts count as empty, but as missing where a check asks for the field. Findings are (rule, id, n): n tells how
often the row breaks the rule, or how many rows a group has, whose smallest id stands for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import TYPES
from ..functions.predicates import negative
from ..functions.text import text, trim
from .audit import first_reason

#: Fixed values.
LETTERS = "ABCDEFGH"
SOURCES = ("textbook", "manual", "bank", "template", "web")
REQUIRED = ("id", "type", "stem", "options", "explanation", "source", "chapter", "section", "src", "ref", "key_concept", "keywords", "why", "part_answer")
#: Where a text names answer letters; a letter that starts a word or a code is none.
NAMED = r"(?:^|[\n。；;])\s*(?:正确答案[:：]|正确选项是)\s*([A-H](?:\s*[、,，/]\s*[A-H](?![A-Za-z0-9\-—]))*)(?![A-Za-z0-9\-—])"
CLAIM = r"^([A-H])\s*[（(](.+?)[）)]\s*$"
RIGHT_ONE = r"与正确项\s*([A-H](?:\s*/\s*[A-H])*)"
MARKS = "[、,，/；;（(]"
#: Empty phrases of notes, and what a note must not contain.
PHRASES = ("相近", "容易混淆", "注意区分题干限定的范围", "干扰项", "与题目不符", "本题所问的考点")
NOTE_BAD = r"[A-Za-z]{2,}|\*\*|^#|^\d+[.、)]|`"


def _none() -> Column:
    return F.array().cast("array<string>")


def _place(letter: Column) -> Column:
    """0 for A; -1 for what is no option letter."""
    return F.instr(F.lit(LETTERS), letter) - 1


def _letters(n: Column) -> Column:
    return F.slice(F.array(*map(F.lit, LETTERS)), 1, F.least(n, F.lit(len(LETTERS))))


def _prepared(bank: DataFrame) -> DataFrame:
    objective = F.coalesce(F.col("type").isin("single", "multi"), F.lit(False))
    marked = F.transform(F.coalesce("letters", _none()), lambda x: F.upper(trim(x)))
    ans = F.when(objective, F.array_distinct(F.array_sort(F.filter(marked, lambda x: x != "")))).otherwise(_none())
    return bank.withColumns({"_opts": F.coalesce("options", _none()), "_why": F.coalesce("why", F.map_from_arrays(_none(), _none())), "_obj": objective, "_ans": ans, "_pa": text("part_answer")}).withColumn("_n", F.size("_opts"))


def _shown(n: Column, line: Column) -> Column:
    """Letters of options that an answer line shows: one before a mark, or at its end."""
    end = F.regexp_replace(line, r"[\s\x{a0}\x{3000}]+$", "")
    return F.filter(_letters(n), lambda x: F.regexp_like(line, F.concat(x, F.lit(r"\s*" + MARKS))) | F.endswith(end, x))


def _count(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def _found(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    hit = F.filter(F.array(*[F.struct(F.lit(r).alias("rule"), n.cast("long").alias("n")) for r, n in rules.items()]), lambda x: x["n"] > 0)
    return rows.select("id", F.explode(hit).alias("f")).select("f.rule", "id", "f.n")


def _key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])), 256)


def consistency(bank: DataFrame) -> DataFrame:
    """Findings R1 to R9. One pass tells the rules on rows; groups are told by a hash of their key.

    R1 letter beyond the options; R2 answer does not fit the type; R3 the text behind the answer letter is not the option's;
    R4 the explanation names another letter; R5 a reason refers to a wrong right option; R6 a reason for a right option;
    R7 the same question again; R8 one stem, several answers; R9 the answer line shows other letters than the answer.
    """
    b = _prepared(bank)
    head = trim(F.col("_pa"))
    at = _place(F.regexp_extract(head, CLAIM, 1))
    claim, option = trim(F.regexp_extract(head, CLAIM, 2)), F.get("_opts", at)
    r3 = (claim != "") & (at >= 0) & option.isNotNull() & ~F.contains(option, claim) & ~F.contains(claim, option)
    named = F.regexp_extract_all(F.concat(text("explanation"), F.lit("\n"), text("part_note")), F.lit(NAMED), F.lit(1))
    told = F.flatten(F.transform(named, lambda x: F.regexp_extract_all(x, F.lit("[A-H]"), F.lit(0))))
    r4 = F.col("_obj") & F.exists(told, lambda c: ~F.array_contains("_ans", c) & (_place(c) < F.greatest("_n", F.lit(1))))
    refs = F.transform(F.map_values("_why"), lambda v: F.regexp_extract_all(F.regexp_extract(text(v), RIGHT_ONE, 1), F.lit("[A-H]"), F.lit(0)))
    r5 = F.size(F.filter(refs, lambda r: (F.size(r) > 1) | F.exists(r, lambda c: ~F.array_contains("_ans", c))))
    keyed = F.map_keys(F.map_filter("_why", lambda k, v: v.isNotNull()))
    shown = _shown(F.col("_n"), F.col("_pa"))
    r2 = ((F.col("type") == "multi") & (F.size("_ans") < 2)) | ((F.col("type") == "single") & (F.size("_ans") != 1)) | ((F.col("type") == "judge") & F.col("flag").isNull())
    rows = _found(b, {
        "R1": _count(F.col("_obj") & F.exists("_ans", lambda c: _place(c) >= F.col("_n"))),
        "R2": _count(r2),
        "R3": _count(r3),
        "R4": _count(r4),
        "R5": r5,
        "R6": F.size(F.filter(keyed, lambda k: F.array_contains("_ans", k))),
        "R9": _count(F.col("_obj") & (F.size(shown) > 0) & (shown != F.col("_ans"))),
    })
    stem = F.regexp_replace(text("stem"), r"[^\x{4e00}-\x{9fff}A-Za-z0-9]", "")
    group = lambda rule: (F.lit(rule).alias("rule"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    same = b.groupBy(_key(stem, F.array_sort(F.transform("_opts", lambda x: trim(x)))).alias("k")).agg(*group("R7")).where("n > 1").drop("k")
    judged = b.where(F.col("type").isin("single", "multi", "judge"))
    split = judged.groupBy(_key(stem).alias("k")).agg(*group("R8"), F.min("_ans").alias("lo"), F.max("_ans").alias("hi")).where("lo <> hi").select("rule", "id", "n")
    return rows.unionByName(same).unionByName(split)


def _reasons(b: DataFrame) -> dict[str, Column]:
    """Tests on the reasons for wrong options that the ingest check and the gate share."""
    all_letters = _letters(F.col("_n"))
    wrong = F.array_except(all_letters, "_ans")
    said = F.map_keys(F.map_filter("_why", lambda k, v: trim(v) != ""))
    covered = F.arrays_overlap(said, wrong) | (negative(F.col("stem"), "ingest") & F.arrays_overlap(said, "_ans"))
    return {"stray": F.size(F.array_except(F.map_keys("_why"), all_letters)) > 0, "uncovered": (F.size(wrong) > 0) & ~covered, "needless": (F.size(wrong) == 0) & (F.size("_why") > 0)}


def _beyond(top: str = "D") -> Column:
    return F.exists("_ans", lambda c: ~c.between("A", top)) | F.exists("_ans", lambda c: _place(c) >= F.col("_n"))


def ingest(new: DataFrame, old: DataFrame, chapters: list[str]) -> DataFrame:
    """Findings N1 to N11 on new rows beside the old ones. A row that lacks a field is told as N2 and by its repeats only.

    N1 a number without its forerunner, or an id twice in the whole bank; N2 missing field or unknown type; N3 answer against type
    and options; N4 options against type; N5 explanation; N6 reasons; N7 chapter and section; N8 source; N9 repeats an old row;
    N10 repeats a new row of smaller number; N11 no hard mark. Types of columns (N12) are the schema's business.
    """
    b = _prepared(new)
    answered = F.coalesce("letters", F.when(F.col("flag").isNotNull() | F.col("answer").isNotNull(), _none())).isNotNull()
    have = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in REQUIRED], answered)
    kind, given = F.col("type"), F.coalesce("letters", _none())
    single = (F.size("_ans") != 1) | (F.length(F.array_join("_ans", "")) != 1) | _beyond()
    multi = (F.size(given) < 2) | (given != F.array_sort(F.array_distinct(given))) | _beyond()
    shown, why = _shown(F.col("_n"), F.col("_pa")), _reasons(b)
    blank = lambda c: trim(c) == ""
    rules = {
        "N3": _count(((kind == "single") & single) | ((kind == "multi") & multi) | ((kind == "judge") & F.col("flag").isNull())),
        "N4": _count(F.col("_obj") & (F.col("_n") < 2)) + _count(F.col("_obj") & F.exists("_opts", blank)) + _count(~F.col("_obj") & (F.col("_n") > 0)),
        "N5": _count(blank("explanation")) + _count(F.col("_obj") & (F.size(shown) > 0) & (shown != F.col("_ans"))),
        "N6": F.when(F.col("_obj") & (F.col("_n") > 0), _count(why["stray"]) + _count(why["uncovered"])).otherwise(0),
        "N7": _count(~F.col("chapter").isin(chapters)) + _count(blank("section")),
        "N8": _count(~F.col("src").isin(*SOURCES)) + _count((F.col("src") == "web") & blank("ref")) + _count((F.col("src") == "template") & ~blank("ref")),
        "N11": _count(F.col("hard").isNull()),
    }
    n2 = F.when(~have, 1).otherwise(_count(~kind.isin(*TYPES)))
    rows = _found(b, {"N2": n2, **{r: F.when(have, n).otherwise(0) for r, n in rules.items()}})
    one = lambda df, rule: df.select(F.lit(rule).alias("rule"), "id", F.lit(1).cast("long").alias("n"))
    least = new.agg(F.min("num").alias("least"))  # one row
    gaps = new.join(new.select((F.col("num") + 1).alias("num")).distinct(), "num", "left_anti").join(F.broadcast(least), F.col("num") > F.col("least"))
    ids = new.select("id").unionByName(old.select("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("N1").alias("rule"), "id", "n")
    key = _key(text("stem"), F.coalesce("options", _none()))
    mine = new.select("id", "num", key.alias("k"))
    first = mine.groupBy("k").agg(F.min("num").alias("first"))
    again = mine.join(first, "k").where("num > first")
    return reduce(DataFrame.unionByName, [rows, one(gaps, "N1"), ids, one(mine.join(old.select(key.alias("k")), "k", "left_semi"), "N9"), one(again, "N10")])


def gate(items: DataFrame) -> DataFrame:
    """items with reject_reason, the first that holds, or null: what may enter the bank. Options without text don't count."""
    filled = F.filter(F.transform(F.coalesce("options", _none()), lambda x: trim(x)), lambda x: x != "")
    b = _prepared(items.withColumn("_given", F.col("options")).withColumn("options", filled))
    multi, single = F.col("type") == "multi", F.col("type") == "single"
    ans = F.when(multi, F.filter("_ans", lambda c: c.between("A", "D"))).otherwise(F.col("_ans"))
    b = b.withColumn("_ans", ans)
    why = _reasons(b)
    rules = {
        "unknown type": F.col("type").isNull() | ~F.col("type").isin(*TYPES),
        "empty stem": trim(F.col("stem")) == "",
        "too few options": F.col("_obj") & (F.col("_n") < 2),
        "unreadable judgement": (F.col("type") == "judge") & F.col("flag").isNull(),
        "bad single answer": single & ((F.size("_ans") != 1) | F.exists("_ans", lambda c: (F.length(c) != 1) | ~c.between("A", "D"))),
        "too few answers": multi & (F.size("_ans") < 2),
        "answer beyond options": F.col("_obj") & F.exists("_ans", lambda c: _place(c) >= F.col("_n")),
        "no explanation": trim(F.col("explanation")) == "",
        "unknown source": ~text("src").isin(*SOURCES),
        "stray reason": F.col("_obj") & why["stray"],
        "no reason": F.col("_obj") & why["uncovered"],
        "needless reason": F.col("_obj") & why["needless"],
        "web without ref": (F.col("src") == "web") & (text("ref") == ""),
    }
    return first_reason(b, rules).withColumn("options", F.col("_given")).select(*items.columns, "reject_reason")


def note_gate(notes: DataFrame, bank: DataFrame) -> DataFrame:
    """notes (ord, id, key, text) with reject_reason: unknown item, no wrong option, a right one, repeated, length, phrase, characters.

    Only a note that passes all else counts as a note's first; later ones for the same option are repeats.
    """
    b = _prepared(bank).select("id", "_ans", F.map_keys("_why").alias("_keys"), F.lit(True).alias("_known"))
    t = trim(F.col("text"))
    j = notes.join(b, "id", "left")
    before = {"unknown item": F.col("_known").isNull() | (t == ""), "not a wrong option": ~F.coalesce(F.array_contains("_keys", F.col("key")), F.lit(False)), "right option": F.array_contains("_ans", F.col("key"))}
    phrase = reduce(lambda x, y: x | y, [F.contains(t, F.lit(p)) for p in PHRASES])
    after = {"length": ~F.length(t).between(15, 80), "empty phrase": phrase, "characters": t.rlike(NOTE_BAD)}
    j = first_reason(first_reason(j, before, "_a"), after, "_b")
    good = j.where("_a IS NULL AND _b IS NULL").groupBy("id", "key").agg(F.min("ord").alias("_first"))
    j = j.join(good, ["id", "key"], "left")
    return j.select(*notes.columns, F.coalesce("_a", F.when(F.col("ord") > F.col("_first"), "repeated"), "_b").alias("reject_reason"))


def short_to_fill(bank: DataFrame) -> DataFrame:
    """Short items with a blank in the stem and an answer (text) of 1 to 12 characters become fill items."""
    turn = (F.col("type") == "short") & text("stem").rlike("[_＿]{2,}") & F.length(text("answer")).between(1, 12)
    return bank.withColumn("type", F.when(turn, "fill").otherwise(F.col("type")))
