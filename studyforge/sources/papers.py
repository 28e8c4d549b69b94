"""Exam papers with a question zone and an answer zone, whose lines may be spread over many tasks.

A line is one event for each part of the parser's state: the chapter, the kind of question, the open question. An event sets
its part or resets it; a part's state at a line is the last event up to there. Blocks of lines are summed up by
their last events, these summaries are combined in order, and each block starts from what came before it; so a file of any
length is parsed by blocks. Only the lines of one question, and the answers of one chapter, come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import text, trim

#: Lines of a block.
BLOCK = 50_000
#: Kinds of questions and heads of zones, questions and options.
KINDS = "单选题|不定项选择题|多项选择题|判断题|填空题|简答题|论述题"
CHAPTER = r"^第([一二三四五六七八九十百零\d]+)章\s*(.*)$"
SECTION = rf"^(?:[（(]?\s*[一二三四五六七八九十]+\s*[）)]?\s*[、.．]?\s*({KINDS}|多选题|名词解释)\s*|({KINDS}|多选题))$"
GLUED = rf"^(.+?)({KINDS})\s*$"
NUMBERED = r"^(\d{1,3})\s*[.、．]\s*(.*)$"
QUANTITY = r"^\d{1,4}[.．]\d+(万|千|百|亿|%|％|倍|米|千米|公里|吨|人|个)"
OPTION = r"^([A-H])\s*[.、．)）]\s*(.*)$"
OPTION_MARK, INLINE_MARK = r"[A-H]\s*[.、．)）]", r"(?:(?<=^)|(?<=[\s。？，、]))[A-H]\s*[.、．)）]\s*"
ANSWERS, PAGE = r"^答案\s*$", r"^===\s*PAGE\s*\d+\s*===$"
KEY = r"^(第[一二三四五六七八九十]+章)[^\n\d]{0,10}"
ANSWER_NUMBER = r"(?<![\dA-Ha-h])(\d{1,3})\s*[.、．]\s*"


def tidy(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return trim(F.regexp_replace(text(c), r"[\s\x{a0}\x{3000}]+", " "))


def carried(rows: DataFrame, key: str, order: str, events: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """rows with the state of each part: the last event (a struct, or null for none) up to the row, by order within key."""
    marked = rows.withColumns({f"_e_{n}": e for n, e in events.items()}).withColumn("_b", F.floor(F.col(order) / block))
    within = W.partitionBy(key, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ends = marked.groupBy(key, "_b").agg(*[F.max_by(f"_e_{n}", F.when(F.col(f"_e_{n}").isNotNull(), F.col(order))).alias(f"_l_{n}") for n in events])
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # a row for each block
    starts = ends.select(key, "_b", *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_s_{n}") for n in events])
    state = {n: F.coalesce(F.last(f"_e_{n}", ignorenulls=True).over(within), F.col(f"_s_{n}")) for n in events}
    return marked.join(starts, [key, "_b"]).withColumns(state).select(*rows.columns, *events)


def zones(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """file, line_no, line (stripped, without blank ones and page marks) before and after each file's first head of answers."""
    rows = lines.select("file", "line_no", trim(F.col("line")).alias("line")).where("line <> ''")
    heads = rows.where(F.col("line").rlike(ANSWERS)).groupBy("file").agg(F.min("line_no").alias("_head"))
    split = rows.join(heads, "file", "left").where(~F.col("line").rlike(PAGE))
    head = F.col("_head")
    return split.where(head.isNull() | (F.col("line_no") < head)).drop("_head"), split.where(F.col("line_no") > head).drop("_head")


def _inline(c: Column) -> tuple[Column, Column]:
    """Stem and options of a line that holds three option marks or more; else the line and none."""
    parts = F.split(c, INLINE_MARK, -1)
    many = F.size(parts) > 3
    none = F.array().cast("array<string>")
    return F.when(many, trim(F.get(parts, 0))).otherwise(c), F.when(many, F.transform(F.slice(parts, 2, 99), tidy)).otherwise(none)


def parse_paper(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """file, item (its line), chapter, kind, no, stem, options of the numbered questions of the question zone.

    A kind that stands at the end of a line holds from that line on. A quantity is no number of a question; lines without a
    mark go on with the last option, or with the stem if there is none yet.
    """
    c, ev = F.col, lambda v, t="string": F.struct(v.cast(t).alias("v"))
    body, _ = zones(lines)
    line = c("line")
    chapter = line.rlike(CHAPTER) & (F.length(line) <= 30)
    section = F.coalesce(F.nullif(F.regexp_extract(line, SECTION, 1), F.lit("")), F.nullif(F.regexp_extract(line, SECTION, 2), F.lit("")))
    glued = F.nullif(F.regexp_extract(line, GLUED, 2), F.lit(""))
    rows = body.withColumn("_ch", chapter).withColumn("_sec", F.when(~chapter, section)).withColumn("_glued", F.when(~c("_ch") & c("_sec").isNull(), glued))
    rows = rows.withColumn("_body", F.when(c("_ch") | c("_sec").isNotNull(), F.lit(None)).when(c("_glued").isNotNull(), trim(F.regexp_extract(line, GLUED, 1))).otherwise(line))
    kind = F.when(c("_ch"), ev(F.lit(None))).otherwise(F.when(F.coalesce("_sec", "_glued").isNotNull(), ev(F.coalesce("_sec", "_glued"))))
    rows = carried(rows, "file", "line_no", {"chapter": F.when(c("_ch"), ev(tidy(line))), "kind": kind}, block)
    ready = c("chapter.v").isNotNull() & c("kind.v").isNotNull()
    numbered, quantity = c("_body").rlike(NUMBERED), c("_body").rlike(QUANTITY)
    starts = F.coalesce(ready & numbered & ~quantity, F.lit(False))
    rows = rows.withColumn("_starts", starts)
    item = F.when(c("_starts"), ev(c("line_no"), "long")).when(c("_ch") | F.coalesce("_sec", "_glued").isNotNull(), ev(F.lit(None), "long"))
    rows = carried(rows, "file", "line_no", {"item": item}, block).where(c("item.v").isNotNull() & c("_body").isNotNull())
    role = F.when(c("_starts"), "question").when(c("_body").rlike(NUMBERED) & c("_body").rlike(QUANTITY), "more").when(c("_body").rlike(OPTION), "options").otherwise("more?")
    stem, inline = _inline(F.when(c("_starts"), F.regexp_extract("_body", NUMBERED, 2)).otherwise(c("_body")))
    marked = F.transform(F.slice(F.split("_body", OPTION_MARK, -1), 2, 12), tidy)
    rows = rows.select("file", c("item.v").alias("item"), "line_no", c("chapter.v").alias("chapter"), c("kind.v").alias("kind"), role.alias("role"), c("_body").alias("line"), stem.alias("stem"), F.when(role == "options", marked).otherwise(inline).alias("options"), F.when(c("_starts"), F.regexp_extract("_body", NUMBERED, 1).cast("int")).alias("no"))
    state = lambda s, o: F.struct(s.alias("stem"), o.alias("options"))

    def fold(acc, x):
        has = F.size(acc["options"]) > 0
        last = F.concat(F.slice(acc["options"], F.lit(1), F.greatest(F.size(acc["options"]) - 1, F.lit(0))), F.array(tidy(F.concat(F.try_element_at(acc["options"], F.lit(-1)), x["line"]))))
        plain = F.when(has, state(acc["stem"], last)).otherwise(state(tidy(F.concat(acc["stem"], x["line"])), acc["options"]))
        opened = (x["role"] == "more?") & ~has & (F.size(x["options"]) > 0)
        return (
            F.when(x["role"] == "question", state(tidy(x["stem"]), x["options"]))
            .when(x["role"] == "options", state(acc["stem"], F.concat(acc["options"], x["options"])))
            .when(opened, state(tidy(F.concat(acc["stem"], F.lit(" "), x["stem"])), x["options"]))
            .otherwise(plain)
        )

    parts = F.array_sort(F.collect_list(F.struct("line_no", "role", "line", "stem", "options")))
    whole = rows.groupBy("file", "item").agg(F.first("chapter").alias("chapter"), F.first("kind").alias("kind"), F.max("no").alias("no"), parts.alias("parts"))
    done = F.aggregate("parts", state(F.lit(""), F.array().cast("array<string>")), fold)
    return whole.withColumn("done", done).select("file", "item", "chapter", "kind", "no", "done.stem", "done.options")


def parse_answers(lines: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The answer zone: (file, chapter key, objective text) and (file, chapter key, no, answer) of the numbered answers that follow it.

    A chapter's lines stand together whatever lies between them; of a number given twice the last text counts.
    """
    c = F.col
    _, tail = zones(lines)
    key = F.nullif(F.regexp_extract("line", KEY, 1), F.lit(""))
    rows = carried(tail, "file", "line_no", {"key": F.when(key.isNotNull(), F.struct(key.alias("v")))}, block).where("key IS NOT NULL")
    rows = rows.select("file", c("key.v").alias("key"), "line_no", F.when(key.isNotNull(), F.regexp_replace("line", KEY, "")).otherwise(c("line")).alias("line")).where("line <> ''")
    blob = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    b = rows.groupBy("file", "key").agg(blob.alias("blob"))
    at = F.regexp_instr("blob", F.lit(ANSWER_NUMBER + r"(?=[①\x{4e00}-\x{9fff}]|\d)"))
    b = b.withColumn("_at", at).withColumn("_tail", F.when(c("_at") > 0, F.expr("substring(blob, _at)")).otherwise(""))
    objective = b.select("file", "key", F.when(c("_at") > 0, F.expr("substring(blob, 1, _at - 1)")).otherwise(c("blob")).alias("objective"))
    numbers, texts = F.regexp_extract_all("_tail", F.lit(ANSWER_NUMBER), F.lit(1)), F.split("_tail", ANSWER_NUMBER, -1)
    each = b.select("file", "key", F.posexplode(F.arrays_zip(numbers.alias("no"), F.slice(texts, 2, 100_000).alias("t"))).alias("pos", "x"))
    each = each.select("file", "key", "pos", c("x.no").cast("int").alias("no"), tidy(c("x.t")).alias("answer")).where("answer <> ''")
    return objective, each.groupBy("file", "key", "no").agg(F.max_by("answer", "pos").alias("answer"))


def attach_by_number_or_place(items: DataFrame, by_number: DataFrame, by_place: DataFrame, group: list[str]) -> DataFrame:
    """items (group, no, place) with the answer of their number, or else the one in their place; `by` tells which, null for neither."""
    a = by_number.select(*group, "no", F.col("answer").alias("_a"))
    b = by_place.select(*group, "place", F.col("answer").alias("_b"))
    j = items.join(a, [*group, "no"], "left").join(b, [*group, "place"], "left")
    by = F.when(F.col("_a").isNotNull(), "number").when(F.col("_b").isNotNull(), "place")
    return j.select(*items.columns, F.coalesce("_a", "_b").alias("answer"), by.alias("by"))
