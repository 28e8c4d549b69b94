"""Outlines of running text: chapters, a closed list of section titles aligned in order, and marked paragraphs.

Texts are independent rows; positions are arrays inside a row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text

#: Page heads and numbers stuck to what follows, the marks of paragraphs, and what ends a title.
PAGE = r"=== PAGE \d+ ==="
STUCK_NUMBER = r"(?m)^\s*\d{1,3}(?=第|[㈠-㈩])"
MARKS = "㈠㈡㈢㈣㈤㈥㈦㈧㈨㈩⒈⒉⒊⒋⒌⒍⒎⒏⒐⒑"
TITLE_ENDS = "，。；：()《》\"“”‘’"
ANY_SECTION = r"第[一二三四五六七八九十]+节\s*[^，。；：、\s]{2,12}"
ORDINALS = "一二三四五六七八九十"
LONGEST_TITLE, SPARE_TITLE, LEAST_BLOCK = 20, 18, 4


def tidy(c: Column) -> Column:
    """Text without page heads and stuck page numbers, with single spaces and line breaks."""
    s = F.regexp_replace(F.regexp_replace(text(c), PAGE, ""), STUCK_NUMBER, "")
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t\x{3000}]+", " "), r"\n{2,}", "\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def chapters(c: Column, names: list[str]) -> Column:
    """Array of (title, body): from each chapter heading to the next one; what stands before the first is left out."""
    heading = "第[" + ORDINALS[: len(names)] + "]章(?:" + "|".join(names) + ")"
    pieces = F.filter(F.split(text(c), f"(?={heading})"), lambda p: p.rlike(f"^{heading}"))
    return F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, f"^{heading}", 0).alias("chapter"), p.alias("body")))


def anchors(body: Column, titles: Column, ordered: bool = True) -> Column:
    """Array of (at, title), at from 1 and ascending: where each title stands in the body.

    Ordered, a title is looked for behind the one found before it, so that a mention further up does not take its place; a title that
    is not there takes no place and moves nothing. Unordered, it is the title's first mention.
    """

    def step(state, t):
        begin = state["next"] if ordered else F.lit(1)
        at = F.instr(F.substring(body, begin, F.length(body)), t)
        place = begin + at - 1
        found = F.struct(place.cast("int").alias("at"), t.alias("title"))
        return F.when(at > 0, F.struct((place + F.length(t)).cast("int").alias("next"), F.concat(state["found"], F.array(found)).alias("found"))).otherwise(state)

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,title:string>>").alias("found"))
    return F.array_sort(F.aggregate(titles, start, step, lambda s: s["found"]))


def spans(body: Column, found: Column) -> Column:
    """Array of (section, text): from each anchor to the next one or the end."""

    def one(a, k):
        end = F.coalesce(F.get(found, k + 1)["at"], F.length(body) + 1)
        return F.struct(a["title"].alias("section"), F.regexp_replace(F.substring(body, a["at"], end - a["at"]), r"^\s+|\s+$", "").alias("text"))

    return F.transform(found, one)


def paragraphs(section: Column, marks: str = MARKS) -> Column:
    """Array of (title, text): the blocks of a section that start with a mark at the start of a line; blocks of under four characters go.

    A title is the first line without its mark, cut at 20 characters or the first closing mark; where that leaves nothing, the block's first 18 characters.
    """
    blocks = F.transform(F.split(section, rf"(?m)(?=^\s*[{marks}])"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    good = F.filter(blocks, lambda b: b.rlike(f"^[{marks}]") & (F.length(b) >= LEAST_BLOCK))

    def one(b):
        line = F.regexp_replace(F.substring_index(b, "\n", 1), rf"^[{marks}]\s*|\s+$", "")
        title = F.regexp_replace(F.regexp_replace(F.substring(line, 1, LONGEST_TITLE), f"[{TITLE_ENDS}].*$", ""), r"^\s+|\s+$", "")
        return F.struct(F.when(title != "", title).otherwise(F.substring(b, 1, SPARE_TITLE)).alias("title"), b.alias("text"))

    return F.transform(good, one)


def outline(docs: DataFrame, key: str, column: str, sections: dict[str, list[str]], ordered: bool = True) -> DataFrame:
    """key, chapter_no, chapter, section_no, section, text, subs: a row for each section found.

    `sections` names the sections of each chapter heading (such as 第一章X) in their order. A chapter none of whose titles stands in the text
    takes the first heading of any section in it, if there is one. Null and empty texts give no row; a chapter that comes twice is
    read twice, with its own number.
    """
    names = [h.split("章", 1)[1] for h in sections]
    rows = docs.select(key, F.posexplode(chapters(tidy(F.col(column)), names)).alias("_k", "_c"))
    known = F.create_map(*[x for h, names_ in sections.items() for x in (F.lit(h), F.array(*[F.lit(f"第{ORDINALS[k]}节{n}") for k, n in enumerate(names_)]))])
    titles = F.coalesce(F.try_element_at(known, F.col("_c.chapter")), F.array().cast("array<string>"))
    rows = rows.select(key, (F.col("_k") + 1).alias("chapter_no"), "_c.chapter", "_c.body", titles.alias("_t"))
    spare = F.filter(F.array(F.regexp_extract("body", ANY_SECTION, 0)), lambda t: t != "")
    found = anchors(F.col("body"), F.col("_t"), ordered)
    rows = rows.withColumn("_f", found).withColumn("_f", F.when(F.size("_f") > 0, F.col("_f")).otherwise(anchors(F.col("body"), spare)))
    out = rows.select(key, "chapter_no", "chapter", F.posexplode(spans(F.col("body"), F.col("_f"))).alias("_k", "_s"))
    return out.select(key, "chapter_no", "chapter", (F.col("_k") + 1).alias("section_no"), "_s.section", "_s.text", paragraphs(F.col("_s.text")).alias("subs"))
