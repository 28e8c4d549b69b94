"""Rule tables that rewrite a text, as one column expression.

A table is a list of (pattern, replacement) pairs, applied in order. `settle` applies a table until
nothing changes, at most so many times, and stops early: the state of the fold holds whether the last
pass changed the text, so a settled text costs a comparison instead of another pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, text

#: Blanks inside a line, and what takes part in the rules below.
GAP = r"[ \t\x{3000}]"
OPENING, CLOSING, STOPS = "（(〔【《〈“”‘’", "）)〕】》〉，。；：、！？", "、，。；：！？"
ORDINAL = r"[一二三四五六七八九十\p{Nd}]+"
BLANK = r"[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: What extraction from pages leaves in a sentence, in the order in which it is taken out.
NOISE_BEFORE = [
    (rf"^(?:{BLANK}|[.·。])+|^\p{{Nd}}{{1,3}}{BLANK}*[.、．]{BLANK}*", ""),  # loose marks or a number at the start
    (rf"^★?{BLANK}*知{BLANK}*识{BLANK}*链{BLANK}*接{BLANK}*[:：]?{BLANK}*", ""),  # the running head of a box
    (rf"(?<=[{OPENING}]){GAP}+", ""),
    (rf"{GAP}+(?=[{CLOSING}])", ""),
    (rf"(?<=[{STOPS}]){GAP}+", ""),
    (r"(?<=[0-9]) +(?=[0-9])", ""),
]
SPLIT_HAN = [(rf"(?<=[{CJK}]){GAP}+(?=[{CJK}])", "")]
NOISE_AFTER = [
    (rf"(?<=[{CJK}]){GAP}+(?=[0-9A-Za-z])|(?<=[0-9A-Za-z]){GAP}+(?=[{CJK}])", ""),
    (rf"[（(]{BLANK}*[)）]", ""),
    (r"([，。；、！？])\1+", "$1"),
    (r"(《[^》]{2,30}》)\1+", "$1"),  # a title printed twice: the page's head and the text
    (r"(“[^”]{2,30}”)\1+", "$1"),
    (rf"{GAP}{{2,}}", " "),
]
ITEM_NUMBER = rf"^(?:[（(]{BLANK}*{ORDINAL}{BLANK}*[)）]|{ORDINAL}{BLANK}*[、.．]){BLANK}*"
ENDS = r"^[ \t\x{3000}.·。，、；：]+|[ \t\x{3000}.·。，、；：]+$"
#: A heading of 3 to 8 characters that comes again within 22 is one; shorter texts have none.
HEADING, REACH, LEAST = range(8, 2, -1), 22, 12

#: What a note says where a corpus has no evidence, long forms first, and what stands in for it.
NO_REASON = "教材中未收录与该题直接对应的内容，建议对照原卷核实"
NO_REASON_FORMS = [NO_REASON, "本题库未收录教材中的直接出处，建议对照原卷核实", "本题库未收录教材中的直接出处", "教材中未收录与该题直接对应的内容", "建议对照原卷核实"]
JUDGE_NOTE = "本题由单选题派生，判断该表述是否与教材原文一致"
NOTE_MARKS = " 。；，、"
MANUAL_SOURCE, MANUAL_WORD = "manual", "人工"


def rewritten(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The text after each rule once, in order."""
    return reduce(lambda s, r: F.regexp_replace(s, r[0], r[1]), rules, c)


def settle(c: Column, step, most: int = 4) -> Column:
    """The text after `step` (a function of columns) until it changes nothing, at most `most` times."""

    def turn(state, _):
        new = step(state["s"])
        # a settled text is not rewritten again: CASE tests the flag before it evaluates the step
        return F.when(state["done"], state).otherwise(F.struct(new.alias("s"), (new == state["s"]).alias("done")))

    start = F.struct(text(c).alias("s"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, turn, lambda state: state["s"])


def _with(c: Column, f) -> Column:
    """f(c) with c evaluated once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def without_heading(c: Column) -> Column:
    """The text without its item number and, where the text's first 3 to 8 characters come again close by, without what stands before that.

    The repetition tells a heading that was printed into the text's first line; without it nothing but the number goes.
    """

    def cut(body):
        found = F.lit(None).cast("string")
        for size in reversed(HEADING):
            at = F.instr(body.substr(size + 1, REACH), body.substr(1, size))
            found = F.when(at > 0, body.substr(F.lit(size) + at, F.length(body))).otherwise(found)
        return F.coalesce(found, body)

    def start(s):
        return _with(F.regexp_replace(s, ITEM_NUMBER, ""), lambda b: F.when(F.length(b) >= LEAST, cut(b)).when(b == "", s).otherwise(b))

    return _with(c, start)


def clean_evidence(c: Column) -> Column:
    """A sentence of a corpus as it can be shown: without blanks between Han characters and beside marks, doubled titles, marks and quotes, item numbers and headings.

    Null is empty. Blanks between a closing and an opening mark stay.
    """
    s = F.regexp_replace(F.translate(text(c), "\x00\ufeff", " "), r"[\x{1}-\x{8}\x{b}\x{c}\x{e}-\x{1f}]", " ")
    s = settle(rewritten(s, NOISE_BEFORE), lambda x: rewritten(x, SPLIT_HAN))
    return F.regexp_replace(without_heading(rewritten(s, NOISE_AFTER)), ENDS, "")


def without_excuse(c: Column) -> Column:
    """A note without the phrases that say that there is no evidence, and without the marks that these leave."""

    def step(s):
        for form in NO_REASON_FORMS:
            s = F.replace(s, F.lit(form), F.lit(""))
        s = F.regexp_replace(F.regexp_replace(s, "[。；，、]{2,}", "。"), rf"{BLANK}{{2,}}", " ")
        return F.regexp_replace(s, f"^[{NOTE_MARKS}]+|[{NOTE_MARKS}]+$", "")

    return settle(c, step)


def note(current: Column, reason: Column, kind: Column, source: Column) -> Column:
    """A question's note made anew; null if nothing is left to say.

    Notes made by hand stay, without excuses. Else a question without a reason says so once; a judge item says where it comes from
    and drops what it said before; others keep what is left of their note.
    """
    gap = rf"^{BLANK}+|{BLANK}+$"
    old = F.regexp_replace(text(current), gap, "")
    tail = without_excuse(old)
    by_hand = F.coalesce(source == MANUAL_SOURCE, F.lit(False)) | F.contains(old, F.lit(MANUAL_WORD))
    judge = F.coalesce(kind == "judge", F.lit(False))
    lacks = F.regexp_replace(text(reason), gap, "") == ""
    parts = F.array(F.when(judge, F.lit(JUDGE_NOTE)), F.when(lacks, F.lit(NO_REASON)), F.when(~judge & (tail != ""), tail))
    made = F.regexp_replace(F.when(by_hand, tail).otherwise(F.array_join(parts, "。")), "^。+|。+$", "")
    return F.when(made != "", made)


def hits(c: Column, rules: list[tuple[str, str]]) -> list[Column]:
    """For each rule, whether it changes the text, each rule applied after those before it."""
    out, s = [], text(c)
    for pattern, new in rules:
        t = F.regexp_replace(s, pattern, new)
        out.append(t != s)
        s = t
    return out
