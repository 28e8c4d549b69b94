"""Yes-or-no tests and text gates on stems, sentences and concepts, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text, trim

#: How a stem asks for what is NOT so; each user has its own pattern, and they differ on purpose.
NEGATIVE = {
    "explain": "不属于|不包括|不正确|错误的是|有误的是|不是.*的是|以下不是|不列入",
    "analyse": "不属于|不包括|不是|不正确|错误的是|有误的是|以下不是",
    "audit": "不属于|不包括|不是|不正确|不符合|错误|例外|除(?:了)?哪|哪(?:一)?项不",
    "ingest": "不属于|不包括|不是|不正确的|错误的是|除外|不对的",
}
#: Several questions in a row, or one at the end; a decimal with a unit at the start of a line.
#: Together `([^。？?]{4,30}[?？]){2,}|[?？]\s*$`, which tries runs of 30 characters from every place of any text: NEAR_MARKS, which starts at a mark, comes first.
NEAR_MARKS, IN_A_ROW, ASKED_LAST = r"[?？][^。？?]{4,30}[?？]", r"[^。？?]{4}[?？][^。？?]{4,30}[?？]", r"[?？]\s*$"
QUESTION_NUMBER = r"^(\d{1,3})\s*[.、．]\s*(.*)$"
DECIMAL = r"^\d{1,4}[.．]\d+(万|千|百|亿|%|％|倍|米|千米|公里|吨|人|个)"
#: What a concept's name must not look like.
CONCEPT_STARTS = "^(哪|什|么|怎|把|将|使|促使|让|带领)"
CONCEPT_TAILS = "(的|和|与|及|在|于|是|为|把|被|对|而|以|其|所|就|也|都)$"
CLAUSE = "[，,；;。].{4,}"
TIME_ONLY = r"^[年月日时分秒第上下旬初末春秋\s]+$"


def negative(stem: Column, use: str, kind: Column | None = None) -> Column:
    """Whether a stem asks for the exception, as `use` (a key of NEGATIVE) understands it; for the audit judge items never do."""
    hit = text(stem).rlike(NEGATIVE[use])
    return hit & ~F.coalesce(kind == "judge", F.lit(False)) if use == "audit" and kind is not None else hit


def exercise(sentence: Column) -> Column:
    """Whether a sentence is a list of questions and so no evidence."""
    c = text(sentence)
    return c.rlike(ASKED_LAST) | (c.rlike(NEAR_MARKS) & c.rlike(IN_A_ROW))


def numbered_question(line: Column) -> Column:
    """Whether a line starts a numbered question; 1.8万 and the like are quantities."""
    return text(line).rlike(QUESTION_NUMBER) & ~text(line).rlike(DECIMAL)


def concept(c: Column) -> Column:
    """The trimmed concept, or an empty text if it is no name: digits, blanks, question words, half sentences, loose ends, unpaired quotes."""
    t = trim(c)
    pairs = F.lit(False)
    for a, b in ("《》", "“”"):
        pairs = pairs | (F.length(F.regexp_replace(t, f"[^{a}]", "")) != F.length(F.regexp_replace(t, f"[^{b}]", "")))
    bad = (F.length(t) < 2) | pairs
    for pattern in ("[0-9０-９]", "[ 　]", CONCEPT_STARTS, CONCEPT_TAILS, CLAUSE, TIME_ONLY):
        bad = bad | t.rlike(pattern)
    return F.when(bad, "").otherwise(t)
