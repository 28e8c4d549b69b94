"""Answers by question type: normalising, comparing and showing them.

An answer is struct(letters array<string>, bool boolean, blanks array<string>, text string);
the type says which field counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_text, text, trim

#: Fixed values.
TYPES = ("single", "multi", "judge", "fill", "short")
TRUE_WORDS = ("true", "t", "1", "对", "正确", "√", "是")


def letters(raw: Column, top: str = "H", distinct: bool = False) -> Column:
    """Sorted option letters in a text; `distinct` drops repeats, as ingest does."""
    found = F.array_sort(F.regexp_extract_all(F.upper(text(raw)), F.lit(f"([A-{top}])")))
    return F.array_distinct(found) if distinct else found


def normalise(kind: Column, raw: Column, ingest: bool = False) -> Column:
    """Answer struct of a raw text; ingest limits letters to A-D and drops repeats."""
    many = letters(raw, "D" if ingest else "H", ingest)
    none = F.lit(None)
    return F.struct(
        F.when(kind == "single", F.slice(many, 1, 1)).when(kind == "multi", many).alias("letters"),
        F.when(kind == "judge", F.lower(trim(raw)).isin(*TRUE_WORDS)).otherwise(none.cast("boolean")).alias("bool"),
        F.when(kind == "fill", F.transform(F.split(text(raw), r"[;；|]"), trim)).alias("blanks"),
        F.when(kind == "short", trim(raw)).alias("text"),
    )


def has_answer(kind: Column, pick: Column) -> Column:
    """Whether a pick (answer struct) holds anything for its type."""
    return F.coalesce(
        F.when(kind.isin("single", "multi"), F.size(pick["letters"]) > 0)
        .when(kind == "judge", pick["bool"].isNotNull())
        .when(kind == "fill", F.exists(pick["blanks"], lambda b: F.length(trim(b)) > 0))
        .otherwise(F.length(trim(pick["text"])) > 0),
        F.lit(False),
    )


def fill_ok(want: Column, got: Column) -> Column:
    """Each blank equal at its place (further picks are ignored), or equal when joined, or the one blank is the one pick."""
    w, g = F.transform(want, norm_text), F.transform(got, norm_text)
    each = (F.size(g) >= F.size(w)) & (F.slice(g, 1, F.greatest(F.size(w), F.lit(1))) == w)
    joined = (F.array_join(w, "") == F.array_join(g, "")) & (F.array_join(w, "") != "")
    filled = F.filter(g, lambda x: F.length(x) > 0)
    one = (F.size(w) == 1) & (F.size(filled) == 1) & (F.element_at(filled, 1) == F.element_at(w, 1))
    return F.coalesce(((F.size(w) > 0) & each) | joined | F.coalesce(one, F.lit(False)), F.lit(False))


def judge(kind: Column, want: Column, pick: Column) -> Column:
    """Whether a pick is right. Unanswered items are never right; short answers are never judged."""
    same = F.array_sort(F.coalesce(pick["letters"], F.array().cast("array<string>"))) == F.array_sort(want["letters"])
    right = F.when(kind.isin("single", "multi"), same).when(kind == "judge", pick["bool"] == want["bool"]).when(kind == "fill", fill_ok(want["blanks"], pick["blanks"])).otherwise(F.lit(False))
    return F.coalesce(has_answer(kind, pick) & right, F.lit(False))


def answer_text(kind: Column, answer: Column, options: Column) -> Column:
    """What an answer says: its options' texts, a yes or no, its blanks or its text. Letters out of range are skipped."""
    at = lambda x: F.try_element_at(options, (F.ascii(x) - 64).cast("int"))
    chosen = F.filter(F.transform(answer["letters"], at), lambda o: o.isNotNull())
    return F.coalesce(F.when(kind.isin("single", "multi"), F.array_join(chosen, "；")).when(kind == "judge", F.when(answer["bool"], "正确").otherwise("错误")).when(kind == "fill", F.array_join(answer["blanks"], "；")).otherwise(answer["text"]), F.lit(""))


def shown_letters(stored: Column, order: Column) -> Column:
    """Letters at which a session shows the stored letters; order lists stored letters as displayed."""
    return F.array_sort(F.transform(stored, lambda x: F.char(64 + F.array_position(order, x))))


def rewrite_letters(prose: Column, order: Column) -> Column:
    """Prose with its stand-alone option letters A-H mapped to where a session shows them, in one pass.

    The text is cut into pieces at the letters, so no letter is mapped twice.
    """
    pieces = F.regexp_extract_all(text(prose), F.lit(r"((?<![A-Za-z])[A-H](?![A-Za-z])|[^A-H]+|[A-H])"))
    where = lambda x: F.array_position(order, x)
    # a letter stands alone when neither neighbour is a letter
    flags = F.transform(pieces, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get(pieces, i - 1), F.lit("")).alias("p"), F.coalesce(F.get(pieces, i + 1), F.lit("")).alias("n")))
    alone = lambda s: s["x"].rlike("^[A-H]$") & ~s["p"].rlike("[A-Za-z]$") & ~s["n"].rlike("^[A-Za-z]")
    return F.array_join(F.transform(flags, lambda s: F.when(alone(s) & (where(s["x"]) > 0), F.char(64 + where(s["x"]))).otherwise(s["x"])), "")
