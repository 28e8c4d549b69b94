"""Substring measures that no built-in expresses, as Arrow-batched pandas functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PUNCTUATION


def longest_common(a: str, b: str) -> int:
    """Length of the longest substring of a that b has; grows a window, so b is searched at most 2 * len(a) times."""
    best, start = 0, 0
    for end in range(1, len(a) + 1):
        while start < end and a[start:end] not in b:
            start += 1
        best = max(best, end - start)
    return best


#: Connectives that runs are compared without, and punctuation that goes with white space.
CONNECTIVES = re.compile("[和与及或、，,·的]")
MARKS = re.compile(PUNCTUATION)


def span_key(s: str | None) -> str:
    """The characters of a text that carry meaning."""
    return CONNECTIVES.sub("", "".join(MARKS.sub("", s or "").split()))


def fit(needle: str | None, hay: str | None) -> float:
    a, b = span_key(needle), span_key(hay)
    if not a or not b:
        return 0.0
    best = longest_common(a, b)
    if best < 2:  # no run to speak of: whole words, numbers and fours of the answer
        for run in re.findall(r"[\u4e00-\u9fff]+|[A-Za-z]+|\d+(?:\.\d+)?", needle):
            pieces = [run[i : i + 4] for i in range(0, len(run), 4)] if "\u4e00" <= run[0] <= "\u9fff" else [run]
            best = max([best, *(len(p) for p in pieces if len(p) >= 2 and p in b)])
    return min(1.0, best / len(a))


def _fit(needle: pd.Series, hay: pd.Series) -> pd.Series:
    return pd.Series([fit(a, b) for a, b in zip(needle, hay, strict=True)], dtype="float64")


def han_run(a: str | None, b: str | None) -> int:
    """Longest shared run of Han characters."""
    other = re.findall(r"[\u4e00-\u9fff]+", b or "")
    return max((longest_common(x, y) for x in re.findall(r"[\u4e00-\u9fff]+", a or "") for y in other), default=0)


def _run(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


#: Numerals before a unit of counting, and marks in their narrow form.
NUMERALS = dict(zip("一二两三四五六七八九十", ["1", "2", "2", "3", "4", "5", "6", "7", "8", "9", "10"], strict=True))
COUNTED = re.compile("([一二两三四五六七八九十])(?=[个名位条项次大战区军年代月日篇章门类种点])")
NARROW_MARKS = str.maketrans("（），。", "(),.")


def audit_text(s: str | None) -> str:
    """Text without control characters and white space, with narrow marks and counted numerals as digits."""
    t = "".join(c for c in s or "" if c >= " ").translate(NARROW_MARKS)
    return COUNTED.sub(lambda m: NUMERALS[m[1]], "".join(t.split()))


def cover(option: str | None, hay: str | None) -> float:
    a, b = audit_text(option), audit_text(hay)
    if len(a) >= 3:
        n = longest_common(a, b)
        return n / len(a) if n >= 3 else 0.0
    return float(bool(a) and re.search(rf"(?<![0-9A-Za-z]){re.escape(a)}(?![0-9A-Za-z])", b) is not None)


def _cover(option: pd.Series, hay: pd.Series) -> pd.Series:
    return pd.Series([cover(a, b) for a, b in zip(option, hay, strict=True)], dtype="float64")


def span_fit(needle: Column, hay: Column) -> Column:
    """Longest run of the needle in hay over the needle's length, both without connectives, punctuation and white space; 0 for an empty needle."""
    return F.pandas_udf(_fit, "double")(needle, hay)


def longest_run(a: Column, b: Column) -> Column:
    """Characters of the longest run that two texts share."""
    return F.pandas_udf(_run, "int")(a, b)


def cover_score(option: Column, hay: Column) -> Column:
    """Longest run, of three characters at least, over the option's length; shorter options count when they stand there as a word."""
    return F.pandas_udf(_cover, "double")(option, hay)


def _han_run(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([han_run(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def longest_han_run(a: Column, b: Column) -> Column:
    """Length of the longest run of Han characters that two texts share."""
    return F.pandas_udf(_han_run, "int")(a, b)
