"""Scalar functions over text columns, as built-in expressions.

Every operator has its own normaliser; they differ on purpose and keep separate names.
Character classes are parameters where the corpus decides the alphabet: `CJK` for Chinese
question banks, `LETTERS` for any script.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"
LETTERS = r"\p{L}\p{N}"
#: Sentence ends and punctuation of question texts.
ENDS_CJK = "。！？"
ENDS_LATIN = ".!?"
PUNCTUATION = r"[，。、；：？！“”‘’（）《》〈〉【】\[\](),.;:?!\"'·…—\-_/\\|~`]"
#: Marks that typed answers are compared without.
ANSWER_MARKS = r"[,，.。;；:：、!！?？\"'“”‘’()（）\[\]【】<>《》\-—_/\\|]"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def text(c) -> Column:
    """A column's text; null is empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def pct(a: Column, b: Column) -> Column:
    """Whole percent of a in b, half up; 0 when b is 0."""
    return F.when(b > 0, F.round(a / b * 100)).otherwise(0).cast("long")


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def to_int(c: Column, default: int = 0) -> Column:
    """The integer that a text starts with, after white space; default if there is none."""
    digits = F.regexp_extract(text(c), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(F.try_to_number(digits, F.lit("S99999999999999")).cast("long"), F.lit(default).cast("long"))


def narrow(c: Column) -> Column:
    """Full-width forms to ASCII, the ideographic space to a space."""
    return F.translate(text(c), WIDE, NARROW)


def norm_text(c: Column) -> Column:
    """Comparison key of typed answers: narrow, without punctuation and white space, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(narrow(c), ANSWER_MARKS, ""), r"[\s\x{3000}]+", ""))


def norm_stem(c: Column) -> Column:
    """Key of a stem: empty brackets, rules of dashes and all but letters, digits and _ go."""
    s = F.regexp_replace(text(c), r"\(\s*\)|（\s*）", "")
    s = F.regexp_replace(s, r"[_＿—-]{2,}", "")
    return F.regexp_replace(s, r"[^\p{L}\p{N}_]", "")


def norm_gram(c: Column) -> Column:
    """Text without punctuation and white space, from which grams are taken."""
    return F.regexp_replace(F.regexp_replace(text(c), PUNCTUATION, ""), r"[\s\x{3000}]+", "")


def squeeze(c: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(text(c), r"[\s\x{3000}]+", "")


def trim(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text(c), r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$", "")


def clean(c: Column) -> Column:
    """Control characters go, no-break spaces become spaces, runs of white space one space."""
    s = F.translate(F.regexp_replace(text(c), r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]", ""), " ", " ")
    return F.trim(F.regexp_replace(s, r"[\s\x{3000}]+", " "))


def sentences(c: Column, ends: str = ENDS_CJK) -> Column:
    """Sentences that keep their end marks; empty ones go."""
    return F.filter(F.transform(F.split(text(c), f"(?<=[{ends}])"), trim), lambda s: F.length(s) > 0)


def trim_sentence(c: Column, most: int = 120, marks: str = "；，、", end: str = "。") -> Column:
    """At most so many characters: up to the last of the first mark that stands in the second half, and `end`; else cut, with an ellipsis."""
    head = F.substring(c, 1, most)
    out = F.concat(head, F.lit("…"))
    for mark in reversed(marks):
        back = F.instr(F.reverse(head), F.lit(mark))
        at = F.length(head) - back
        out = F.when((back > 0) & (at * 2 >= most), F.concat(F.substring(head, F.lit(1), at), F.lit(end))).otherwise(out)
    return F.when(F.length(c) <= most, c).otherwise(out)


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams in order of first appearance; texts shorter than n have none."""
    return F.when(F.length(c) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: c.substr(i, F.lit(n)))))


def words(c: Column, least: int = 1, letters: str = LETTERS) -> Column:
    """Lower-case words of at least so many letters, in order."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(f"([{letters}]{{{least},}})"))


#: Runs of one script: Han characters, Latin words, numbers.
RUNS = r"([\x{4e00}-\x{9fff}]+|[A-Za-z]%s|\d+(?:\.\d+)?)"
HAN = r"^[\x{4e00}-\x{9fff}]"


def keywords(c: Column, longest: int = 4) -> Column:
    """Distinct search words in order: Latin words and numbers whole; Han runs of two characters or more, long ones as their sliding 4-, 3- and 2-grams."""
    runs = F.regexp_extract_all(text(c), F.lit(RUNS % "{2,}"))
    cut = F.transform(runs, lambda x: F.when(~x.rlike(HAN), F.array(x)).when(F.length(x) <= longest, F.filter(F.array(x), lambda y: F.length(y) >= 2)).otherwise(F.concat(*[grams(x, n) for n in (4, 3, 2)])))
    return F.array_distinct(F.flatten(cut))


def atoms(c: Column) -> Column:
    """Pieces of an answer: Latin words and numbers whole, Han runs in fours with what is left."""
    runs = F.regexp_extract_all(text(c), F.lit(RUNS % "+"))
    return F.flatten(F.transform(runs, lambda x: F.when(~x.rlike(HAN), F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.length(x), F.lit(4)), lambda i: x.substr(i, F.lit(4))))))


def neighbours(w: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    n = F.size(w)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))))


def clip(c: Column, required: Column, most: int = 160) -> Column:
    """About `most` characters around the required part: a third before it, two thirds after; the beginning where it is not found."""
    at = F.instr(c, required) - 1
    at = F.when(at < 0, F.instr(squeeze(c), squeeze(required)) - 1).otherwise(at)
    start = F.greatest(at - most // 3, F.lit(0))
    end = F.least(F.length(c), at + F.length(required) + most * 2 // 3)
    dots = lambda cond: F.when(cond, "…").otherwise("")
    around = F.concat(dots(start > 0), trim(c.substr(start + 1, end - start)), dots(end < F.length(c)))
    return F.when(at < 0, F.concat(F.substring(c, 1, most), dots(F.length(c) > most))).otherwise(around)


def pick_sentence(c: Column, required: Column, most: int = 160) -> Column:
    """The first part, up to a stop or semicolon, that has the required text, white space apart; clipped if it is long or there is none."""
    need = squeeze(required)
    part = F.get(F.filter(F.split(c, "(?<=[。！？；])"), lambda p: (F.length(need) > 0) & F.contains(squeeze(p), need)), 0)
    return F.when(part.isNull(), clip(c, required, most)).when(F.length(trim(part)) <= most, trim(part)).otherwise(clip(trim(part), required, most))


def coverage(needle: Column, hay: Column) -> Column:
    """Share of the needle's elements that hay has; 0 for an empty needle."""
    return F.when(F.size(needle) > 0, F.size(F.array_intersect(needle, hay)) / F.size(F.array_distinct(needle))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def characters(c: Column) -> Column:
    """Set of characters."""
    return F.array_distinct(F.filter(F.split(text(c), ""), lambda x: F.length(x) > 0))


def keyword_score(length: Column, df: Column, bonus: Column | float = 0.0) -> Column:
    """Long and rare terms first."""
    return (1 + F.least(length, F.lit(8)) / 4) * (1 + 1.6 / F.sqrt(1 + df)) + bonus


def gram_weight(df: Column, power: float) -> Column:
    """Weight of a gram by the share of units that have it; frequent grams weigh less, none is dropped."""
    return F.pow(1 + 60 * df, F.lit(-power))


def stem_score(keyword_cover: Column, likeness: Column, same_chapter: Column) -> Column:
    return 0.62 * keyword_cover + 0.28 * likeness + 0.10 * same_chapter.cast("double")


def search_match(blob: Column, query: str) -> Column:
    """All keywords of the query are in the lower-case blob; an empty query matches nothing."""
    keys = query.lower().split()
    out = F.lit(bool(keys))
    for k in keys:
        out = out & F.contains(F.lower(blob), F.lit(k))
    return out


def phrase_match(blob: Column, phrase: str) -> Column:
    """The phrase as a whole is in the lower-case blob; an empty phrase matches everything."""
    p = phrase.strip().lower()
    return F.contains(F.lower(blob), F.lit(p)) if p else F.lit(True)


def proximity(hay: Column, anchor: Column | str, terms: Column, reach: int = 14) -> Column:
    """1 if two or more terms stand within reach of the anchor, .6 if one does, else 0; .4 if the anchor is absent but some term is there."""
    s, a = squeeze(hay), text(F.lit(anchor) if isinstance(anchor, str) else anchor)
    at = F.instr(s, a)
    start = F.greatest(at - reach, F.lit(1))
    near = s.substr(start, at + F.length(a) + reach - start)
    hits = F.size(F.filter(terms, lambda t: F.contains(near, t)))
    absent = F.when(F.exists(terms, lambda t: F.contains(s, t)), 0.4).otherwise(0.0)
    return F.when((F.length(s) == 0) | (F.length(a) == 0), 0.0).when(at == 0, absent).when(hits >= 2, 1.0).when(hits == 1, 0.6).otherwise(0.0)


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def date_ok(c: Column) -> Column:
    """Whether a text is a real calendar day written yyyy-MM-dd."""
    return F.coalesce(text(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text(c), "yyyy-MM-dd").isNotNull(), F.lit(False))


def clock(ms: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on."""
    s = F.floor(ms / 1000)
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def escape_html(c: Column) -> Column:
    out = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def short_hash(c: Column) -> Column:
    """Base-36 text of the 32-bit multiply-xor hash that reads a text from its end."""
    codes = F.transform(F.filter(F.split(F.reverse(text(c)), ""), lambda x: F.length(x) > 0), lambda x: F.ascii(x).cast("long"))
    h = F.aggregate(codes, F.lit(5381).cast("long"), lambda acc, x: ((acc * 33) % (1 << 32)).bitwiseXOR(x))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def render_parts(*parts: Column) -> Column:
    """Parts one below the other; empty parts are left out."""
    return F.concat_ws("\n", *[F.when(F.length(F.trim(text(p))) > 0, p) for p in parts])
