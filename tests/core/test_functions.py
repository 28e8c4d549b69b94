import pytest
from pyspark.sql import functions as F

from studyforge.functions import answers as A
from studyforge.functions import spans, text
from studyforge.operators import folds


def one(spark, *cols, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    got = row.select(*cols).first()
    return got[0] if len(cols) == 1 else tuple(got)


def test_numbers(spark):
    assert one(spark, *[text.to_int(F.lit(x), 7) for x in ("12abc", " -3", "abc", "")]) == (12, -3, 7, 7)
    assert one(spark, text.pct(F.lit(1), F.lit(40)), text.pct(F.lit(1), F.lit(0))) == (3, 0)
    assert one(spark, text.clock(F.lit(61_000)), text.clock(F.lit(3_661_000))) == ("01:01", "1:01:01")


def test_normalisers(spark):
    assert one(spark, text.norm_text(F.lit("Ａ，b　C。"))) == "abc"
    assert one(spark, text.norm_stem(F.lit("下列（ ）正确的是____é国?"))) == "下列正确的是é国"
    assert one(spark, text.clean(F.lit("a  b　c\u0001"))) == "a b c"
    assert one(spark, text.sentences(F.lit("一。二！三"))) == ["一。", "二！", "三"]
    assert one(spark, text.grams(F.lit("abab"), 2), text.grams(F.lit("a"), 2)) == (["ab", "ba"], [])
    assert one(spark, text.atoms(F.lit("侵略和武装颠覆")), text.atoms(F.lit(""))) == (["侵略和武", "装颠覆"], [])
    assert one(spark, text.date_ok(F.lit("2026-02-30")), text.date_ok(F.lit("2026-02-28"))) == (False, True)
    assert one(spark, text.escape_html(F.lit("<a&'>"))) == "&lt;a&amp;&#39;&gt;"
    assert one(spark, text.render_parts(F.lit("a"), F.lit(" "), F.lit("b"))) == "a\nb"
    assert one(spark, text.trim_sentence(F.lit("x" * 80 + "，" + "y" * 60))) == "x" * 80 + "。"
    assert one(spark, text.trim_sentence(F.lit("x" * 70 + "；" + "y" * 20 + "，" + "z" * 60))) == "x" * 70 + "。"
    assert one(spark, text.trim_sentence(F.lit("x" * 20 + "；" + "y" * 140))) == "x" * 20 + "；" + "y" * 99 + "…"
    assert one(spark, text.norm_text(F.lit("a<b>·~c"))) == "ab·~c"
    terms = F.array(F.lit("bb"), F.lit("cc"))
    near = lambda s, a: one(spark, text.proximity(F.lit(s), F.lit(a), terms))
    assert [near("bb key cc", "key"), near("bb key", "key"), near("no key", "key"), near("bb and", "key"), near("and", "key"), near("", "key")] == [1.0, 0.6, 0.0, 0.4, 0.0, 0.0]
    assert near("bb" + "-" * 15 + "key", "key") == 0.0


def test_search(spark):
    assert one(spark, text.search_match(F.lit("Abc def"), "DEF a"), text.search_match(F.lit("a"), " "), text.phrase_match(F.lit("a"), " ")) == (True, False, True)


def test_short_hash_wraps_at_32_bits(spark):
    h = 5381
    for ch in reversed("hello"):
        h = (h * 33 % 2**32) ^ ord(ch)
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    want = ""
    while h:
        h, r = divmod(h, 36)
        want = digits[r] + want
    assert one(spark, text.short_hash(F.lit("hello"))) == want


@pytest.mark.parametrize(
    "kind,want,pick,right",
    [("single", "A", "a", True), ("multi", "C,A", "AC", True), ("multi", "A,C", "A", False), ("judge", "false", "对", False), ("judge", "false", "错", True), ("judge", "false", None, False), ("fill", "a;b", "A；b", True), ("fill", "ab", "a b", True), ("fill", "a;b", "b;a", False), ("short", "x", "x", False)],
)
def test_judging(spark, kind, want, pick, right):
    p = A.normalise(F.lit(kind), F.lit(pick).cast("string"))
    if pick is None:
        p = p.withField("bool", F.lit(None).cast("boolean"))
    assert one(spark, A.judge(F.lit(kind), A.normalise(F.lit(kind), F.lit(want)), p)) is right


def test_answer_text_and_letters(spark):
    opts = F.array(F.lit("x"), F.lit("y"))
    assert one(spark, A.answer_text(F.lit("multi"), A.normalise(F.lit("multi"), F.lit("BAH")), opts)) == "x；y"
    order = F.array(*[F.lit(c) for c in "BCDA"])
    assert one(spark, A.shown_letters(F.array(F.lit("A"), F.lit("B")), order)) == ["A", "D"]
    assert one(spark, A.rewrite_letters(F.lit("A、B、C正确；故D；A项 DNA"), order)) == "D、A、B正确；故C；D项 DNA"


def test_spans(spark):
    df = spark.createDataFrame([("abcd", "xxbcdx"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(spans.span_fit(F.col("a"), F.col("b"))).collect()] == [0.75, 0.0]
    assert [r[0] for r in df.select(spans.longest_run(F.col("a"), F.col("b"))).collect()] == [3, 0]


def test_folds(spark):
    assert one(spark, folds.pick_terms(F.array(*[F.lit(x) for x in ("abc", "ab", "thirteen long", "xyz", "wxyzw", "q")]), 4)) == ["abc", "xyz", "wxyzw", "q"]
    assert one(spark, folds.merge_lines(F.array(*[F.lit(x) for x in ("a b", "()", "x.", "d", "2. e", "f" * 50 + "。", "g", "A、h")]))) == ["a bx.d", "2. e" + "f" * 50 + "。", "g", "A、h"]
    assert sorted(folds.shuffled(10, 3)) == list(range(10)) and folds.shuffled(10, 3) == folds.shuffled(10, 3) != folds.shuffled(10, 4)
