"""The explanation audit on rows worked out by hand."""

from studyforge.operators.explanation_audit import explanations, web_sources

SCHEMA = "id string, type string, options array<string>, letters array<string>, flag boolean, answer string, explanation string, parts array<string>"
OPTIONS = ["私有制的出现", "阶级的产生", "国家的形成", "战争"]
ROWS = {
    "none": ("single", OPTIONS, ["A"], None, None, None, None),
    "blank": ("single", OPTIONS, ["A"], None, None, "　\n ", []),
    "short": ("single", OPTIONS, ["D"], None, None, "是战争。", ["战争"]),
    "long": ("fill", None, None, None, "国防", "国防" * 201, None),
    "held": ("single", OPTIONS, ["A"], None, None, "因为私 有制的出现才有了国防", None),
    "run": ("single", OPTIONS, ["A"], None, None, "国防起于私有制与其他", None),
    "declared": ("multi", OPTIONS, ["C", "A"], None, None, "正确答案：A、甲；C（乙）。其余不论", None),
    "declares less": ("multi", OPTIONS, ["A", "C"], None, None, "正确答案：A、甲。其余都不论", None),
    "wrong": ("single", OPTIONS, ["A"], None, None, "国防起于阶级的产生这件事", None),
    "wrong but tiny": ("single", OPTIONS, ["A"], None, None, "这里讲的只是战争而已", None),
    "two letters": ("single", OPTIONS, ["A", "B"], None, None, "国防起于阶级的产生这件事", None),
    "beyond": ("single", OPTIONS, ["H"], None, None, "国防起于阶级的产生这件事", None),
    "judge": ("judge", None, None, None, None, "此说法是错误的，应当另看", None),
    "free": ("short", None, None, None, "要点", "这里什么相关的也没有", None),
    "set badly": ("fill", None, None, None, None, "古　代国防的起源与发展", ["《国防法》《国防法》", None]),
    "no parts": ("fill", None, None, None, None, "古代国防的起源与发展", ["", " 　", None]),
    None: (None, None, None, None, None, "没有题型的解析也可以", [" "]),
}
WANT = {
    ("held", "blanks between characters"),
    ("none", "no explanation"), ("blank", "no explanation"), ("short", "too short"), ("long", "too long"), ("declares less", "answer not supported"),
    ("wrong", "answer not supported"), ("wrong", "wrong option supported"), ("wrong but tiny", "answer not supported"),
    ("set badly", "blanks between characters"), ("set badly", "title twice"), ("no parts", "empty parts"), (None, "empty parts"),
}


def test_faults_of_explanations(spark):
    df = spark.createDataFrame([(k, *r) for k, r in ROWS.items()], SCHEMA)
    got = [(r["id"], r["rule"]) for r in explanations(df).collect()]
    assert set(got) == WANT and len(got) == len(WANT)
    assert explanations(df.limit(0)).count() == 0


def test_findings_on_web_sources(spark):
    long = "国防的对象主要是武装侵略，也有武装颠覆和分裂祖国的活动"
    same = "一个国家的边界由条约与历史共同划定，并且为邻国所承认，这里后面还有很多很多别的文字，接下去的才不同"
    base = dict(type="single", src="web", ref="r", url="https://a", stem="国防的对象____是什么", options=["武装侵略", "其他", "战争", "无"], letters=["A"], reason=long, disputed=False)
    rows = {
        "q1": {}, "q2": {"ref": None}, "q3": {"ref": "　"}, "q4": {"url": None}, "q5": {"url": "ftp://a"},
        "q6": {"stem": "边界 邻国 何在", "reason": same + "甲"}, "q7": {"stem": "完全无关", "reason": same + "乙"}, "q8": {"reason": "国防的对象是武装侵略"},
        "q9": {"reason": None}, "r1": {"src": "textbook", "ref": None, "disputed": True}, "r2": {"src": None, "disputed": None}, "r3": {"stem": None, "options": None, "letters": None, "reason": "别的话里有足够多的自己的字"},
    }
    schema = "id string, type string, src string, ref string, url string, stem string, options array<string>, letters array<string>, flag boolean, answer string, reason string, disputed boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple({"id": k, **base, **v}.get(n) for n in names) for k, v in rows.items()], schema)
    got = sorted((r["rule"], r["id"], r["n"]) for r in web_sources(df).collect())
    assert got == sorted([
        ("no reference", "q2", 1), ("no reference", "q3", 1), ("no url", "q4", 1), ("no url", "q5", 1),
        ("little shared text", "q6", 2), ("little shared text", "q7", 0), ("off topic", "q7", 0),
        ("repeats the answer", "q8", 0), ("little shared text", "q9", 0), ("off topic", "q9", 0), ("repeats the answer", "q9", 0),
        ("little shared text", "r3", 0), ("off topic", "r3", 0), ("shared reason", "q1", 5), ("shared reason", "q6", 2), ("disputed", "r1", 1),
    ])
    assert web_sources(df.limit(0)).count() == 0
