"""Readers of question banks, text corpora, evidence files, outlines and exported progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers
from ..functions.text import clean, sentences, text

QUESTION = """id string, type string, stem string, options array<string>, answer variant, explanation string,
explanationSrc string, explanationRef string, explanationParts struct<answer:string,reason:string,note:string,ref:string>,
source string, chapter string, section string, keyConcept string, keywords array<string>, distractorWhy map<string,string>,
isHard boolean, answerUncertain boolean, subsection string, sectionName string"""
EXPORT = """app string, ver int, exportedAt string,
progress map<string,struct<seen:long,correct:long,wrong:long,lastTs:long,box:int,fav:boolean,wrongFlag:boolean>>,
exams array<struct<ts:long,total:long,correct:long,score:long,durationMs:long>>, daily map<string,struct<n:long,ok:long>>"""
PAGE_MARK = r"^=== PAGE (\d+) ===$"


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Questions of bank documents {questions: [...]}, with their position."""
    docs = spark.read.schema(f"questions array<struct<{', '.join(_fields())}>>").json(path, multiLine=True)
    return docs.select(F.posexplode("questions").alias("ord", "q")).select("ord", "q.*")


def _fields() -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in QUESTION.replace("\n", " "):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [":".join(f.split(" ", 1)) for f in [*out, cur.strip()]]


def raw_answer(answer: Column) -> Column:
    """Text of a union-typed answer: arrays are joined by semicolons."""
    return F.coalesce(F.array_join(F.try_variant_get(answer, "$", "array<string>"), ";"), F.try_variant_get(answer, "$", "string"))


def hydrate(bank: DataFrame) -> DataFrame:
    """Rows that can be asked, coerced: known type, a stem, two options or more for choices, at most 8 keywords.

    A repeated id gets its position as a suffix. Answers become structs.
    """
    ok = F.col("type").isin(*answers.TYPES) & (F.trim(text("stem")) != "")
    options = F.filter(F.coalesce("options", F.array().cast("array<string>")), lambda o: F.trim(o) != "")
    choice = F.col("type").isin("single", "multi")
    rows = bank.withColumn("options", F.when(choice, options).otherwise(F.array().cast("array<string>"))).where(ok & (~choice | (F.size("options") >= 2)))
    turn = F.row_number().over(W.partitionBy("id").orderBy("ord"))
    rows = rows.withColumn("_turn", turn).withColumn("id", F.when(F.col("_turn") > 1, F.concat_ws("-", "id", "ord")).otherwise(F.col("id"))).drop("_turn")
    return rows.withColumns({"keywords": F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 8), "isHard": F.coalesce("isHard", F.lit(False)), "answer": answers.normalise(F.col("type"), raw_answer(F.col("answer")))})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of text files; a file is one row of the scan, so line numbers need no shuffle."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("line_no", "line"))


def corpus_units(lines: DataFrame, chapter: str = r"^(第.{1,3}章.*)$", least: int = 12, most: int = 220, ends: str = "。！？") -> DataFrame:
    """file, page, chapter, ord, sentence: page marks and chapter heads run down the lines; sentences of fair length stay."""
    down = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    page = F.regexp_extract("line", PAGE_MARK, 1)
    head = F.regexp_extract(F.trim("line"), chapter, 1)
    rows = lines.withColumn("page", F.last(F.when(page != "", page.cast("int")), ignorenulls=True).over(down)).withColumn("chapter", F.last(F.when(head != "", head), ignorenulls=True).over(down))
    rows = rows.where((page == "") & (head == ""))
    cut = rows.select("file", "page", "chapter", "line_no", F.posexplode(sentences(clean(F.col("line")), ends)).alias("pos", "sentence"))
    return cut.where(F.length("sentence").between(least, most))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence items of JSON files, arrays or {results: [...]}; broken files give a row with `error`."""
    item = "struct<id:string,found:boolean,confidence:string,url:string,source:string,reason:string,note:string,disputed:boolean>"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    plain, wrapped = F.from_json("value", f"array<{item}>"), F.from_json("value", f"struct<results:array<{item}>>")["results"]
    start = F.substring(F.ltrim("value"), 1, 1)
    items = F.when(start == "[", plain).otherwise(wrapped)
    rows = whole.withColumn("items", items).withColumn("error", F.when(F.col("items").isNull(), F.lit("not an array or {results}")))
    return rows.select("file", "error", F.posexplode_outer("items").alias("ord", "item")).select("file", "error", "ord", "item.*")


def outline_rows(outline: DataFrame) -> DataFrame:
    """chapter, section, sub, text of outline documents {chapters: [{chapter, sections: [{section, text, subs}]}]}."""
    c = outline.select(F.posexplode("chapters").alias("c", "ch")).select("c", "ch.chapter", F.posexplode_outer("ch.sections").alias("s", "se"))
    return c.select("c", "chapter", "s", F.col("se.section").alias("section"), F.col("se.text").alias("text"), F.posexplode_outer("se.subs").alias("u", "sub"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Exported progress documents; one that does not parse is a null row."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", EXPORT).alias("x")).select("x.*")


def progress_rows(export: DataFrame) -> DataFrame:
    """question and its state; reserved keys are left out."""
    kept = F.map_filter("progress", lambda k, v: ~k.startswith("__") & ~k.isin("constructor", "prototype"))
    return export.select(F.explode(kept).alias("question", "state")).select("question", "state.*")


def parse_questions(lines: DataFrame) -> DataFrame:
    """file, no, stem, options of exam papers: numbered stems, lettered options, other lines continue what came before."""
    down = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    no = F.regexp_extract("line", r"^\s*(\d{1,3})\s*[.．、]\s*\S", 1)
    letter = F.regexp_extract("line", r"^\s*([A-H])\s*[.．、]\s*\S", 1)
    rows = lines.where(F.trim("line") != "").withColumn("no", F.last(F.when(no != "", no.cast("int")), ignorenulls=True).over(down))
    rows = rows.withColumn("item", F.sum((no != "").cast("int")).over(down)).where("item > 0")
    part = W.partitionBy("file", "item").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("letter", F.coalesce(F.last(F.when(letter != "", letter), ignorenulls=True).over(part), F.lit("")))
    body = F.trim(F.regexp_replace("line", r"^\s*(\d{1,3}|[A-H])\s*[.．、]\s*", ""))
    piece = rows.groupBy("file", "item", "no", "letter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", body.alias("t")))), lambda x: x["t"]), "").alias("t"))
    parts = F.array_sort(F.collect_list(F.struct("letter", "t")))
    whole = piece.groupBy("file", "item", "no").agg(parts.alias("parts"))
    return whole.select("file", "item", "no", F.element_at(F.filter("parts", lambda p: p["letter"] == ""), 1)["t"].alias("stem"), F.transform(F.filter("parts", lambda p: p["letter"] != ""), lambda p: p["t"]).alias("options"))


def parse_answer_key(lines: DataFrame) -> DataFrame:
    """file, no, letters of keys such as `1-5 ABCDA` (a letter each) or `6. ACD`; ranges stand before their letters."""
    spans = F.regexp_extract_all("line", F.lit(r"(\d+\s*-\s*\d+\s*[A-H]+)"))
    ranged = lines.select("file", F.explode(spans).alias("s")).select("file", F.regexp_extract("s", r"^(\d+)", 1).cast("int").alias("lo"), F.regexp_extract("s", r"([A-H]+)$", 1).alias("keys"))
    each = ranged.select("file", "lo", F.posexplode(F.filter(F.split("keys", ""), lambda x: x != "")).alias("k", "letter")).select("file", (F.col("lo") + F.col("k")).alias("no"), F.col("letter").alias("letters"))
    single = lines.select("file", F.regexp_extract("line", r"^\s*(\d+)\s*[.．、]\s*([A-H]+)\s*$", 1).alias("n"), F.regexp_extract("line", r"^\s*(\d+)\s*[.．、]\s*([A-H]+)\s*$", 2).alias("letters"))
    return each.unionByName(single.where("n != ''").select("file", F.col("n").cast("int").alias("no"), "letters"))


def attach_answers(items: DataFrame, key: DataFrame) -> DataFrame:
    """items with answer and reject: a number without an answer or with several different ones is rejected."""
    found = key.groupBy("file", "no").agg(F.collect_set("letters").alias("found"))
    j = items.join(found, ["file", "no"], "left")
    return j.select("*", F.when(F.size("found") == 1, F.element_at("found", 1)).alias("answer"), F.when(F.col("found").isNull(), "no answer").when(F.size("found") > 1, "several answers").alias("reject")).drop("found")
