"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from studyforge.llm import exact_dedup, stages
from studyforge.llm.exact_dedup import exact_groups
from studyforge.llm.fingerprints import compare_with_next, edited_branches, fingerprint_texts
from studyforge.llm.html_text import main_text
from studyforge.llm.jaccard_join import keep_one_per_class, similarity_classes
from studyforge.llm.language_id import language_of
from studyforge.llm.mixing import mix, mixed_documents
from studyforge.llm.packing import pack
from studyforge.llm.quality import quality_scores
from studyforge.llm.queries import tokenizer_path
from studyforge.llm.secrets import secret_report
from studyforge.llm.sharding import shard_documents

LONG = "the long text goes on and on " * 20_000
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (1, "one two three four five six seven", "en", "a", 33),
    (2, "ONE two three four five six  seven", "en", "b", 34),
    (3, None, None, None, None),
    (4, "", "de", "b", 0),
    (None, "no id here at all today", "en", None, 23),
    (5, LONG, None, "a", len(LONG)),
    (6, " \t\n ", "fr", "c", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    # clashing names: operators must not mix these up with their own
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "n", "size", "source_size", "copies", "hub", "shard", "owner", "place", "token", "comp", "label", "_id", "_n", "_k", "_copy", "_sha", "_sha2", "_chars", "_row", "_key", "row", "key", "doc", "id", "sha", "chars", "copies2", "keep_id", "text_sha256", "their_row", "grouped")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, None), (5, None, 1)], LABELS)


OPERATORS = {
    "packing": lambda d, _: pack(d, tokenizer_path()),
    "jaccard": lambda d, _: similarity_classes(d),
    "quality": quality_scores,
    "secrets": lambda d, _: secret_report(d),
    "mixing": lambda d, _: mix(d),
    "sharding": lambda d, _: shard_documents(d),
    "dedup": lambda d, _: exact_groups(d),
    "fingerprints": lambda d, _: compare_with_next(d),
    "language": lambda d, _: language_of(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_and_an_empty_table(docs, labels, name):
    n = OPERATORS[name](docs, labels).count()
    assert n >= len(ROWS) if name == "packing" else n == len(ROWS)
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_defined_results(docs):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in similarity_classes(docs).collect()}
    assert got[1, 3] == got[2, 3] == 1 and got[3, 0] == 3 and got[4, 0] == 4 and got[6, 0] == 6
    kept = {r["doc_id"]: r for r in exact_groups(docs).where("doc_id != 1").collect()}
    assert kept[3]["keep_id"] == kept[4]["keep_id"] == kept[6]["keep_id"] == 6 and kept[3]["group_size"] == 3
    assert sorted(r["doc_id"] for r in keep_one_per_class(docs).collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6]
    assert {r["doc_id"]: r["lang_pred"] for r in language_of(docs).collect()}[3] == "und"


def test_pages(spark):
    rows = [(1, None, None), (2, "http://h.org/a", ""), (2, "http://h.org/a", "<p>a &amp; b<br>c"), (None, "no host", "<nav>x</nav><div>text <b>bold</b></div><script>1</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    assert sorted(r["text"] for r in main_text(pages).collect()) == ["", "", "a & b c", "text bold"]
    assert main_text(pages.limit(0)).count() == 0


P = "Plain words of a paragraph that goes on for some time. " * 4
PARA = P.strip()
LAYOUTS = {
    "nested body": (f"<article><h1>T</h1><p>intro</p><div class=body><p>{P}</p><p>{P}</p></div></article>", ["T", "intro", PARA, PARA]),
    "list": (f"<article><p>{P}</p><ul>" + f"<li>{P}</li>" * 3 + "</ul></article>", [PARA] * 4),
    "quote": (f"<div class=post><p>lead</p><blockquote><p>{P}</p><p>{P}</p></blockquote><p>end</p></div>", ["lead", PARA, PARA, "end"]),
    "table": (f"<div class=post><p>lead</p><table><tr><td>{P}</td><td>b</td></tr><tr><td class=x>{P}</td></tr></table></div>", ["lead", PARA, "b", PARA]),
    "linked title": (f"<div class=post><h1><a href=/t>A linked title</a></h1><div class=body><p>{P}</p></div></div>", ["A linked title", PARA]),
    "links beside": (f"<div class=post><h1>T</h1><div class=body><p>{P}</p></div></div><div class=more>" + "<a href=/x>another page of the site</a> " * 9 + "</div>", ["T", PARA]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_pages_keep_the_whole_article(spark, name):
    html, want = LAYOUTS[name]
    page = f"<html><body><nav><a href=/>home</a></nav>{html}<footer>foot</footer></body></html>"
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", page) for i in range(3)], "page_id long, url string, html string")
    assert [r["text"].split("\n") for r in main_text(pages).collect()] == [want] * 3


#: A page of which the whole text of its article, and nothing else, is kept.
NAMED = {
    "page class": (f'<body><div id=page class="has-sidebar"><p>{P}</p><div class="sidebar">side</div></div></body>', [PARA]),
    "article class": (f'<body><article class="post tag-search comments-open"><p>{P}</p></article></body>', [PARA]),
    "article word": (f'<body><article class="social"><p>{P}</p></article><p class=ad>buy</p></body>', [PARA]),
    "main class": (f'<body><main class="with-related related"><p>{P}</p><div class="social-share">share</div></main></body>', [PARA]),
    "form": (f'<body><form action=/><div class=menu><a href=/a>a</a></div><div><p>{P}</p></div></form><form>search</form></body>', [PARA]),
    "data-id": (f'<body><div><p>{P}</p><p data-id="menu" data-role=search title="x id=ad">end</p></div></body>', [PARA, "end"]),
    "svg": (f'<body><div><p>{P}</p><svg class=i/><p>end</p><svg><text>no</text></svg></div></body>', [PARA, "end"]),
    "comments": (f'<body><article><p>{P}</p></article><div id=comments><p>{P}</p><p>{P}</p></div><div class="comment-7">c</div></body>', [PARA]),
}


@pytest.mark.parametrize("name", NAMED)
def test_pages_keep_articles_whatever_their_names(spark, name):
    html, want = NAMED[name]
    pages = spark.createDataFrame([(1, "http://h.org/a", html)], "page_id long, url string, html string")
    assert [r["text"].split("\n") for r in main_text(pages).collect()] == [want]


def test_pages_of_two_templates_take_the_path_that_covers_them(spark):
    one = f"<body><div class=content><p>{P}</p><p>{P}</p></div><div class=info><p><a href=/a>all about us</a></p></div></body>"
    two = f"<body><div class=info><p>{P}</p></div><ul><li><a href=/a>a link that leads away</a></li></ul></body>"
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", one if i < 2 else two) for i in range(8)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in main_text(pages).collect()}
    assert got == {i: [PARA] * 2 if i < 2 else [PARA] for i in range(8)}


def test_fingerprints_locate_edits(spark):
    text = "\n".join(f"paragraph number {i} says something" for i in range(40))
    both = spark.createDataFrame([(1, text), (2, text.replace("number 7 says", "number 7 denies")), (3, text)], "doc_id long, text string")
    fp = {r["doc_id"]: r["fingerprint"] for r in fingerprint_texts(both).collect()}
    assert fp[1] == fp[3] and edited_branches(fp[1], fp[3]) == []
    assert len(edited_branches(fp[1], fp[2])) == 1


@pytest.mark.parametrize("k", range(5))
def test_stages_take_edges_and_keep_columns(spark, docs, tmp_path, k):
    sf = str(tmp_path)
    spark.createDataFrame([], LABELS).write.parquet(f"{sf}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, sf)
    assert out.count() > 0 and stage(spark, docs.limit(0), sf).count() == 0
    if name != "packing":
        assert out.columns == docs.columns


def test_pipeline_keeps_what_brute_force_keeps(spark):
    """Each stage on its own input: one row per equal text, none but the smallest id of a class, whole copies."""
    d = spark.createDataFrame([(i, f"word{i} " * 3 + " ".join(f"w{i}x{j}" for j in range(30)), "en", "ab"[i % 2], 0) for i in range(20)] + [(100 + i, f"word{i} " * 3 + " ".join(f"w{i}x{j}" for j in range(29)), "en", "a", 0) for i in range(5)] + [(200 + i, f"word{i}  " * 3 + " ".join(f"w{i}x{j}" for j in range(30)), "en", "a", 0) for i in range(5)], SCHEMA)
    exact = stages.exact_dedup(spark, d, "")
    assert sorted(r["doc_id"] for r in exact.collect()) == [*range(5, 20), *range(100, 105), *range(200, 205)]
    near = stages.near_dedup(spark, exact, "")
    assert sorted(r["doc_id"] for r in near.collect()) == [*range(5, 20), *range(100, 105)]
    taken = {r["doc_id"]: r["count"] for r in mixed_documents(near).groupBy("doc_id").count().collect()}
    assert taken == {r["doc_id"]: r["copies"] for r in mix(near).where("copies > 0").collect()}


def test_near_dedup_keeps_different_texts_of_null_and_repeated_ids(spark):
    """Of each class the smallest id's row stays, whatever other rows have its id; rows without words all stay."""
    body = {k: " ".join(f"{k}{j}" for j in range(40)) for k in "abcdefgh"}
    rows = [(1, body["a"]), (None, body["a"] + " more"), (None, body["b"]), (None, body["c"]), (None, body["c"] + " more"), (None, None), (None, ""), (None, " ")]
    rows += [(7, body["d"]), (7, body["e"]), (3, body["e"] + " more"), (7, body["f"]), (8, body["g"]), (8, body["g"]), (9, body["h"]), (9, body["h"] + " more"), (9, " ")]
    d = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in stages.near_dedup(spark, d, "").collect()]
    sure = [(1, body["a"]), (None, body["b"]), (None, None), (None, ""), (None, " "), (7, body["d"]), (3, body["e"] + " more"), (7, body["f"]), (8, body["g"]), (9, " ")]
    assert all(got.count(r) == 1 for r in sure)
    rest = [r for r in got if r not in sure]
    assert sorted((str(i), t.split()[0]) for i, t in rest) == [("9", "h0"), ("None", "c0")]


def test_stages_return_the_callers_columns_unchanged(spark, docs, tmp_path):
    """Columns named like the operators' own come back with their values."""
    names = ["_n", "_k", "_copy", "_sha", "row", "key", "doc", "id", "copies"]
    for stage in (stages.exact_dedup, stages.near_dedup, stages.mixing):
        assert {tuple(r) for r in stage(spark, docs, "").select(*names).collect()} == {("x",) * len(names)}


def test_memory_is_bounded_by_rows_and_trigrams():
    """2 MB of text with 100,000 trigrams, 10,000 short texts and 200,000 equal texts stay far below what one dense table would take."""
    import tracemalloc

    import numpy as np

    from studyforge.llm import language_id, quality
    from studyforge.llm.common import slices

    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 100_000)))
    letters = language_id.Letters(language_id.DIMENSIONS, 11)
    doc, num, codes = language_id.trigrams([text])
    assert len(codes) > 90_000
    tracemalloc.start()
    some = language_id.bundled(letters, 1, doc, num, codes)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    few = slice(0, 500)
    want = language_id.bound(letters, codes[few]).sum(0)
    assert np.allclose(language_id.bundled(letters, 1, doc[num < 500], num[num < 500], codes[few])[0], want) and some.shape == (1, letters.dims)
    tracemalloc.reset_peak()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["two words"] * 10_000})
    for b in slices(batch, "text", quality.BATCH_BYTES, quality.BATCH_ROWS):
        assert b.num_rows <= quality.BATCH_ROWS
        quality.features(b.column(0).to_pylist())
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    trie = exact_dedup.RadixTrie(96_000_000, itertools.count())
    for i in range(200_000):
        assert trie.add(b"body", b"tag", 4, 200_000 - i, 1, (i,)) == 0
    assert [(key, o.rows, o.id, m) for key, o, m in trie.drain()] == [(b"body", 200_000, 1, None)] and trie.held < 1000


@pytest.mark.parametrize("kind", ["words", "chain", "prefix", "long"])
def test_trie_spills_subtrees_and_keeps_every_owner(kind):
    """Owners and rows under a tight budget equal those of a dict, subtrees spilled again and again and within one another."""
    rng = random.Random(3)
    make = {
        "words": lambda: bytes(rng.choices(b"abcd", k=rng.randint(0, 9))),
        "chain": lambda: b"a" * rng.randint(0, 300),
        "prefix": lambda: b"p" * 400 + bytes(rng.choices(b"xyz", k=rng.randint(0, 7))) + b"q" * 50,
        "long": lambda: bytes([rng.randint(65, 70)]) * 9_000 + bytes(rng.choices(b"xy", k=3)),
    }[kind]
    trie, want, told, ends = exact_dedup.RadixTrie(6_000, itertools.count()), {}, {}, {}
    for i in range(4_000):
        key, chars, doc_id = make(), rng.randint(1, 3), rng.choice([None, *range(50)])
        rank = (-chars, doc_id is None, doc_id or 0)
        old = want.get(key)
        want[key] = (min(rank, old[0]) if old else rank, (old[1] if old else 0) + 1)
        number = trie.add(key, b"t", chars, doc_id, 1, (i, key))
        if number is not None:
            told[i] = (number, key)
        assert trie.held <= 6_000 or trie.owners <= 1 or kind == "long"
    assert trie.spilled > (1 if kind == "chain" else 3)
    got = {}
    for key, owner, member in trie.drain():
        if key is None:
            told[member[0]] = (owner, member[1])
        else:
            assert key not in got and owner.number not in ends
            got[key], ends[owner.number] = ((-owner.chars, owner.id is None, owner.id or 0), owner.rows), key
    assert got == want
    assert sorted(told) == list(range(4_000)) and all(ends[number] == key for number, key in told.values())


def test_dedup_spills_and_short_digests_give_the_same_groups(spark):
    rows = [(i, f"text {i % 40} " * 30) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, exact_groups(d).collect()))
    assert want == sorted(map(tuple, exact_groups(d, digest_bytes=1, budget=2_000).collect()))


def test_mixing_takes_the_same_texts_in_every_partitioning(spark):
    """Different texts of one size with null or equal ids: reruns over other partitions take the same ones."""
    rows = [(None if i % 2 else 7, f"text number {i}", "en", "ab"[i % 3 == 0], 0) for i in range(400)] + [(None, "text number 1", "en", "a", 0)] * 3
    d = spark.createDataFrame(rows, SCHEMA)
    got = [sorted((str(r["doc_id"]), r["text"]) for r in mixed_documents(d.repartition(n)).collect()) for n in (3, 7)]
    assert got[0] == got[1] and len({t for _, t in got[0]}) > 200
