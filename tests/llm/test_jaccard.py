"""The Jaccard join where groups are crowded: parameters so small that every path is taken."""

import random

import numpy as np
import pyarrow as pa

from studyforge.llm import jaccard_join as J


def families(seed: int, families: int = 6, members: int = 25) -> list[tuple[int, str]]:
    """Texts that keep between nine tenths and half of a family's passages, and texts that share one passage with all."""
    r = random.Random(seed)
    common = " ".join(f"common{i}" for i in range(12))
    out = []
    for f in range(families):
        base = [f"f{f}w{i}" for i in range(80)]
        for m in range(members):
            words = list(base)
            start = r.randrange(60)
            words[start : start + r.choice((1, 2, 4, 8, 12, 30))] = [f"f{f}m{m}x{i}" for i in range(r.choice((1, 4, 9)))]
            out.append(" ".join(words) + (f" {common}" if m % 3 == 0 else ""))
    out += [f"{common} own{i} words{i} here{i}" for i in range(20)] + [f"{common} " + " ".join(f"a{i}b{j}" for j in range(4)) for i in range(20)]
    return list(enumerate(out))


def brute(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in rows)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


def test_forced_parameters_equal_all_pairs(spark, monkeypatch):
    """Long lists in cells, one member tried first, one pair a group, hardly any neighbour: the classes are those of all pairs."""
    rows = families(1)
    want = brute(rows)
    assert 20 < len(set(want.values())) < len(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in J.similarity_classes(d).collect()} == want
    for name, value in (("LIST", 3), ("TRIES", 1), ("GROUP", 1), ("FIRST", 1), ("FREQUENT", 10)):
        monkeypatch.setattr(J, name, value)
    assert {r["doc_id"]: r["component_id"] for r in J.similarity_classes(d).collect()} == want


def entries(seed: int) -> dict:
    r = np.random.default_rng(seed)
    token = np.sort(r.choice([5, 6, 7], 400, p=[0.8, 0.15, 0.05]))
    lo = r.integers(4, 60, 400)
    hi = lo + r.integers(0, 5, 400) * (r.random(400) < 0.3)
    return {"token": token, "cell": np.zeros(400, np.int32), "part": np.zeros(400, np.int32), "g": r.permutation(4000)[:400], "lo": lo, "hi": hi, "slack": np.maximum(1, hi - r.integers(0, 20, 400)), "solo": lo == hi, "comp": r.integers(0, 80, 400), "bits": [np.zeros(J.BITS // 64, np.int64)] * 400}


def test_skipped_blocks_lose_no_pair(monkeypatch):
    """Pairs of a list by blocks, whatever their length, are those that a look at all pairs gives."""
    e = entries(2)
    want = set()
    for i in range(400):
        for j in range(400):
            if e["token"][i] == e["token"][j] and e["g"][i] < e["g"][j] and e["comp"][i] != e["comp"][j]:
                sizes = [(a, b) for a in range(e["lo"][i], e["hi"][i] + 1) for b in range(e["lo"][j], e["hi"][j] + 1) if 4 * min(a, b) >= 3 * max(a, b)]
                if any(min(e["slack"][i], e["slack"][j]) >= -(-3 * (a + b) // 7) for a, b in sizes):
                    want.add((int(e["g"][i]), int(e["g"][j])))
    table = pa.table(e)
    for block in (2, 7, 32, 1000):
        monkeypatch.setattr(J, "BLOCK", block)
        got = set()
        for rows in J._pairs(table.to_batches(max_chunksize=90)):
            got |= set(zip(rows["a"].tolist(), rows["b"].tolist(), strict=True))
        assert want <= got and len(got) <= 1.3 * len(want)


def test_equal_first_signatures_are_told_apart():
    texts = ["a b c d e f", "g h i j k l"]
    doc, h = J.shingles(texts)
    _, v, sig = J._vertices(2, doc, h)
    _, told, _ = J._vertices(2, doc, h, frozenset(v.tolist()))
    assert (told == (v ^ sig)).all()


def test_bitmaps_bound_the_difference_of_sets():
    texts = [t for _, t in families(3, 2, 12)]
    doc, h = J.shingles(texts)
    bits = J._bitmaps(len(texts), doc, h)
    sets = [set(h[doc == i].tolist()) for i in range(len(texts))]
    far = {(i, j): int(np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum()) for i in range(len(texts)) for j in range(len(texts))}
    assert all(d <= len(sets[i] ^ sets[j]) for (i, j), d in far.items()) and max(far.values()) > 60


def test_boilerplate_below_the_threshold_gives_hardly_any_pair(spark):
    """600 sets that share between 56 and 67 % of their shingles with each other: frequent tokens of all values stand last, so nearly no pair is formed."""
    n = 600
    for shared in (72, 75, 78, 80):  # of 100 shingles
        rng = random.Random(shared)
        rows = [(i, " ".join([f"own{i}x{j}" for j in range(100 - shared)] + [f"all{j}" for j in range(shared + 4)])) for i in range(n)]
        rng.shuffle(rows)
        d = spark.createDataFrame(rows, "doc_id long, text string")
        table, _ = J.frequent_tokens(d)
        late = spark.sparkContext.broadcast(table)
        e = J.entries_of_texts(d, late, {}, frozenset()).toPandas().sort_values(["token", "cell"], kind="stable")
        e["comp"], e["bits"] = e["g"], [np.zeros(J.BITS // 64, np.int64)] * len(e)
        pairs = sum(len(rows_["a"]) for rows_ in J._pairs(pa.Table.from_pandas(e, preserve_index=False).to_batches()))
        assert pairs <= n, (shared, pairs)


def test_tokens_are_counted_in_all_documents(spark, monkeypatch):
    """Tokens of FREQUENT documents are told, those of one less are not, and shards follow the whole count, in however many parts it is made."""
    many, few = J.FREQUENT, J.FREQUENT - 1
    rows = [(i, f"often o1 o2 o3 o4{' s0 s1 s2 s3 s4' if i < few else ''}") for i in range(many)]
    rows += [(100 + i, f"single{i} a b c d") for i in range(200)]
    token = {t: int(J.shingles([t])[1].view(np.int64)[0]) for t in ("often o1 o2 o3 o4", "s0 s1 s2 s3 s4")}
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for counted in (J.COUNTED, 3):
        monkeypatch.setattr(J, "COUNTED", counted)
        monkeypatch.setattr(J, "LIST", 4)
        table, shards = J.frequent_tokens(d)
        told = J._in_table(table, np.array(list(token.values()), np.int64))
        assert told.tolist() == [True, False]
        low = {t: int(J._low(np.array([x], np.int64))[0]) for t, x in token.items()}
        assert shards == {low["often o1 o2 o3 o4"]: -(-many // 4)}
        e = J._dealt(shards, np.array([token["often o1 o2 o3 o4"], token["s0 s1 s2 s3 s4"]], np.int64), g=np.array([7, 7]))
        assert len(e["token"]) == -(-many // 4) + 1


def test_sets_just_below_the_threshold_do_not_meet_every_member(spark, monkeypatch):
    """150 near copies and 60 texts one shingle short of a link to them: the pairs looked at stay far from 150 * 60, and the classes are those of all pairs."""
    base = [f"w{i}" for i in range(150)]
    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = list(base)
        words[0 if i % 2 else -1] = f"m{i}"
        rows.append((i, " ".join(words)))
    for i in range(60):
        # four words apart from each other and the third: 20 shingles and 3, or 20 and 1
        words = list(base)
        for at in [2 if i % 10 == 9 else 0] + [rng.randrange(8 + 35 * k, 35 + 35 * k) for k in range(4)]:
            words[at] = f"far{i}x{at}"
        rows.append((150 + i, " ".join(words)))
    made = []
    plain = J.Tables.cut

    def counted(self, df, name):
        out = plain(self, df, name)
        if name in ("items", "cross", "pairs"):
            made.append(out.count())
        return out

    monkeypatch.setattr(J.Tables, "cut", counted)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in J.similarity_classes(d).collect()} == brute(rows)
    assert sum(made) <= (J.TRIES + 2) * 60, made


def test_many_bitmaps_are_shuffled_and_give_the_same_classes(spark, monkeypatch):
    """Bitmaps beyond BITMAPS rows go to their entries by a shuffle."""
    sent = []
    plain = J.only

    def watched(df, rows, on, how="left_semi", most=1_000_000):
        if "bits" in rows.columns:
            sent.append(most)
        return plain(df, rows, on, how, most)

    monkeypatch.setattr(J, "only", watched)
    monkeypatch.setattr(J, "BITMAPS", 10)
    rows = families(7, 2, 10)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in J.similarity_classes(d).collect()} == brute(rows)
    assert sent == [10]
