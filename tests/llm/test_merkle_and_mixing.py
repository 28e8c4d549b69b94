import random

import pytest

from studyforge.llm.fingerprints import Tree, edited_branches, likeness, parse
from studyforge.llm.mixing import LEAF_ROWS, hand_down, mix, pivot


def like(a, b):
    return likeness(a, b, a.leaves(), b.leaves())


def test_merkle_levels():
    lines = [f"Paragraph {i} says this. And it says that, number {i * i}." for i in range(40)]
    a = Tree("\n".join(lines))
    assert like(a, Tree("\n".join(lines))) == 1.0 and a.root == Tree("\n".join(lines)).root
    swapped = Tree("\n".join([lines[1], lines[0], *lines[2:]]))
    assert a.root != swapped.root and 0.9 < like(a, swapped) < 1.0
    edited = Tree("\n".join([*lines[:20], "Something else is here now.", *lines[21:]]))
    place = [(i, j) for i, (_, ps) in enumerate(a.sections) for j in range(len(ps))][20]
    assert edited_branches(str(a), str(edited)) == [place]
    assert [[p for p, _ in ps] for _, ps in parse(str(a))] == [[p for p, _ in ps] for _, ps in a.sections]
    # the same characters cut into paragraphs elsewhere, and blank ones, are other texts
    assert len({Tree(t).root for t in ("", "\n", "\n\n", "ab", "a\nb", "ab\n", "\nab")}) == 7
    assert like(Tree(""), Tree("")) == 1.0 and like(Tree(""), Tree("a")) == 0.0


@pytest.mark.parametrize("seed", range(20))
def test_hand_down_keeps_words_and_leaves_a_short_one_open(seed):
    rng = random.Random(seed)
    sizes = sorted([50_000] + [rng.randrange(50, 200) for _ in range(3_000)], reverse=True)
    probs = [rng.random() for _ in sizes]
    p = pivot(list(range(len(sizes))), sizes, probs, seed)
    q = hand_down(sizes, probs, p, rng.random())
    words = lambda x: sum(n * y for n, y in zip(sizes, x, strict=True))
    assert words(q) == pytest.approx(words(probs)) and all(0 <= x <= 1 for x in q)
    assert all(sizes[i] < 200 for i, x in enumerate(q) if 0 < x < 1)


def test_hand_down_without_help_changes_nothing():
    assert hand_down([100, 5], [0.5, 0.5], [0.5, 1.0], 0.3) == [0.5, 1.0]
    assert hand_down([], [], [], 0.3) == []


def test_sources_meet_their_targets_beside_a_large_one(spark):
    rng = random.Random(3)
    rows = [(i, "a", "w " * rng.randrange(1, 6)) for i in range(3 * LEAF_ROWS)]
    rows += [(100_000 + i, s, "w " * (5_000 if i == 0 else rng.randrange(10, 60))) for s in ("b", "c") for i in range(800)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    for s in ("a", "b", "c"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60
