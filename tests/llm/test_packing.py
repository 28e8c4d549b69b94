import zlib
from collections import defaultdict

import numpy as np
import pytest

from studyforge.llm.packing import PARTS, Rounds, mixture_parts, pack, window_pieces
from studyforge.llm.queries import tokenizer_path


@pytest.mark.parametrize("weights", [None, [5, 1, 1, 3]])
def test_rounds_equal_a_simulated_round_robin(weights):
    """Deficit round-robin, token by token, against the closed forms."""
    totals = [700, 35, 0, 2300]
    parts, window = mixture_parts(totals, weights), 64
    plan, deficits, left, stream, r = Rounds(np.array(totals), np.array(parts), window), [0] * 4, list(totals), [], 0
    while sum(left):
        for s in range(4):
            deficits[s] += window * parts[s]
            k = min(deficits[s] // PARTS, left[s])
            deficits[s] -= (deficits[s] // PARTS) * PARTS
            stream += [(s, totals[s] - left[s] + i) for i in range(k)]
            left[s] -= k
        r += 1
    where = {x: i for i, x in enumerate(stream)}
    for s, t in enumerate(totals):
        if t:
            doc, lo, pos, length = plan.runs(s, np.array([0, t // 3]), np.array([t // 3, t - t // 3]))
            seen = {}
            for d, a, p, n in zip(doc, lo, pos, length):
                for i in range(n):
                    seen[(0, t // 3)[d] + a + i] = p + i
            assert seen == {j: where[s, j] for j in range(t)}


def test_window_pieces_cut_the_tail_at_powers_of_two():
    run, skip, seq, off, k = window_pieces(np.array([0]), np.array([16 + 16 + 13]), 45, 16)
    assert k.tolist() == [16, 16, 8, 4, 1] and seq.tolist() == [0, 1, 2, 3, 4] and off.tolist() == [0] * 5 and skip.tolist() == [0, 16, 32, 40, 44]


def test_pack_round_trip_and_edges(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["", None, "a", "Hello, world.\n\nNext  line ", "^a b ^a", " lead", "don't they're 12,5 x.,. é ñ 日本  x", "<|endoftext|> in text", "word " * 4000, "tab\tand\x1fsep \x85 y", "same text", "same text"]
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 3}", 1) for i, t in enumerate(texts)] + [(None, "no id", "s1", 1), (10, "same text", "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, start int")
    got = pack(df, tokenizer_path(), window=256, with_ids=True).collect()
    seqs = defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seqs.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    for i, t, *_ in rows:
        want = tok.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r["start"], r["ids"]) for r in got if r["doc_id"] == i and r["doc_tokens"] == len(want))
        times = sum(x[0] == i and x[1] == t for x in rows)
        flat = [k for _, ids in mine for k in ids]
        assert sorted(flat) == sorted(want * times)
        if times == 1:
            assert flat == want
    assert pack(df.limit(0), tokenizer_path()).count() == 0


def test_windows_hold_the_mixture(spark):
    rows = [(i, "some words here " * (20 + i % 7), "big" if i % 3 else "small") for i in range(300)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), tokenizer_path(), window=512).toPandas()
    share = got[got.source == "big"].length.sum() / got.length.sum()
    full = got.groupby("sequence_id").length.sum() == 512
    per = got[got.source == "big"].groupby("sequence_id").length.sum()[full]
    assert (abs(per / 512 - share) < 0.02).all()


def test_letters_are_encoded_once_whatever_marks_and_line_breaks_follow(monkeypatch):
    """200 words before and after line breaks, each pair other, and with marks: the tokenizer gets each word once with and once without a space; ids are those of whole texts."""
    import tokenizers

    from studyforge.llm import packing
    from studyforge.llm.common import tokenizer_path

    plain, given = tokenizers.Tokenizer, []

    class Counting:
        def __init__(self, tok):
            self.tok = tok

        from_file = staticmethod(lambda path: Counting(plain.from_file(path)))

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode_batch_fast(self, parts, **options):
            given.extend(parts)
            return self.tok.encode_batch_fast(parts, **options)

    tok = plain.from_file(tokenizer_path())
    monkeypatch.setattr(tokenizers, "Tokenizer", lambda model: Counting(plain(model)))
    tokenizers.Tokenizer.from_file = Counting.from_file
    names = ["é" * (i % 3) + "".join(chr(97 + int(d)) for d in str(1000 + i)) for i in range(200)]
    texts = [" ".join(f"{a}{m}\n{names[(i * 7 + k) % 200]}{m}" for i, a in enumerate(names)) for k, m in enumerate((".", ",", "!!", "$$$", "", ".%%%"))]
    odd = ["a'll\nb", "x.\n\ny", "l'été.\nÉté 's", "ǆ\nz", "a\tb c", "²x\n3", ""]
    ids = packing._make_encoder(tokenizer_path(), 1)(texts + odd)
    assert [np.frombuffer(x, "<u2").tolist() for x in ids] == [[*e.ids, 1] for e in tok.encode_batch_fast(texts + odd, add_special_tokens=False)]
    assert len(given) <= 2 * len(names) + 40, len(given)
