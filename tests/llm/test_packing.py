import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from headwater.llm.packing import WordTokenizer, cuts, pack

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
ODD = ["", None, "it's we'RE 'sleep' don''t", "á ́b", "ΣΑΣ ΌΣΟΣ", "İstanbul", "x y z\x1cw", "<|endoftext|>a <|startoftext|>", "1234 5,6!!", "汉字漢字 かな", "word*** a&&&.b", "퟿\U0001f600🙂!", "''s", "don't.", "tail'", "<|EndOfText|>", "a.b,c !!, x.'s .5", "é.ü,… …. ÷.", "x" * 300]


def test_ids_equal_whole_text_encoding():
    t = tokenizers.Tokenizer.from_file(PATH)
    for cache in (400_000, 3):
        words = WordTokenizer(PATH, cache)
        for text in [x or "" for x in ODD] * 2:
            assert np.frombuffer(words.encode(pa.array([text, "b"]))[0], np.uint16).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_cuts_are_cheapest():
    rng = random.Random(3)
    for _ in range(30):
        at = sorted({0, *(rng.randrange(1, 200) for _ in range(25)), *range(0, 200, 10), 200})
        penalty = [0, *(rng.choice((0, 2, 9)) for _ in at[1:-1]), 0]
        best = {0: 0}
        for j in range(1, len(at)):
            best[at[j]] = min(best[at[i]] + 32 - (at[j] - at[i]) + penalty[j] for i in range(j) if at[j] - at[i] <= 32)
        got = cuts(at, penalty, 32)
        assert got[0] == 0 and got[-1] == 200
        assert sum(32 - (b - a) + penalty[at.index(b)] for a, b in zip(got, got[1:])) == best[200]


@pytest.mark.parametrize("block", [16 * 64, 1 << 14])
def test_round_trip(spark, block):
    rows = [(i, ODD[i % len(ODD)], "z") for i in range(40)] + [(99, "Long one. " * 3000, "z"), (None, "no id", "z"), (200, "twice", "z"), (200, "twice", "z")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), PATH, max_len=64, block=block).collect()
    check(rows, got, 64)
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert sum(filled.values()) > 0.9 * 64 * len(filled)


def check(rows, got, most):
    """Every id of every document lies in as many pieces as its row comes; sequences have no gaps."""
    t = tokenizers.Tokenizer.from_file(PATH)
    want, copies, seen, filled = {}, Counter(), Counter(), Counter()
    for i, text, *_ in rows:
        want[i] = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        copies.update((i, k) for k in range(len(want[i])))
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id] and r.doc_tokens == len(want[r.doc_id])
        assert r.ids == want[r.doc_id][r.start : r.start + r.length].tobytes() and len(r.ids) == 4 * r.length > 0
        filled[r.sequence_id] += r.length
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    assert seen == copies and max(filled.values()) <= most


@pytest.mark.parametrize("parts", [1, 60])
def test_little_padding_in_any_number_of_partitions(spark, parts):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "stone.", "water", "falls", "again."]) for _ in range(rng.randint(0, 90)))) for i in range(1500)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), PATH, max_len=256, block=16 * 256).collect()
    check(rows, got, 256)
    assert sum(r.length for r in got) > 0.985 * 256 * len({r.sequence_id for r in got})


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
