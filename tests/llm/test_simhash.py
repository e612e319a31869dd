import numpy as np
import pytest

from headwater.llm.simhash import BLOCKS, RADIUS, fingerprint, links, near_duplicates, one_of_each


def components_by_hand(values):
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    v = np.array(values, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= RADIUS).tolist():
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(v))]


@pytest.mark.parametrize("heavy", [1 << 20, 3])
def test_links_span_every_component(spark, heavy):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    values = set()
    for c in centres.tolist():
        for _ in range(12):
            bits = rng.choice(64, rng.integers(0, 8), replace=False)
            values.add(c ^ sum(1 << int(b) for b in bits))
    values = sorted(values)
    assert sum(BLOCKS) == 64
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    found = [(r.a, r.b) for r in links(frame, heavy).collect()]
    at = {int(np.uint64(v).view(np.int64)): i for i, v in enumerate(values)}
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in found:
        a, b = root(at[a]), root(at[b])
        up[max(a, b)] = min(a, b)
    want = components_by_hand(values)
    assert len({(root(i), w) for i, w in enumerate(want)}) == len(set(want)) == len({root(i) for i in range(len(values))})


def test_every_rotation_finds_its_pairs(spark):
    """Pairs that only one rotation's first block leaves equal."""
    base = 0x0123456789ABCDEF
    ends = np.cumsum((0, *BLOCKS))
    for turn in range(5):
        other = base
        for block in range(5):
            if block != turn:
                other ^= 1 << (63 - int(ends[block]))
        frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in (base, other)], "fp long")
        assert links(frame).count() >= 1, turn


def test_odd_rows(spark):
    rows = [(5, None, "x"), (3, "", "x"), (9, " \t", "y"), (1, "a b", None), (1, "a b", None), (None, "A  b", "z"), (7, "word " * 30000, "z")]
    got = {}
    for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect():
        got.setdefault(r.doc_id, []).append((r.fp, r.component_id))
    assert got[5] == got[3] == got[9] == [(0, 3)]
    assert len(got[1]) == 2 and got[None][0] == got[1][0] and got[1][0][1] == 1
    assert got[7][0][1] == 7
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprint_of_few_words():
    from xxhash import xxh64_intdigest

    assert fingerprint("One\x0btwo  THREE") == xxh64_intdigest(b"one two three", 42)
    assert fingerprint("É x y z") == xxh64_intdigest("É x y z".encode(), 42)


def test_one_of_each(spark):
    rows = [(5, "a b c d e", 1), (3, "a b c d e", 2), (3, "a b c d e", 2), (3, "quite another text here", 3), (None, "A b c d e", 4), (None, "no id at all here", 5), (None, "no id at all here", 6), (9, "", 7), (8, None, 8)]
    got = sorted((r.doc_id or 0, r.text or "") for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string, root int")).collect())
    assert got == [(0, "no id at all here"), (3, "a b c d e"), (3, "quite another text here"), (8, "")]
