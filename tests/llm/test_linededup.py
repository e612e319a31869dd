import random
import re

import pytest

from headwater.llm.linededup import WORDS, dedup


def count(line):
    return len([x for x in re.split("[ \t\n\x0b\x0c\r]+", line) if x])


def by_hand(rows, words=WORDS):
    """Lines kept of each (doc_id, text): every pair of places with equal lines is extended to its longest run."""
    order, out = {}, {}
    docs = sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0))
    split = [[(k, x, count(x)) for k, x in enumerate(t.split("\n")) if count(x)] for _, t in docs]
    for d, lines in enumerate(split):
        for p, (_, x, _) in enumerate(lines):
            order.setdefault(x, []).append((d, p))
    gone = [set() for _ in docs]
    for spots in order.values():
        for n, (d2, q) in enumerate(spots):
            for d1, p in spots[:n]:
                if p and q and split[d1][p - 1][1] == split[d2][q - 1][1]:
                    continue  # not where the run begins
                size = 0
                while p + size < len(split[d1]) and q + size < len(split[d2]) and split[d1][p + size][1] == split[d2][q + size][1]:
                    size += 1
                most = size if d1 != d2 else q - p
                for a in range(q, q + size):
                    b = min(a + most, q + size)
                    if sum(w for _, _, w in split[d2][a:b]) >= words:
                        gone[d2].update(range(split[d2][a][0], split[d2][b - 1][0] + 1))
    for (i, text), drop in zip(docs, gone):
        out[i, text] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 4, 9, 20, 60]))) for _ in range(60)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(2, 12))] for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice([rng.choice(runs), [f"own {i} {rng.random()}"], [rng.choice(pool)]]) for _ in range(rng.randint(1, 8))]
        rows.append((i, "\n".join(x for p in parts for x in p)))
    want = by_hand(rows)
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 150
    for r, (i, text) in zip(sorted(got), rows):
        assert r.text == want.get((i, text), text)
        assert r.n_lines == len(text.split("\n"))
    assert any(r.n_removed for r in got)


def test_long_line_and_periodic_text(spark):
    line = " ".join(f"w{k}" for k in range(55))
    rows = [(2, "intro\n" + line + "\nend"), (1, line), (3, "\n".join(["one two"] * 100)), (4, " ".join(["x"] * 49))]
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == line and got[2].text == "intro\nend" and got[2].n_removed == 1
    assert got[3].text == "\n".join(["one two"] * 25) and got[3].n_removed == 75
    assert got[4].n_removed == 0


def test_a_run_is_deleted_to_its_ends(spark):
    """Lines past the last window, or before the first, go with the run that they belong to."""
    line = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    run = [line("a", 30), line("b", 30), line("c", 15)]
    rows = [(1, "\n".join([*run, "own end"])), (2, "\n".join([*run, "another"])), (3, "\n".join(["head", line("z", 60), line("y", 40)])), (4, "\n".join([line("z", 60), line("y", 40)])), (5, "\n".join([line("x", 10), *run[:2]]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F_lit())
    got = {r.doc_id: r.text for r in dedup(frame).collect()}
    assert got == {1: rows[0][1], 2: "another", 3: rows[2][1], 4: "", 5: line("x", 10)}


def test_the_longest_earlier_run_counts(spark):
    """A line that only the second of three occurrences has is deleted from the third."""
    line = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, line("p", 60)), (2, "\n".join([line("p", 60), line("q", 20)])), (3, "\n".join([line("p", 60), line("q", 20), "own"]))]
    got = {r.doc_id: r.text for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: line("p", 60), 2: line("q", 20), 3: "own"}


def test_odd_rows(spark):
    long = "\n".join(f"line {k} of a long text" for k in range(20000))
    rows = [(5, None, 1), (5, "", 1), (5, "\n\n", 1), (7, long, 1), (7, long, 1), (None, long, 1), (8, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines long").withColumnRenamed("n_lines", "line").withColumn("hash", F_lit())
    got = dedup(frame).collect()
    assert len(got) == 7 and set(got[0].asDict()) == {"doc_id", "text", "line", "hash", "n_lines", "n_removed"}
    at = {}
    for r in got:
        at.setdefault(r.doc_id, []).append(r)
    assert sorted((r.text, r.n_lines) for r in at[5] if r.text is not None) == [("", 1), ("\n\n", 3)]
    assert [r.n_lines for r in at[5] if r.text is None] == [0]
    assert at[None][0].text == long and [r.text for r in at[7]] == ["", ""]
    assert dedup(frame.limit(0)).count() == 0


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("h")
