import random

import numpy as np
from pyspark.sql import functions as F

from headwater.llm.quality import COST, WIDTH, classify, descend, fit_rows, indicators, may_learn


def sample(n):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        some = [rng.choice(["the", "and", "river", "under", "stone", "light"]) for _ in range(rng.randint(3, 60))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in some) if bad else " ".join(some), int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = sample(600)
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = classify(docs, labels).withColumn("free", may_learn(F.col("doc_id"))).collect()
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if not r.free]
    assert len(got) == 600 and len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_copied_words_are_a_shape():
    """n-grams of shapes see that words repeat, whatever the words are."""
    plain = [indicators(f"{a} {b} {c} {d}") for a, b, c, d in (("one", "two", "six", "ten"), ("red", "sky", "sun", "sea"))]
    copied = [indicators(" ".join([w] * 4)) for w in ("one", "red")]
    assert len(np.intersect1d(*copied)) > len(np.intersect1d(*plain)) == len(np.intersect1d(plain[0], indicators("abc xyz ijk uvw")))
    assert indicators("Ab12! Ab12!").tolist() == sorted(set(indicators("Ab12! Ab12!")))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x"), (3, "word " * 200000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 5), (2, 0)], "doc_id long, quality int")
    got = classify(docs, labels).collect()
    assert len(got) == 5 and all(r.score is not None and r.predicted in (0, 1) for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    assert {r.predicted for r in classify(docs, labels.limit(0)).collect()} == {1}
    assert classify(docs.limit(0), labels).count() == 0


def test_hinge_loss_is_least():
    """The dual's solution has nearly no gap to its primal on a small problem."""
    rows = [indicators(t) for _, t, _ in sample(60)]
    labels = np.array([q for *_, q in sample(60)])
    w, b = descend(rows, labels, np.ones(WIDTH))
    assert all((w[p].sum() / np.sqrt(len(p)) + b > 0) == bool(q) for p, q in zip(rows, labels))
    # the loss whose minimum it is, from scratch: no step away from the solution lowers it by over a fiftieth
    y, share = np.where(labels > 0, 1, -1), np.array([(labels == 0).mean(), (labels > 0).mean()])
    x = np.zeros((len(rows), WIDTH))
    for i, places in enumerate(rows):
        x[i, places] = 1 / np.sqrt(len(places))
    loss = lambda w, b: (w @ w + b * b) / 2 + (COST / (2 * share[labels]) * np.maximum(0, 1 - y * (x @ w + b))).sum()
    rng, best = np.random.default_rng(1), loss(w, b)
    for size in (1e-3, 1e-2, 1e-1):
        for _ in range(50):
            step = rng.normal(size=len(rows)) @ x * size
            assert loss(w + step, b + rng.normal() * size) > best * 0.98
    assert fit_rows([], np.array([])).score(indicators("x")) > 0.5
