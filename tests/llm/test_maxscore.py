import math

import numpy as np
from pyspark.sql import functions as F

from headwater.llm.maxscore import essential, top_k, top_of_shard


def by_hand(rows, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    best = []
    for at, (q, a) in enumerate(good):
        if q % every == 0:
            mine = sorted((-sum(x * y for x, y in zip(a, b)), c) for other, (c, b) in enumerate(good) if other != at and len(b) == len(a))
            best += [(q, n + 1, c, -s) for n, (s, c) in enumerate(mine[:k])]
    return best


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=24) * (1 + (i % 7 == 0))]) for i in range(900)]
    rows += [(1000 + i, [0.25] * 24) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert got(top_k(frame, 5, 10, shard=2048)) == sorted(by_hand(exact, 5, 10))
    assert got(top_k(frame, 5, 10, shard=100, least=100)) == sorted(by_hand(exact, 5, 10))


def test_shards_are_skipped_and_terms_left_aside():
    """Few strong terms: the rest is non-essential, and a shard without them is not traversed."""
    rng = np.random.default_rng(6)
    vectors = rng.integers(-3, 4, (500, 30))
    vectors[:20, :2] += 900
    query = np.concatenate([[50, 60], rng.integers(-2, 3, 28)])[None, :]
    gaps = np.sort(np.abs(query[0]) * (vectors.max(axis=0) - vectors.min(axis=0)))[::-1]
    low = np.minimum(query[0] * vectors.max(axis=0), query[0] * vectors.min(axis=0)).sum()
    assert 1 <= essential(gaps, low, np.sort(vectors @ query[0])[-5]) <= 2
    rows = np.arange(500)
    ask = lambda t: (np.array([0]), np.array([-1]), query, np.array([t]))
    want = sorted((-s, i) for i, s in enumerate((vectors @ query[0]).tolist()))[:5]
    assert [(-s, i) for i, s in zip(*top_of_shard((rows, rows, vectors), ask(-np.inf), 5)[2:])] == want
    assert top_of_shard((rows[20:], rows[20:], vectors[20:]), ask(float(-want[-1][0])), 5)[2] == []


def test_repeated_queries_have_their_own_rows(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [-1.0, 0.5]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (9, [0.0, 1.0])] + [(1000 + i, [1.0, 2.0]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert got(top_k(frame)) == sorted(by_hand(rows, 5, 50)) and len(by_hand(rows, 5, 50)) >= 15
    assert got(top_k(frame, shard=50, least=50)) == sorted(by_hand(rows, 5, 50))


def test_odd_vectors(spark):
    rows = [(0, [1.0, None]), (1, None), (None, [1.0, 1.0]), (2, [math.nan, 1.0]), (3, [math.inf, 0.0]), (50, [0.1, -0.2]), (51, [1e6, 1e6]), (52, [1.0]), (53, []), (100, [-3e6, 2.5e6]), (54, [1e6, -1e6]), (150, []), (51, [1e6, 1e6])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    want = [r for r in by_hand(rows, 5, 50)]
    assert got(top_k(frame)) == sorted(want)


def test_no_rows(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
