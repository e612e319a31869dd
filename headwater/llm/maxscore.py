"""Exact top-k inner-product search by MaxScore over integer vectors.

The dimensions of the vectors are the terms.  Vectors are dealt by row into
shards, and queries into blocks, both bounded in size, so copies of one vector
spread over all shards; each block meets each shard in one task-sized row.

In a shard a term adds to any vector's score at least its low and at most its
high bound.  A query's threshold is its k-th best score so far: first that of a
single shard which all blocks meet beforehand, then that of the ``PROBE``
vectors of the shard that look best.  A shard whose high bounds do not sum to
the threshold is skipped.  Terms are ordered by the width of their bounds.  The
strongest ones are essential: as many as it takes until a vector with only low
bounds there cannot reach the threshold with all the others' high bounds.  Their
postings are traversed for all vectors; the non-essential ones are then probed,
strongest first and ``STEP`` at a time, for the vectors that are still
competitive.  Shards' best k are merged by score, ties to the smaller id.

Scores are exact integers: float64 products are used where all sums are below
2**53 and Python integers otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.common import saved

SCALE = 256
#: Vectors in a shard and queries in a block at most (on average), and the least in a shard.
SHARD, LEAST, BLOCK = 32768, 2048, 2048
PROBE, STEP = 64, 8

PACKED = "part long, ids binary, rows binary, terms binary, width long"
ASKED = "query_ids binary, query_rows binary, queries binary, width long, thresholds binary"
PARTIAL = "query_row long, query_id long, vec_id long, score decimal(38,0)"


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id, terms``: floor(256 * x) of each component; rows that hold a null or non-finite component, or no vector, are left out."""
    x = F.col("v").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~bad).select("id", F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE)))).alias("terms"))


def _pack(key: tuple, group: pa.Table) -> pa.Table:
    lists = group.column("terms").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8")
    whole = lambda name: pa.array([group.column(name).to_numpy().astype("<i8").tobytes()], pa.binary())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "ids": whole("id"), "rows": whole("row"), "terms": pa.array([flat.tobytes()], pa.binary()), "width": pa.array([len(flat) // max(1, len(lists))], pa.int64())})


def essential(order_gaps: np.ndarray, low: object, threshold: object) -> int:
    """How many of the terms, given their bounds' widths in falling order, are essential.

    The others' widths, added to the sum ``low`` of all low bounds, stay below the threshold.
    """
    n, rest = len(order_gaps), low
    while n and rest + order_gaps[n - 1] < threshold:
        rest = rest + order_gaps[n - 1]
        n -= 1
    return n


def top_of_shard(shard: tuple[np.ndarray, np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """The k best of a shard (ids, rows, vectors) for each query (ids, rows, vectors, thresholds): query rows, query ids, vector ids and scores."""
    (ids, rows, vectors), (query_ids, query_rows, queries, known) = shard, asked
    n, width = vectors.shape
    out: tuple[list[int], list[int], list[int], list[int]] = ([], [], [], [])
    if not n:
        return out
    # bound on any sum's magnitude, in floats: only for choosing the arithmetic
    big = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * max(1, width)
    kind = np.float64 if big < 2.0**52 else object
    v, q = vectors.astype(kind), queries.astype(kind)
    most, least = v.max(axis=0), v.min(axis=0)
    postings = np.ascontiguousarray(v.T) if kind is np.float64 else v.T
    own = {int(r): i for i, r in enumerate(rows)}
    for at in range(len(q)):
        high, low = np.maximum(q[at] * most, q[at] * least), np.minimum(q[at] * most, q[at] * least)
        threshold = known[at]
        if high.sum() < threshold:
            continue  # nothing in this shard can be among the best
        order = np.argsort(-(high - low).astype(float), kind="stable")
        here = own.get(int(query_rows[at]))
        if threshold == -np.inf:
            some = np.array([i for i in range(min(n, PROBE + 1)) if i != here], int)
            threshold = _kth(v[some] @ q[at], k, threshold)
        first = essential((high - low)[order], low.sum(), threshold)
        score = q[at][order[:first]] @ postings[order[:first]] if first else np.zeros(n, kind)
        alive = np.arange(n) if here is None else np.delete(np.arange(n), here)
        score, rest = score[alive], high[order[first:]].sum()
        if first < width and len(alive) > PROBE:  # the most promising ones, whole
            top = np.argpartition(-score, PROBE)[:PROBE] if kind is np.float64 else np.array(sorted(range(len(alive)), key=lambda i: -score[i])[:PROBE])
            threshold = max(threshold, _kth(v[alive[top]] @ q[at], k, threshold))
        done = first
        while True:
            keep = score + rest >= threshold
            if not keep.all():
                alive, score = alive[keep], score[keep]
            if done == width or not len(alive):
                break
            terms = order[done:] if len(alive) <= 4 * PROBE else order[done : done + STEP]
            score = score + v[np.ix_(alive, terms)] @ q[at][terms]
            done += len(terms)
            rest = high[order[done:]].sum()
        for s, i in _smallest(-score, ids[alive], k):
            out[0].append(int(query_rows[at]))
            out[1].append(int(query_ids[at]))
            out[2].append(i)
            out[3].append(int(-s))
    return out


def _kth(scores: np.ndarray, k: int, otherwise: object) -> object:
    return np.sort(scores)[-k] if len(scores) >= k else otherwise


def _smallest(score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    order = np.lexsort((ids, score)) if score.dtype != object else sorted(range(len(ids)), key=lambda i: (score[i], ids[i]))
    return [(score[i], int(ids[i])) for i in order[:k]]


def _vectors(flat: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(flat, "<i8").reshape(n, width)


def _meet(batch: pa.RecordBatch, r: int, k: int) -> tuple:
    """The search of one row: a shard's three columns, if any, and a block's five."""
    ids, rows, terms, query_ids, query_rows, queries, width, thresholds = (batch.column(c)[r].as_py() for c in range(8))
    query_ids, query_rows = np.frombuffer(query_ids, "<i8"), np.frombuffer(query_rows, "<i8")
    known = np.frombuffer(thresholds, "<f8") if thresholds is not None else np.full(len(query_ids), -np.inf)
    asked = (query_ids, query_rows, _vectors(queries, len(query_ids), width), known)
    if ids is None:
        return asked, ([], [], [], [])
    ids = np.frombuffer(ids, "<i8")
    return asked, top_of_shard((ids, np.frombuffer(rows, "<i8"), _vectors(terms, len(ids), width)), asked, k)


def top_k(rows: DataFrame, k: int = 5, every: int = 50, shard: int = SHARD, least: int = LEAST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other rows for each row whose vec_id divides by ``every``.

    Vectors that are null or hold a null or non-finite component take no part,
    nor do rows without vec_id.  Vectors of another length than a query's are
    no candidates of it.  A row is no candidate of its own; another row with its
    vec_id is.  A vec_id that repeats is ranked as often as it comes, and each
    row of a repeated query has its own k best.  Ties go to the smaller vec_id.
    Fewer candidates give fewer rows, an empty table none; other columns are not
    read.  A score beyond 64 bits is ranked exactly and returned as null.
    """
    vectors = saved(integer_vectors(rows).withColumn("row", F.monotonically_increasing_id()))
    count = vectors.count()
    slots = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-count // max(least, min(shard, -(-count // slots)))))
    blocks = max(1, -(-count // (every * BLOCK)))
    by_width = F.least(F.size("terms"), F.lit((1 << 20) - 1))  # packed vectors are of one length
    part = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)) * F.lit(1 << 20) + by_width
    packed = saved(vectors.withColumn("part", part(shards, 1)).groupBy("part").applyInArrow(_pack, PACKED))
    asked = vectors.where(F.pmod("id", F.lit(every)) == 0).withColumn("part", part(blocks, 2)).groupBy("part").applyInArrow(_pack, PACKED)
    asked = saved(asked.select(F.col("ids").alias("query_ids"), F.col("rows").alias("query_rows"), F.col("terms").alias("queries"), "width"))
    spot = F.col("shard").cast("long") * F.lit(1 << 20) + F.least("width", F.lit((1 << 20) - 1))
    columns = ["ids", "rows", "terms", "query_ids", "query_rows", "queries", "width", "thresholds"]

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (query_ids, query_rows, queries, _), (of, _, _, scores) = _meet(batch, r, k)
                found: dict[int, list[int]] = {}
                for row, s in zip(of, scores):
                    found.setdefault(row, []).append(s)
                known = [np.nextafter(float(x[k - 1]), -np.inf) if len(x := found.get(int(row), [])) >= k else -np.inf for row in query_rows]
                yield pa.RecordBatch.from_pylist([{"query_ids": query_ids.tobytes(), "query_rows": query_rows.tobytes(), "queries": queries.tobytes(), "width": queries.shape[1], "thresholds": np.array(known, "<f8").tobytes()}])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                _, (of, query_ids, ids, scores) = _meet(batch, r, k)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(query_ids, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.decimal128(38, 0))], names=["query_row", "query_id", "vec_id", "score"])

    one = asked.withColumn("shard", F.lit(0)).withColumn("part", spot).drop("shard").join(packed.drop("width"), "part", "left")
    asked = saved(one.withColumn("thresholds", F.lit(None).cast("binary")).select(columns).mapInArrow(thresholds, ASKED)) if shards > 1 else asked.withColumn("thresholds", F.lit(None).cast("binary"))
    dealt = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("part", spot).drop("shard")
    met = packed.drop("width").join(dealt.hint("shuffle_hash"), "part").select(columns)
    ranked = met.mapInArrow(search, PARTIAL)
    window = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))
