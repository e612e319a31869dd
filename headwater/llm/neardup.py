"""Near duplicates by Jaccard similarity of word shingles: a trie of SimHash fingerprints and MinHash bands propose, the exact similarity decides.

Texts are first grouped to their distinct shingle sets.  Each set gets a SimHash
fingerprint, and the trie self-join of ``simhash`` proposes the pairs that connect
all fingerprints at four or fewer differing bits, which is a similarity of about
0.95.  Two sets at 0.8 differ in ten bits on average, so for what lies between a
set's MinHash values form ``BANDS`` bands of ``ROWS``; sets that agree in a band share a bucket.  A
pair at similarity s shares none with a chance of (1 - s ** ROWS) ** BANDS,
which is 3 in a million at 0.8.  Proposed pairs are linked if the Jaccard
similarity of their whole sets is ``SIMILAR`` or more.

Within a bucket sets are compared by sketches, a byte of each MinHash value, in
two rounds.  The first proposes pairs that look alike and are not connected by
such pairs yet, so a large group of copies takes a pair for each member and not
all pairs.  When these and those of the trie are checked, the second proposes every pair of a bucket
whose members are not connected and whose sketches agree in ``LEAST`` of their
bytes or more, which a pair at 0.8 misses with a chance of 1 in a million.  A
bucket is compared in blocks in one task; its work is quadratic in its distinct
sets, as long as they stay unconnected.

The driver collects its garbage after each step, and Python workers get small
batches, as both have little memory beside their heaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm import simhash
from headwater.llm.common import checkpointed, let_go, light_worker
from headwater.llm.graph import components

WORDS = 5
SIMILAR = 0.8
#: Shares of equal sketch bytes: of pairs proposed at first, and of all that are worth a check.
ALIKE, LEAST = 0.85, 0.6
BANDS, ROWS = 24, 4
SEED = 42
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
FACTORS, SHIFTS = (_DRAWN[0] | np.uint64(1))[:, None], _DRAWN[1][:, None]
#: Members of a bucket compared with one another at once, and rows held before buckets are compared.
SPAN, ROWS_AT_ONCE = 1 << 10, 1 << 15
#: Most rows and bytes that a Python worker gets at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
MIXED = np.random.default_rng(SEED + 1).integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def saved(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, after which the driver lets go of what the step left in it."""
    out = checkpointed(df)
    let_go(df.sparkSession)
    return out


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Sessions' settings are as before afterwards, so only what runs inside gets batches of ``BATCH``."""
    before = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of five words; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts = [0, *(g + 1 for g in gaps)]
    ends = [*gaps[WORDS - 1 :], len(joined)]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64))


def bands(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One value a band of a set that is not empty, and its sketch."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[None, at : at + (1 << 12)] * FACTORS + SHIFTS).min(axis=1), out=least)
    sketch = ((least * MIXED[0]) >> np.uint64(56)).astype(np.uint8).tobytes()
    return (least.reshape(BANDS, ROWS) * MIXED).sum(axis=1, dtype=np.uint64), sketch


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, key, n, fp, bands, sketch``, a row for each row of ``docs``: the text's hash, its shingle set's hash and size, and the set's fingerprint, bands and sketch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        light_worker()
        for batch in batches:
            texts, keys, sizes, prints, found, sketches = batch.column(2), [], [], [], [], []
            for i in range(len(texts)):
                hashes = shingles(texts[i].as_py())
                keys.append(xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0)
                sizes.append(len(hashes))
                prints.append(simhash.majority(hashes))
                of_bands, sketch = bands(hashes) if len(hashes) else (np.zeros(0, np.uint64), b"")
                found.append(of_bands.view(np.int64))
                sketches.append(sketch)
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists, pa.array(sketches, pa.binary())], names=["doc_id", "mark", "key", "n", "fp", "bands", "sketch"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(each, "doc_id long, mark long, key long, n long, fp long, bands array<long>, sketch binary")


def sets(texts: DataFrame) -> DataFrame:
    """``key, hashes``: the shingle sets of ``texts`` (key, text) as bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py()).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["key", "hashes"])

    return texts.select("key", "text").mapInArrow(each, "key long, hashes binary")


def similar(pairs: DataFrame, have: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, of, to) whose sets in ``have`` (key, hashes) have a Jaccard similarity of ``SIMILAR`` or more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4), batch.column(5)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SIMILAR * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "of", "to"]).filter(pa.array(keep, pa.bool_()))

    left = saved(pairs.join(have.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a"))
    return saved(left.join(have.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "of", "to", "x", "y").mapInArrow(each, "a long, b long, of long, to long"))


def compared(sizes: np.ndarray, roots: np.ndarray, sketches: np.ndarray, spanning: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of one bucket's members that are worth a check and have different roots; with ``spanning`` those that look alike, fewest to connect them."""
    label, need = roots.copy(), (ALIKE if spanning else LEAST) * sketches.shape[1]
    for lo in range(0, len(sizes), 1 if spanning else SPAN):
        hi = lo + 1 if spanning else min(lo + SPAN, len(sizes))
        for at in range(lo, len(sizes), 1 << 14 if spanning else SPAN):
            other = slice(at, at + (1 << 14 if spanning else SPAN))
            near = (label[lo:hi, None] != label[None, other]) & (np.minimum(sizes[lo:hi, None], sizes[None, other]) >= SIMILAR * np.maximum(sizes[lo:hi, None], sizes[None, other]) - 1e-9)
            i, j = np.nonzero(near)
            i, j = i + lo, j + at
            i, j = i[i < j], j[i < j]
            for part in range(0, len(i), 1 << 17):
                x, y = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
                good = (sketches[x] == sketches[y]).sum(axis=1) >= need
                x, y = x[good], y[good]
                if spanning and len(x):
                    # of several members of one label the first is enough
                    y = y[np.sort(np.unique(label[y], return_index=True)[1])]
                    x = np.full(len(y), lo)
                    label[np.isin(label, label[y])] = label[lo]
                if len(x):
                    yield x, y


def proposed(members: DataFrame, spanning: bool) -> DataFrame:
    """``a, b, of, to``: pairs of ``members`` (band, bucket, key, n, root, sketch) to check, each once, and their roots."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        band, bucket, keys, sizes, roots = (table.column(c).to_numpy() for c in range(5))
        sketches = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(len(keys), -1)
        starts = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (bucket[1:] != bucket[:-1])]))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            if hi - lo > 1:
                for x, y in compared(sizes[lo:hi], roots[lo:hi], sketches[lo:hi], spanning):
                    x, y = np.where(keys[lo + x] < keys[lo + y], [x, y], [y, x]) + lo
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[x], keys[y], roots[x], roots[y])], names=["a", "b", "of", "to"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, now = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            band, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if rows >= ROWS_AT_ONCE:  # up to the last change of the bucket
                last = np.flatnonzero((np.append(now[0], band[:-1]) != band) | (np.append(now[1], bucket[:-1]) != bucket))
                if len(last):
                    yield from solve(pa.Table.from_batches([*held, batch.slice(0, int(last[-1]))]).combine_chunks())
                    held, rows = [], 0
                    batch = batch.slice(int(last[-1]))
            held.append(batch)
            rows, now = rows + batch.num_rows, (band[-1:], bucket[-1:])
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    dealt = members.select("band", "bucket", "key", "n", "root", "sketch").repartition("band", "bucket").sortWithinPartitions("band", "bucket", "key")
    return dealt.mapInArrow(each, "a long, b long, of long, to long").distinct()


def near(values: DataFrame) -> DataFrame:
    """``a, b, of, to``: pairs that connect all sets of ``values`` (key, n, fp) whose fingerprints the trie finds within reach of each other."""
    found = simhash.links(values.where("n > 0").select("fp", F.col("key").alias("id")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select("a", "b", F.col("a").alias("of"), F.col("b").alias("to"))


def rooted(docs: DataFrame, values: DataFrame) -> DataFrame:
    """``key, best, root``: a root for each group of ``values`` (key, n, fp, bands, sketch, best) that similar sets connect."""
    banded = saved(values.select("key", "n", F.posexplode("bands").alias("band", "bucket")))
    shared = saved(banded.groupBy("band", "bucket").agg(F.count("*").alias("count")).where("count > 1").select("band", "bucket"))
    spots = saved(banded.join(shared, ["band", "bucket"], "left_semi"))
    alike = saved(near(values))
    wanted = spots.select("key").union(alike.select("a")).union(alike.select("b")).distinct()
    held = saved(values.join(wanted, "key", "left_semi").select("key", "sketch", F.col("best.mark").alias("mark")))
    text = F.col("text").cast("string")
    texts = docs.select(F.xxhash64(text).alias("mark"), text.alias("text")).join(held.select("key", "mark"), "mark").groupBy("key").agg(F.min("text").alias("text"))
    have = saved(sets(texts))
    members = spots.join(held.select("key", "sketch"), "key")
    first = saved(proposed(members.withColumn("root", F.col("key")), True).union(alike).distinct())
    roots = components(similar(first, have), saved).withColumnRenamed("node", "key")
    members = saved(members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    mixed = saved(members.groupBy("band", "bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "bucket"))
    late = similar(saved(proposed(members.join(mixed, ["band", "bucket"], "left_semi"), False)), have)
    every = saved(values.select("key", "best").join(roots, "key", "left").select("key", "best", F.coalesce("root", "key").alias("root")))
    if late.isEmpty():
        return every
    # what the second round links are groups of the first
    over = components(late.select(F.col("of").alias("a"), F.col("to").alias("b")).distinct(), saved)
    return saved(every.join(over.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left").select("key", "best", F.coalesce("over", "root").alias("root")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group of ``docs`` (doc_id, text) at a similarity of 0.8 or more, all columns kept.

    Groups are what links reach.  Null texts and texts without words make one
    group.  Of rows with the smallest doc_id, or of a group without any, the
    one whose text has the smallest hash stays, and of equal rows one.
    """
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    with small_batches(docs.sparkSession):
        values = saved(signed(docs).groupBy("key").agg(F.min(best).alias("best"), *[F.first(c).alias(c) for c in ("n", "fp", "bands", "sketch")]))
        groups = rooted(docs, values)
    return simhash.first_of_each(docs, groups.groupBy("root").agg(F.min("best").alias("x")))
