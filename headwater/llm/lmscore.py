"""Document scores by masked pseudo-likelihood.

A small bidirectional window network, written in numpy, predicts every word of a
text from the ``REACH`` words on either side of it.  A document's score is the
sum of its words' conditional log-probabilities.

The most frequent words of the corpus have numbers of their own; all others
share ``BUCKETS`` numbers by their last letters.  The number 0 pads the ends of
a text.  The network predicts numbers, its output factored into ``CLASSES``
classes of equally many, so a probability costs two short softmaxes.  Within a
bucket a word has its share of the bucket's occurrences in the corpus, so the
probabilities of all words add up to 1 and the vocabulary is the corpus's own.

Everything learnt comes from all documents: words are counted over the whole
corpus; every task then trains a copy of the network on its own documents, each
position masked and predicted once, and the copies are averaged in two steps,
weighted by the positions that they saw.  Only the average and the buckets'
totals, whose size is fixed, reach the driver; the counts of the words in
buckets stay a table, which the documents' words are joined to by their hash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from headwater.llm.common import saved

CLASSES, MEMBERS, BUCKETS = 32, 32, 256
SIZE = CLASSES * MEMBERS
WORDS = SIZE - BUCKETS - 1
REACH, WIDTH = 2, 16
OFFSETS = [*range(-REACH, 0), *range(1, REACH + 1)]
BATCH, RATE, SEED = 8192, 0.1, 3
#: Seed of the 64-bit hashes of words, the one that Spark's xxhash64 has.
HASH = 42
#: Largest size of a logit that counts, far beyond those that training reaches; exp of it fits 32 bits.
CLIP = 60.0
#: Words scored at once, words counted or remembered before a cache is emptied, parts of the averaged network and first-step groups for each.
CHUNK, CACHE, PARTS, FAN = 1 << 15, 400_000, 32, 64

SHAPES = {"context": (len(OFFSETS), SIZE, WIDTH), "classes": (CLASSES, WIDTH), "class_bias": (CLASSES,), "members": (CLASSES, MEMBERS, WIDTH), "member_bias": (CLASSES, MEMBERS)}


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct lower-case words of ``texts``, the place of each word among them, and the number of words of each text; null is an empty text."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = split.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = split.offsets.to_numpy() - (split.offsets[0].as_py() if len(split) else 0)
    sizes = np.diff(np.append(0, np.cumsum(real))[bounds]) if len(split) else np.zeros(0, np.int64)
    coded = (flat if real.all() else flat.filter(pa.array(real))).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False), sizes


class Numbers(dict):
    """Words to places in ``numbers`` and ``hashes``; words without a number of their own get their bucket's, and are remembered."""

    def __init__(self, words: list[str]):
        super().__init__()
        self.words = words
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update({w: i for i, w in enumerate(self.words)})
        self.numbers, self.hashes = array("q", range(1, len(self.words) + 1)), array("Q", bytes(8 * len(self.words)))

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self.numbers)
        raw = word.encode("utf-8", "replace")
        self.numbers.append(SIZE - BUCKETS + crc32(word[-3:].encode("utf-8", "replace")) % BUCKETS)
        self.hashes.append(xxh64_intdigest(raw, HASH))
        return i

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all texts' words, padded by ``REACH`` zeros before each text and after the last; words of each text; hashes of the words, unpadded."""
        if len(self) > len(self.words) + CACHE:
            self.reset()
        distinct, which, sizes = words_of(texts)
        at = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))[which]
        out = np.zeros(len(which) + REACH * (len(sizes) + 1), np.int64)
        out[places(sizes)] = np.array(self.numbers)[at]
        return out, sizes, np.array(self.hashes)[at]


class Network:
    """Parameters by name; context embeddings for each offset, tanh, class and member softmaxes."""

    def __init__(self, values: dict[str, np.ndarray]):
        self.__dict__.update(values)

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        """Small random embeddings; biases that give the corpus' word frequencies."""
        rng = np.random.default_rng(SEED)
        values = {n: (rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for n, s in SHAPES.items()}
        p = (counts + 1.0) / (counts + 1.0).sum()
        by_class = p[np.arange(SIZE).reshape(MEMBERS, CLASSES).T]
        values["class_bias"] = np.log(by_class.sum(axis=1)).astype(np.float32)
        values["member_bias"] = np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32)
        return cls(values)

    @classmethod
    def of_flat(cls, flat: np.ndarray) -> Network:
        values, at = {}, 0
        for name, shape in SHAPES.items():
            size = int(np.prod(shape))
            values[name] = flat[at : at + size].reshape(shape).astype(np.float32)
            at += size
        return cls(values)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in SHAPES])

    def hidden(self, seen: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.tanh(sum(self.context[k][seen[at + o]] for k, o in enumerate(OFFSETS)))

    def log_probabilities(self, seen: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the words at places ``at``, each from the words around it."""
        out = np.empty(len(at))
        for lo in range(0, len(at), CHUNK):
            some = at[lo : lo + CHUNK]
            h = self.hidden(seen, some)
            of_class, of_member = seen[some] % CLASSES, seen[some] // CLASSES
            z = h @ self.classes.T + self.class_bias
            got = z[np.arange(len(some)), of_class] - _log_sum(z)
            order = np.argsort(of_class.astype(np.uint8), kind="stable")
            bounds = np.searchsorted(of_class[order], np.arange(CLASSES + 1))
            for c in range(CLASSES):
                own = order[bounds[c] : bounds[c + 1]]
                if len(own):
                    z = h[own] @ self.members[c].T + self.member_bias[c]
                    got[own] += z[np.arange(len(own)), of_member[own]] - _log_sum(z)
            out[lo : lo + CHUNK] = got
        return out

    def gradients(self, seen: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Of the summed log-probabilities of the words at ``at``, by parameter."""
        at = at[np.argsort((seen[at] % CLASSES).astype(np.uint8), kind="stable")]
        h = self.hidden(seen, at)
        of_class, of_member = seen[at] % CLASSES, seen[at] // CLASSES
        g = {n: np.zeros(s, h.dtype) for n, s in SHAPES.items()}
        d = -_softmax(h @ self.classes.T + self.class_bias)
        d[np.arange(len(at)), of_class] += 1
        g["classes"], g["class_bias"], back = d.T @ h, d.sum(axis=0), d @ self.classes
        bounds = np.searchsorted(of_class, np.arange(CLASSES + 1))
        for c, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if lo < hi:
                d = -_softmax(h[lo:hi] @ self.members[c].T + self.member_bias[c])
                d[np.arange(hi - lo), of_member[lo:hi]] += 1
                g["members"][c], g["member_bias"][c] = d.T @ h[lo:hi], d.sum(axis=0)
                back[lo:hi] += d @ self.members[c]
        back *= 1 - h * h
        for k, o in enumerate(OFFSETS):
            word = seen[at + o].astype(np.uint16)
            order = np.argsort(word, kind="stable")
            word = word[order]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            g["context"][k][word[first]] = np.add.reduceat(back[order], first, axis=0)
        return g

    def train(self, seen: np.ndarray, at: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        for lo in range(0, len(at), BATCH):
            for name, g in self.gradients(seen, at[lo : lo + BATCH]).items():
                squares[name] += g * g
                getattr(self, name).__iadd__(RATE * g / np.sqrt(squares[name] + 1))


def _log_sum(z: np.ndarray) -> np.ndarray:
    return np.log(np.exp(np.clip(z, -CLIP, CLIP)) @ np.ones(z.shape[1], z.dtype))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(np.clip(z, -CLIP, CLIP))
    return e / (e @ np.ones(z.shape[1], z.dtype))[:, None]


def places(sizes: np.ndarray) -> np.ndarray:
    """Where the words of texts lie among ``Numbers.of``'s padded numbers."""
    starts = np.cumsum(sizes) - sizes + REACH * (np.arange(len(sizes)) + 1)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def portions(texts: pa.Array, most: int = 1 << 21) -> Iterator[pa.Array]:
    """The texts in order, some two million bytes at a time."""
    filled = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(filled, (filled[lo - 1] if lo else 0) + most, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts; counted in the tasks that read them, then added up by word."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for some in portions(batch.column(0)):
                distinct, which, _ = words_of(some)
                for word, n in zip(distinct, np.bincount(which, minlength=len(distinct)).tolist()):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > CACHE:
                    yield rows()
                    counts = {}
        yield rows()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _averaged(key: tuple, group: pa.Table) -> pa.Table:
    """Weighted sums of one part of the copies; the last key column is the part."""
    total = sum(np.frombuffer(v.as_py(), np.float64) for v in group.column("sums"))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "weight": pa.array([sum(group.column("weight").to_pylist())], pa.float64()), "sums": pa.array([total.tobytes()], pa.binary())})


@dataclass
class Model:
    """Words with numbers, the network, the buckets' totals, and a table of all words' counts (key, n) by hash."""

    words: list[str]
    network: Network
    totals: np.ndarray
    counts: DataFrame


def fit(docs: DataFrame) -> Model:
    """The vocabulary and network of the corpus ``docs`` (text)."""
    spark = docs.sparkSession
    counts = saved(word_counts(docs))
    top = counts.orderBy(F.col("n").desc(), "word").limit(WORDS).collect()
    words = [r.word for r in top]
    bucket = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(BUCKETS)).alias("bucket")
    rest = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in words], "word string")), "word", "left_anti")
    totals = np.zeros(BUCKETS)
    for r in rest.groupBy(bucket).agg(F.sum("n").alias("n")).collect():
        totals[r.bucket] = r.n
    tally = np.zeros(SIZE)
    tally[1 : len(top) + 1] = [r.n for r in top]
    tally[SIZE - BUCKETS :] = totals
    start = Network.fresh(tally)
    held = spark.sparkContext.broadcast((words, start.flat()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = held.value
        own, network, weight = Numbers(words), Network.of_flat(flat), 0
        squares = {n: np.zeros(s, np.float32) for n, s in SHAPES.items()}
        rng = np.random.default_rng(SEED)
        for batch in batches:
            for some in portions(batch.column(0)):
                seen, sizes, _ = own.of(some)
                at = rng.permutation(places(sizes))
                network.train(seen, at, squares)
                weight += len(at)
        if weight:
            parts = np.array_split(network.flat().astype(np.float64) * weight, PARTS)
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PARTS), pa.int32()), pa.array([task % FAN] * PARTS, pa.int32()), pa.array([float(weight)] * PARTS), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["part", "fan", "weight", "sums"],
            )

    copies = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "part int, fan int, weight double, sums binary")
    kind = "part int, weight double, sums binary"
    sums = copies.groupBy("part", "fan").applyInArrow(_averaged, kind).groupBy("part").applyInArrow(_averaged, kind).collect()
    network = Network.of_flat(np.concatenate([np.frombuffer(r.sums, np.float64) / r.weight for r in sorted(sums, key=lambda r: r.part)])) if sums else start
    return Model(words, network, totals, rest.select(F.xxhash64("word").alias("key"), "n"))


def scorer(spark, model: Model) -> Column:
    """Of column ``text``: its number of words, their summed log-probability but for the counts of words in buckets, and these words' hashes."""
    held = spark.sparkContext.broadcast((model.words, model.network.flat(), model.totals))
    kind = pa.struct([("n_words", pa.int64()), ("sum", pa.float64()), ("rest", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n_words: long, sum: double, rest: array<long>>")
    def scored(texts: pa.Array) -> pa.Array:
        words, flat, totals = held.value
        numbers, network = Numbers(words), Network.of_flat(flat)
        share = np.zeros(SIZE)
        share[SIZE - BUCKETS :] = -np.log(np.maximum(totals, 1))
        n, total, rest, size = [], [], [], []
        for some in portions(texts):
            seen, sizes, hashes = numbers.of(some)
            at = places(sizes)
            each = np.append(0.0, np.cumsum(network.log_probabilities(seen, at) + share[seen[at]]))
            in_bucket = seen[at] >= SIZE - BUCKETS
            held_so_far = np.append(0, np.cumsum(in_bucket))
            ends = np.cumsum(sizes)
            n.append(sizes)
            total.append(each[ends] - each[ends - sizes])
            size.append(held_so_far[ends] - held_so_far[ends - sizes])
            rest.append(hashes[in_bucket].view(np.int64))
        if not n:
            return pa.array([], kind)
        offsets = np.append(0, np.cumsum(np.concatenate(size))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rest)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n)), pa.array(np.concatenate(total)), lists], fields=list(kind))

    return scored.asNondeterministic()(F.col("text").cast("string"))  # so that the optimiser runs it once


def scores(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text among its columns), with ``n_words``, ``log_probability`` and ``mean_log_probability``, as ``with_scores``."""
    model = fit(docs)
    new = ("n_words", "log_probability", "mean_log_probability")
    keep = [c for c in keep if c not in new]
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("__row"), scorer(docs.sparkSession, model).alias("__lm"))
    # a word that comes once adds the logarithm of 1
    rows = saved(rows.select(*keep, "__row", "__lm.n_words", F.col("__lm.sum").alias("__sum"), F.col("__lm.rest").alias("__rest")))
    shares = rows.select("__row", F.explode("__rest").alias("key")).join(model.counts.where("n > 1"), "key").groupBy("__row").agg(F.sum(F.ln("n")).alias("__more"))
    total = F.col("__sum") + F.coalesce("__more", F.lit(0.0))
    out = rows.drop("__rest").join(shares, "__row", "left").withColumn("log_probability", total)
    return out.select(*keep, "n_words", "log_probability", F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words")).alias("mean_log_probability"))


def with_scores(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (text among them), ``n_words``, ``log_probability`` and ``mean_log_probability`` (per word).

    The network is trained on the texts of ``docs``.  Null, empty and blank
    texts have no words, the log-probability 0 and a null mean; repeated rows
    get equal scores up to rounding; no rows give none.  A column of ``docs``
    with a new column's name is replaced.
    """
    return scores(docs, docs.columns)
