"""Benchmark decontamination by a BM25 index of the test items and block-max WAND.

The index holds the test items; the queries are passages of the training
documents, windows that overlap by half.  Items are indexed by length, in
classes of ``PASSAGE`` words, twice as many, and so on; the passages of a class
are twice as long as its longest item may be, so some passage holds any item whole.  A term's impact on an item
is its BM25 weight divided by the item's own total, so a passage with all of an
item's words scores 1.  All items at ``THRESHOLD`` or more are retrieved.

Passages are pruned exactly.  Of each item the most common terms that together
weigh at most ``ASIDE`` are set aside; the others are essential.  The essential
postings of a batch of documents are added up by item and half passage, for all
passages at once; where an item's sum and the weight it has set aside do not
reach the threshold, its score cannot either.  The passages left go through
WAND: postings lists in order of item, term bounds to choose a pivot, bounds of
blocks of ``RUN`` postings to skip, and full scores for the rest.

A retrieved item counts as leaked if ``OVERLAP`` of its five-word shingles lie in
the passage, and at least ``PART`` of the question's and of the answer's.  The
answer is the last line of an item of several lines; an item of one line is cut
in the middle.

BM25's statistics are those of all items.  What is broadcast at once is an index
of ``SLICE`` bytes of items at most (a single item may be longer); with more
items, the documents are searched for one slice after the other.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import saved

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, PART = 0.6, 0.8, 0.5
ASIDE = 0.3
SHINGLE, PASSAGE, RUN = 5, 64, 16
SLICE = 8 << 20
#: Documents and bytes of text searched at once.
DOCS, BYTES = 512, 2 << 20

MATCHES = "array<struct<item_id: long, score: double, overlap: double, question: double, answer: double>>"
#: ASCII punctuation and control characters separate words.
_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII characters other than letters and digits separate them."""
    return (text or "").lower().encode("utf-8", "replace").translate(_BLANK).split()


def shingles(some: list[bytes], size: int = SHINGLE) -> list[tuple]:
    """Runs of ``size`` words in order."""
    return [tuple(some[i : i + size]) for i in range(len(some) - size + 1)]


def item_parts(some: list[bytes], answer: int = 0) -> tuple[set, set, set]:
    """An item's shingles: all, the question's and the answer's, its last ``answer`` words; one of all its words if they are fewer than five."""
    size = min(SHINGLE, len(some))
    runs = shingles(some, size)
    cut = len(some) - answer - size + 1 if answer else -(-len(runs) // 2)  # runs before it lie in the question
    if cut <= 0:
        cut = -(-len(runs) // 2)
    return set(runs), set(runs[:cut]), set(runs[cut:])


def answer_words(text: str) -> int:
    """Words in the last line of a text of several lines with words; 0 for one line."""
    head, _, last = text.strip().rpartition("\n")
    return len(words(last)) if words(head) else 0


def step_of(size: int) -> int:
    """Half a passage's words, for items of ``size`` words."""
    return PASSAGE << max(0, math.ceil(math.log2(max(1, size) / PASSAGE)))


class Index:
    """BM25 index of items (id, text) that scores passages by block-max WAND."""

    def __init__(self, items: list[tuple[int, str]], step: int | None = None, stats: tuple[int, float, dict[bytes, int]] | None = None):
        """``stats``: number of all items, their mean length and their terms' document frequencies; those of ``items`` if not given."""
        given = [(i, w, t) for i, t in sorted(items) if (w := words(t))]
        self.items = [(i, w) for i, w, _ in given]
        n, mean, df = stats or (len(given), sum(len(w) for _, w in self.items) / max(1, len(given)), Counter(t for _, w in self.items for t in set(w)))
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        essential: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        self.need = np.zeros(len(given))  # what an item's essential terms must add up to
        for k, (_, w) in enumerate(self.items):
            tf = Counter(w)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            total = math.fsum(impact.values())
            aside, full = 0.0, False
            for t in sorted(impact, key=lambda t: (-df[t], t)):
                share = impact[t] / total
                postings[t].append((k, share))
                full = full or aside + share > ASIDE
                if full:
                    essential[t].append((k, share))
                else:
                    aside += share
            self.need[k] = THRESHOLD - aside - 1e-9
        self.term = {t: i for i, t in enumerate(essential)}
        self.first = np.cumsum([0, *(len(p) for p in essential.values())])
        self.item = np.array([k for p in essential.values() for k, _ in p], np.int64)
        self.weight = np.array([x for p in essential.values() for _, x in p])
        self.postings = {t: ([k for k, _ in p], [x for _, x in p], max(x for _, x in p), [max(x for _, x in p[i : i + RUN]) for i in range(0, len(p), RUN)]) for t, p in postings.items()}
        self.step = step or max((step_of(len(w)) for _, w in self.items), default=PASSAGE)
        self.parts = [item_parts(w, answer_words(t)) for _, w, t in given]

    def above(self, terms: set[bytes]) -> list[tuple[int, float]]:
        """Numbers and scores of all items at the threshold or more, by block-max WAND."""
        post, found, least = self.postings, [], THRESHOLD - 1e-9
        lists = [[post[t][0][0], 0, *post[t]] for t in terms if t in post]  # item, place, items, impacts, bound, block bounds
        while lists:
            lists.sort(key=lambda x: x[0])
            bound, p = 0.0, -1
            for p, x in enumerate(lists):
                bound += x[4]
                if bound >= least:
                    break
            else:
                break
            pivot = lists[p][0]
            while p + 1 < len(lists) and lists[p + 1][0] == pivot:
                p += 1
            block, until = 0.0, 1 << 60
            for x in lists[: p + 1]:
                place = self._seek(x[2], x[1], pivot)
                if place == len(x[2]):
                    continue
                run = place // RUN
                block += x[5][run]
                until = min(until, x[2][min(len(x[2]), run * RUN + RUN) - 1] + 1)
            if block < least:
                target = max(pivot + 1, until)
                if p + 1 < len(lists):
                    target = min(target, lists[p + 1][0])
                target = max(target, pivot + 1)
            else:
                got = 0.0
                for x in lists[: p + 1]:
                    x[1] = self._seek(x[2], x[1], pivot)
                    if x[1] < len(x[2]) and x[2][x[1]] == pivot:
                        got += x[3][x[1]]
                if got >= least:
                    found.append((pivot, got))
                target = pivot + 1
            for x in lists[: p + 1]:
                if x[0] < target:
                    x[1] = self._seek(x[2], x[1], target)
                    x[0] = x[2][x[1]] if x[1] < len(x[2]) else 1 << 60
            lists = [x for x in lists if x[0] < 1 << 60]
        return found

    @staticmethod
    def _seek(items: list[int], place: int, target: int) -> int:
        from bisect import bisect_left

        return bisect_left(items, target, place)

    def passages(self, split: list[list[bytes]]) -> list[tuple[int, int]]:
        """(document, start) of the passages in which some item may reach the threshold, in order."""
        sizes = np.array([len(w) for w in split])
        term = np.fromiter(map(self.term.get, chain.from_iterable(split), repeat(-1)), np.int64, int(sizes.sum()))
        halves = -(-sizes // self.step) + 1  # an empty half keeps documents apart
        base = np.cumsum(halves) - halves
        hit = np.flatnonzero(term >= 0)
        if not len(hit):
            return []
        doc = np.searchsorted(np.cumsum(sizes), hit, "right")
        half = base[doc] + (hit - (np.cumsum(sizes) - sizes)[doc]) // self.step
        once = np.unique(half * len(self.term) + term[hit])
        half, term = once // len(self.term), once % len(self.term)
        count = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        n = int(halves.sum())
        key, place = np.unique(self.item[at] * n + np.repeat(half, count), return_inverse=True)
        held = np.bincount(place, self.weight[at])
        follows = np.append(key[1:] == key[:-1] + 1, False)
        both = held + np.where(follows, np.append(held[1:], 0), 0)
        need = self.need[key // n]
        starts = set((key[both >= need] % n).tolist())
        # a passage that ends with the half a sum lies in, where the half before has no entry of its own
        alone = (held >= need) & ~np.append(False, follows[:-1])
        starts |= set((key[alone] % n - 1).tolist())
        out = []
        for s in sorted(starts):
            d = int(np.searchsorted(base, s, "right")) - 1
            if s >= 0 and s - base[d] < halves[d] - 1:
                out.append((d, int(s - base[d]) * self.step))
        return out

    def leaks(self, split: list[list[bytes]]) -> list[list[dict]]:
        """Items that each document (its words) leaks, with the best of its passages."""
        best: list[dict[int, dict]] = [{} for _ in split]
        if not self.term:
            return [[] for _ in split]
        for d, s in self.passages(split):
            passage = split[d][s : s + 2 * self.step]
            runs: dict[int, set] = {}
            for k, score in self.above(set(passage)):
                size = min(SHINGLE, len(self.items[k][1]))
                near = runs.get(size) or runs.setdefault(size, set(shingles(passage, size)))
                whole, question, answer = ((len(x & near) / len(x)) if x else 1.0 for x in self.parts[k])
                if whole >= OVERLAP and min(question, answer) >= PART and (k not in best[d] or (whole, score) > (best[d][k]["overlap"], best[d][k]["score"])):
                    best[d][k] = {"item_id": self.items[k][0], "score": min(1.0, score), "overlap": whole, "question": question, "answer": answer}
        return [[b[k] for k in sorted(b)] for b in best]


def leaks_of_all(indexes: list[Index], texts: pa.Array) -> list[list[dict]]:
    """What each text leaks of the items of all ``indexes``, a bounded part of the texts at a time."""
    out: list[list[dict]] = []

    def search(some: list[str | None]) -> None:
        split = [words(t) for t in some]
        each = [index.leaks(split) for index in indexes]
        out.extend([x for found in of_text for x in found] for of_text in zip(*each))

    some, held = [], 0
    for t in texts:
        some.append(t.as_py())
        held += len(some[-1] or "")
        if len(some) == DOCS or held >= BYTES:
            search(some)
            some, held = [], 0
    search(some)
    return out


def _searched(indexes, column: Column) -> Column:
    @F.arrow_udf(MATCHES)
    def search(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.float64()) for n in ("score", "overlap", "question", "answer"))]))
        return pa.array(leaks_of_all(indexes.value, texts), kind)

    return search.asNondeterministic()(column)  # so that the optimiser runs it once


def indexed(items: DataFrame, most: int) -> Iterator[list[Index]]:
    """Indexes of all ``items`` (item_id, text), ``most`` bytes of text at a time, with the statistics of all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [words(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), batch.column(1), pa.array([len(w) for w in split], pa.int64()), pa.array([step_of(len(w)) for w in split], pa.int64()), pa.array([sorted(set(w)) for w in split], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "size", "step", "terms"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    own = saved(own.mapInArrow(each, "item_id long, text string, size long, step long, terms array<binary>").where("size > 0"))
    n, mean = own.agg(F.count("*"), F.coalesce(F.avg("size"), F.lit(1.0))).first()
    bits = F.length(F.bin("step")).cast("long")  # one class of passages for each
    sliced = own.join(F.broadcast(own.groupBy("step").agg(F.greatest(F.ceil(F.sum(F.octet_length("text")) / most), F.lit(1)).alias("slices"))), "step")
    sliced = saved(sliced.withColumn("slice", bits * (1 << 32) + F.pmod(F.xxhash64("item_id"), "slices")))
    df = saved(own.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    held, size = [], 0
    for slice_, step, bytes_ in sliced.groupBy("slice").agg(F.first("step"), F.sum(F.octet_length("text"))).orderBy("slice").toLocalIterator():
        if held and size + bytes_ > most:
            yield held
            held, size = [], 0
        some = sliced.where(F.col("slice") == slice_)
        of_terms = {bytes(r.term): r.df for r in some.select(F.explode("terms").alias("term")).distinct().join(df, "term").collect()}
        held.append(Index([(r.item_id, r.text) for r in some.select("item_id", "text").collect()], step, (n, mean, of_terms)))
        size += bytes_
    if held:
        yield held


def with_leaks(docs: DataFrame, items: DataFrame, most: int = SLICE) -> DataFrame:
    """All columns of ``docs`` (text among them) and ``leaks``, an array of the ``items`` (item_id, text) that the text leaks.

    An entry has the item's id, the best passage's score and the shares of the
    item's shingles found there; entries are ordered by item.  Null, empty and
    blank texts leak nothing and are leaked by nothing; items without id are
    left out; of items with one id each is searched; repeated rows get equal
    results; with no items every array is empty.  An item shorter than five
    words is one shingle.  A column ``leaks`` of ``docs`` is replaced.
    ``most``: bytes of items searched for at once; the result is the same for any.
    """
    spark = docs.sparkSession
    out, last = docs, None
    for indexes in indexed(items, most):
        if last is not None:  # one slice's index is let go before the next is sent
            out = saved(out)
            last.destroy()
        last = spark.sparkContext.broadcast(indexes)
        found = _searched(last, F.col("text").cast("string"))
        out = out.withColumn("leaks", found if out is docs else F.array_sort(F.concat("leaks", found)))
    return out if last is not None else docs.withColumn("leaks", F.array().cast(MATCHES))


def leaked_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, overlap, question, answer``: a row for each leaked item of each row of ``docs``."""
    return with_leaks(docs.select("doc_id", "text"), items).select("doc_id", "leaks").select("doc_id", F.inline("leaks"))
