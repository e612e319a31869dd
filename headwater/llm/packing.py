"""Packing of tokenised documents into fixed-length training sequences.

Order-preserving dynamic programming.  The documents of an input partition
form one token stream in the order in which they are stored.  Window cuts are
chosen among document ends (free), sentence ends inside a document (a small
penalty) and, where neither is near, a grid of plain token positions (a larger
penalty).  With ``p`` the position of a cut and ``f`` its least cost,

    f(j) = penalty(j) + min over 0 < p_j - p_i <= max_len of f(i) + max_len - (p_j - p_i)

and since ``p_j`` leaves the minimum, a monotone queue over ``f(i) + p_i``
makes each transition amortised constant time.

The stream is solved in blocks of ``BLOCK`` tokens: all windows but the last
few of a block are settled and the rest starts the next block, so memory is
bounded by a block and the longest single document, and no padding is added
between blocks.  The program is exact over the cuts offered, within a block and
what it takes over.  No text is shuffled: a partition is packed where it is read.

A partition's windows end where that costs least within a window's length of its
end.  What lies behind, less than a window, goes to a second step, which packs
the remainders of ``TOGETHER`` partitions at a time in the same way; only the
last sequence of each such group ends where its tokens do.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import WORKER_CACHES, saved

MAX_LEN = 4096
BLOCK = 1 << 19
#: Partitions whose remainders are packed together.
TOGETHER = 1024
#: Cost of a cut, in tokens of padding that it is worth.
SENTENCE_CUT, PLAIN_CUT = 4, 32
#: Plain cuts are offered every so many tokens in stretches without a sentence end.
GRID = 64
#: Words after which the cache of a Python worker becomes the old one, which serves until the next such time.
CACHE = 400_000
#: Bytes of text after which a batch of documents is tokenised.
CHARS = 4_000_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loose boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loose", pa.bool_())])
TAIL = ".,!?*$%&#|;:\"'"


class WordTokenizer:
    """Token ids of whole texts through a cache of words.

    Exact for tokenizers that fold case, drop white space and never merge
    across it: a text's ids are then the ids of its blank-separated words, one
    after the other.  Arrow splits the texts of a batch and numbers their
    distinct words; only those are looked up, and only new ones encoded.  A full
    stop or comma after a letter or digit is a word of its own, which leaves
    fewer distinct words; texts with adjacent punctuation or unusual characters
    are not cut there, and texts that may hold a special token are encoded whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        vocab = self.encoder.get_vocab(with_added_tokens=True)
        if max(vocab.values()) > 65535:
            raise ValueError("token ids must fit 16 bits")
        self.ends_word = np.zeros(65536, bool)
        self.ends_sentence = np.zeros(65536, bool)
        for token, i in vocab.items():
            self.ends_word[i] = token.endswith("</w>")
            self.ends_sentence[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
        self.cache, self.young, self.old = cache, {}, {}
        self.mark = np.array([not (chr(b).isalnum() or b == 32 or 9 <= b <= 13) for b in range(128)] + [False] * 128)

    def plain(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def learn(self, letters: list[str]) -> None:
        """Encode words of plain letters in groups, cut apart at the end-of-word tokens."""
        for at in range(0, len(letters), 64):
            group = letters[at : at + 64]
            ids = np.array(self.encoder.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, np.uint16)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                raw, k = ids.tobytes(), 0
                for word, end in zip(group, (2 * ends).tolist()):
                    self.young[word] = raw[k:end]
                    k = end
            else:
                for word in group:
                    self.young[word] = self.plain(word)

    def known(self, words: list[str]) -> list[bytes]:
        if len(self.young) > self.cache:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = [w for w in words if w not in young]
        letters, ended = set(), []
        for word in new:
            if word in old:
                young[word] = old[word]
            elif word.isalpha():
                letters.add(word)
            else:
                stem = word.rstrip(TAIL)
                tail = word[len(stem) :]
                if tail and stem.isalpha():
                    ended.append((word, stem, tail))
                    if stem in old:
                        young[stem] = old[stem]
                    elif stem not in young:
                        letters.add(stem)
                    if tail not in young:
                        young[tail] = self.plain(tail)
                else:
                    young[word] = self.plain(word)
        self.learn(list(letters))
        for word, stem, tail in ended:
            young[word] = young[stem] + young[tail]
        return [young[w] for w in words]

    def cut_at_stops(self, texts: pa.Array) -> pa.Array:
        """Texts with a blank before each full stop and comma, where that leaves their tokens as they are."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        if not len(raw):
            return texts
        mark = self.mark[raw]
        after = np.append(raw[1:], 0)
        odd = (raw == 0xC2) | (raw >= 0xC4) | ((raw == 0xC3) & ((after == 0x97) | (after == 0xB7)))
        odd[:-1] |= mark[1:] & mark[:-1]
        bad = np.zeros(len(texts), bool)
        at = np.searchsorted(offsets - offsets[0], np.flatnonzero(odd), "right") - 1
        bad[at] = True
        cut = pc.replace_substring(pc.replace_substring(texts, ".", " ."), ",", " ,")
        return pc.if_else(pa.array(bad), texts, cut)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (none is null) as little-endian 16-bit numbers."""
        texts = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))  # a copy from offset 0: kernels misread slices
        whole = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        folded = pc.replace_substring(self.cut_at_stops(pc.ascii_lower(texts)), "\n", " ")
        split = pc.split_pattern(folded, " ")
        coded = split.flatten().dictionary_encode()
        ids = self.known(coded.dictionary.to_pylist())
        size = np.array([len(x) // 2 for x in ids], np.int64)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), np.uint16)
        code = coded.indices.to_numpy()
        each = size[code]
        ends = np.cumsum(each)
        out = flat[np.repeat(start[code] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = split.offsets.to_numpy() - (split.offsets[0].as_py() if len(split) else 0)
        edges = (2 * np.concatenate([[0], ends])[bounds]).tolist()
        found = [out[a:b] for a, b in zip(edges, edges[1:])]
        for i in whole.tolist():
            found[i] = self.plain(texts[i].as_py())
        return found


@lru_cache(2)
def worker_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a Python worker, which keep its cache warm."""
    return WordTokenizer(path)


WORKER_CACHES.append(worker_tokenizer.cache_clear)


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a stream (its start and end included) and their penalties."""
    total = len(ids)
    cost = np.full(total + 1, -1, np.int32)
    cost[np.flatnonzero(ends_sentence[ids]) + 1] = SENTENCE_CUT
    cost[doc_ends] = 0
    cost[0] = cost[total] = 0
    at = np.flatnonzero(cost >= 0)
    wide = np.flatnonzero(np.diff(at) > GRID)
    for k in wide:
        cost[at[k] + GRID : at[k + 1] : GRID] = PLAIN_CUT
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def cuts(at: list[int], penalty: list[int], max_len: int, open_end: bool = False) -> list[int]:
    """Positions of the cheapest cuts, from the first candidate to the last; with ``open_end`` to the cheapest one less than ``max_len`` before it."""
    cost, back = [0] * len(at), [0] * len(at)
    queue = deque([(at[0], at[0], 0)])  # f + p, p, index; f + p grows along the queue
    for j in range(1, len(at)):
        p = at[j]
        while queue[0][1] < p - max_len:
            queue.popleft()
        best, _, i = queue[0]
        f = penalty[j] + best + max_len - p
        cost[j], back[j] = f, i
        key = f + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    out, j = [], len(at) - 1
    if open_end:
        j = min((k for k in range(len(at)) if at[k] > at[-1] - max_len), key=lambda k: (cost[k], -k))
    while j:
        out.append(at[j])
        j = back[j]
    return [at[0], *reversed(out)]


def pack_partition(batches: Iterator[pa.RecordBatch], path: str, max_len: int, end_id: int, block: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 40
    words = worker_tokenizer(path)
    end = np.array([end_id], np.uint16).tobytes()
    stream: list[tuple] = []  # doc_id, ids from its first open token on, tokens before those, tokens in all
    held, sequence = 0, 0

    def solve(last: bool) -> pa.RecordBatch | None:
        nonlocal stream, held, sequence
        if not held:
            return None
        loose_from = None
        ids = np.concatenate([np.frombuffer(x[1], np.uint16) for x in stream])
        ends = np.cumsum([len(x[1]) // 2 for x in stream])
        at, penalty = candidates(ids, ends, words.ends_sentence)
        chosen = cuts(at.tolist(), penalty.tolist(), max_len, open_end=last)
        if not last:
            chosen = [c for c in chosen if c <= len(ids) - 8 * max_len] or chosen
        elif chosen[-1] < len(ids):
            chosen.append(len(ids))
            loose_from = chosen[-2]
        columns: list[list] = [[] for _ in ARROW]
        loose_from = len(ids) if not last or loose_from is None else loose_from
        k, begun, wide = 0, 0, ids.astype("<u4")
        for lo, hi in zip(chosen, chosen[1:]):
            offset = 0
            while lo + offset < hi:
                doc_id, raw, before, total = stream[k]
                here = lo + offset
                size = min(hi, int(ends[k])) - here
                for column, value in zip(columns, (doc_id, before + here - begun, size, wide[here : here + size].tobytes(), total, base + sequence, offset, lo >= loose_from)):
                    column.append(value)
                offset += size
                if here + size == ends[k]:
                    begun = int(ends[k])
                    k += 1
            sequence += 1
        settled = chosen[-1]
        rest = stream[k:]
        if rest and settled > begun:
            doc_id, raw, before, total = rest[0]
            rest[0] = (doc_id, raw[2 * (settled - begun) :], before + settled - begun, total)
        stream, held = rest, len(ids) - settled
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
        filled = np.cumsum(pc.binary_length(texts).to_numpy())
        lo = 0
        while lo < len(doc_ids):
            hi = max(lo + 1, int(np.searchsorted(filled, (filled[lo - 1] if lo else 0) + CHARS, "right")))
            for doc_id, raw in zip(doc_ids[lo:hi], words.encode(texts.slice(lo, hi - lo))):
                raw += end
                stream.append((doc_id, raw, 0, len(raw) // 2))
                held += len(raw) // 2
            lo = hi
            if held >= block and (out := solve(False)) is not None:
                yield out
    if (out := solve(True)) is not None:
        yield out


def pack_loose(pieces: pa.Table, ends_sentence: np.ndarray, max_len: int) -> pa.Table:
    """Pieces of one group of partitions, packed in their order."""
    pieces = pieces.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
    rows = pieces.to_pylist()
    size = np.array([r["length"] for r in rows], np.int64)
    ends = np.cumsum(size)
    at, penalty = candidates(np.frombuffer(b"".join(r["ids"] for r in rows), "<u4"), ends, ends_sentence)
    chosen = np.array(cuts(at.tolist(), penalty.tolist(), max_len))
    base = (1 << 62) | ((rows[0]["sequence_id"] >> 40) // TOGETHER) << 40
    edges = np.unique(np.concatenate([chosen, ends]))
    columns: list[list] = [[] for _ in ARROW]
    for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
        row = rows[k := int(np.searchsorted(ends, lo, "right"))]
        skip, window = lo - int(ends[k] - size[k]), int(np.searchsorted(chosen, lo, "right")) - 1
        for column, value in zip(columns, (row["doc_id"], row["start"] + skip, hi - lo, row["ids"][4 * skip : 4 * (skip + hi - lo)], row["doc_tokens"], base + window, lo - int(chosen[window]), True)):
            column.append(value)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def pack(docs: DataFrame, path: str, max_len: int = MAX_LEN, end_id: int = 2, block: int = BLOCK) -> DataFrame:
    """Pieces of the sequences into which ``docs`` (doc_id, text) are packed.

    A document's ids are those of its text followed by ``end_id``; a null or
    empty text has that id alone, a null doc_id stays null, repeated rows are
    packed as often as they come, an empty table gives no row.  Other columns
    are not read.  ``ids`` holds a piece's ids as little-endian 32-bit numbers.
    Every id lies in exactly one piece; a sequence holds at most ``max_len``.
    """
    if block < 16 * max_len:
        raise ValueError("a block holds at least 16 windows")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = saved(texts.mapInArrow(lambda it: pack_partition(it, path, max_len, end_id, block), SCHEMA))
    group = F.shiftright("sequence_id", 40) / F.lit(TOGETHER)
    rest = first.where("loose").groupBy(F.floor(group)).applyInArrow(lambda t: pack_loose(t, worker_tokenizer(path).ends_sentence, max_len), SCHEMA)
    return first.where("NOT loose").union(rest).drop("loose")
