"""Near duplicates by SimHash fingerprints and a binary trie self-join.

Fingerprints are grouped to their distinct values first, so copies cost
nothing further.  The self-join finds every pair of distinct values at
``RADIUS`` = 4 or fewer differing bits.  The 64 bits are five blocks.  For at
most four differing bits there is, by the cycle lemma, a rotation of the blocks
under which the first i blocks hold at most i - 1 of them, for each i.  So each
value enters five tries, one for each rotation, dealt out by their first block
(which must be equal), and a trie walk visits pairs of nodes together,
accumulates the differing bits and prunes a pair as soon as it exceeds the
budget of its depth: 0 in the first block, 1 up to the end of the second, and
so on up to 4.

A walk also drops node pairs whose members are linked already, and what a group
emits are links that span it (a tree of fan-out 64), never all of its pairs.
A group of over ``HEAVY`` values is dealt out again by its second block: each
value lies once under its own and once, as a guest, under each at one bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.common import checkpointed as saved
from headwater.llm.graph import components

RADIUS = 4
BLOCKS = (13, 13, 13, 13, 12)
WORDS = 4
SEED = 42
HEAVY = 1 << 20
#: Node pairs handled at once, values after which groups are joined, and the fan-out of the links.
PAIRS, VALUES, FAN = 1 << 17, 1 << 16, 64


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the unsigned 64-bit ``hashes``."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text's shingles of four words; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts = [0, *(g + 1 for g in gaps)]
    ends = [*gaps[WORDS - 1 :], len(joined)]
    return majority(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, fp``, a row for each row of ``docs``: the text's hash and its fingerprint's bits, as signed longs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            fp = np.array([fingerprint(texts[i].as_py()) for i in range(len(texts))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "mark", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(each, "doc_id long, mark long, fp long")


def rotated(fp: np.ndarray, turn: int) -> np.ndarray:
    """Values with block number ``turn`` moved to the front."""
    shift = sum(BLOCKS[:turn])
    return fp if not shift else (fp << np.uint64(shift)) | (fp >> np.uint64(64 - shift))


def budgets() -> np.ndarray:
    """Most differing bits allowed among the first d bits, for d from 0 to 64.

    The blocks differ in width, so their ends differ by rotation; the largest budget of any holds.
    """
    turns = []
    for turn in range(len(BLOCKS)):
        widths = BLOCKS[turn:] + BLOCKS[:turn]
        turns.append([0, *(i for i, width in enumerate(widths) for _ in range(width))])
    return np.max(turns, axis=0)


class Links:
    """Union-find over positions, with labels that can be tested for whole ranges; ``pairs`` are those that joined two components."""

    def __init__(self, n: int):
        self.up, self.pairs = list(range(n)), []
        self.renew()

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        fresh = self.label[a] != self.label[b]
        changed = False
        for x, y in zip(a[fresh].tolist(), b[fresh].tolist()):
            i, j = self.root(x), self.root(y)
            if i != j:
                self.up[max(i, j)] = min(i, j)
                self.pairs.append((x, y))
                changed = True
        if changed:
            self.renew()

    def renew(self) -> None:
        label = np.array(self.up)
        while not np.array_equal(above := label[label], label):
            label = above
        self.label = label
        self.up = label.tolist()
        self.changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])]) if len(label) else label

    def linked(self, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Whether two ranges lie in one component."""
        return (self.changes[lo] == self.changes[hi - 1]) & (self.changes[lo2] == self.changes[hi2 - 1]) & (self.label[lo] == self.label[lo2])


def trie_join(values: np.ndarray, roots: list[tuple[int, int, int, int, int, int]], links: Links) -> None:
    """Link all positions of ``values`` that the walk finds within the budget.

    roots: pairs of ranges, each sorted, whose members share their first
    ``depth`` bits up to ``errors`` differing ones: lo, hi, lo2, hi2, depth, errors.
    A node is a range of the sorted values; equal ranges make a pair of a node with itself.
    """
    budget = budgets()
    stack = [np.array(roots, np.int64).reshape(-1, 6)]
    while stack:
        pairs = stack.pop()
        if len(pairs) > PAIRS:
            stack += [pairs[PAIRS:], pairs[:PAIRS]]
            continue
        lo, hi, lo2, hi2, depth, errors = pairs.T
        pairs = pairs[(lo < hi) & (lo2 < hi2) & (errors <= budget[depth])]
        if len(pairs):
            pairs = pairs[~links.linked(*pairs[:, :4].T)]
        if not len(pairs):
            continue
        lo, hi, lo2, hi2, depth, errors = pairs.T
        small = ((hi - lo) * (hi2 - lo2) <= 16) | (depth == 64)
        if small.any():
            at, wide = pairs[small], (hi2 - lo2)[small]
            size = (at[:, 1] - at[:, 0]) * wide
            which = np.repeat(np.arange(len(at)), size)
            k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            a, b = at[which, 0] + k // wide[which], at[which, 2] + k % wide[which]
            near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= RADIUS)
            links.join(a[near], b[near])
            pairs = pairs[~small]
        if not len(pairs):
            continue
        lo, hi, lo2, hi2, depth, errors = pairs.T
        mid, mid2 = split_at(values, lo, hi, depth), split_at(values, lo2, hi2, depth)
        own = (lo == lo2) & (hi == hi2)
        down = depth + 1
        same = [np.stack([lo, mid, lo2, mid2, down, errors], 1), np.stack([mid, hi, mid2, hi2, down, errors], 1)]
        cross = [np.stack([lo, mid, mid2, hi2, down, errors + 1], 1), np.stack([mid, hi, lo2, mid2, down, errors + 1], 1)[~own]]
        stack += cross
        stack += same


def split_at(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the bit number ``depth`` of each sorted range turns to 1."""
    lo, hi, bit = lo.copy(), hi.copy(), (63 - depth).astype(np.uint64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def spanning(values: np.ndarray, turn: np.ndarray, links: Links) -> pa.RecordBatch:
    """Links of each component of over one member, as pairs of fingerprints."""
    label = links.label
    size = np.bincount(label, minlength=len(label))
    member = np.flatnonzero(size[label] > 1)
    shift = np.cumsum([0, *BLOCKS])[turn[member]].astype(np.uint64)
    v = values[member]
    fp = np.where(shift == 0, v, (v >> shift) | (v << ((np.uint64(64) - shift) & np.uint64(63)))).view(np.int64)
    order = np.lexsort((fp, label[member]))
    fp, group = fp[order], label[member][order]
    first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    at = np.arange(len(group)) - start
    a, b = fp[start + np.maximum(at - 1, 0) // FAN], fp
    keep = (at > 0) & (a != b)
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def join_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by turn, block, sub, guest and value; yields links, of ids within reach of each other if rows have one."""

    def solve(table: np.ndarray) -> pa.RecordBatch:
        keys, guest, values = table[:, :3], table[:, 3], table[:, 4].view(np.uint64)
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(table))
        homes = stops - np.add.reduceat(guest, starts)
        width = np.array(BLOCKS)
        turn = keys[starts, 0]
        deep = width[turn] + np.where(keys[starts, 2] < 0, 0, width[(turn + 1) % len(width)])
        roots = [(s, h, s, h, d, 0) for s, h, d in zip(starts.tolist(), homes.tolist(), deep.tolist())]
        roots += [(s, h, h, e, d, 1) for s, h, e, d in zip(starts.tolist(), homes.tolist(), stops.tolist(), deep.tolist()) if h < e]
        links = Links(len(table))
        if table.shape[1] > 5:
            same = np.flatnonzero((table[1:, :5] == table[:-1, :5]).all(axis=1))
            links.join(same, same + 1)
        trie_join(values, roots, links)
        if table.shape[1] > 5:
            a, b = table[np.array(links.pairs, np.int64).reshape(-1, 2).T, 5]
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])
        return spanning(values, keys[:, 0], links)

    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.stack([c.to_numpy() for c in batch.columns], 1).astype(np.int64)
        if rows >= VALUES:  # up to the last change of the key
            table = np.concatenate(held)
            edge = np.flatnonzero((table[1:, :3] != table[:-1, :3]).any(axis=1))
            if len(edge):
                yield solve(table[: edge[-1] + 1])
                held = [table[edge[-1] + 1 :]]
                rows = len(held[0])
        held.append(part)
        rows += len(part)
    if rows:
        yield solve(np.concatenate(held))


def links(values: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints of ``values`` (fp) within reach of each other.

    Where ``values`` have an ``id``, links are pairs of ids whose own fingerprints
    are within reach, which fingerprints may share.
    """
    with_id = [c for c in ("id",) if c in values.columns]
    turns = []
    for turn in range(len(BLOCKS)):
        shift = sum(BLOCKS[:turn])
        v = F.col("fp") if not shift else F.shiftleft("fp", shift).bitwiseOR(F.shiftrightunsigned("fp", 64 - shift))
        turns.append(F.struct(F.lit(turn).cast("long").alias("turn"), F.shiftrightunsigned(v, 64 - BLOCKS[turn]).alias("block"), v.alias("v")))
    keyed = values.select(*with_id, F.explode(F.array(*turns)).alias("x")).select("x.*", *with_id)
    crowded = saved(keyed.groupBy("turn", "block").count().where(F.col("count") > heavy).select("turn", "block"))
    columns = ["turn", "block", "sub", "guest", "v", *with_id]
    light = keyed.join(crowded, ["turn", "block"], "left_anti") if (some := not crowded.isEmpty()) else keyed
    dealt = light.select("turn", "block", F.lit(-1).cast("long").alias("sub"), F.lit(0).cast("long").alias("guest"), "v", *with_id)
    if some:
        crowd = keyed.join(crowded, ["turn", "block"], "left_semi")
        for turn in range(len(BLOCKS)):
            width, then = BLOCKS[turn], BLOCKS[(turn + 1) % len(BLOCKS)]
            second = F.shiftrightunsigned("v", 64 - width - then).bitwiseAND(F.lit((1 << then) - 1))
            spots = [F.struct(second.alias("sub"), F.lit(0).cast("long").alias("guest"))]
            spots += [F.struct(second.bitwiseXOR(F.lit(1 << b)).alias("sub"), F.lit(1).cast("long").alias("guest")) for b in range(then)]
            own = crowd.where(F.col("turn") == turn).select("turn", "block", "v", *with_id, F.explode(F.array(*spots)).alias("s"))
            dealt = dealt.union(own.select("turn", "block", "s.sub", "s.guest", "v", *with_id))
    # unsigned order of the values: the sign bit is flipped for sorting
    dealt = dealt.repartition("turn", "block", "sub").sortWithinPartitions("turn", "block", "sub", "guest", F.col("v").bitwiseXOR(F.lit(-(1 << 63))))
    return dealt.select(*columns).mapInArrow(join_partition, "a long, b long")


def grouped(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, mark, fp, component_id`` for every row of ``docs``."""
    rows = saved(fingerprints(docs))
    values = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(values.select("fp"), heavy)).withColumnRenamed("node", "fp")
    of_root = saved(found.join(values, "fp").groupBy("root").agg(F.min("least").alias("smallest")))
    linked = saved(found.join(of_root, "root").select("fp", "root", "smallest"))
    every = saved(values.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("smallest", "least").alias("component_id")))
    return rows.join(every, "fp", "left").select("doc_id", "mark", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs`` (doc_id, text).

    Documents whose fingerprints differ in at most four bits are linked;
    component_id is the smallest doc_id that a document reaches over links.
    Null and empty texts have fingerprint 0 and are linked like any other.
    Rows without doc_id take part and get their component's smallest doc_id,
    null if it has none; repeated rows come as often as given; no rows give
    none.  Other columns are not read.
    """
    return grouped(docs, heavy).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The row of each component with the smallest doc_id, all columns kept.

    Of rows with that doc_id, or of a component without any, the one whose text
    has the smallest hash stays, and of equal rows one.
    """
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    return first_of_each(docs, grouped(docs, heavy).groupBy("root").agg(F.min(best).alias("x")))


def first_of_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each row of ``chosen``, whose x holds its doc_id and its text's hash (mark)."""
    kept = saved(chosen.select(F.col("x.doc_id").alias("__of"), F.col("x.mark").alias("__mark")))
    rows = docs.withColumn("__key", F.xxhash64(F.col("text").cast("string")))
    stays = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept["__of"]) & (rows["__key"] == kept["__mark"]))
    once = Window.partitionBy("__of", "__mark").orderBy(F.lit(0))
    return stays.withColumn("__nth", F.row_number().over(once)).where("__nth = 1").drop("__key", "__of", "__mark", "__nth")
