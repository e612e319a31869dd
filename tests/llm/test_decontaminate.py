import math
import random
from collections import Counter

from pyspark.sql import functions as F

from headwater.llm.decontaminate import B, K1, OVERLAP, PART, THRESHOLD, Index, leaked_pairs, shingles, with_leaks, words


def scores_by_hand(items, passage):
    split = [w for _, t in sorted(items) if (w := words(t))]
    df = Counter(t for w in split for t in set(w))
    mean = sum(map(len, split)) / len(split)
    out = []
    for w in split:
        weight = {t: math.log(1 + (len(split) - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
        out.append(sum(x for t, x in weight.items() if t in passage) / sum(weight.values()))
    return out


def test_wand_finds_all_above_threshold():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, weights=range(60, 0, -1), k=rng.randint(1, 25)))) for i in range(150)]
    index = Index(items)
    for _ in range(200):
        passage = set(words(" ".join(rng.choices(vocabulary, weights=range(60, 0, -1), k=50))))
        want = {k for k, s in enumerate(scores_by_hand(items, passage)) if s >= THRESHOLD}
        assert {k for k, _ in index.above(passage)} == want
        assert not want or index.passages([sorted(passage)]) == [(0, 0)]


def test_leaks_as_by_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["th", "er", "an", "in", "on", "re"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(6, 90))) for i in range(38)] + [(38, text(300)), (39, text(20) + "\n" + text(3))]
    docs = [(i, text(rng.randint(0, 600))) for i in range(120)]
    for i in range(0, 120, 3):
        whole = words(items[i % 40][1])
        part = b" ".join(whole if i % 2 else whole[: int(len(whole) * 0.9) + 1]).decode().upper().replace(" ", ",\n", 2)
        at = rng.randint(0, len(docs[i][1]))
        docs[i] = (i, docs[i][1][:at] + " " + part + " " + docs[i][1][at:])
    want = set()
    for d, t in docs:
        w = words(t)
        for step, s in [(step, s) for step in (64, 128, 256, 512) for s in range(0, len(w), step)]:
            passage = w[s : s + 2 * step]
            near = set(shingles(passage))
            for (i, item), score in zip(sorted(items), scores_by_hand(items, set(passage))):
                if step != max(64, 1 << (len(words(item)) - 1).bit_length()):
                    continue
                runs = shingles(words(item))
                cut = len(words(item.rpartition("\n")[0])) - 4 if "\n" in item else -(-len(runs) // 2)
                parts = [set(runs), set(runs[:cut]), set(runs[cut:])]
                share = [len(x & near) / len(x) if x else 1.0 for x in parts]
                if score >= THRESHOLD and share[0] >= OVERLAP and min(share[1:]) >= PART:
                    want.add((d, i))
    got = leaked_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) >= 20
    # with the index in many slices every score is the same
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r.doc_id, r.item_id, round(r.score, 9), r.overlap, r.question, r.answer)
    sliced = with_leaks(*frames, most=3000).select("doc_id", F.inline("leaks")).collect()
    assert sorted(map(key, sliced)) == sorted(map(key, got))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "one two three four five six", "a"), (3, "one two three four five six", "a"), (None, "x " * 9000 + "One, two! three four five six", "a")], "doc_id long, text string, leaks string")
    items = spark.createDataFrame([(7, "one two three four five six", 1), (None, "one two three", 1), (8, None, 1), (9, "  ", 1), (10, "?", 1), (11, "six", 1)], "item_id long, text string, doc_id int")
    got = [(r.doc_id, r.item_id, r.overlap) for r in leaked_pairs(docs, items).collect()]
    assert sorted(got, key=str) == [(3, 11, 1.0), (3, 11, 1.0), (3, 7, 1.0), (3, 7, 1.0), (None, 11, 1.0), (None, 7, 1.0)]
    assert with_leaks(docs, items.limit(0)).where("size(leaks) = 0").count() == 5
    assert with_leaks(docs.limit(0), items).count() == 0
