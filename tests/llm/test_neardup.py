"""The pipeline's near-duplicate stage against all pairs in plain Python."""

import random

import corpus_pipeline
from headwater.llm import neardup, simhash
from headwater.llm.simhash import RADIUS, fingerprint


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_stage_joins_at_four_fifths(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = {}
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        texts[4 * i] = " ".join(base)
        for k in range(1, 4):  # some words replaced: similarities on both sides of 0.8
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 30))):
                copy[at] = rng.choice(vocabulary)
            texts[4 * i + k] = " ".join(copy)
    texts |= {900: None, 901: "", 902: "one two", 903: "one two"}
    sets = {i: five(t) for i, t in texts.items()}
    above = {i: i for i in texts}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    far = 0
    for i in texts:
        for j in texts:
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                far += (fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > RADIUS
                a, b = sorted((root(i), root(j)))
                above[b] = a
    assert far > 20
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame, "").collect())
    assert got == sorted({root(i) for i in texts})


def test_driver_lets_go_after_each_step(spark, monkeypatch):
    """What a step leaves in the driver goes before the next; what the second round links are groups of the first."""
    steps, ends = [], []
    real = neardup.components
    monkeypatch.setattr(neardup, "let_go", lambda session: steps.append(1))
    monkeypatch.setattr(neardup, "components", lambda edges, saved: (ends.append((saved is neardup.saved, edges.count())), real(edges, saved))[1])
    texts = {i: " ".join(f"w{k}" for k in range(200) if k != i) for i in range(3)}
    texts[3] = " ".join(f"w{k}" for k in range(25, 200))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert [r.doc_id for r in neardup.one_of_each(frame).collect()] == [0]
    assert all(own for own, _ in ends) and len(steps) > 10
    assert len(ends) == 1 or ends[1][1] < ends[0][1]


def test_stage_takes_pairs_from_the_trie(spark, monkeypatch):
    """Near copies within the fingerprints' radius are found where bands propose nothing, and links hold for the exact similarity alone."""
    rng = random.Random(5)
    texts, sets = {}, {}
    for i in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts[2 * i] = " ".join(words)
        texts[2 * i + 1] = " ".join([*words, "end"])
    sets = {i: neardup.shingles(t) for i, t in texts.items()}
    reach = {i for i in range(0, 60, 2) if (simhash.majority(sets[i]) ^ simhash.majority(sets[i + 1])).bit_count() <= RADIUS}
    assert len(reach) > 20
    monkeypatch.setattr(neardup, "proposed", lambda members, spanning: spark.createDataFrame([], "a long, b long, of long, to long"))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in neardup.one_of_each(frame).collect()} == set(texts) - {i + 1 for i in reach}
    # one fingerprint for all: the trie proposes, the similarity refuses
    values = spark.createDataFrame([(k, 1, 5) for k in range(40)], "key long, n long, fp long")
    assert len({x for r in neardup.near(values).collect() for x in (r.a, r.b)}) == 40


def test_batches_and_worker_caches(spark, monkeypatch):
    """The stage hands small batches to Python workers, lets the driver collect its garbage after each step, and leaves the session as it was."""
    from headwater.llm import common
    from headwater.llm.packing import worker_tokenizer

    before, seen, steps = {k: spark.conf.get(k) for k in neardup.BATCH}, [], []
    monkeypatch.setattr(neardup, "checkpointed", lambda df: (seen.append({k: spark.conf.get(k) for k in neardup.BATCH}), common.checkpointed(df))[1])
    monkeypatch.setattr(neardup, "let_go", lambda session: steps.append(1))
    frame = spark.createDataFrame([(i, f"a b c d e f{i % 7}") for i in range(50)], "doc_id long, text string")
    assert neardup.one_of_each(frame).count() == 7
    assert len(steps) >= len(seen) > 10 and all(x == neardup.BATCH for x in seen)
    assert {k: spark.conf.get(k) for k in neardup.BATCH} == before
    assert worker_tokenizer.cache_clear in common.WORKER_CACHES
