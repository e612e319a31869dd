import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

from headwater.llm.lmscore import BUCKETS, CLASSES, HASH, MEMBERS, OFFSETS, REACH, SHAPES, SIZE, Network, Numbers, fit, places, with_scores


def random_network():
    rng = np.random.default_rng(0)
    return Network({n: rng.normal(0, 0.5, s) for n, s in SHAPES.items()})


def test_probabilities_add_up_and_match_loops():
    network, rng = random_network(), np.random.default_rng(1)
    seen = np.concatenate([[0] * REACH, rng.integers(1, SIZE, 30), [0] * REACH])
    at = np.arange(REACH, REACH + 30)
    got = network.log_probabilities(seen, at)
    for i in (at[0], at[13], at[-1]):
        h = np.tanh(sum(network.context[k][seen[i + o]] for k, o in enumerate(OFFSETS)))
        z, every = network.classes @ h + network.class_bias, np.empty(SIZE)
        for c in range(CLASSES):
            y = network.members[c] @ h + network.member_bias[c]
            every[np.arange(MEMBERS) * CLASSES + c] = z[c] - np.log(np.exp(z).sum()) + y - np.log(np.exp(y).sum())
        assert abs(np.exp(every).sum() - 1) < 1e-9 and abs(every[seen[i]] - got[i - REACH]) < 1e-6


def test_gradients_by_differences():
    network, rng = random_network(), np.random.default_rng(2)
    seen = np.concatenate([[0] * REACH, rng.integers(1, SIZE, 40), [0] * REACH])
    at = np.arange(REACH, REACH + 40)
    found = network.gradients(seen, at)
    for name in SHAPES:
        values = getattr(network, name)
        for flat in np.argsort(-np.abs(found[name]).ravel())[:4]:
            spot = np.unravel_index(flat, values.shape)
            ends = []
            for step in (1e-4, -1e-4):
                values[spot] += step
                ends.append(network.log_probabilities(seen, at).sum())
                values[spot] -= step
            assert abs((ends[0] - ends[1]) / 2e-4 - found[name][spot]) < 1e-2 * max(1, abs(found[name][spot])), name


def test_padding_keeps_texts_apart():
    numbers = Numbers(["a", "b"])
    seen, sizes, hashes = numbers.of(pa.array(["a b", None, " b zzz  a\n"]))
    assert hashes[3] == xxh64_intdigest("zzz", HASH)
    assert sizes.tolist() == [2, 0, 3] and seen[places(sizes)].tolist()[:3] == [1, 2, 2]
    network = random_network()
    alone = network.log_probabilities(*[(s, places(z)) for s, z, _ in [numbers.of(pa.array(["b zzz a"]))]][0])
    assert np.allclose(network.log_probabilities(seen, places(sizes))[2:], alone)


def test_held_out_texts_in_order_score_higher(spark):
    rng = random.Random(0)
    follow = {w: f"w{(i * 7 + 3) % 50}" for i, w in enumerate(f"w{k}" for k in range(50))}

    def text(n):
        w = rng.choice(list(follow))
        out = []
        for _ in range(n):
            out.append(w)
            w = follow[w] if rng.random() < 0.9 else rng.choice(list(follow))
        return out

    model = fit(spark.createDataFrame([(" ".join(text(400)),) for _ in range(300)], "text string").repartition(2))
    numbers, network = Numbers(model.words), model.network
    gain = []
    for _ in range(20):
        good = text(200)
        bad = rng.sample(good, len(good))
        scores = []
        for t in (good, bad):
            seen, sizes, _ = numbers.of(pa.array([" ".join(t)]))
            scores.append(network.log_probabilities(seen, places(sizes)).sum())
        gain.append(scores[0] > scores[1])
    assert all(gain)


def test_words_in_buckets_have_their_share(spark):
    """A score is the network's part and, of each word in a bucket, the log of its share of the bucket's occurrences."""
    rng = random.Random(3)
    rare = [f"{rng.randrange(10**9)}ing" for _ in range(3000)]
    texts = [" ".join(rng.choices(rare, range(1, 3001), k=40)) for _ in range(400)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    tally = Counter(w for t in texts for w in t.split())
    model = fit(frame)
    numbers = Numbers(model.words)
    inside = {w: n for w, n in tally.items() if w not in set(model.words)}
    assert inside and sum(inside.values()) == model.totals.sum() and len(model.words) + BUCKETS < SIZE
    for r in with_scores(frame).collect():
        seen, sizes, _ = numbers.of(pa.array([r.text]))
        want = model.network.log_probabilities(seen, places(sizes)).sum()
        want += sum(math.log(inside[w] / sum(inside.values())) for w in r.text.split() if w in inside)
        assert abs(r.log_probability - want) < 1e-2 * abs(want)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, " ", "a"), (3, "x y z", "a"), (3, "x y z", "a"), (None, "long " * 90000, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = with_scores(frame).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 3, 3, 90000]
    assert all((r.mean_log_probability is None and r.log_probability == 0) if r.n_words == 0 else r.log_probability < 0 for r in got)
    assert with_scores(frame.limit(0)).count() == 0
