import random
import re

import numpy as np

from headwater.llm.pii import KINDS, all_spans, base_spans, digest, features, joined, labelled_findings, luhn, pii, proposals, redact, trained, with_pii

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def by_hand(text):
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (k == 0) or (k == 1 and all(int(p) <= 255 for p in m.group().split("."))) or (k == 2 and 16 <= len(digits) <= 19 and luhn(digits)) or (k == 3 and 8 <= len(digits) <= 15):
                out.append((k, *m.span()))
    return out


def test_base_spans_as_plain_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["@", ".", "a", "é", "1", "25", "256", " ", "-", "+", "(", ")", "4111111111111111", "b@c.de", "1.2.3.4", "+1 2345678", "_", "%"]) for _ in range(rng.randint(0, 30)))
        assert base_spans(text) == by_hand(text), text
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_long_runs_are_linear():
    assert base_spans("1" * 200000) == [] and base_spans("a" * 200000 + "@") == [] and base_spans("1." * 100000) != []
    many = "call 864-555-0138 now, " * 20000  # as many spans as sentences
    assert len(all_spans(many, trained())[1]) == 20000


def test_trees_on_held_out_findings():
    trees = trained()
    rows = labelled_findings(1500, 99)
    x, y = np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows])
    chosen = trees.probability(x) >= np.array([trees.threshold.get(int(k), 2) for k in x[:, 0]])
    assert y[chosen].mean() > 0.97 and chosen[y == 1].mean() > 0.6


def test_added_spans():
    text = "please call 864-555-0138 or write jane.doe (at) mail (dot) com, not 4111111111111112"
    base, every = all_spans(text, trained())
    assert base == [] and {(KINDS[k], text[s:e]) for k, s, e in every} == {("email", "jane.doe (at) mail (dot) com"), ("phone", "864-555-0138")}


def test_parts_of_failed_matches_are_added():
    """A phone number that runs into an address fails as a base match; the trees put the right part of it back."""
    text = "Des +1 (826) 555-4081 190.137.223.17 and 4111 1111 1111 1111 2024 then 192[.]168[.]20[.]17 end"
    base, every = all_spans(text, trained())
    assert [(KINDS[k], text[s:e]) for k, s, e in base] == [("ip", "190.137.223.17")]
    assert {(KINDS[k], text[s:e]) for k, s, e in every} - {("card", "4111 1111 1111 1111")} == {("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.17"), ("ip", "192[.]168[.]20[.]17")}


def test_added_spans_as_by_comparing_all():
    """The most probable first, each compared with every span taken before."""
    rng, added = random.Random(5), 0
    pieces = ["+1 (826) 555-4081", "190.137.223.17", "864-555-0138", "jane.doe (at) mail (dot) com", "4111111111111111", "4111 1111 1111 1111 20", "call", "order", "card", "no", "2024-01-02", "x", "a@b.cd", "10[.]0[.]0[.]1", "7536784127813050"]
    trees = trained()
    for _ in range(400):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        base, every = all_spans(text, trees)
        new = sorted(set(proposals(text)))
        p = trees.probability(np.array([features(text, *s) for s in new])) if new else []
        taken = list(base)
        for i in sorted(range(len(new)), key=lambda i: (-p[i], new[i][1], i)):
            k, s, e = new[i]
            if p[i] >= trees.threshold[k] and not any(s < e2 and s2 < e for _, s2, e2 in taken):
                taken.append(new[i])
        added += len(taken) - len(base)
        assert base == by_hand(text) and every == sorted(taken), text
    assert added > 400


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é b@c.de 1.2.3.4"), (3, "é b@c.de 1.2.3.4"), (None, "x" * 100000 + " +1 (864) 555-0138")]
    frame = spark.createDataFrame(rows, "pii long, text string").withColumnRenamed("pii", "doc_id")
    got = with_pii(frame).select("doc_id", joined(pii(spark, frame["text"])["spans"]).alias("s")).collect()
    assert [(r.doc_id, r.s) for r in got] == [(1, ""), (2, ""), (3, "email:2:8,ip:9:16"), (3, "email:2:8,ip:9:16"), (None, "phone:100001:100018")]
    assert [r.text for r in redact(frame).limit(3).collect()] == [None, "", "é ****** *******"]
    assert digest([]) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert with_pii(frame.limit(0)).count() == 0
