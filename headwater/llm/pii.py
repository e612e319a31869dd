"""Personal data: fixed patterns, and further spans chosen by boosted trees.

The base spans are the matches of four fixed patterns that pass their checks;
they always stay.  High-recall generators then propose further spans: spelled-out
mail and network addresses, digit groups of 7 to 19 digits, and parts of base
matches that failed because they ran into other digits.  Proposals overlap each
other freely.  Gradient-boosted trees over format and context features give each
a probability, and those at their kind's calibrated threshold are added, most
probable first, if they overlap no span taken before; base spans are taken first.

The trees are trained here on findings that are labelled by construction: formats
filled with digits and put into contexts with and without cues.  A share of them
is held out; a kind's threshold is the least that keeps its held-out precision at
``PRECISION``, and ``FLOOR`` at least.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
PRECISION, FLOOR = 0.99, 0.9
ROUNDS, DEPTH, RATE = 40, 3, 0.3
SAMPLES, SEED = 6000, 11

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GROUPS = re.compile(r"(?<![0-9A-Za-z.,+])\(?[0-9](?:[ ().\-/]{0,3}[0-9]){6,18}(?![0-9A-Za-z]|[.,][0-9])")
_SPELLED = re.compile(r"(?i)(?<![\w.+-])[a-z0-9][\w.+-]{0,40} ?(?:@|\(at\)|\[at\]| at ) ?[a-z0-9-]{1,40}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[a-z]{2,12}){1,3}(?!\w)")
_DEFANGED = re.compile(r"(?<![0-9.\[(\]])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9\[(])")
#: Fixed cue words, lower case.
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "dial", "whatsapp"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "pan"),
    "email": ("email", "mail", "contact", "write", "reach", "e-mail"),
    "other": ("order", "invoice", "version", "page", "id", "ref", "isbn", "lines", "total", "date", "no", "serial", "build"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns' matches that pass, by kind and start."""
    out: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            done = m.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() <= 37 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Spans of the high-recall generators; a digit group is proposed both as a card and as a phone."""
    out = []
    if "@" in text or "dot" in text or "DOT" in text or "(at)" in text or "[at]" in text:
        out += [(0, *m.span()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        for m in _GROUPS.finditer(text):
            out += [(2, *m.span()), (3, *m.span())]
        if "[" in text or "(" in text:
            out += [(1, *m.span()) for m in _DEFANGED.finditer(text)]
        for m in _PHONE.finditer(text) if "+" in text else ():
            if not 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out += [(3, m.start(), end) for end in _ends(text, m.start(), m.end(), 8, 15)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() > 19 and not (16 <= len(d := re.sub("[ -]", "", m.group()[:40])) <= 19 and m.end() - m.start() <= 37 and luhn(d)):
                for g in re.finditer("[0-9]+", m.group()):
                    out += [(2, m.start() + g.start(), end) for end in _ends(text, m.start() + g.start(), m.end(), 15, 19) if luhn(re.sub("[ -]", "", text[m.start() + g.start() : end]))]
    return out


def _ends(text: str, start: int, stop: int, least: int, most: int) -> list[int]:
    """Ends of digit groups at which a span from ``start`` has between ``least`` and ``most`` digits."""
    out, digits = [], 0
    for i in range(start, stop):
        digits += "0" <= text[i] <= "9"
        if digits > most:
            break
        if digits >= least and "0" <= text[i] <= "9" and not (i + 1 < stop and "0" <= text[i + 1] <= "9"):
            out.append(i + 1)
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a span."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    groups = re.findall("[0-9]+", span)
    before = text[max(0, start - 40) : start].lower()
    words = re.findall(r"[a-z-]+", before)[-4:]
    cue = [float(any(w == c or w == c + "s" for w in words for c in CUES[k])) for k in ("phone", "card", "email", "other")]
    sizes = [len(g) for g in groups]
    return [
        float(kind), float(len(span)), float(len(digits)), float(len(groups)), float(max(sizes, default=0)), float(min(sizes, default=0)),
        float(len(digits) >= 12 and luhn(digits)), float("(" in span), float("-" in span), float("." in span), float(" " in span), float("/" in span),
        float(sizes == [3, 3, 4]), float(len(groups) >= 3 and sizes[:-1] == [4] * (len(groups) - 1)), float("@" in span), float(bool(re.search(r"(?i)\bat\b", span))),
        float(bool(re.search(r"(?i)\bdot\b", span))), float(bool(re.search(r"(?i)\.(com|org|net|edu|de|fr|es|io)$|dot\)? ?(com|org|net|edu|de|fr|es|io)$|dot\] ?(com|org|net)$", span))),
        *cue, float(digits[:1] in ("3", "4", "5", "6")), float(before[-1:].isspace() or before == ""),
        float(span[:1] == "+"), float(len(digits) == 10 + len(groups[0]) and sizes[1:] == [3, 3, 4]) if groups else 0.0, float("[" in span), float(all(int(g) <= 255 for g in groups[:4]) and sizes == [len(g) for g in groups[:4]]),
        float(bool(re.match(r"[ ,;]*[0-9]{1,3}\.[0-9]", text[end : end + 8]))), float(bool(re.match(r"[ .-]?[0-9(]", text[end : end + 2]))),
    ]


@dataclass
class Trees:
    """Sums of small regression trees; node k has children 2k+1 and 2k+2."""

    feature: np.ndarray  # rounds x nodes, -1 at leaves
    cut: np.ndarray
    value: np.ndarray
    threshold: dict[int, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]))
            total += value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting for the logistic loss, by exact splits with Newton leaf values."""
    nodes = 2 ** (DEPTH + 1) - 1
    trees = Trees(np.full((ROUNDS, nodes), -1), np.zeros((ROUNDS, nodes)), np.zeros((ROUNDS, nodes)), {})
    margin = np.zeros(len(x))
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-6
        where = np.zeros(len(x), int)
        for k in range(nodes):
            own = np.flatnonzero(where == k)
            if not len(own):
                continue
            trees.value[t, k] = RATE * g[own].sum() / (h[own].sum() + 1)
            if k >= nodes // 2 or len(own) < 10:
                continue
            best = (1e-6, -1, 0.0)
            for f in range(x.shape[1]):
                order = own[np.argsort(x[own, f], kind="stable")]
                v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
                ends = np.flatnonzero(v[1:] != v[:-1])
                if len(ends):
                    gain = cg[ends] ** 2 / (ch[ends] + 1) + (cg[-1] - cg[ends]) ** 2 / (ch[-1] - ch[ends] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), f, float(v[ends[i]] + v[ends[i] + 1]) / 2)
            if best[1] >= 0:
                trees.feature[t, k], trees.cut[t, k] = best[1:]
                where[own] = 2 * k + 1 + (x[own, best[1]] > best[2])
        margin += trees.value[t, where]
    return trees


def labelled_findings(n: int = SAMPLES, seed: int = SEED) -> list[tuple[str, int, int, int, int]]:
    """(text, kind, start, end, label) of spans whose label is known from how they were made."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda some: some[int(rng.integers(len(some)))]
    word = lambda: "".join(pick("abcdefghijklmnoprstuvw") for _ in range(int(rng.integers(2, 9))))

    def card(size: int) -> str:
        body = pick("3456") + num(size - 2)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def failing(size: int) -> str:
        c = card(size)
        return c[:-1] + str((int(c[-1]) + int(rng.integers(1, 10))) % 10)

    fours = lambda s, by: by.join(s[i : i + 4] for i in range(0, len(s), 4))
    amex = lambda s, by: by.join((s[:4], s[4:10], s[10:]))
    makers = [
        (0, 1, "email", lambda: f"{word()}.{word()} (at) {word()} (dot) {pick(('com', 'org', 'net'))}"),
        (0, 1, "email", lambda: f"{word()}{num(2)} [at] {word()} [dot] {pick(('com', 'org', 'net'))}"),
        (0, 1, "email", lambda: f"{word()} at {word()} dot {pick(('com', 'org', 'net', 'de'))}"),
        (0, 0, "", lambda: f"{word()} at {word()}. {word()}"),
        (0, 0, "", lambda: f"{word()} at {word()} dot {word()}"),
        (0, 0, "other", lambda: f"{word()}@{word()}. {word()}"),
        (2, 1, "card", lambda: amex(card(15), pick((" ", "-")))),
        (2, 1, "card", lambda: fours(card(16), pick((".", "/", " - ")))),
        (2, 0, pick(("", "card", "other")), lambda: failing(int(rng.integers(13, 20)))),
        (2, 0, "other", lambda: num(int(rng.integers(7, 13)))),
        (2, 0, "", lambda: f"{num(3)}-{num(3)}-{num(4)}"),
        (2, 0, "phone", lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        (2, 0, "other", lambda: fours(failing(16), " ")),
        (3, 1, "phone", lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        (3, 1, "phone", lambda: pick(("-", " ", ".")).join((num(3), num(3), num(4)))),
        (3, 1, "phone", lambda: f"0{num(3)} {num(7)}"),
        (3, 1, "", lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        (3, 1, "phone", lambda: f"+{pick((num(1), num(2)))} ({num(3)}) {num(3)}-{num(4)}"),
        (3, 1, "", lambda: f"+{pick((num(1), num(2)))}{pick((' ', '-', '.'))}{pick((' ', '-', '.')).join((num(3), num(3), num(4)))}"),
        (3, 0, "", lambda: f"+{num(int(rng.integers(8, 15)))} {num(int(rng.integers(1, 4)))}"),
        (3, 0, "other", lambda: f"+{num(2)} {num(3)} {num(2)}"),
        (1, 1, "", lambda: pick(("[.]", "(.)", "[dot]", "(dot)")).join(str(int(rng.integers(0, 256))) for _ in range(4))),
        (1, 0, "", lambda: pick(("[.]", "(.)", "[dot]")).join([str(int(rng.integers(256, 999))), *(num(3) for _ in range(3))])),
        (2, 1, "", lambda: fours(card(16), pick((" ", "-")))),
        (2, 0, "other", lambda: " ".join(num(int(rng.integers(1, 4))) for _ in range(7))),
        (3, 0, "", lambda: num(int(rng.integers(7, 20)))),
        (3, 0, "other", lambda: num(int(rng.integers(7, 20)))),
        (3, 0, "other", lambda: f"20{num(2)}-{num(2)}-{num(2)}"),
        (3, 0, "", lambda: f"{num(2)}/{num(2)}/20{num(2)}"),
        (3, 0, "card", lambda: fours(card(16), pick((" ", "-")))),
        (3, 0, "", lambda: fours(failing(16), pick((" ", "-")))),
        (3, 0, "other", lambda: "-".join((num(3), num(1), num(4), num(4), num(1)))),
        (3, 0, "", lambda: " ".join(num(int(rng.integers(1, 6))) for _ in range(4))),
        (3, 0, "", lambda: ".".join(num(int(rng.integers(1, 4))) for _ in range(4))),
    ]
    makers += [m for m in makers if m[0] == 1] * 3  # the kind with the fewest
    out = []
    for i in range(n):
        kind, label, cue, make = makers[i % len(makers)]
        span = make()
        lead = " ".join(word() for _ in range(int(rng.integers(0, 4))))
        if cue and rng.random() < 0.8:
            lead += " " + pick(CUES[cue]) + pick((" ", ": ", " is ", " "))
        tail = pick((f" {int(rng.integers(1, 256))}.{num(2)}.{num(2)}.{num(1)}", f" {num(4)} {word()}")) if label and kind > 1 and rng.random() < 0.3 else pick((" ", ". ", ", ")) + word()
        text = f"{lead} ".lstrip() + span + tail
        start = text.index(span)
        out.append((text, kind, start, start + len(span), label))
    return out


@lru_cache(1)
def trained() -> Trees:
    rows = labelled_findings()
    x = np.array([features(*r[:4]) for r in rows])
    y, kind = np.array([r[4] for r in rows], float), x[:, 0].astype(int)
    held = np.random.default_rng(SEED + 1).random(len(rows)) < 0.3
    trees = boost(x[~held], y[~held])
    p = trees.probability(x[held])
    for k in range(len(KINDS)):
        own = kind[held] == k
        q, t = p[own], y[held][own]
        fine = [c for c in np.unique(q) if c >= FLOOR and t[q >= c].mean() >= PRECISION]
        trees.threshold[k] = min(fine, default=2.0)
    return trees


def all_spans(text: str, trees: Trees) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and these with the added ones; both by kind and start."""
    base = base_spans(text)
    new = _apart(sorted(set(proposals(text))), base)  # what overlaps a base span could never be added
    if not new:
        return base, base
    p = trees.probability(np.array([features(text, *s) for s in new]))
    taken: list[tuple[int, int, int]] = []
    edges: list[tuple[int, int]] = []  # of spans taken, which lie apart, in order
    for i in np.lexsort(([s[1] for s in new], -p)).tolist():
        if p[i] >= trees.threshold[new[i][0]]:
            _, start, end = new[i]
            k = bisect_left(edges, (end, 0))
            if not k or edges[k - 1][1] <= start:
                edges.insert(k, (start, end))
                taken.append(new[i])
    return base, sorted([*base, *taken]) if taken else base


def _apart(spans: list[tuple], base: list[tuple]) -> list[tuple]:
    """Of ``spans`` those that overlap no base span."""
    marks = sorted((b, e) for _, b, e in base)
    reach, far = [], 0
    for _, e in marks:
        far = max(far, e)
        reach.append(far)
    starts = [b for b, _ in marks]
    return [s for s in spans if not (k := bisect_left(starts, s[2])) or reach[k - 1] <= s[1]]


SPANS = "struct<base: array<struct<kind: string, start: long, end: long>>, spans: array<struct<kind: string, start: long, end: long>>>"


def pii(spark, text: Column) -> Column:
    """``base`` and ``spans`` of a text, arrays of kind, start and end in code points; null is an empty text."""
    held = spark.sparkContext.broadcast(trained())
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kind = pa.struct([("base", pa.list_(one)), ("spans", pa.list_(one))])

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            both = all_spans(t.as_py() or "", held.value)
            out.append({n: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans] for n, spans in zip(("base", "spans"), both)})
        return pa.array(out, kind)

    return found.asNondeterministic()(text.cast("string"))  # so that the optimiser runs it once


def with_pii(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (text among them) and ``pii``, the struct of base and of all spans of the whole text.

    Null and empty texts have none; a row's spans depend on its text alone, so
    repeated rows get equal ones; no rows give none.  A column ``pii`` is replaced.
    """
    return docs.withColumn("pii", pii(docs.sparkSession, F.col("text")))


def redact(docs: DataFrame, mask: str = "*") -> DataFrame:
    """``docs`` with each character of each span in ``text`` replaced by ``mask``; null texts stay null."""
    held = docs.sparkSession.sparkContext.broadcast(trained())

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py()
            if text:
                chars = list(text)
                for _, s, e in all_spans(text, held.value)[1]:
                    chars[s:e] = mask * (e - s)
                text = "".join(chars)
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn("text", masked(F.col("text").cast("string")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: list[tuple[int, int, int]]) -> str:
    """What ``sha2(joined(spans))`` gives, in Python, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
