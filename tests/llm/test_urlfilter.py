import math
import re
from collections import defaultdict

from headwater.llm.urlfilter import CUT, RULES, STRENGTH, SUPPORT, Z, judge


def split_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [(len(h + p), -i) for i, (_, h, p) in enumerate(RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return -max(fits)[1] if fits else None


def kind(s):
    if re.search(r"^[0-9]+(\.[A-Za-z]{1,5})?$", s) or re.search(r"^[0-9a-fA-F-]{8,}$", s):
        return "{n}"
    return "{x}" if len(s) > 24 else "{w}"


def grow(units, branch, prior, overall, level, out):
    """Judge the units (host, path, parts, n, known, bad) of one node; ``prior`` has its labelled and blocked pages, what it hands down and its name."""
    known, bad, handed, name = prior
    raw = defaultdict(list)
    for u in units:
        raw[branch(u)].append(u)
    named = defaultdict(list)
    for s, some in raw.items():
        n = sum(u[3] for u in some)
        named[s if level < 2 else "{end}" if not s else s.replace("{", "%7B") if n >= SUPPORT and kind(s) == "{w}" else kind(s)] += some
    groups = defaultdict(dict)
    for s, some in named.items():
        k, b = sum(u[4] for u in some), sum(u[5] for u in some)
        pooled = (b + bad) / (k + known) if k + known else 0
        same = min(k, known) == 0 or pooled in (0, 1) or abs(b / k - bad / known) < Z * math.sqrt(pooled * (1 - pooled) * (1 / k + 1 / known))
        groups[s if level < 2 else "{=}" if same else "{q%d}" % math.floor(4 * b / k + 0.5)][s] = some
    for g, parts in groups.items():
        some = [u for x in parts.values() for u in x]
        n, k, b = (sum(u[c] for u in some) for c in (3, 4, 5))
        p = (b + STRENGTH * handed) / (k + STRENGTH)
        child = f"{name}/{next(iter(parts)) if len(parts) == 1 else g}"
        further = [u for u in some if n >= SUPPORT and (level < 2 or len(u[2]) > level - 2)]
        for u in some:
            if u not in further:
                out[u[:2]] = (child, p)
        if further:
            grow(further, (lambda u: u[0]) if level == 0 else lambda u: u[2][level - 1] if len(u[2]) > level - 1 else "", (k, b, k / n * p + (1 - k / n) * overall, child), overall, level + 1, out)


def by_hand(rows):
    pages, units = [], defaultdict(lambda: [0, 0, 0])
    for i, url in rows:
        host, path = split_url(url)
        r = rule(host, path)
        pages.append((i, host, path, r))
        t = units[host, path]
        t[0] += 1
        t[1] += r is not None
        t[2] += r is not None and RULES[r][0] == "block"
    every = [(h, p, tuple(x for x in p.split("/") if x), *t) for (h, p), t in units.items()]
    known, bad = sum(u[4] for u in every), sum(u[5] for u in every)
    overall, out = bad / known if known else 0.0, {}
    grow(every, lambda u: ".".join(u[0].split(".")[-2:]), (known, bad, overall, ""), overall, 0, out)
    return [(i or 0, h, p, None if r is None else RULES[r][1] + RULES[r][2], RULES[r][0] if r is not None else "block" if out[h, p][1] >= CUT else "allow", out[h, p][0]) for i, h, p, r in pages]


def test_against_brute_force(spark):
    rows = []
    for i in range(900):
        host = ("a.example.net", "example.net", "B.Example.com", "x.example.org", "notexample.net", "y.test")[i % 6]
        path = (f"/en/{i}", f"/de/{i}.html", f"/fr/post/{i}", "/", "", f"/shop/{'ab' * 20}/{i}", "/de/about/us/now")[i % 7]
        rows.append((i, f"https://{host}{path}" + ("", "?q=://z", "#x/y")[i % 3]))
    for i in range(700):  # ten segments and more, labelled by the last of them
        deep = "/".join(f"s{k}" for k in range(9)) + ("/good/", "/bad/", "/other/")[i % 3]
        rows.append((2000 + i, f"http://{('deep.net', 'deep.example.com', 'deep.test')[i % 3]}/{'en/' * (i % 2)}{deep}{i}"))
    rows += [(1000, None), (1001, ""), (1002, "no scheme/x"), (1003, "a://b://c/d"), (None, "http://net/x"), (5, rows[5][1]), (1004, "http://net?x"), (1005, "://\n/a\nb"), (1006, "http://h.net/" + "z/" * 20000)]
    frame = spark.createDataFrame([(i, u, "n") for i, u in rows], "page_id long, url string, node string")
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict, r.template) for r in judge(frame).collect())
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(by_hand(rows), key=key)


def test_labels_and_no_rows(spark):
    frame = spark.createDataFrame([(i, f"http://q.test/bad/{i}" if i % 2 else f"http://q.test/good/{i}") for i in range(200)], "page_id long, url string")
    told = spark.createDataFrame([(i, i % 2) for i in range(100)], "page_id long, blocked int")
    verdicts = {(r.page_id % 2, r.verdict) for r in judge(frame, labels=told).collect()}
    assert verdicts == {(1, "block"), (0, "allow")}
    assert {r.verdict for r in judge(frame).collect()} == {"allow"}
    assert judge(frame.limit(0)).count() == 0
