"""URL filtering by a tree of path templates.

A url's path is cut at slashes; query strings are no part of it.  The tree's
root is followed by the registered suffix, the host and then a level for each
segment, as deep as paths go.

1. Generalise.  Under a node, a segment's own branch is kept if it is a word
   that comes at ``SUPPORT`` or more of the node's pages; all others become the
   wildcard of their shape: ``{n}`` for numbers and hex, ``{x}`` for long tokens,
   ``{w}`` for other words, and ``{end}`` where the path ends.
2. Merge.  Branches of one node whose labelled share of blocked pages is not
   statistically different from the node's (two-proportion z below ``Z``, or no
   labels) become one branch ``{=}``; the others merge with those of the nearest
   quarter, ``{q0}`` to ``{q4}``.  A branch that merges with none keeps its name.
   What lies below merged branches is merged with them.
3. Decide.  Purity is smoothed from the top down: a node's estimate is
   (blocked + STRENGTH * what its parent hands down) / (labelled + STRENGTH),
   starting from the share over all labelled pages.  What a node hands down is
   its own estimate and the overall share, mixed by the part of its pages that
   is labelled: a branch is not judged by a few labelled siblings alone.  A page
   whose template's estimate is at least ``CUT`` is blocked.

A node of fewer than ``SUPPORT`` pages is not split further, so levels end with
the deepest path that so many pages share.  Pages that a rule decides are the
labelled ones; a table of further labels may be given.  The tree is built over
the distinct hosts and paths with their counts, by aggregates that add up a hot
host on the map side first; only these are carried from level to level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import saved

#: Fixed rules: verdict, host suffix, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT = 20
Z = 1.96
STRENGTH = 4.0
CUT = 0.5
#: Levels above the segments: registered suffix and host.
ABOVE = 2


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Number of the longest fitting rule (host and path together), null if none fits; of equal ones the first."""
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    found = F.lit(None).cast("int")
    for i in reversed(order):
        _, suffix, prefix = rules[i]
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def shape(segment: Column) -> Column:
    return F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$"), F.lit("{n}")).when(segment.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{n}")).when(F.length(segment) > 24, F.lit("{x}")).otherwise(F.lit("{w}"))


def _merged(known: Column, bad: Column, known_above: Column, bad_above: Column) -> Column:
    """The name of the merged branch that a branch with these labels belongs to."""
    pooled = (bad + bad_above) / (known + known_above)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / known + 1 / known_above))
    apart = F.abs(bad / known - bad_above / known_above)
    same = F.when(F.least(known, known_above) == 0, True).when(pooled.isin(0.0, 1.0), True).otherwise(apart < Z * spread)
    return F.when(same, "{=}").otherwise(F.concat(F.lit("{q"), F.round(4 * bad / known).cast("int").cast("string"), F.lit("}")))


def _level(state: DataFrame, nodes: DataFrame, level: int, overall: float) -> tuple[DataFrame, DataFrame]:
    """The next state and its nodes: each row of ``state`` one branch further down."""
    counts = [F.sum(c).alias(c) for c in ("n", "known", "bad")]
    raw = F.substring_index("host", ".", -2) if level == 0 else F.col("host") if level == 1 else F.coalesce(F.get("parts", F.lit(level - ABOVE)), F.lit(""))
    state = state.withColumn("branch", raw)
    kids = saved(state.groupBy("node", "branch").agg(*counts))
    if level < ABOVE:
        kids = kids.withColumn("name", F.col("branch"))
    else:
        kept = (F.col("n") >= SUPPORT) & (shape(F.col("branch")) == "{w}") & (F.col("branch") != "")
        kids = kids.withColumn("name", F.when(F.col("branch") == "", "{end}").when(kept, F.replace("branch", F.lit("{"), F.lit("%7B"))).otherwise(shape(F.col("branch"))))
    names = kids.groupBy("node", "name").agg(*counts).join(nodes, "node")
    group = F.col("name") if level < ABOVE else _merged(F.col("known"), F.col("bad"), F.col("known_above"), F.col("bad_above"))
    names = saved(names.withColumn("group", group))
    groups = names.groupBy("node", "group").agg(*counts, F.count("*").alias("members"), F.min("name").alias("only"), F.first("handed").alias("prior"))
    child = F.concat("node", F.lit("/"), F.when(F.col("members") == 1, F.col("only")).otherwise(F.col("group")))
    p, share = (F.col("bad") + STRENGTH * F.col("prior")) / (F.col("known") + STRENGTH), F.col("known") / F.col("n")
    groups = saved(groups.select("node", "group", child.alias("child"), "n", "known", "bad", p.alias("p"), (share * p + (1 - share) * overall).alias("handed")))
    # words are looked up by their branch, wildcards by the shape that the row itself has
    words = kids.where("branch <> '' AND name NOT LIKE '{%'").select("node", "branch", F.col("name").alias("word"))
    wild = F.when(F.col("branch") == "", "{end}").otherwise(shape(F.col("branch")))
    named = state.join(words, ["node", "branch"], "left").withColumn("name", F.coalesce("word", F.lit("") if level < ABOVE else wild))
    way = names.select("node", "name", "group").join(groups.select("node", "group", "child", "p", F.col("n").alias("pages")), ["node", "group"]).select("node", "name", "child", "p", "pages")
    ended = (F.col("branch") == "") | (F.col("pages") < SUPPORT) if level >= ABOVE else F.col("pages") < SUPPORT
    moved = named.join(way, ["node", "name"]).select("host", "path", "parts", "n", "known", "bad", F.col("child").alias("node"), "p", ended.alias("ended"))
    return saved(moved), groups.select(F.col("child").alias("node"), F.col("known").alias("known_above"), F.col("bad").alias("bad_above"), "handed")


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages`` (page_id, url).

    ``rule`` is the longest fitting rule's host and path, null if none fits,
    and its verdict then holds; otherwise the template's.  A null url or one
    without ``://`` has an empty host and path.  ``labels`` (page_id, blocked
    0/1) adds labelled pages; with none labelled every estimate is 0 and pages
    without a rule are allowed.  Repeated rows come as often as given, and
    count as often; no rows give none; other columns are not read.
    """
    url = F.col("url").cast("string")
    base = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    blocks = F.col("r").isin([i for i, (v, _, _) in enumerate(rules) if v == "block"])
    told = base.withColumn("blocked", F.when(F.col("r").isNotNull(), blocks.cast("int")))
    if labels is not None:
        more = labels.select(F.col("page_id"), F.col("blocked").cast("int").alias("told")).where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("told").alias("told"))
        told = told.join(more, "page_id", "left").withColumn("blocked", F.coalesce("blocked", "told")).drop("told")
    units = saved(told.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("blocked").alias("known"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad")))
    total = units.agg(F.coalesce(F.sum("known"), F.lit(0)).alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    overall = total.bad / total.known if total.known else 0.0
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    state = units.select("host", "path", parts.alias("parts"), "n", "known", "bad", F.lit("").alias("node"))
    nodes = base.sparkSession.range(1).select(F.lit("").alias("node"), F.lit(total.known).alias("known_above"), F.lit(total.bad).alias("bad_above"), F.lit(float(overall)).alias("handed"))
    judged, level = None, 0
    while True:
        moved, nodes = _level(state, nodes, level, float(overall))
        done = moved.where("ended").select("host", "path", F.col("node").alias("template"), F.col("p").alias("purity"))
        judged = done if judged is None else judged.union(done)
        state = moved.where("NOT ended").select("host", "path", "parts", "n", "known", "bad", "node")
        level += 1
        if state.isEmpty():
            break
    found = base.join(judged, ["host", "path"])
    own = F.when(F.col("purity") >= CUT, "block").otherwise("allow")
    of_rule = lambda values: F.element_at(F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(i), F.lit(v))]), F.col("r")) if rules else F.lit(None).cast("string")
    return found.select("page_id", "host", "path", of_rule([h + p for _, h, p in rules]).alias("rule"), F.coalesce(of_rule([v for v, _, _ in rules]), own).alias("verdict"), "template", "purity")
