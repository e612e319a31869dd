"""Secret scanning: pattern candidates, and a random forest against false positives.

Candidates are long runs of key-like characters and values after words such as
``token``.  The forest sees a candidate's length and character classes, its
character transitions (changes of class, common letter pairs, repeats), how much
of it dictionary words cover, whether it stands in a path, and the words beside
it.  It is trained on findings that are labelled by construction: random values
in assignments, against identifiers, prose, paths, checksums and placeholders.

Everything is a DataFrame expression or Spark ML on the JVM; a text never leaves
its row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of candidates.
RUN = r"[A-Za-z0-9+/_=~-]{20,}+"
CUES = r"token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
ASSIGNED = rf"(?i)(?:{CUES})s?[\"']? {{0,3}}[:= ] {{0,3}}[\"']?([^\s\"'<>]{{8,}}+)"
DOUBTS = r"sha-?[0-9]|md5|checksum|digest|commit|revision|hash|uuid|guid|integrity|etag|version"
#: Fixed letter pairs and words that are common in prose and identifiers.
PAIRS = "th he in er an re on at en nd ti es or te ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch"
WORDS = (
    "the and for that with this from have not are was you your all can will get set new old test user name file path data list item value key index count size type node root main "
    "string number function return class object error message config default example sample change password admin server client request response header content length version "
    "build update delete create insert select table column order group time date year page link home local temp image text line word code source target input output open close "
    "start stop read write load save send check valid true false null none der die das und ein eine ist nicht mit auch von ung heit keit lich sch les des une est que pour dans "
    "sur avec para los las una con por del ment tion cion ando ado"
)
TREES, DEPTH, FINDINGS, SEED = 24, 6, 6000, 17
CUT = 0.5
NAMES = ("length", "digits", "upper", "lower", "marks", "distinct", "changes", "pairs", "repeats", "covered", "path", "cue", "doubt", "assigned", "quoted", "hexes")


def _kept(value: Column, keep: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, f"[{keep}]", ""))


def features(value: Column, before: Column, after: Column) -> list[Column]:
    """The forest's inputs, named by ``NAMES``, as doubles."""
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    low = F.lower(value)
    words = "|".join(sorted({w for w in WORDS.split() if len(w) > 2}, key=lambda w: (-len(w), w)))
    near = F.lower(before)
    columns = [
        F.length(value),
        _kept(value, "0-9") / size,
        _kept(value, "A-Z") / size,
        _kept(value, "a-z") / size,
        (F.length(value) - _kept(value, "A-Za-z0-9")) / size,
        F.size(F.array_distinct(F.split(value, ""))) / size,
        F.regexp_count(value, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])")) / size,
        F.regexp_count(low, F.lit("(?=" + "|".join(PAIRS.split()) + ")[a-z]")) / size,
        F.regexp_count(low, F.lit(r"(.)(?=\1)")) / size,
        (F.length(value) - F.length(F.regexp_replace(low, words, ""))) / size,
        (F.regexp_count(value, F.lit("/")) >= 3).cast("int") + near.rlike(r"(://|[/\\.])[^ ]*$").cast("int") + after.rlike(r"^\.[a-z]{2,4}\b").cast("int"),
        near.rlike(rf"({CUES})[^ ]? ?[^a-z]{{0,6}}$|({CUES})[^a-z]").cast("int"),
        F.substring(near, -16, 16).rlike(DOUBTS).cast("int") + low.rlike(r"example|xxxx|change|placeholder|your|1234567|abcdef").cast("int"),
        before.rlike(r"[:=] ?[\"']?$").cast("int"),
        (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("int"),
        low.rlike("^[0-9a-f]+$").cast("int"),
    ]
    return [c.cast("double").alias(n) for n, c in zip(NAMES, columns)]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``before, value, after, label``: findings whose label is known from how they were made."""
    i = F.col("id")
    digest = F.sha2(F.concat_ws(":", F.lit(str(SEED)), i.cast("string")), 256)
    dice = lambda k, m: F.pmod(F.xxhash64(F.lit(k), i), F.lit(m)).cast("int")
    letters = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")
    options = lambda *some: F.array(*[F.lit(x) for x in some])
    pick = lambda k, *some: F.element_at(options(*some), dice(k, len(some)) + 1)
    words = [w for w in WORDS.split() if len(w) > 2]
    joined = lambda k, m, by: F.concat_ws(by, *[F.element_at(options(*words), F.pmod(F.xxhash64(F.lit(k + j), i), F.lit(len(words))).cast("int") + 1) for j in range(m)])
    cue = F.concat(pick(1, "", "our ", "the ", "set "), pick(2, "token", "secret", "api_key", "password", "TOKEN", "auth token", "access-key", "private key"), pick(3, " = \"", "=", ": ", ": '", " = ", ":\""))
    plain = F.concat(joined(20, 2, " "), F.lit(" "))
    doubt = F.concat(pick(4, "sha256:", "commit ", "md5 ", "checksum = ", "uuid: ", "integrity=\"", "hash ", "revision "), F.lit(""))
    hexes = F.expr(f"substring(sha2(concat('{SEED}:', id), 256), 1, 24 + 8 * pmod(id, 6))")
    cases = [
        (cue, hexes, 1),
        (cue, F.upper(hexes), 1),
        (cue, letters, 1),
        (cue, F.concat(pick(5, "AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-"), letters), 1),
        (plain, F.concat(pick(5, "AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-"), letters), 1),
        (cue, F.concat(F.substring(letters, 1, 9), pick(6, "!", "#", "$", "%"), F.substring(letters, 10, 4)), 1),
        (doubt, hexes, 0),
        (plain, hexes, 0),
        (doubt, letters, 0),
        (plain, joined(40, 5, ""), 0),
        (plain, joined(50, 4, "_"), 0),
        (cue, joined(60, 3, "_"), 0),
        (cue, joined(60, 4, ""), 0),
        (cue, pick(7, "changeme", "your_token_here", "xxxxxxxxxxxxxxxxxxxxxxxx", "placeholder", "1234567890123456", "example-secret-value", "<redacted-value>"), 0),
        (F.concat(plain, F.lit("/usr/")), F.concat_ws("/", joined(70, 5, "/"), hexes), 0),
        (F.lit("https://host.example/"), F.concat(joined(80, 3, "/"), F.lit("/"), F.substring(letters, 1, 12)), 0),
        (plain, F.initcap(joined(90, 4, " ")), 0),
        (plain, F.repeat(pick(8, "=", "-", "_", "ab", "0"), 30), 0),
    ]
    rows = F.element_at(F.array(*[F.struct(b.alias("before"), F.regexp_replace(v, " ", "").alias("value"), F.lit(float(y)).alias("label")) for b, v, y in cases]), F.pmod(i, F.lit(len(cases))).cast("int") + 1)
    after = F.when(F.col("x.before").rlike("\"$"), "\"").when(F.col("x.before").rlike("'$"), "'").otherwise(" ")
    return spark.range(n).select(rows.alias("x")).select("x.before", "x.value", after.alias("after"), "x.label")


def train(spark: SparkSession) -> RandomForestClassificationModel:
    rows = labelled_findings(spark).select("label", *features(F.col("value"), F.col("before"), F.col("after")))
    rows = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(rows.coalesce(1))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def places(text: Column, value: Column) -> Column:
    """All places of a value in a text, overlapping ones too, from 1 in code points."""
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    empty = F.struct(F.array().cast("array<int>").alias("at"), F.lit(1).alias("next"))
    starts = F.aggregate(F.split(text, literal, -1), empty, lambda a, x: F.struct(F.concat(a["at"], F.array(a["next"])).alias("at"), (a["next"] + F.length(x)).alias("next")), lambda a: a["at"])
    return F.filter(starts, lambda p: (p > 1) | F.startswith(text, value))


def candidates(docs: DataFrame, every: bool = False) -> DataFrame:
    """``doc_id, start, value, before, after``: each candidate value of a text at its first place, or at every one (from 0, in code points)."""
    text = F.col("text").cast("string")
    found = F.array_distinct(F.concat(F.regexp_extract_all(F.col("t"), F.lit(RUN), F.lit(0)), F.regexp_extract_all(F.col("t"), F.lit(ASSIGNED), F.lit(1))))
    rows = docs.select(F.col("doc_id"), text.alias("t")).select("doc_id", "t", F.explode(found).alias("value"))
    at = F.explode(places(F.col("t"), F.col("value"))) if every else F.expr("locate(value, t)")
    rows = rows.select("doc_id", "t", "value", at.alias("at"))
    return rows.select("doc_id", (F.col("at") - 1).cast("long").alias("start"), "value", F.expr("substring(t, greatest(at - 40, 1), least(40, at - 1))").alias("before"), F.expr("substring(t, at + length(value), 8)").alias("after"))


def secrets(docs: DataFrame, cut: float = CUT, every: bool = False) -> DataFrame:
    """``doc_id, start, length, value, score``: the candidates of whole texts that the forest takes for secrets.

    Each value counts once in a row's text, at its first place; with ``every``
    each of its places is judged by what stands beside it there.  Null and empty texts have none;
    repeated rows give repeated findings; a null doc_id stays null; no rows give
    none.  Other columns are not read.
    """
    model = train(docs.sparkSession)
    rows = candidates(docs, every)
    rows = rows.select("doc_id", "start", "value", *features(F.col("value"), F.col("before"), F.col("after")))
    scored = model.transform(VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(rows))
    scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.where(F.col("score") >= cut).select("doc_id", "start", F.length("value").cast("long").alias("length"), "value", "score")
