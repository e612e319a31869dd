"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from headwater.llm.linededup import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from headwater.llm.pii import KINDS, joined, with_pii

    found = with_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii.*")
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from headwater.llm.secrets import secrets

    return secrets(table(spark, sf_dir, "documents"), every=True).select("doc_id", "start", "length", "score", F.sha2("value", 256).alias("value_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from headwater.llm.quality import classify, may_learn

    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (~may_learn(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from headwater.llm.decontaminate import leaked_pairs

    return leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from headwater.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from headwater.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from headwater.llm.maxscore import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from headwater.llm.lmscore import scores

    return scores(table(spark, sf_dir, "documents"), ["doc_id"])


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from headwater.llm.urlfilter import judge

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op8_lm_score": op8_lm_score,
    "op1_line_dedup": op1_line_dedup,
    "op2_pii": op2_pii,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_maxscore": op10_maxscore,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
}

#: Lines of documents and those of them that lie in a run which has occurred before: l(doc_id, line, x) and gone(doc_id, line).
#: Runs are maximal: islands of equal lines on each diagonal of two documents.  Within one document a run may not reach its repeat.
LINES_SQL = """
        l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
            FROM {documents} WHERE text IS NOT NULL),
        c AS (SELECT *, len(regexp_extract_all(x, '[^ \\x09-\\x0d]+')) AS words FROM l),
        p AS (
            SELECT *, row_number() OVER o AS place, sum(words) OVER o AS through
            FROM c WHERE words > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
        m AS (
            SELECT a.doc_id AS d1, b.doc_id AS d2, b.place - a.place AS shift, b.place, b.line, b.words,
                   b.place - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, b.place - a.place ORDER BY b.place) AS island
            FROM p a JOIN p b ON a.x = b.x AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.place < b.place)),
        runs AS (
            SELECT d1, d2, shift, min(place) AS p0, max(place) AS p1, min(line) AS l0, max(line) AS l1
            FROM m GROUP BY d1, d2, shift, island HAVING sum(words) >= 50),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(l0, l1 + 1)) AS line FROM (
                SELECT d2 AS doc_id, l0, l1 FROM runs WHERE d1 <> d2
                UNION ALL
                SELECT d2, a.line, b.line FROM runs JOIN p a ON a.doc_id = d2 AND a.place BETWEEN p0 AND p1
                JOIN p b ON b.doc_id = d2 AND b.place = least(a.place + shift - 1, p1)
                WHERE d1 = d2 AND b.through - a.through + a.words >= 50))"""

def urls_sql(segments: int = 6) -> str:
    """The template tree in SQL, a few tables for each level, to paths of ``segments`` segments (the test tables' have two)."""
    from headwater.llm import urlfilter as u

    order = sorted(u.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN {pick(v, h, p)}" for v, h, p in order) + " END"
    shape = "CASE WHEN regexp_matches(branch, '^[0-9]+(\\.[A-Za-z]{1,5})?$') OR regexp_matches(branch, '^[0-9a-fA-F-]{8,}$') THEN '{n}' WHEN length(branch) > 24 THEN '{x}' ELSE '{w}' END"
    base = f"""
        WITH a AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        b AS (SELECT *, {case(lambda v, h, p: f"'{h}{p}'")} AS rule, {case(lambda v, h, p: f"'{v}'")} AS ruled FROM a),
        units AS (SELECT host, path, count(*) AS n, count(ruled) AS known, count(*) FILTER (ruled = 'block') AS bad FROM b GROUP BY 1, 2),
        total AS (SELECT sum(known) AS known, sum(bad) AS bad, CASE WHEN sum(known) > 0 THEN sum(bad) / sum(known) ELSE 0 END AS overall FROM units),
        s0 AS (SELECT host, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, n, known, bad, '' AS node FROM units),
        v0 AS (SELECT '' AS node, known AS known_above, bad AS bad_above, CAST(overall AS DOUBLE) AS handed FROM total)"""
    counts = "CAST(sum(n) AS BIGINT) AS n, CAST(sum(known) AS BIGINT) AS known, CAST(sum(bad) AS BIGINT) AS bad"
    for k in range(u.ABOVE + segments + 1):
        raw = ("array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')", "host")[k] if k < u.ABOVE else f"coalesce(parts[{k - u.ABOVE + 1}], '')"
        name = "branch" if k < u.ABOVE else f"CASE WHEN branch = '' THEN '{{end}}' WHEN n >= {u.SUPPORT} AND {shape} = '{{w}}' THEN replace(branch, '{{', '%7B') ELSE {shape} END"
        pooled = "((bad + bad_above) / (known + known_above))"
        same = f"least(known, known_above) = 0 OR {pooled} IN (0, 1) OR abs(bad / known - bad_above / known_above) < {u.Z} * sqrt({pooled} * (1 - {pooled}) * (1 / known + 1 / known_above))"
        group = "name" if k < u.ABOVE else f"CASE WHEN {same} THEN '{{=}}' ELSE '{{q' || CAST(round(4 * bad / known) AS INTEGER) || '}}' END"
        ended = "g.n < 20" if k < u.ABOVE else "o.branch = '' OR g.n < 20"
        base += f""",
        o{k} AS (SELECT *, {raw} AS branch FROM s{k}),
        k{k} AS (SELECT *, {name} AS name FROM (SELECT node, branch, {counts} FROM o{k} GROUP BY 1, 2)),
        m{k} AS (SELECT *, {group} AS grp FROM (SELECT node, name, {counts} FROM k{k} GROUP BY 1, 2) JOIN v{k} USING (node)),
        g{k} AS (
            SELECT *, (bad + {u.STRENGTH} * prior) / (known + {u.STRENGTH}) AS p, node || '/' || CASE WHEN members = 1 THEN only_ ELSE grp END AS child
            FROM (SELECT node, grp, {counts}, count(*) AS members, min(name) AS only_, min(handed) AS prior FROM m{k} GROUP BY 1, 2)),
        t{k} AS MATERIALIZED (
            SELECT o.host, o.path, o.parts, o.n, o.known, o.bad, g.child AS node, g.p, {ended} AS ended
            FROM o{k} o JOIN k{k} k USING (node, branch) JOIN m{k} m ON m.node = k.node AND m.name = k.name JOIN g{k} g ON g.node = m.node AND g.grp = m.grp),
        s{k + 1} AS (SELECT host, path, parts, n, known, bad, node FROM t{k} WHERE NOT ended),
        v{k + 1} AS MATERIALIZED (SELECT child AS node, known AS known_above, bad AS bad_above, known / n * p + (1 - known / n) * (SELECT overall FROM total) AS handed FROM g{k})"""
    last = " UNION ALL ".join(f"SELECT host, path, p FROM t{k} WHERE ended" for k in range(u.ABOVE + segments + 1))
    return f"""{base},
        done AS ({last})
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN p >= {u.CUT} THEN 'block' ELSE 'allow' END) AS verdict FROM b JOIN done USING (host, path)"""


ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH {LINES_SQL.format(documents="documents")}
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
               coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
        FROM documents d LEFT JOIN (
            SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.line) FILTER (gone.line IS NULL) AS text,
                   count(*) AS n_lines, count(gone.line) AS n_removed
            FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.line = gone.line
            GROUP BY l.doc_id) k ON d.doc_id = k.doc_id""",
    "op9_url_filter": urls_sql(),
    "op10_maxscore": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS t
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        e AS (SELECT r, vec_id, unnest(t) AS x, generate_subscripts(t, 1) AS k FROM v),
        s AS (
            SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM e q JOIN e c ON q.k = c.k AND q.r <> c.r
            WHERE q.vec_id % 50 = 0 GROUP BY q.r, c.r, q.vec_id, c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
}
