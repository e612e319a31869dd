"""The stages against plain Python, on a fixture that holds a case for each."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from headwater.llm.decontaminate import words

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    sounds = ["th", "er", "an", "in", "on", "re", "st", "ou", "ti", "ha"]
    word = lambda: "".join(rng.choice(sounds) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    text = lambda k: "\n".join(line(rng.randint(8, 20)) for _ in range(k))
    items = [(i, text(3)) for i in range(5)]
    shared = line(60)
    docs = []
    for i in range(240):
        body = text(rng.randint(2, 8))
        if i % 6 == 0:
            body = " ".join(w + "***" for w in body.upper().split())
        elif i % 20 == 1:
            body = docs[i - 20][1] if i > 20 and (i // 20) % 2 else body
        elif i % 20 == 3:
            body += "\n" + shared
        elif i % 20 == 5:
            body += "\n" + items[i % 5][1]
        docs.append((i, body, "en", f"src{i % 3}", len(body)))
    docs += [(240, None, "en", "s", None), (241, "", "en", "s", 0)]
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 240)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, items


def test_each_stage_on_its_input(spark, folder):
    from test_linededup import by_hand
    from test_neardup import five

    root, docs, items = folder
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, spark.read.parquet(f"{root}/documents.parquet"), root)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    assert {r.doc_id for r in kept.collect()} >= {i for i, *_ in docs if i % 6 and i < 240} and not any(r.doc_id % 6 == 0 for r in kept.collect() if r.doc_id < 240)

    before = {r.doc_id: r.text for r in kept.collect()}
    lines = stages["line_dedup"](spark, kept, root).collect()
    want = by_hand(list(before.items()))
    assert {r.doc_id: r.text for r in lines} == {i: want.get((i, t), t) for i, t in before.items()}
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in lines)

    frame = spark.createDataFrame(lines, kept.schema)
    near = stages["near_dedup"](spark, frame, root).collect()
    sets = {r.doc_id: five(r.text) for r in lines}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    assert sorted(r.doc_id for r in near) == sorted(set(group.values()))

    clean = stages["decontaminate"](spark, spark.createDataFrame(near, kept.schema), root).collect()
    leaks = {r.doc_id for r in near if any(b" ".join(words(t)) in b" ".join(words(r.text)) for _, t in items)}
    assert leaks and {r.doc_id for r in clean} == {r.doc_id for r in near} - leaks

    packed = stages["packing"](spark, spark.createDataFrame(clean, kept.schema).coalesce(1), root).collect()
    t = tokenizers.Tokenizer.from_file(P.path(corpus_pipeline.TOKENIZER))
    ids_of = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in clean}
    for r in packed:
        assert r.ids_crc32 == zlib.crc32(np.array(ids_of[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in packed) == sum(map(len, ids_of.values()))


def test_odd_tables(spark, folder):
    """Null ids, repeated rows, columns with the operators' own names, and no rows."""
    root, docs, _ = folder
    rows = [(i, t, 0.25, 7, "kept", n) for i, t, _, _, n in docs[:40]] * 2 + [(None, docs[1][1], 0.5, 8, "kept", 0), (None, None, 0.5, 8, "kept", None)]
    kind = "doc_id long, text string, score double, predicted int, leaks string, n_chars long"
    frame = spark.createDataFrame(rows, kind).withColumn("n_removed", F.lit("x")).withColumn("Key", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, frame.limit(0), root)
        got = stage(spark, frame, root)
        assert none.count() == 0
        if name != "packing":
            assert got.columns == frame.columns and none.columns == frame.columns
            found = got.collect()
            assert found and {(r.score, r.predicted, r.leaks, r.n_removed) for r in found} <= {(0.25, 7, "kept", "x"), (0.5, 8, "kept", "x")}
            if name == "near_dedup":
                assert len(found) == len({r.doc_id for r in found}) < 41


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0
