import hashlib

from headwater.llm.queries import op3_secrets
from headwater.llm.secrets import candidates


def test_every_place_of_a_secret_is_found(spark, tmp_path):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [
        (1, f'TOKEN = "{key}" x TOKEN = "{key}"'),
        (2, f'commit {key} of the tree, then \U0001f511 token = "{key}"'),
        (3, "nothing here"),
        (4, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.start, r.length) for r in op3_secrets(spark, str(tmp_path)).collect())
    assert got == [(1, 9, 40), (1, 62, 40), (2, rows[1][1].rindex(key), 40)]


def test_places_as_by_hand(spark):
    odd = r'pa\E.(x)$1\Q[z'
    texts = [f"{odd} secret={odd} {odd}", "a" * 25 + " b " + "a" * 30, "ä password: 'Hunter+2+2!' Hunter+2+2!"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    values = {(r.doc_id, r.value) for r in candidates(frame).collect()}
    want = sorted((i, p, v) for i, v in values for p in range(len(texts[i])) if texts[i].startswith(v, p))
    assert (0, odd) in values and len(want) > len(values)
    assert sorted((r.doc_id, r.start, r.value) for r in candidates(frame, True).collect()) == want
