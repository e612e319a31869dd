import hashlib

from pyspark.sql import functions as F

from headwater.llm.secrets import candidates, features, labelled_findings, secrets, train


def test_forest_on_held_out_findings(spark):
    from pyspark.ml.feature import VectorAssembler

    from headwater.llm.secrets import NAMES

    rows = labelled_findings(spark, 9000).withColumn("n", F.monotonically_increasing_id()).orderBy(F.col("n").desc()).limit(2000)
    rows = rows.select("label", *features(F.col("value"), F.col("before"), F.col("after")))
    got = train(spark).transform(VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(rows))
    assert got.where("prediction = label").count() / got.count() > 0.95


def test_findings(spark):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [
        (1, f'thed thon token = "{key}" onr a'),
        (2, f"commit {key} of the tree, sha256:{hashlib.sha256(b'z').hexdigest()}"),
        (3, "Einungtzheitgeungverlichkeitenheiten der und schaeversteinheitlichung"),
        (4, "password = changeme_your_token_here and /usr/share/lib/python/site/packages"),
        (5, f"TOKEN = \"{key.upper()}\" x TOKEN = \"{key.upper()}\""),
        (6, None),
        (7, ""),
        (None, f"api_key: '{key}'"),
        (8, "word " * 60000 + f'secret="{key}"'),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("value", F.lit("v"))
    got = sorted(((r.doc_id or 0), r.start, r.length) for r in secrets(frame).collect())
    assert got == [(0, 10, 40), (1, 19, 40), (5, 9, 40), (8, 300008, 40)]
    assert secrets(frame.limit(0)).count() == 0
    assert {r.doc_id for r in candidates(frame).collect()} >= {1, 2, 3, 4, 5, 8}
