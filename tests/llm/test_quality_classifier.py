import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from plotyard.llm.quality_classifier import WIDTH, featurize, keep_quality, score_quality, text_features


def _tables(spark, n=1500):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    good = lambda: " ".join(word() for _ in range(60)).capitalize() + "."
    bad = lambda: rng.choice([" | ", "### ", "!! "]).join(word().upper() for _ in range(60))
    rows = [(i, good() if i % 5 else bad(), "en", "s0", 1.0) for i in range(n)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, n, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, _, docs, labels = _tables(spark)
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [(r.score >= 0.3) == (r.doc_id % 5 != 0) for r in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_decide_nothing(spark):
    _, labels, docs, given = _tables(spark, 400)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    other = spark.createDataFrame(turned, "doc_id long, quality int, toxic int")
    a = {r.doc_id: r.score for r in score_quality(docs, given).collect()}
    b = {r.doc_id: r.score for r in score_quality(docs, other).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 200_000), (3, "\n\n \t")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = labels.limit(0)
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).collect() == []
    assert featurize(docs.limit(0)).count() == 0
    assert text_features("a b").shape == (WIDTH,) and np.isfinite(text_features("😀\n" * 9)).all()


def test_the_filter_keeps_rows_as_they_are(spark):
    rows, labels, docs, given = _tables(spark, 600)
    odd = docs.select("doc_id", "text", F.lit(1).alias("score"), F.lit("x").alias("features"), F.lit(True).alias("held_out"))
    odd = odd.unionByName(odd.filter("doc_id = 7")).unionByName(odd.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.unionByName(odd.filter("doc_id = 9").withColumn("text", F.lit(None).cast("string")))
    kept = keep_quality(odd, given)
    assert kept.columns == odd.columns
    scored = [(r.doc_id, r.score) for r in score_quality(odd, given).collect()]
    key = lambda i: (i is not None, i or 0)
    assert len(scored) == odd.count()
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted((i for i, s in scored if s >= 0.3), key=key)
    assert keep_quality(odd.limit(0), given).collect() == []
