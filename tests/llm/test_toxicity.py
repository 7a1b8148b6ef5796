import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitframe.llm import toxicity as X


def test_features_match_plain_words():
    texts = ["The cat  sat\non THE mat", "", "one", "a b a b", "É x É"]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    text, bucket = X.features(np.frombuffer(b"".join(raw), np.uint8), at)
    ids = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        want = [(x,) for x in w] + list(zip(w, w[1:], [1] * 99, strict=False)) + list(zip(w, w[2:], [2] * 99, strict=False))
        assert len(want) == (text == i).sum()
        ids.setdefault(i, set()).update(want)
    assert len(set(bucket[text == 3].tolist())) == len(ids[3])
    assert len(set(bucket.tolist())) == len(set().union(*ids.values()))


def test_fit_is_ftrl():
    """The vectorised update against the published one, coordinate by coordinate."""
    rng = random.Random(1)
    rows = [(np.array(sorted(rng.sample(range(40), 5)), np.uint32), int(rng.random() < 0.4)) for _ in range(200)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.7, 0.3
    z, n, zb, nb = [0.0] * 40, [0.0] * 40, 0.0, 0.0
    for _ in range(2):
        for x, y in rows:
            w = {i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2) for i in x.tolist()}
            b = -zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-(b + sum(w.values())))) - y
            for i in w:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i], n[i] = z[i] + g - s * w[i], n[i] + g * g
            s = (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha
            zb, nb = zb + g - s * b, nb + g * g
    model = X.fit(rows, passes=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    want = {i: (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2) for i in range(40) if abs(z[i]) > l1}
    assert dict(zip(model.bucket.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(want)


def docs_and_labels(spark, n=1500):
    rng = random.Random(9)
    rows, labels = [], []
    for d in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["Vile", "rotten", "FOUL"]))
        rows.append((d, " ".join(words), "x"))
        labels.append((d, None if d % 50 == 0 else int(toxic)))
    return (spark.createDataFrame(rows + [(9001, None, "x"), (9002, "", "x"), (None, "rotten foul vile", "x")], "doc_id long, text string, score string"),
            spark.createDataFrame(labels + labels[:5], "doc_id long, toxic int"), dict(labels))


def test_held_out_accuracy(spark):
    docs, labels, known = docs_and_labels(spark)
    model = X.train(docs, labels)
    got = X.score(docs.withColumnRenamed("score", "source"), model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.3, known[r.doc_id]) for r in got
            if known.get(r.doc_id) is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 200 and sum(p == bool(y) for p, y in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[None] > 0.9 and by_id[9001] == by_id[9002] < 0.3
    assert len(model.bucket) < 500


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels, _ = docs_and_labels(spark, 300)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    other = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.train(docs, labels, l1=1.0), X.train(docs, other, l1=1.0)
    assert a.bucket.tolist() == b.bucket.tolist() and a.weight.tolist() == b.weight.tolist()


def test_bounded_sample(spark):
    from gaitframe.llm.labels import training_rows
    docs, labels, _ = docs_and_labels(spark, 1000)
    n = training_rows(docs, labels, "toxic", 4, 2, 200).count()
    assert 140 <= n <= 260


def test_empty(spark):
    docs, labels, _ = docs_and_labels(spark, 5)
    model = X.train(docs.limit(0), labels)
    assert X.score(docs.drop("score").limit(0), model).count() == 0
    assert {r.score for r in X.score(docs.drop("score"), X.train(docs, labels.limit(0))).collect()} == {0.5}
    one = X.train(docs, labels.withColumn("toxic", F.lit(0)))
    assert all(r.score < 0.5 for r in X.score(docs.drop("score"), one).collect())
