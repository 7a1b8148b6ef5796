import itertools
import math
import random
import zlib

import numpy as np

from gaitframe.llm import quality as Q


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    first = np.array([0, 1, 4, 10])
    unary, move = rng.normal(size=10) * 2, rng.normal(size=(2, 2))
    ahead, back = Q.messages(unary, first, move)
    got = Q._sigmoid(ahead + back)
    for a, b in zip(first[:-1], first[1:], strict=True):
        weights = np.zeros((b - a, 2))
        for labels in itertools.product((0, 1), repeat=int(b - a)):
            score = sum(unary[a + i] for i, y in enumerate(labels) if y) + sum(move[p, q] for p, q in zip(labels, labels[1:], strict=False))
            for i, y in enumerate(labels):
                weights[i, y] += math.exp(score)
        assert np.allclose(got[a:b], weights[:, 1] / weights.sum(axis=1))


def test_gradient_leads_to_the_maximum():
    """The fitted likelihood is not improved by any small step."""
    rng = np.random.default_rng(5)
    first = np.arange(0, 61, 5)
    x = np.concatenate([rng.normal(size=(60, 2)), np.ones((60, 1))], axis=1)
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)

    def likelihood(theta):
        move, total = theta[-4:].reshape(2, 2), 0.0
        for a, b in zip(first[:-1], first[1:], strict=True):
            u = s[a:b] @ theta[:-4]
            alpha = np.array([0.0, u[0]])
            for t in range(1, b - a):
                alpha = np.logaddexp.reduce(alpha[:, None] + move, axis=0) + np.array([0.0, u[t]])
            path = sum(u[t] * y[a + t] for t in range(b - a)) + sum(move[y[a + t - 1], y[a + t]] for t in range(1, b - a))
            total += path - np.logaddexp.reduce(alpha)
        return total / 60 - 1e-3 / 2 * (theta ** 2).sum()

    model = Q.fit(x, y, first, steps=3000, rate=0.02)
    s = (x - model.mean) / model.scale
    theta = np.concatenate([model.weight, model.move.ravel()])
    best = likelihood(theta)
    for i in range(len(theta)):
        for d in (-0.05, 0.05):
            moved = theta.copy()
            moved[i] += d
            assert likelihood(moved) <= best + 1e-6


def test_lines_are_seen_whole():
    raw = [b"Ab 1\n\nxx xx", b"", b"\n"]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    x, size, first = Q.observe(np.frombuffer(b"".join(raw), np.uint8), at)
    assert first.tolist() == [0, 3, 4, 6] and size.tolist() == [4, 1, 5, 1, 1, 1]
    assert x[0, 0] == x[0, 1] == x[0, 2] == 0.25 and x[1, Q.CLASSES + 2] == 1 and x[2, Q.CLASSES + 3] == 1
    assert (x[1, Q.OWN:2 * Q.OWN] == x[0, :Q.OWN]).all() and (x[1, 2 * Q.OWN:3 * Q.OWN] == x[2, :Q.OWN]).all()
    assert not x[3, Q.OWN:3 * Q.OWN].any()


def docs_and_labels(spark, n=600):
    rng = random.Random(4)
    rows, labels = [], []
    for d in range(n):
        bad = rng.random() < 0.25
        lines = [" ".join(f"word{rng.randrange(99)}" + ("$$%" if bad else "") for _ in range(rng.randint(3, 15))) for _ in range(rng.randint(1, 12))]
        rows.append((d, "\n".join(lines), 1.0))
        labels.append((d, int(not bad)))
    rows += [(9001, None, 1.0), (9002, "", 1.0), (None, "word1 word2 word3", 1.0), (9003, "a line of words\n" * 20000, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, label double"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, known = docs_and_labels(spark)
    got = Q.score(docs, Q.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.3, known[r.doc_id]) for r in got if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and sum(p == bool(y) for p, y in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[9001] == by_id[9002] and by_id[None] > 0.5


def test_empty(spark):
    docs, labels, _ = docs_and_labels(spark, 5)
    assert {r.score for r in Q.score(docs, Q.train(docs, labels.limit(0))).collect()} == {0.5}
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), labels)).count() == 0
    one = Q.train(docs, labels.withColumn("quality", Q.F.lit(1)))
    assert all(r.score > 0.5 for r in Q.score(docs.filter("doc_id < 5"), one).collect())


def test_training_reads_all_lines(spark):
    """Clean heads of 250 lines; what is bad comes after them."""
    clean, junk = "Some plain words, in order.\n", "|||| ### 99 !!!! ||\n"
    rows = [(i, clean * (250 + i % 7) + (junk * 300 if i % 2 else clean * 300)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    got = {r.doc_id: r.score for r in Q.score(spark.createDataFrame([(1, clean * 9), (2, junk * 9)], "doc_id long, text string"), model).collect()}
    assert got[1] > 0.6 and got[2] < 0.1


def test_other_columns_with_the_same_names_stay(spark):
    docs = spark.createDataFrame([(1, "A line.", 7.0, "x"), (None, None, None, None)], "doc_id long, text string, score double, label string")
    got = Q.score(docs, Q.untrained(), out="quality").collect()
    assert [(r.doc_id, r.score, r.label, r.quality) for r in got] == [(1, 7.0, "x", 0.5), (None, None, None, 0.5)]
