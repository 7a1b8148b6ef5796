"""The balanced network: its gradient, and what balance does for a rare class."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gaitframe.operators import metrics as M
from gaitframe.operators import models as MO
from gaitframe.operators import network as N


@pytest.mark.parametrize("gamma", [0.0, 1.0, 2.0])
def test_gradient_by_finite_differences(gamma):
    rng = np.random.default_rng(1)
    x, y, weight = rng.normal(size=(30, 5)), rng.integers(0, 3, 30), np.array([0.5, 1.0, 3.0])
    layers = [rng.normal(size=s) for s in ((5, 4), (4,), (4, 3), (3,))]
    _, gradient = N.loss_and_gradient(x, y, weight, layers, gamma)
    for k, p in enumerate(layers):
        for i in np.ndindex(p.shape):
            ends = []
            for e in (1e-6, -1e-6):
                moved = [q.copy() for q in layers]
                moved[k][i] += e
                ends.append(N.loss_and_gradient(x, y, weight, moved, gamma)[0])
            assert gradient[k][i] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-5)


def frame(spark, n, seed):
    """A rare class inside the spread of a common one."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        rare = i % 25 == 0
        rows.append((i, "falling" if rare else "walking" if i % 2 else "sitting",
                     [float(rng.normal() + (1.6 if rare else 0.0)), float(rng.normal() + 3 * (i % 2)), 5.0, float(rng.normal())]))
    return spark.createDataFrame(rows, "k int, label string, x array<double>").withColumn("features", array_to_vector("x")).drop("x")


def test_balance_finds_rare_falls(spark):
    train, test = frame(spark, 2000, 1).repartition(4), frame(spark, 2000, 2)
    scored = N.predict_network(N.fit_network(train, hidden=8, rounds=80, rate=0.05), test)
    row, plain = M.evaluate(scored).first(), M.evaluate(MO.predict(MO.fit_perceptron(train, hidden=(8,)), test)).first()
    assert row.fall_recall > 0.6 > plain.fall_recall and row.accuracy > 0.6
    again = N.fit_network(train, hidden=8, rounds=5), N.fit_network(train.repartition(2), hidden=8, rounds=5)
    assert all(np.allclose(a, b) for a, b in zip(*(n.layers for n in again), strict=True))
    assert scored.columns == ["k", "label", "probabilities", "prediction"]


def test_cases(spark):
    rows = [(1, "a", [1.0, float("nan")]), (2, "b", [0.0, 0.0]), (3, None, [9.0, 9.0])] * 4
    df = spark.createDataFrame(rows, "k int, label string, x array<double>").withColumn("features", array_to_vector("x")).drop("x")
    net = N.fit_network(df, hidden=2, rounds=30, rate=0.1)
    got = N.predict_network(net, df).filter("label IS NOT NULL").collect()
    assert net.labels == ["a", "b"] and all(r.prediction == r.label for r in got)
    assert N.predict_network(net, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        N.fit_network(df.filter(F.lit(False)))
