"""The perceptron fitted by arrays: its gradient, its start and end beside Spark ML's, and its cases."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector

from gaitframe.operators import models as MO
from gaitframe.operators import perceptron as P


@pytest.mark.parametrize("sizes", [(5, 3), (5, 4, 3), (5, 4, 6, 3)])
def test_gradient_by_finite_differences(sizes):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 5)), rng.integers(0, 3, 30)
    w = rng.normal(size=sum((n + 1) * m for n, m in zip(sizes, sizes[1:])))
    _, gradient = P.loss_and_gradient(x, y, w, sizes)
    for i in range(len(w)):
        ends = [P.loss_and_gradient(x, y, w + e * (np.arange(len(w)) == i), sizes)[0] for e in (1e-6, -1e-6)]
        assert gradient[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-5)


def test_minimum_of_a_curved_valley():
    def valley(w):
        a, b = w
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert np.allclose(P.minimize(valley, np.array([-1.2, 1.0]), 200, 1e-9), 1.0, atol=1e-3)


def frame(spark, n):
    rng = np.random.default_rng(3)
    rows = [(("falling", "sitting", "walking")[i % 3], [float(rng.normal() + 1.2 * (i % 3)), float(rng.normal()), 5.0, float(rng.normal() + (i % 2))]) for i in range(n)]
    return spark.createDataFrame(rows, "label string, x array<double>").withColumn("features", array_to_vector("x")).drop("x")


def test_equals_spark_ml(spark, tmp_path):
    """Same start by the seed, one row counted once in every block, as low a loss, and a model that can be saved."""
    train = frame(spark, 1500)
    ours = MO.fit_perceptron(train, hidden=(8,))
    plain = MO._fit(train, MultilayerPerceptronClassifier(layers=[4, 8, 3], maxIter=100, seed=MO.SEED))
    assert isinstance(ours, PipelineModel) and ours.stages[2].getLayers() == [4, 8, 3] and ours.stages[2].numFeatures == 4

    def weights(classifier):
        return MO._fit(train, classifier(layers=[4, 8, 3], maxIter=0, seed=MO.SEED)).stages[2].weights.toArray()

    assert np.allclose(weights(P.ArrayPerceptron), weights(MultilayerPerceptronClassifier), atol=0)
    rows = ours.stages[1].transform(ours.stages[0].transform(train)).collect()
    x, y = np.array([r["_scaled"].toArray() for r in rows]), np.array([int(r["_label"]) for r in rows])
    low, high = (P.loss_and_gradient(x, y, m.stages[2].weights.toArray(), [4, 8, 3])[0] / len(y) for m in (ours, plain))
    assert low < high + 0.01
    scored = MO.predict(ours, train).select("label", "prediction", "probabilities").collect()
    own = [r["probabilities"][MO.label_order(ours).index(r["label"])] for r in scored]
    assert -np.log(own).mean() == pytest.approx(low, abs=1e-6)
    MO.save_model(ours, str(tmp_path / "m"))
    assert [r["prediction"] for r in MO.predict(MO.load_model(str(tmp_path / "m")), train).collect()] == [r["prediction"] for r in scored]


def test_sums_count_every_row_once(spark, monkeypatch):
    """Short blocks weigh by their rows; sums added up on the cluster are those of the driver."""
    monkeypatch.setattr(P, "BLOCK", 7)
    rng = np.random.default_rng(5)
    data = [([float(v) for v in rng.normal(size=3)], int(i % 2)) for i in range(100)]
    blocks = P.pack(spark.createDataFrame(data, "x array<double>, y long"))
    w = rng.normal(size=(3 + 1) * 2)
    want = P.loss_and_gradient(np.array([d[0] for d in data]), np.array([d[1] for d in data]), w, (3, 2))
    direct = P.mean_loss(blocks, (3, 2))(w)
    monkeypatch.setattr(P, "DIRECT", 2)
    for f, g in (direct, P.mean_loss(blocks, (3, 2))(w)):
        assert f == pytest.approx(want[0] / 100, rel=1e-5) and np.allclose(g, want[1] / 100, atol=1e-5)


def test_cases(spark):
    bad = spark.createDataFrame([("a", [1.0, float("nan")]), ("b", [0.0, 1.0])], "label string, x array<double>").withColumn("features", array_to_vector("x"))
    with pytest.raises(ValueError, match="no finite loss"):
        MO.fit_perceptron(bad, hidden=(2,))
    empty = spark.createDataFrame([], "x array<double>, y long")
    with pytest.raises(ValueError, match="no rows"):
        P.mean_loss(P.pack(empty), (2, 2))(np.zeros(6))
