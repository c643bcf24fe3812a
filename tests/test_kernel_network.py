import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tenure.models import classifiers, kernel, network
from tenure.operators.ranking import auc


@pytest.fixture(scope="module")
def circles(spark):
    """A disc inside a ring, on scales that differ, with some inputs missing."""
    rng = np.random.default_rng(3)
    n = 2000
    inside = rng.random(n) < 0.5
    radius, turn = np.where(inside, rng.random(n), 1.5 + rng.random(n)), rng.random(n) * 2 * np.pi
    rows = [(i, float(100 * radius[i] * np.cos(turn[i]) + 7), float(radius[i] * np.sin(turn[i])), bool(inside[i])) for i in range(n)]
    rows += [(n, None, 0.1, True)]
    return spark.createDataFrame(rows, "id long, a double, b double, y boolean").repartition(4).cache()


def score(df):
    return auc(df, "pred", "y").first()[0]


def test_fourier_features_estimate_the_kernel():
    w, b = kernel.frequencies(5, 3, 4000, 0.4)
    x, y = np.array([0.3, -0.2, 1.0]), np.array([0.1, 0.4, 0.2])
    made = [np.sqrt(2 / 4000) * np.cos(v @ w + b) for v in (x, y)]
    assert made[0] @ made[1] == pytest.approx(np.exp(-0.4 * np.sum((x - y) ** 2)), abs=0.04)


def test_radial_support_vectors_see_a_circle(circles, tmp_path):
    train, test = circles.where("id % 5 > 0"), circles.where("id % 5 = 0")
    linear = classifiers.predict_classifier(classifiers.fit_svc(train, ["a", "b"], "y", 30), test)
    model = classifiers.fit_svc(train, ["a", "b"], "y", 30, kernel="radial", components=64)
    radial = classifiers.predict_classifier(model, test)
    assert score(linear) < 0.65 and score(radial) > 0.97
    assert radial.where("pred is null").count() == 1
    model.write().save(str(tmp_path / "m"))
    again = classifiers.predict_classifier(PipelineModel.load(str(tmp_path / "m")), test)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, radial.collect()), key=str)


def test_gradients_are_derivatives():
    rng = np.random.default_rng(0)
    weights = [w + 0.05 for w in network.first_weights([3, 4, 5, 1], 2)]  # away from the kink at zero
    x, y = rng.normal(size=(20, 3)), (rng.random(20) < 0.5).astype(float)
    masks = [network.kept_units(np.arange(20), 1, k, n, 0.3) for k, n in enumerate((4, 5))]
    _, slope = network.gradient(x, y, weights, masks)
    for k, w in enumerate(weights):
        at = tuple(0 for _ in w.shape)
        moved = [v.copy() for v in weights]
        moved[k][at] += 1e-6
        change = (network.gradient(x, y, moved, masks)[0] - network.gradient(x, y, weights, masks)[0]) / 1e-6
        assert slope[k][at] == pytest.approx(change, abs=1e-3)
    drawn = network.kept_units(np.arange(5000), 0, 0, 8, 0.25)
    assert set(np.unique(drawn)) == {0.0, 1 / 0.75} and abs(drawn.mean() - 1) < 0.02


def test_network_learns_a_circle_and_repeats_itself(circles):
    train, test = circles.where("id % 5 > 0"), circles.where("id % 5 = 0")
    settings = {"hidden": (16, 8), "epochs": 8, "batches": 4, "rate": 0.02}
    first = network.fit_network(train, ["a", "b"], "y", "id", **settings)
    scored = first.predict(test)
    assert scored.columns == [*test.columns, "pred"] and scored.where("pred is null").count() == 1
    assert score(scored) > 0.97 and first.losses[-1] < first.losses[0] / 2
    again = network.fit_network(train.repartition(3), ["a", "b"], "y", "id", **settings)
    assert again.losses == pytest.approx(first.losses, rel=1e-6)
