import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tenure.models import classifiers
from tenure.models.bagging import FlatTree, bag_count, fit_bagged
from tenure.models.design import FEATURES


@pytest.fixture(scope="module")
def planted(spark):
    """A label that follows from two columns; the other two are noise, one of them text."""
    x = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).alias(f"x{i}") for i in range(3)]
    rows = spark.range(3000).select("id", *x, F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("text"))
    return rows.withColumn("label", ((F.col("x0") > 0.5) | (F.col("x1") > 0.8)).cast("int"))


INPUTS = ["x0", "x1", "x2", "text"]


def test_bags_are_poisson_and_follow_the_key(spark):
    rows = spark.range(20_000).select("id", bag_count(F.col("id"), 3).alias("n"), bag_count(F.col("id"), 4).alias("m"))
    mean, spread, same = rows.agg(F.avg("n"), F.var_pop("n"), F.corr("n", "m")).first()
    assert abs(mean - 1) < 0.03 and abs(spread - 1) < 0.05 and abs(same) < 0.03


def test_importance_stands_above_noise(planted):
    forest = fit_bagged(planted, INPUTS, "label", "id", trees=12, depth=5)
    found = {r["feature"]: r for r in forest.importance().collect()}
    assert set(found) == set(INPUTS)
    assert found["x0"]["importance"] > found["x1"]["importance"] > 0.02
    for noise in ("x2", "text"):
        assert abs(found[noise]["importance"]) < 0.02 and found[noise]["importance"] < found["x1"]["importance"] / 3
    votes = forest.out_of_bag_votes().select("label", "trees_out", "votes").collect()
    assert len(votes) == 3000 and 2.5 < np.mean([v["trees_out"] for v in votes]) < 6
    right = [(2 * v["votes"] > v["trees_out"]) == (v["label"] == 1) for v in votes if v["trees_out"]]
    assert np.mean(right) > 0.9


def test_flat_trees_predict_like_the_fitted_ones(planted):
    stages, _ = classifiers.fit_design(planted, INPUTS, one_hot=False)
    from pyspark.ml import PipelineModel

    ready = PipelineModel(stages).transform(planted.withColumn("label", F.when(F.col("text") == "g2", 1 - F.col("label")).otherwise(F.col("label"))))
    model = RandomForestClassifier(featuresCol=FEATURES, labelCol="label", numTrees=1, bootstrap=False, maxDepth=7, featureSubsetStrategy="all").fit(ready)
    tree = FlatTree(model.toDebugString)
    assert tree.categories and tree.used() >= {0, 3}
    rows = model.transform(ready).select(vector_to_array(FEATURES).alias("x"), "prediction").collect()
    assert (tree.predict(np.array([r["x"] for r in rows])) == np.array([r["prediction"] for r in rows])).all()


def test_importance_does_not_depend_on_partitions(planted, monkeypatch):
    from tenure.models import bagging

    monkeypatch.setattr(bagging, "SLICE_ROWS", 700)
    first, second = (
        sorted(map(tuple, fit_bagged(rows, ["x0", "x2"], "label", "id", trees=3, depth=3).importance().collect()))
        for rows in (planted.repartition(3), planted.repartition(3))
    )
    assert first == second


def test_empty_bags_and_missing_inputs(spark):
    rows = spark.createDataFrame([(i, float(i % 2), i % 2 if i else None) for i in range(40)] + [(99, None, 1)], "id int, x double, label int")
    forest = fit_bagged(rows, ["x"], "label", "id", trees=4, depth=2)
    assert forest.out_of_bag_votes().count() == 39
    assert [r["feature"] for r in forest.importance().collect()] == ["x"]
