import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tenure.models import classifiers, design, forest
from tenure.models.design import FEATURES, fit_design, training_rows
from tenure.models.forest import Tree, code_rows, fit_fold, score_fold
from tenure.operators import ranking
from tenure.operators.sampling import stratified_folds
from tenure.session import stage

N = 6000
INPUTS = ["x", "z", "flag", "plan"]


@pytest.fixture(scope="module")
def rows(spark):
    """Labels that follow from a number, a flag and a text; ``z`` is noise."""
    u = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000 for i in range(4)]
    df = spark.range(N).select(
        "id", F.floor(u[0] * 20).alias("x"), F.floor(u[1] * 9).cast("double").alias("z"), (u[2] < 0.3).alias("flag"),
        F.element_at(F.array(*[F.lit(p) for p in "abcdef"]), (F.col("id") % 6 + 1).cast("int")).alias("plan"), u[3].alias("u"),
    )
    chance = F.col("x") / 40 + F.col("flag").cast("int") * 0.3 + F.col("plan").isin("b", "e").cast("int") * 0.2
    return stage(df.withColumn("y", (F.col("u") < chance).cast("double")).drop("u"))


@pytest.fixture(scope="module")
def dealt(rows):
    return stage(stratified_folds(rows, "id", "y", 3, 1))


def taken(coded, fold, held_out=False):
    return list(forest._taken(iter(coded.blocks.toArrow().to_batches()), coded.layout, fold, held_out))


def by_key(parts):
    return {int(k): tuple(float(c[i]) for c in p.columns) + (i >= p.zeros,) for p in parts for i, k in enumerate(p.keys)}


@pytest.mark.parametrize("features", [["x"], ["plan"]])
def test_a_tree_without_a_bag_is_that_of_spark(dealt, features):
    coded = code_rows(dealt, features, "y", "id", 3)
    bins = np.array(coded.layout.bins(0))
    (own,), (out,) = taken(coded, 0), taken(coded, 0, held_out=True)
    tree = Tree(3)
    while tree.open:
        tree.draw(1, np.random.default_rng(0))
        tree.grow(tree.best(tree.count(own.columns, bins, np.arange(len(own.keys)), own.zeros).astype(np.int64), bins, coded.layout.categories))
    tree.prune()
    assert tree.splits
    rates = np.zeros(len(out.keys))
    tree.add_rates(out.columns, np.arange(len(rates)), rates)
    stages, _ = fit_design(dealt.where("fold <> 0"), features, one_hot=False)
    ready = PipelineModel(stages).transform(dealt)
    plain = RandomForestClassifier(featuresCol=FEATURES, labelCol="y", numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=3)
    found = plain.fit(ready.where("fold <> 0")).transform(ready.where("fold = 0"))
    expected = [r[0] for r in found.select(vector_to_array("probability")[1]).collect()]
    assert sorted(rates) == pytest.approx(sorted(expected), abs=1e-12)


def test_folds_do_not_depend_on_partitions_or_blocks(dealt, monkeypatch):
    scores = []
    for size, parts in ((forest.BLOCK_BYTES, 1), (400, 7)):
        monkeypatch.setattr(forest, "BLOCK_BYTES", size)
        coded = code_rows(stage(dealt.repartition(parts)), INPUTS, "y", "id", 3)
        assert coded.blocks.count() >= parts
        scored = score_fold(coded, 1, fit_fold(coded, 1, trees=6, depth=5), "y")
        scores.append(sorted(map(tuple, scored.collect())))
    assert scores[0] == scores[1] and len(scores[0]) == dealt.where("fold = 1").count()
    assert len({p for _, _, p in scores[0]}) > 20


def test_cross_validation_does_not_depend_on_partitions(rows):
    found = [
        sorted(map(tuple, classifiers.cross_validate(rows.repartition(parts), INPUTS, "y", "id", k=2, trees=5, depth=3).collect()))
        for parts in (1, 6)
    ]
    assert found[0] == found[1]


def test_only_keys_and_labels_are_dealt_to_folds(rows, monkeypatch):
    columns, run = [], classifiers.stratified_folds
    monkeypatch.setattr(classifiers, "stratified_folds", lambda df, *rest: columns.append(df.columns) or run(df, *rest))
    folds = classifiers.cross_validate(rows, INPUTS, "y", "id", k=2, trees=1, depth=1)
    assert columns == [["id", "y"]]
    assert folds.agg(F.sum("n")).first()[0] == N


def test_blocks_hold_every_row_once(dealt, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(forest, "TASK_BYTES", 9000)
    coded = code_rows(stage(dealt.repartition(4)), INPUTS, "y", "id", 3)
    own, out = taken(coded, 2), taken(coded, 2, held_out=True)
    assert len(own) > 1 and sum(len(p.keys) for p in own + out) == N and len(by_key(own + out)) == N
    assert sum(len(p.keys) for p in out) == dealt.where("fold = 2").count()
    seen = by_key(own + out)
    places = dealt.select(F.xxhash64("id", F.lit(1)).alias("place"), "x", "z", F.col("flag").cast("int").alias("flag"), "plan", "y").collect()
    for r in places:  # few values: every one has a bin of its own
        assert seen[r["place"] % 2**64] == (r["x"], r["z"], r["flag"], "abcdef".index(r["plan"]), r["y"] == 1)


def test_a_coded_row_is_small(dealt):
    """A pass reads a bit for a flag and a byte for a number, whatever the type of the column."""
    coded = code_rows(stage(dealt.repartition(1)), INPUTS, "y", "id", 3)
    n, bits, codes = coded.blocks.agg(F.sum("n"), F.sum(F.length("bits")), F.sum(F.length("codes"))).first()
    assert (n, bits, codes) == (N, N // 8, 3 * N)


def test_folds_may_cut_a_number_differently(spark, dealt):
    """A value that only one fold has begins no bin where that fold is held out."""
    rare = stage(dealt.withColumn("x", F.when(F.col("fold") == 2, F.col("x")).otherwise(F.col("x") % 2)))
    coded = code_rows(rare, ["x", "z"], "y", "id", 3)
    assert [coded.layout.bins(f)[0] for f in range(3)] == [20, 20, 2]
    assert {c.dtype.kind for p in taken(coded, 2) for c in p.columns[:1]} == {"b"}
    scored = score_fold(coded, 2, fit_fold(coded, 2, trees=3, depth=2), "y")
    assert scored.count() == rare.where("fold = 2").count()


def test_level_unknown_to_the_training_rows_is_scored(dealt):
    odd = stage(dealt.withColumn("plan", F.when((F.col("fold") == 0) & (F.col("id") % 12 == 0), "new").otherwise(F.col("plan"))))
    coded = code_rows(odd, ["plan"], "y", "id", 3)
    scored = score_fold(coded, 0, fit_fold(coded, 0, trees=5, depth=3), "y")
    assert scored.where("pred between 0 and 1").count() == odd.where("fold = 0").count()


def test_many_values_are_cut_evenly():
    cuts = forest._cuts(np.linspace(0, 1, forest.GRID + 1), forest.BINS)
    assert len(cuts) == forest.BINS - 1
    assert np.allclose(np.diff(cuts), 1 / forest.BINS, atol=2 / forest.GRID)
    assert forest._cuts(np.array([0.0, 0, 0, 1]), 32).tolist() == [0.5]
    assert forest._cuts(np.array([3.0, 3]), 32).tolist() == []
    heavy = forest._cuts(np.concatenate([np.zeros(1900), np.arange(1, 102)]), 32)
    assert heavy[0] == 0.5 and len(heavy) <= 31 and (np.diff(heavy) > 0).all()


def test_bags_are_poisson():
    keys = np.random.default_rng(5).integers(0, 1 << 63, 100_000, np.uint64)
    bags = [forest.Rows(40_000, keys, []).bag(np.uint64(f)) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    times = np.array([np.bincount(b, minlength=len(keys)) for b in bags])
    assert np.allclose(times.mean(axis=1), 1, atol=0.02) and np.allclose(times.var(axis=1), 1, atol=0.03)
    assert abs(np.corrcoef(times)[0, 1]) < 0.02
    for b in bags:  # class 0 first
        assert (np.diff((b >= 40_000).astype(int)) >= 0).all()


def test_leaves_that_vote_alike_are_one():
    tree = Tree(2)
    tree.splits = {1: (0, 0), 2: (0, 0), 3: (0, 0)}
    tree.counts = {1: (50, 30), 2: (40, 3), 3: (10, 27), 4: (30, 1), 5: (10, 2), 6: (9, 2), 7: (1, 25)}
    tree.prune()
    assert set(tree.splits) == {1, 3}


def test_no_rows_and_one_class(spark, dealt):
    for df, n in ((dealt.where("y = 0"), N), (dealt.where("id < 0"), 0)):
        some = stage(df)
        coded = code_rows(some, ["x", "flag"], "y", "id", 3)
        scored = score_fold(coded, 0, fit_fold(coded, 0, trees=2, depth=2), "y")
        assert scored.count() == some.where("fold = 0").count() <= n
        assert scored.where("pred <> 0").isEmpty()


def test_a_label_of_three_classes_is_refused(dealt):
    with pytest.raises(Exception, match="is not 0 or 1"):
        code_rows(dealt.withColumn("y", F.col("x") % 3), ["z"], "y", "id", 3)


def test_forest_ranks_like_the_one_of_spark(rows):
    folds = classifiers.cross_validate(rows, INPUTS, "y", "id", k=3, trees=30, depth=5).agg(F.avg("auc")).first()[0]
    model = classifiers.fit_forest(rows.where("id % 3 <> 0"), INPUTS, "y", trees=30, depth=5)
    plain = ranking.auc(classifiers.predict_classifier(model, rows.where("id % 3 = 0")), "pred", "y").first()["auc"]
    assert folds == pytest.approx(plain, abs=0.03) and folds > 0.7


def test_training_rows_miss_nothing(spark):
    df = spark.range(4).select(
        "id", F.when(F.col("id") == 1, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("x"),
        F.when(F.col("id") != 2, F.lit(3)).alias("n"), (F.col("id") > 1).alias("y"),
    )
    assert not df.schema["x"].nullable and not df.schema["y"].nullable
    assert sorted(r["id"] for r in training_rows(df, ["id", "x", "n"], "y").collect()) == [0, 3]
    assert training_rows(df, ["id"], "y").count() == 4


def test_filled_columns_are_not_asked_again(spark, monkeypatch):
    monkeypatch.setattr(design, "stage", lambda df: df)
    df = spark.range(4).select("id", F.coalesce(F.nullif("id", F.lit(2)), F.lit(0)).alias("filled"), F.nullif("id", F.lit(1)).alias("open"), (F.col("id") > 1).alias("y"))
    rows = training_rows(df, ["id", "filled", "open"], "y")
    asked = [line for line in rows._jdf.queryExecution().analyzed().toString().splitlines() if "atleastnnonnulls" in line.lower()]
    assert len(asked) == 1 and "open" in asked[0] and "filled" not in asked[0]
    assert sorted(r["id"] for r in rows.collect()) == [0, 2, 3]
